"""Compositions of operators into complete analyses."""
