"""Operators: DataFrame in, DataFrame (or small fitted table) out."""
