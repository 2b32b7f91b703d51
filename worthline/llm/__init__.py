"""Operators for building training text: licences, quality, tokens, personal data, neighbours, mixing, copies."""
