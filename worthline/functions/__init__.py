"""Column expressions: no actions, no joins, usable inside any select or filter."""
