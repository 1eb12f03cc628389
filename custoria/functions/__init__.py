"""Column expressions and probability functions."""
