"""Column expressions: bits, rounding, decimal digits."""
