"""Column expressions and texts."""
