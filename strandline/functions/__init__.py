"""Column expressions of the analytics engine."""
