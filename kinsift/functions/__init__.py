"""Column expressions and name or title variants."""
