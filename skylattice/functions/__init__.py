"""Column expressions: geometry, text, pixels, predicates."""
