"""Column expressions: text, time and predicates."""
