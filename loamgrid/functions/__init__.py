"""Column expressions and string scorers."""
