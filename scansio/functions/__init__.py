"""Column expressions: text cleaning and stress patterns."""
