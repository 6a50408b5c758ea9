"""Column functions: numbers, text, dates."""
