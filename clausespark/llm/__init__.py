"""Operators for preparing training text, their queries and the corpus pipeline's building blocks."""
