"""Operators for large training-data corpora, their queries and SQL twins."""
