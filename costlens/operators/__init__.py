"""Relational operators of the pipeline (DataFrame → DataFrame)."""
