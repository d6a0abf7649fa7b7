"""Composite plans: dashboard frames, incremental refresh, query registry."""
