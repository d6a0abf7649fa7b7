"""Column-level functions (no Python UDFs)."""
