"""Sources: landed JSON lines, payload files and Parquet tables."""
