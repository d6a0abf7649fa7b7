"""Structured Streaming ingest (file source + foreachBatch)."""
