"""Sinks: Parquet tables with replay-safe write modes."""
