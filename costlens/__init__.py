"""costlens: session cost analytics on Spark.

Telemetry of AI-assisted coding sessions (OTLP spans and log records,
commit records, prompt/tool signals, issue and CI payloads) is parsed,
pseudonymised, merged idempotently into Parquet tables and rolled up into
per-session active/wait time and per-ticket cost, plus hygiene reports.
Everything is expressed as DataFrame plans; see README.md.
"""

from costlens.config import EngineConfig, configure_session

__all__ = ["EngineConfig", "configure_session"]
