"""JSON-lines sink for derived signals and commit records (the landed form
that ``streaming.ingest`` reads back)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, folder: str, batch_id: int) -> None:
    """Write ``df`` as JSON lines under ``folder/batch=<id>``; rewriting the
    same batch replaces its files, so a replay does not duplicate lines."""
    lines = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
    lines.write.mode("overwrite").text(f"{folder.rstrip('/')}/batch={batch_id}")
