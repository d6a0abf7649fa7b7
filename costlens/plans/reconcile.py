"""Tickets that telemetry names and the store does not know: a stored work list.

``open_work`` adds the keys that have come up since the watermark, each with a
state; ``close_work`` takes what a fetch brought. A key whose fetch failed is
marked and left behind, so that a key which never resolves is not asked for
again until new rows name it; when no fetch ran at all (no credentials, say)
the watermark stays and the same keys are listed next time. The watermark is
the newest batch that a closed list covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens import schemas
from costlens.config import EngineConfig
from costlens.operators import context, merge
from costlens.sinks.tables import TableStore
from costlens.sources import records

WORK, WATERMARK = "issue_work", "reconcile_watermark"
PENDING, FETCHED, FAILED = "pending", "fetched", "failed"


def watermark(store: TableStore) -> int:
    """The newest batch that a closed work list covers; -1 before the first."""
    row = store.read_keyed(WATERMARK)
    found = row.agg(F.max("upto").alias("upto")).first()["upto"] if row is not None else None
    return -1 if found is None else found


def _advance(store: TableStore, upto: int, batch_id: int) -> None:
    row = store.spark.createDataFrame([("issues", upto)], "name string, upto long")
    store.upsert(WATERMARK, row, ["name"], batch_id, lambda old, new: new)


def _since(store: TableStore, name: str, batches: list[int], schema) -> DataFrame:
    rows = store.read_batches(name, batches)
    return rows if rows is not None else store.spark.createDataFrame([], schema)


def open_work(store: TableStore, batch_id: int) -> DataFrame:
    """List the missing keys of all batches since the watermark, as a batch of
    its own, and return those to fetch (issue_key). With none, the watermark
    advances at once: there is nothing to come back for."""
    store.begin(batch_id)
    since = watermark(store)
    batches = [b for b in store.committed() if since < b < batch_id]
    commits = store.read_keyed("git_commits", before_batch=batch_id)
    commits = commits if commits is not None else store.spark.createDataFrame([], schemas.GIT_COMMITS)
    issues = store.read_keyed("issues", before_batch=batch_id)
    issues = issues if issues is not None else store.spark.createDataFrame([], schemas.ISSUES)
    missing = context.missing_issue_keys(
        _since(store, "raw_spans", batches, schemas.RAW_SPANS), _since(store, "raw_events", batches, schemas.RAW_EVENTS),
        commits.filter((F.col("ingested_batch") > since) & (F.col("ingested_batch") < batch_id)), issues)
    store.write_batch("issue_work_found", missing, batch_id)
    found = store.read_batch("issue_work_found", batch_id)
    if found is None:
        _advance(store, max(batches, default=since), batch_id)
        store.commit(batch_id)
        return store.spark.createDataFrame([], "issue_key string")
    rows = found.select("issue_key", F.lit(PENDING).alias("state"), F.lit(max(batches)).cast("long").alias("seen_batch"),
                        F.lit(0).alias("_seq"))
    store.upsert(WORK, rows, ["issue_key"], batch_id, lambda old, new: merge.upsert(old, new, ["issue_key"]))
    store.commit(batch_id)
    return found.select("issue_key")


def close_work(store: TableStore, fetched: DataFrame | None, batch_id: int, cfg: EngineConfig) -> None:
    """Take the fetch of the pending keys: ``fetched`` has a row (issue_key,
    value) for each that answered, ``value`` being the issue's JSON body. None
    says that no fetch ran, which changes nothing."""
    store.begin(batch_id)
    work = store.read_keyed(WORK, before_batch=batch_id)
    if fetched is not None and work is not None:
        pending = work.filter(F.col("state") == PENDING)
        answered = fetched.join(pending.select("issue_key"), "issue_key", "left_semi")
        bodies, _ = records.parse_issue_payloads(answered.select("value", F.col("issue_key").alias("seq")), cfg)
        # A body counts for the key that was asked for.
        good = bodies.filter(F.col("issue_key") == F.col("_seq"))
        store.upsert("issues", good, ["issue_key"], batch_id, lambda old, new: merge.upsert_issues(old, new, batch_id))
        known = good.select("issue_key").distinct().withColumn("got", F.lit(True))
        closed = pending.join(known, "issue_key", "left").select(
            "issue_key", F.when(F.col("got"), F.lit(FETCHED)).otherwise(F.lit(FAILED)).alias("state"), "seen_batch", F.lit(0).alias("_seq"))
        upto = pending.agg(F.max("seen_batch").alias("b")).first()["b"]
        store.upsert(WORK, closed, ["issue_key"], batch_id, lambda old, new: merge.upsert(old, new, ["issue_key"]))
        if upto is not None:
            _advance(store, max(upto, watermark(store)), batch_id)
    store.commit(batch_id)
