"""Attribution suggestions and their review, stored.

``suggestions`` is a keyed table; ``review_log`` keeps every decision by the
batch that brought it. A decision counts if it is newer than the one its
suggestion holds (``decided_seq``), so decisions that come again, or late,
change nothing. A confirmed one pins its session's ticket in the stored
rollups, which later refreshes keep (``merge.pinned_upsert``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.operators import merge
from costlens.sinks.tables import TableStore

SUGGESTIONS = "suggestions"
SCHEMA = (
    "suggestion_id string, session_id string, suggested_issue_key string, confidence_score decimal(4,3), rationale string, "
    "signals_used string, model_version string, suggested_at timestamp, status string, reviewed_by string, "
    "reviewed_at timestamp, decided_seq long"
)


def _shaped(suggestions: DataFrame) -> DataFrame:
    columns = []
    for part in SCHEMA.split(", "):
        name, kind = part.split()
        default = F.lit("pending") if name == "status" else F.lit(None)
        columns.append((F.col(name) if name in suggestions.columns else default).cast(kind).alias(name))
    return suggestions.select(*columns)


def record(store: TableStore, suggestions: DataFrame, batch_id: int) -> None:
    """Insert-ignore of new suggestions on their id, as a batch of their own."""
    store.begin(batch_id)
    new = merge.first_wins(_shaped(suggestions), ["suggestion_id"], [F.col("suggested_at"), F.col("session_id"), F.col("suggested_issue_key")])
    store.upsert(SUGGESTIONS, new, ["suggestion_id"], batch_id, lambda old, rows: rows if old is None else old.unionByName(
        rows.join(old.select("suggestion_id"), "suggestion_id", "left_anti").select(*old.columns)))
    store.commit(batch_id)


def _newer(store: TableStore, decisions: DataFrame, batch_id: int) -> DataFrame | None:
    """The last decision of each known suggestion, if it is newer than the
    stored one; written once, as the batch's part of the log."""
    last = merge.last_wins(
        decisions.filter(F.col("status").isin("confirmed", "rejected")).select(
            "suggestion_id", "status", "reviewed_by", "decided_seq", "decided_at"),
        ["suggestion_id"], [F.col("decided_seq")])
    known = store.read_keyed(SUGGESTIONS, store.buckets_of(last, "suggestion_id"), batch_id)
    if known is None:
        return None
    held = known.select("suggestion_id", "session_id", "suggested_issue_key", F.col("decided_seq").alias("held_seq"))
    news = last.join(held, "suggestion_id").filter(F.col("held_seq").isNull() | (F.col("decided_seq") > F.col("held_seq")))
    store.write_batch("review_log", news.drop("held_seq"), batch_id)
    return store.read_batch("review_log", batch_id)


def _decided(old: DataFrame | None, news: DataFrame) -> DataFrame:
    d = news.select("suggestion_id", *[F.col(c).alias(f"d_{c}") for c in ("status", "reviewed_by", "decided_at", "decided_seq")])
    j = old.join(d, "suggestion_id", "left")
    changed = F.col("d_decided_seq").isNotNull()
    put = {"status": "d_status", "reviewed_by": "d_reviewed_by", "reviewed_at": "d_decided_at", "decided_seq": "d_decided_seq"}
    return j.select(*[F.when(changed, F.col(put[c])).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in old.columns])


def _pinned(old: DataFrame | None, pins: DataFrame) -> DataFrame:
    j = old.join(pins, "session_id", "left")
    put = {"issue_key": F.coalesce("pin_key", "issue_key"),
           "attribution_source": F.when(F.col("pin_key").isNotNull(), "ai_confirmed").otherwise(F.col("attribution_source"))}
    return j.select(*[put.get(c, F.col(c)).alias(c) for c in old.columns])


def decide(store: TableStore, decisions: DataFrame, batch_id: int) -> None:
    """Apply decisions (suggestion_id, status, reviewed_by, decided_seq,
    decided_at) as a batch of their own: suggestions that have one change, and
    the sessions of confirmed ones are pinned, the latest decision of a session
    winning. Buckets without either keep their files."""
    store.begin(batch_id)
    news = _newer(store, decisions, batch_id)
    if news is not None:
        store.upsert(SUGGESTIONS, news, ["suggestion_id"], batch_id, _decided)
        confirmed = news.filter(F.col("status") == "confirmed")
        pins = merge.last_wins(confirmed.select("session_id", "suggested_issue_key", "decided_seq", "suggestion_id"), ["session_id"],
                               [F.col("decided_seq"), F.col("suggestion_id")])
        pins = pins.select("session_id", F.col("suggested_issue_key").alias("pin_key"))
        buckets = store.buckets_of(pins, "session_id")
        old = store.read_rollups(buckets, batch_id)
        if old is not None:
            store.write_keyed("session_rollups", _pinned(old, pins), ["session_id"], batch_id, buckets)
    store.commit(batch_id)
