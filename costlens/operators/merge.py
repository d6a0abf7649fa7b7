"""Idempotent merge operators over DataFrames (plain Parquet has no MERGE).

Every operator is a function ``(target, batch, ...) → frame`` and never
uses ``row_number`` over a key: duplicates are resolved with a min/max of
a struct whose leading fields are the order key, which Spark evaluates as
a partial aggregation before the shuffle. A key holding a large share of
all copies therefore never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.config import UNATTRIBUTED
from costlens.functions import columns as C


def _pick(df: DataFrame, keys: list[str], order: list[Column], pick=F.min) -> DataFrame:
    """One row per key: the row whose ``order`` tuple is smallest (``F.min``)
    or largest (``F.max``). Columns keep their names and types."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(
        F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"),
        F.struct(*[F.col(c) for c in rest]).alias("r"),
    )
    g = df.groupBy(*keys).agg(pick(packed).alias("_w"))
    return g.select(*keys, *[F.col("_w.r")[c].alias(c) for c in rest])


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _pick(df, keys, order, F.min)


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _pick(df, keys, order, F.max)


def insert_ignore(target: DataFrame | None, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``batch`` to append: first occurrence per key, minus keys
    already in ``target`` (``ON CONFLICT DO NOTHING``)."""
    fresh = first_wins(batch, keys, order)
    if target is None:
        return fresh
    return fresh.join(target.select(*keys), keys, "left_anti")


# ---- raw tables ------------------------------------------------------------

SPAN_KEY = ["span_id"]


def spans_to_append(target: DataFrame | None, batch: DataFrame) -> DataFrame:
    """K1: insert-ignore on ``span_id``, first in file order wins."""
    return insert_ignore(target, batch, SPAN_KEY, [F.col("_seq")]).drop("_seq")


def _event_key(df: DataFrame) -> DataFrame:
    return df.withColumn("_tool_key", F.coalesce(F.col("tool_name"), F.lit("")))


EVENT_KEY = ["session_id", "event_name", "ts", "_tool_key"]


def events_to_append(target: DataFrame | None, batch: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """K2: insert-ignore on (session, event name, ts, tool name or '').
    Rows without a session are never duplicates of anything."""
    order = order or [F.col("_seq")]
    b = _event_key(batch)
    keyed = b.filter(F.col("session_id").isNotNull())
    loose = b.filter(F.col("session_id").isNull())
    t = None if target is None else _event_key(target.filter(F.col("session_id").isNotNull()))
    fresh = insert_ignore(t, keyed, EVENT_KEY, order)
    out = fresh.unionByName(loose.select(*fresh.columns))
    return out.drop("_tool_key", *[c for c in ("_seq",) if c in out.columns])


def upsert(target: DataFrame | None, batch: DataFrame, keys: list[str], keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Last-wins upsert; returns the whole new table.

    ``batch`` carries ``_seq`` (its order, e.g. file position); a batch row
    beats the target row and a later batch row beats an earlier one.
    ``keep_first`` columns keep the value of the earliest version of the
    key (e.g. the first ingest batch). One aggregation, no join."""
    payload = [c for c in batch.columns if c not in keys and c != "_seq"]
    seq_type = batch.schema["_seq"].dataType
    b = batch.select(*keys, *payload, F.lit(1).alias("_rank"), F.col("_seq"))
    if target is not None:
        t = target.select(*keys, *payload, F.lit(0).alias("_rank"), F.lit(None).cast(seq_type).alias("_seq"))
        b = t.unionByName(b)
    packed = F.struct(
        F.struct(F.col("_rank").alias("o0"), F.col("_seq").alias("o1")).alias("o"),
        F.struct(*[F.col(c) for c in payload]).alias("r"),
    )
    win = b.groupBy(*keys).agg(F.max(packed).alias("_w"), *[F.min(c).alias(f"_first_{c}") for c in keep_first])
    return win.select(
        *keys,
        *[(F.col(f"_first_{c}") if c in keep_first else F.col("_w.r")[c]).alias(c) for c in payload],
    )


def upsert_commits(target: DataFrame | None, batch: DataFrame, batch_id: int) -> DataFrame:
    """K3: git commits, last wins on ``commit_sha``; ``ingested_batch`` keeps
    the first batch that saw the commit."""
    b = batch.withColumn("ingested_batch", F.lit(batch_id).cast("long"))
    return upsert(target, b, ["commit_sha"], keep_first=("ingested_batch",))


def upsert_issues(target: DataFrame | None, batch: DataFrame, batch_id: int) -> DataFrame:
    """K7: issues, last wins on ``issue_key``; ``updated_batch`` is refreshed."""
    return upsert(target, batch.withColumn("updated_batch", F.lit(batch_id).cast("long")), ["issue_key"])


def upsert_ci_runs(target: DataFrame | None, batch: DataFrame, batch_id: int) -> DataFrame:
    """K8: CI runs, last wins on (commit sha, check name); ``ingested_batch`` refreshed."""
    b = batch.withColumn("ingested_batch", F.lit(batch_id).cast("long"))
    return upsert(target, b, ["commit_sha", "check_name"])


def developers_to_append(target: DataFrame | None, identity_frames: list[DataFrame], salt: str) -> DataFrame:
    """K4: pseudonym → identity rows, first seen wins, existing ids ignored.

    ``identity_frames`` are (seq, ri, raw_developer_id, developer_email)
    frames in processing order. Unattributed identities are skipped; the
    display name is kept only when there is no email."""
    per_source = []
    for rank, frame in enumerate(identity_frames):
        f = frame.filter(F.col("raw_developer_id").isNotNull() & (F.col("raw_developer_id") != UNATTRIBUTED))
        f = _first_places(f, ["raw_developer_id", "developer_email"]).select(
            C.pseudonym(F.col("raw_developer_id"), salt).alias("developer_id"),
            F.col("developer_email").alias("git_email"),
            F.when(F.col("developer_email").isNull(), F.col("raw_developer_id")).alias("display_name"),
            F.lit(rank).alias("_rank"),
            F.struct("seq", "ri").alias("_pos"),
        )
        per_source.append(first_wins(f, ["developer_id"], [F.col("_pos")]).drop("_pos"))
    allsrc = per_source[0]
    for f in per_source[1:]:
        allsrc = allsrc.unionByName(f)
    fresh = first_wins(allsrc, ["developer_id"], [F.col("_rank")]).drop("_rank")
    if target is not None:
        fresh = fresh.join(target.select("developer_id"), "developer_id", "left_anti")
    return fresh.select("developer_id", "git_email", "display_name")


def _first_places(df: DataFrame, keys: list[str]) -> DataFrame:
    """The places (seq, ri) of ``keys`` without those that another one of the
    same file and ``ri`` comes before: its least byte has a buffer of fixed width,
    so raw rows are reduced by a hash aggregation."""
    kind = df.schema["seq"].dataType
    if not (isinstance(kind, T.StructType) and kind.fieldNames() == ["file", "mark", "offset"]):
        return df
    least = F.when(F.count("seq.offset") == F.count(F.lit(1)), F.min("seq.offset"))  # null comes first
    firsts = df.groupBy(*keys, "ri", F.col("seq.file").alias("file"), F.col("seq.mark").alias("mark")).agg(least.alias("offset"))
    return firsts.select(*keys, F.struct("file", "mark", "offset").alias("seq"), "ri")


def duplicate_emails(developers: DataFrame) -> DataFrame:
    """Check frame: e-mails mapped to more than one pseudonym (reported, not fatal)."""
    return developers.filter(F.col("git_email").isNotNull()).groupBy("git_email").agg(
        F.count(F.lit(1)).alias("developer_ids")
    ).filter(F.col("developer_ids") > 1)


# ---- rollups -----------------------------------------------------------------

def pinned_upsert(target: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """K9: new session rollups replace old ones, except that a confirmed
    (``ai_confirmed``) ticket key stays; ``attribution_source`` is never
    recomputed. Both sides hold one row per session."""
    cols = [c for c in fresh.columns if c not in ("session_id", "attribution_source")]
    if target is None:
        return fresh.withColumn("attribution_source", F.lit("explicit"))
    t = target.select("session_id", *[F.col(c).alias(f"t_{c}") for c in cols], F.col("attribution_source").alias("t_src"))
    n = fresh.select("session_id", *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("n_present"))
    j = t.join(n, "session_id", "full_outer")
    has_new = F.coalesce(F.col("n_present"), F.lit(False))
    out = [F.col("session_id")]
    for c in cols:
        if c == "issue_key":
            val = F.when(has_new & (F.col("t_src") == "ai_confirmed"), F.col("t_issue_key")) \
                .when(has_new, F.col("n_issue_key")).otherwise(F.col("t_issue_key"))
        else:
            val = F.when(has_new, F.col(f"n_{c}")).otherwise(F.col(f"t_{c}"))
        out.append(val.alias(c))
    out.append(F.coalesce(F.col("t_src"), F.lit("explicit")).alias("attribution_source"))
    return j.select(*out)


def apply_reviews(rollups: DataFrame, suggestions: DataFrame, decisions: DataFrame, reviewed_at: Column | None = None):
    """C9: apply human review decisions to attribution suggestions.

    ``decisions``: (suggestion_id, status ∈ {confirmed, rejected},
    reviewed_by, decided_seq). The latest decision per suggestion counts;
    a confirmed suggestion pins its session to the suggested ticket
    (``attribution_source = ai_confirmed``). When several confirmed
    suggestions target one session, the latest decision wins.
    Returns (rollups, suggestions)."""
    reviewed_at = reviewed_at if reviewed_at is not None else F.current_timestamp()
    latest = last_wins(decisions.filter(F.col("status").isin("confirmed", "rejected")),
                       ["suggestion_id"], [F.col("decided_seq")])
    d = latest.select("suggestion_id", F.col("status").alias("d_status"), F.col("reviewed_by").alias("d_by"),
                      "decided_seq")
    s = suggestions.join(d, "suggestion_id", "left")
    decided = F.col("d_status").isNotNull()
    new_suggestions = s.select(
        *[F.when(decided, F.col("d_status")).otherwise(F.col("status")).alias("status") if c == "status"
          else F.when(decided, F.col("d_by")).otherwise(F.col("reviewed_by")).alias("reviewed_by") if c == "reviewed_by"
          else F.when(decided, reviewed_at).otherwise(F.col("reviewed_at")).alias("reviewed_at") if c == "reviewed_at"
          else F.col(c) for c in suggestions.columns]
    )
    confirmed = s.filter(F.col("d_status") == "confirmed").select("session_id", "suggested_issue_key", "decided_seq")
    pin = last_wins(confirmed, ["session_id"], [F.col("decided_seq")]).select(
        "session_id", F.col("suggested_issue_key").alias("pin_key"))
    r = rollups.join(pin, "session_id", "left")
    new_rollups = r.select(
        *[F.coalesce(F.col("pin_key"), F.col("issue_key")).alias("issue_key") if c == "issue_key"
          else F.when(F.col("pin_key").isNotNull(), F.lit("ai_confirmed")).otherwise(F.col("attribution_source"))
          .alias("attribution_source") if c == "attribution_source"
          else F.col(c) for c in rollups.columns]
    )
    return new_rollups, new_suggestions
