"""Per-session rollups: wait time, active (developer) time and token cost.

wait    = Σ duration of tool / llm_request spans, with first start and last end
active  = Σ min(gap, ceiling) over stop → next user_prompt gaps
cost    = Σ cost_usd of api_request events

The work is split at fixed time slices (``bucket_seconds``, default 60 s):

1. ``session_slices`` summarises each (session, slice): wait and cost
   partials, the first and last stop/prompt event of the slice and the
   clamped gaps *inside* it (``lag`` per (session, slice)). A session
   holding a large share of all rows is spread over as many tasks as it
   has slices, and the window's shuffle also serves the slice aggregate.
2. ``rollups_from_slices`` reduces the slices of each session: partials
   are summed, and the gap *across* consecutive slices comes from a
   ``lag`` over slice summaries (one row per slice, not per event).

The slice table is also the incremental state: a new batch only
recomputes the slices it touches (``streaming.ingest``). The result equals
a full-session ``LAG``, with the three sides merged as the chained FULL
OUTER join does (tested against brute force and the DuckDB twin).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costlens.config import UNATTRIBUTED
from costlens.functions import columns as C

WAIT_KINDS = ("tool", "llm_request")
STOP, PROMPT, API_REQUEST = "stop", "user_prompt", "api_request"
KEY = ["session_id", "slice"]

# (column, type) of one slice summary besides the key
SLICE_COLUMNS = [
    ("wait_us", "bigint"), ("w_issue", "string"), ("w_dev", "string"),
    ("w_start", "timestamp"), ("w_end", "timestamp"),
    ("cost", "decimal(22,6)"),
    ("first_ts", "timestamp"), ("first_event", "string"), ("first_issue", "string"), ("first_dev", "string"),
    ("last_ts", "timestamp"), ("last_event", "string"),
    ("inner_us", "bigint"), ("inner_issue", "string"), ("inner_dev", "string"),
]


def slice_of(ts, bucket_seconds: int):
    """Slice number of a timestamp (monotonic in time; slices never span days
    when the width divides a day)."""
    return C.int_div(F.unix_micros(ts), bucket_seconds * C.MICROS)


def _shape(df: DataFrame, **present) -> DataFrame:
    cols = [F.col("session_id"), F.col("slice")]
    for name, typ in SLICE_COLUMNS:
        cols.append((present[name] if name in present else F.lit(None)).cast(typ).alias(name))
    return df.select(*cols)


def _turn_slices(events: DataFrame, ceiling_seconds: int, bucket_seconds: int) -> DataFrame:
    """First/last turn event and inner clamped gaps per (session, slice).

    Ties at the same instant order by event name (stop before user_prompt),
    so a zero gap is dropped by ``ts > prev_ts``."""
    turns = events.filter(F.col("event_name").isin(STOP, PROMPT) & F.col("session_id").isNotNull()).select(
        "session_id", "issue_key", "developer_id", "event_name", "ts", slice_of(F.col("ts"), bucket_seconds).alias("slice"),
    )
    w = Window.partitionBy(*KEY).orderBy("ts", "event_name", "issue_key", "developer_id")
    seq = turns.select(
        "*", F.lag("ts").over(w).alias("prev_ts"), F.lag("event_name").over(w).alias("prev_event"),
    )
    gap = (F.col("event_name") == PROMPT) & (F.col("prev_event") == STOP) & (F.col("ts") > F.col("prev_ts"))
    clamped = C.clamp_gap(C.duration_micros(F.col("prev_ts"), F.col("ts")), ceiling_seconds * C.MICROS)
    ev = F.struct("ts", "event_name", "issue_key", "developer_id")
    g = seq.groupBy(*KEY).agg(
        F.min(ev).alias("f"),
        F.max(ev).alias("l"),
        F.sum(F.when(gap, clamped)).alias("inner_us"),
        F.max(F.when(gap, F.col("issue_key"))).alias("inner_issue"),
        F.max(F.when(gap, F.col("developer_id"))).alias("inner_dev"),
    )
    return _shape(
        g, first_ts=F.col("f.ts"), first_event=F.col("f.event_name"), first_issue=F.col("f.issue_key"),
        first_dev=F.col("f.developer_id"), last_ts=F.col("l.ts"), last_event=F.col("l.event_name"),
        inner_us=F.col("inner_us"), inner_issue=F.col("inner_issue"), inner_dev=F.col("inner_dev"),
    )


_FIXED = [("w_issue", "string"), ("w_dev", "string"), ("wait_us", "bigint"), ("w_start", "timestamp"),
          ("w_end", "timestamp"), ("n_wait", "bigint"), ("cost", "decimal(22,6)"), ("n_cost", "bigint")]


def _fixed_groups(spans: DataFrame, events: DataFrame | None, bucket_seconds: int | None = None) -> DataFrame:
    """Wait and cost rows added up by session (and slice), ticket and developer.

    Sums and times have buffers of fixed width, so this step over raw rows
    is a hash aggregation; the greatest ticket and developer of a session,
    whose string buffers need a sorted one, are taken from its few groups."""
    def side(df: DataFrame, ts: str, **present) -> DataFrame:
        keys = [F.col("session_id")]
        if bucket_seconds is not None:
            keys.append(slice_of(F.col(ts), bucket_seconds).alias("slice"))
        return df.select(*keys, *[(present[n] if n in present else F.lit(None)).cast(t).alias(n) for n, t in _FIXED])

    wait = spans.filter(F.col("span_kind").isin(*WAIT_KINDS) & F.col("session_id").isNotNull())
    rows = side(wait, "start_ts", w_issue=F.col("issue_key"), w_dev=F.col("developer_id"),
                wait_us=C.duration_micros(F.col("start_ts"), F.col("end_ts")), w_start=F.col("start_ts"),
                w_end=F.col("end_ts"), n_wait=F.lit(1))
    if events is not None:
        cost = events.filter((F.col("event_name") == API_REQUEST) & F.col("session_id").isNotNull())
        rows = rows.unionByName(side(cost, "ts", cost=F.col("cost_usd"), n_cost=F.lit(1)))
    keys = ["session_id", "w_issue", "w_dev"] if bucket_seconds is None else [*KEY, "w_issue", "w_dev"]
    return rows.groupBy(*keys).agg(
        F.sum("wait_us").alias("wait_us"), F.min("w_start").alias("w_start"), F.max("w_end").alias("w_end"),
        F.sum("n_wait").alias("n_wait"), F.sum("cost").cast("decimal(22,6)").alias("cost"), F.sum("n_cost").alias("n_cost"),
    )


def session_slices(spans: DataFrame, events: DataFrame, ceiling_seconds: int = 900,
                   bucket_seconds: int = 60) -> DataFrame:
    """One summary row per (session, slice) with any wait, cost or turn input
    (the incremental state; recomputing a slice from its raw rows is
    idempotent)."""
    groups = _fixed_groups(spans, events, bucket_seconds)
    row_side = _shape(groups, **{c: F.col(c) for c in ("wait_us", "w_issue", "w_dev", "w_start", "w_end", "cost")})
    turn_side = _turn_slices(events, ceiling_seconds, bucket_seconds)
    merged = row_side.unionByName(turn_side)
    aggs = {"wait_us": F.sum, "w_issue": F.max, "w_dev": F.max, "w_start": F.min, "w_end": F.max, "cost": F.sum}
    # turn columns come from exactly one row per key (the turn side): max picks it
    return merged.groupBy(*KEY).agg(*[(aggs.get(name, F.max))(name).alias(name) for name, _ in SLICE_COLUMNS])


def _active_per_session(turn_slices: DataFrame, ceiling_seconds: int) -> DataFrame:
    """Active time per session from turn slices: inner gaps plus the gap
    across consecutive turn slices (a running ``last`` over the session's
    slices carries the previous slice's last turn event)."""
    w = Window.partitionBy("session_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    prev_end = F.struct(F.col("last_ts").alias("ts"), F.col("last_event").alias("event"))
    linked = turn_slices.withColumn("prev", F.last(prev_end, ignorenulls=True).over(w))
    cross = (F.col("first_event") == PROMPT) & (F.col("prev.event") == STOP) & (F.col("first_ts") > F.col("prev.ts"))
    cross_us = F.when(cross, C.clamp_gap(C.duration_micros(F.col("prev.ts"), F.col("first_ts")),
                                         ceiling_seconds * C.MICROS))
    g = linked.groupBy("session_id").agg(
        F.sum("inner_us").alias("inner_us"),
        F.sum(cross_us).alias("cross_us"),
        F.greatest(F.max("inner_issue"), F.max(F.when(cross, F.col("first_issue")))).alias("a_issue"),
        F.greatest(F.max("inner_dev"), F.max(F.when(cross, F.col("first_dev")))).alias("a_dev"),
        (F.count("inner_us") + F.count(cross_us)).alias("n_active"),
    )
    active = F.coalesce(F.col("inner_us"), F.lit(0)) + F.coalesce(F.col("cross_us"), F.lit(0))
    return g.filter(F.col("n_active") > 0).select("session_id", active.alias("active_us"), "a_issue", "a_dev")


_PART_COLUMNS = [
    ("wait_us", "bigint"), ("w_issue", "string"), ("w_dev", "string"), ("w_start", "timestamp"),
    ("w_end", "timestamp"), ("n_wait", "bigint"), ("cost", "decimal(22,6)"), ("n_cost", "bigint"),
    ("active_us", "bigint"), ("a_issue", "string"), ("a_dev", "string"), ("n_active", "bigint"),
]


def _part(df: DataFrame, **present) -> DataFrame:
    return df.select(F.col("session_id"), *[
        (present[n] if n in present else F.lit(None)).cast(t).alias(n) for n, t in _PART_COLUMNS])


def _combine(*parts: DataFrame) -> DataFrame:
    """Merge the wait, cost and active sides per session (each side holds at
    most one logical row per session, so this equals their FULL OUTER join)."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    agg = merged.groupBy("session_id").agg(
        F.sum("wait_us").alias("wait_us"), F.max("w_issue").alias("w_issue"), F.max("w_dev").alias("w_dev"),
        F.min("w_start").alias("session_start"), F.max("w_end").alias("session_end"),
        F.sum("n_wait").alias("n_wait"), F.sum("cost").alias("cost"), F.sum("n_cost").alias("n_cost"),
        F.sum("active_us").alias("active_us"), F.max("a_issue").alias("a_issue"), F.max("a_dev").alias("a_dev"),
        F.sum("n_active").alias("n_active"),
    )
    return _finish(agg)


def _finish(agg: DataFrame) -> DataFrame:
    """Final projection: COALESCE(wait, active, 'UNATTRIBUTED') keys, exact seconds."""
    return agg.select(
        "session_id",
        F.coalesce(F.when(F.col("n_wait") > 0, F.col("w_issue")), "a_issue", F.lit(UNATTRIBUTED)).alias("issue_key"),
        F.coalesce(F.when(F.col("n_wait") > 0, F.col("w_dev")), "a_dev", F.lit(UNATTRIBUTED)).alias("developer_id"),
        C.micros_to_seconds(F.coalesce("active_us", F.lit(0))).alias("active_time_sec"),
        C.micros_to_seconds(F.coalesce("wait_us", F.lit(0))).alias("wait_time_sec"),
        F.coalesce(F.col("cost"), F.lit(0)).cast("decimal(38,6)").alias("token_cost_usd"),
        "session_start",
        "session_end",
    )


def rollups_from_slices(slices: DataFrame, ceiling_seconds: int = 900) -> DataFrame:
    """Reduce stored slice summaries to one row per session (the C2 output).

    One pass: a window over each session's slices carries the last turn
    event of the previous turn slice (a running ``last`` that skips slices
    without turns), and the per-session aggregate runs on the same
    partitioning. A session has at most one slice per minute of activity."""
    w = Window.partitionBy("session_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    turn_end = F.when(F.col("first_ts").isNotNull(),
                      F.struct(F.col("last_ts").alias("ts"), F.col("last_event").alias("event")))
    linked = slices.withColumn("prev", F.last(turn_end, ignorenulls=True).over(w))
    cross = (F.col("first_event") == PROMPT) & (F.col("prev.event") == STOP) & (F.col("first_ts") > F.col("prev.ts"))
    cross_us = F.when(cross, C.clamp_gap(C.duration_micros(F.col("prev.ts"), F.col("first_ts")),
                                         ceiling_seconds * C.MICROS))
    active_n = F.count("inner_us") + F.count(cross_us)
    g = linked.groupBy("session_id").agg(
        F.sum("wait_us").alias("wait_us"), F.max("w_issue").alias("w_issue"), F.max("w_dev").alias("w_dev"),
        F.min("w_start").alias("session_start"), F.max("w_end").alias("session_end"),
        F.count("wait_us").alias("n_wait"), F.sum("cost").alias("cost"), F.count("cost").alias("n_cost"),
        (F.coalesce(F.sum("inner_us"), F.lit(0)) + F.coalesce(F.sum(cross_us), F.lit(0))).alias("active_us"),
        F.greatest(F.max("inner_issue"), F.max(F.when(cross, F.col("first_issue")))).alias("a_issue"),
        F.greatest(F.max("inner_dev"), F.max(F.when(cross, F.col("first_dev")))).alias("a_dev"),
        active_n.alias("n_active"),
    ).filter((F.col("n_wait") > 0) | (F.col("n_cost") > 0) | (F.col("n_active") > 0))
    return _finish(g)


def session_rollups(spans: DataFrame, events: DataFrame | None, ceiling_seconds: int = 900,
                    bucket_seconds: int = 60) -> DataFrame:
    """One row per session with any wait, active or cost input.

    Output: session_id, issue_key, developer_id, active_time_sec,
    wait_time_sec, token_cost_usd (decimal(38,6)), session_start, session_end.
    Wait and cost rows are first added up by hash aggregation
    (``_fixed_groups``); only turn events go through slices.
    """
    groups = _fixed_groups(spans, events)
    row_part = _part(groups, **{n: F.col(n) for n, _ in _FIXED})
    if events is None:  # spans only (e.g. trace-only telemetry)
        return _combine(row_part)
    active = _active_per_session(_turn_slices(events, ceiling_seconds, bucket_seconds), ceiling_seconds)
    active_part = _part(active, active_us=F.col("active_us"), a_issue=F.col("a_issue"), a_dev=F.col("a_dev"),
                        n_active=F.lit(1))
    return _combine(row_part, active_part)
