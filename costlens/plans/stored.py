"""Dashboard frames from a ``TableStore``.

What the panels count is added up once per batch, into two keyed tables that a
batch changes only where its rows lie; a dashboard never reads raw rows:

* ``daily_signals``: per day and label, how many prompts (and how many of
  them mention tests), tool calls and guardrail blocks;
* ``session_activity``: per session, prompts and code changes by ticket, the
  first passing test run, commit events by instant and the distinct traces.
  Late rows change past days through these: a test run that arrives late moves
  its session's first pass, and with it the days of the session's commits.

Both merge by sum, least instant and distinct key, so any split of the rows
into batches gives the same tables.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens import schemas
from costlens.config import EngineConfig
from costlens.functions import columns as C
from costlens.operators import economics, hygiene
from costlens.plans import panels
from costlens.sinks.tables import TableStore

DAILY, ACTIVITY = "daily_signals", "session_activity"
DAILY_KEY = ["day", "what", "label"]
ACTIVITY_KEY = ["session_id", "what", "issue_key", "at", "trace_id"]
DAILY_SCHEMA = "day timestamp, what string, label string, n long, n_tests long"
ACTIVITY_SCHEMA = (
    "session_id string, what string, issue_key string, at timestamp, trace_id string, n long, n_mutations long, first_at timestamp"
)
#: The rate that holds until a deployment sets its own.
DEFAULT_RATE = ("default", Decimal("75.00"))


def _shaped(df: DataFrame, schema: str, **present: Column) -> DataFrame:
    columns = [part.split() for part in schema.split(", ")]
    return df.select(*[(present[name] if name in present else F.lit(None)).cast(kind).alias(name) for name, kind in columns])


def _daily(prompts: DataFrame | None, tools: DataFrame | None, blocks: DataFrame | None) -> DataFrame | None:
    parts = []
    for rows, what, label, ts in (
        (prompts, "prompt", "intent", "ts"), (tools, "tool", "category", "ts"), (blocks, "block", "reason", "blocked_at"),
    ):
        if rows is not None:
            tests = F.col("mentions_tests") if what == "prompt" else F.lit(False)
            counted = rows.groupBy(C.day(F.col(ts)).alias("day"), F.col(label).alias("label")).agg(
                F.count(F.lit(1)).alias("n"), F.count_if(tests).alias("n_tests"))
            parts.append(_shaped(counted, DAILY_SCHEMA, what=F.lit(what), **{c: F.col(c) for c in ("day", "label", "n", "n_tests")}))
    return _union(parts)


def _activity(spans: DataFrame | None, events: DataFrame | None) -> DataFrame | None:
    parts = []
    if events is not None:
        turns = hygiene.turn_counts(events)
        commits = hygiene.commit_events(events).groupBy("session_id", "ts").agg(F.count(F.lit(1)).alias("n"))
        parts = [
            _shaped(turns, ACTIVITY_SCHEMA, session_id=F.col("session_id"), what=F.lit("turns"), issue_key=F.col("issue_key"),
                    n=F.col("prompt_count"), n_mutations=F.col("mutation_count")),
            _shaped(hygiene.first_passes(events), ACTIVITY_SCHEMA, session_id=F.col("session_id"), what=F.lit("pass"),
                    first_at=F.col("first_pass_ts")),
            _shaped(commits, ACTIVITY_SCHEMA, session_id=F.col("session_id"), what=F.lit("commit"), at=F.col("ts"), n=F.col("n")),
        ]
    if spans is not None:
        traces = spans.filter(F.col("session_id").isNotNull()).select("session_id", "issue_key", "trace_id").distinct()
        parts.append(_shaped(traces, ACTIVITY_SCHEMA, session_id=F.col("session_id"), what=F.lit("trace"),
                             issue_key=F.col("issue_key"), trace_id=F.col("trace_id")))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    united = parts[0] if parts else None
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def _merge_daily(old: DataFrame | None, new: DataFrame) -> DataFrame:
    both = new if old is None else old.unionByName(new)
    return both.groupBy(*DAILY_KEY).agg(F.sum("n").alias("n"), F.sum("n_tests").alias("n_tests"))


def _merge_activity(old: DataFrame | None, new: DataFrame) -> DataFrame:
    both = new if old is None else old.unionByName(new)
    return both.groupBy(*ACTIVITY_KEY).agg(
        F.sum("n").alias("n"), F.sum("n_mutations").alias("n_mutations"), F.min("first_at").alias("first_at"))


def add_partials(store: TableStore, batch_id: int) -> None:
    """Add the rows that a batch has written to the partials."""
    daily = _daily(*(store.read_batch(t, batch_id) for t in ("prompt_signals", "tool_signals", "guardrail_blocks")))
    if daily is not None:
        store.upsert(DAILY, daily, ["day"], batch_id, _merge_daily)
    activity = _activity(store.read_batch("raw_spans", batch_id), store.read_batch("raw_events", batch_id))
    if activity is not None:
        store.upsert(ACTIVITY, activity, ["session_id"], batch_id, _merge_activity)


# ---- what dashboards read -----------------------------------------------------

def _keyed(store: TableStore, name: str, schema) -> DataFrame:
    df = store.read_keyed(name)
    return df if df is not None else store.spark.createDataFrame([], schema)


def rates(store: TableStore) -> DataFrame:
    """The stored hourly rates; the default team's seeded one until it is set."""
    found = _keyed(store, "rates", schemas.RATE_CONFIG).select("team", "hourly_rate_usd")
    seed = store.spark.createDataFrame([DEFAULT_RATE], schemas.RATE_CONFIG)
    return found.unionByName(seed.join(found, "team", "left_anti"))


def guardrail_blocks(store: TableStore) -> DataFrame:
    return store.read_or_empty("guardrail_blocks", schemas.GUARDRAIL_BLOCKS)


def tickets(store: TableStore, cfg: EngineConfig) -> DataFrame:
    rollups = _keyed(store, "session_rollups", schemas.SESSION_ROLLUPS)
    return economics.ticket_rollup(rollups, _keyed(store, "issues", schemas.ISSUES), rates(store), cfg.team)


def testing_discipline_daily(store: TableStore) -> DataFrame:
    a = _keyed(store, ACTIVITY, ACTIVITY_SCHEMA)
    commits = a.filter(F.col("what") == "commit").select("session_id", F.col("at").alias("ts"), "n")
    passes = a.filter(F.col("what") == "pass").select("session_id", F.col("first_at").alias("first_pass_ts"))
    return hygiene.discipline_of_commits(commits, passes)


def prompt_thrash_by_session(store: TableStore) -> DataFrame:
    turns = _keyed(store, ACTIVITY, ACTIVITY_SCHEMA).filter(F.col("what") == "turns")
    return hygiene.thrash_ratios(turns.select(
        "session_id", "issue_key", F.col("n").alias("prompt_count"), F.col("n_mutations").alias("mutation_count")))


def subagent_fanout_by_session(store: TableStore) -> DataFrame:
    traces = _keyed(store, ACTIVITY, ACTIVITY_SCHEMA).filter(F.col("what") == "trace")
    counted = traces.groupBy("session_id", "issue_key").agg(F.count("trace_id").alias("traces"))
    return counted.filter("traces > 1").select("session_id", "issue_key", (F.col("traces") - 1).alias("subagent_trace_count"))


def _signals(store: TableStore, what: str, label: str, n: str) -> DataFrame:
    d = _keyed(store, DAILY, DAILY_SCHEMA).filter(F.col("what") == what)
    return d.select("day", F.col("label").alias(label), F.col("n").alias(n), F.col("n_tests").alias("mentions_tests_count"))


def prompt_intent_daily(store: TableStore) -> DataFrame:
    d = _signals(store, "prompt", "intent", "prompt_count")
    return d.withColumn("mentions_tests_pct", C.pct(F.col("mentions_tests_count"), F.col("prompt_count"), 1))


def tool_category_daily(store: TableStore) -> DataFrame:
    return _signals(store, "tool", "category", "tool_call_count").drop("mentions_tests_count")


def guardrail_blocks_daily(store: TableStore) -> DataFrame:
    return _signals(store, "block", "reason", "block_count").drop("mentions_tests_count")


def frames(store: TableStore, cfg: EngineConfig, start=None, end=None) -> dict[str, DataFrame]:
    """The 13 dashboard frames; ranked ones from the top, daily ones by day
    (and label)."""
    per_ticket = tickets(store, cfg)
    rollups = _keyed(store, "session_rollups", schemas.SESSION_ROLLUPS)
    intents = prompt_intent_daily(store)
    return {
        "p01_total_spend": panels.total_spend(per_ticket),
        "p02_tickets_tracked": panels.tickets_tracked(per_ticket),
        "p03_sessions_ingested": panels.sessions_ingested(rollups),
        "p04_commits_correlated": panels.commits_correlated(_keyed(store, "git_commits", schemas.GIT_COMMITS)),
        "p05_cost_leaderboard": panels.cost_leaderboard(per_ticket),
        "p06_time_split": panels.time_split(per_ticket),
        "p07_testing_discipline": panels.by_day(panels.testing_discipline(testing_discipline_daily(store), start, end)),
        "p08_prompt_thrash": panels.by_day(panels.thrash_by_day(prompt_thrash_by_session(store), rollups, start, end)),
        "p10_subagent_fanout": panels.by_day(panels.fanout_by_day(subagent_fanout_by_session(store), rollups, start, end)),
        "p11_guardrail_blocks": panels.by_day(panels.guardrail_blocks(guardrail_blocks_daily(store), start, end), "reason"),
        "p13_prompt_intent": panels.by_day(panels.prompt_intent(intents, start, end), "intent"),
        "p14_tool_category": panels.by_day(panels.tool_category(tool_category_daily(store), start, end), "category"),
        "p15_mentions_tests": panels.mentions_tests_pct(intents, start, end),
    }
