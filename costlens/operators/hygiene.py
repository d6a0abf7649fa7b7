"""Team-level hygiene reports (testing discipline, thrash, fan-out, guardrails,
prompt intent, tool categories). All are partial-aggregation friendly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions import columns as C


def test_run_events(events: DataFrame) -> DataFrame:
    """Bash tool results whose command runs a known test runner."""
    return events.filter(
        (F.col("event_name") == "tool_result") & (F.col("tool_name") == "Bash") & C.is_test_run(F.col("full_command"))
    )


def commit_events(events: DataFrame) -> DataFrame:
    """Bash tool results whose command starts with ``git commit``."""
    return events.filter(
        (F.col("event_name") == "tool_result") & (F.col("tool_name") == "Bash")
        & C.is_commit_command(F.col("full_command"))
    )


def commits_with_prior_pass(events: DataFrame) -> DataFrame:
    """Commit events flagged when a passing test ran earlier in the session.

    "Exists an earlier passing test" equals "the session's first passing
    test is earlier", so the correlated EXISTS becomes one per-session
    ``min`` joined back on the session key (a skewed session is split by
    AQE's skew-join handling; the min side has one row per session)."""
    commits = commit_events(events).select("session_id", "ts")
    return commits.join(first_passes(events), "session_id", "left").select(
        "session_id", "ts", F.coalesce(F.col("first_pass_ts") < F.col("ts"), F.lit(False)).alias("preceded")
    )


def first_passes(events: DataFrame) -> DataFrame:
    """A session's first passing test run."""
    passes = test_run_events(events).filter(F.col("success") == F.lit(True))
    return passes.groupBy("session_id").agg(F.min("ts").alias("first_pass_ts"))


def discipline_of_commits(commits: DataFrame, passes: DataFrame) -> DataFrame:
    """The daily report from commit events added up by session and instant
    (session_id, ts, n) and each session's first pass."""
    flagged = commits.join(passes, "session_id", "left")
    preceded = F.coalesce(F.col("first_pass_ts") < F.col("ts"), F.lit(False))
    daily = flagged.groupBy(C.day(F.col("ts")).alias("day")).agg(
        F.sum("n").alias("commit_count"),
        F.sum(F.when(preceded, F.col("n")).otherwise(0)).alias("commits_with_prior_passing_test"),
    )
    return daily.withColumn(
        "testing_discipline_pct", C.pct(F.col("commits_with_prior_passing_test"), F.col("commit_count"), 1)
    )


def testing_discipline_daily(events: DataFrame) -> DataFrame:
    flagged = commits_with_prior_pass(events)
    return flagged.groupBy(C.day(F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.count_if(F.col("preceded")).alias("commits_with_prior_passing_test"),
    ).withColumn(
        "testing_discipline_pct", C.pct(F.col("commits_with_prior_passing_test"), F.col("commit_count"), 1)
    )


def prompt_thrash_by_session(events: DataFrame) -> DataFrame:
    """Prompts per code-mutating tool call, per (session, issue); the
    null-session group is kept as its own row."""
    return thrash_ratios(turn_counts(events))


def turn_counts(events: DataFrame) -> DataFrame:
    """Prompts and code-mutating tool calls per (session, issue): sums of any
    split of the events add up."""
    is_prompt = F.col("event_name") == "user_prompt"
    is_mutation = (F.col("event_name") == "tool_result") & F.col("tool_name").isin("Edit", "Write")
    return events.groupBy("session_id", "issue_key").agg(
        F.count_if(is_prompt).alias("prompt_count"),
        F.count_if(F.coalesce(is_mutation, F.lit(False))).alias("mutation_count"),
    )


def thrash_ratios(counts: DataFrame) -> DataFrame:
    return counts.withColumn("thrash_ratio", C.ratio_at_least_one(F.col("prompt_count"), F.col("mutation_count"), 2))


def subagent_fanout_by_session(spans: DataFrame) -> DataFrame:
    """Distinct traces beyond the first, for sessions with more than one."""
    g = spans.filter(F.col("session_id").isNotNull()).groupBy("session_id", "issue_key").agg(
        F.countDistinct("trace_id").alias("traces")
    )
    return g.filter(F.col("traces") > 1).select(
        "session_id", "issue_key", (F.col("traces") - 1).alias("subagent_trace_count")
    )


def guardrail_blocks_daily(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(C.day(F.col("blocked_at")).alias("day"), "reason").agg(F.count(F.lit(1)).alias("block_count"))


def prompt_intent_daily(prompt_signals: DataFrame) -> DataFrame:
    g = prompt_signals.groupBy(C.day(F.col("ts")).alias("day"), "intent").agg(
        F.count(F.lit(1)).alias("prompt_count"),
        F.count_if(F.col("mentions_tests")).alias("mentions_tests_count"),
    )
    return g.withColumn("mentions_tests_pct", C.pct(F.col("mentions_tests_count"), F.col("prompt_count"), 1))


def tool_category_daily(tool_signals: DataFrame) -> DataFrame:
    return tool_signals.groupBy(C.day(F.col("ts")).alias("day"), "category").agg(
        F.count(F.lit(1)).alias("tool_call_count")
    )
