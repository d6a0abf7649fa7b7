"""Work-item context: ticket/identity resolution, missing-ticket discovery and
the documented joins between commits, CI runs, signals and sessions.

Every join here is an equi-join between frames that are first reduced to
one row per join key where the other side is many-per-key, so no join
multiplies rows and no key's group is materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.config import UNATTRIBUTED
from costlens.functions import columns as C


def resolve_issue_key(sessions: DataFrame, flag: str = "issue_flag", branch: str = "branch") -> DataFrame:
    """P20: ticket key from an explicit flag, else the first key-shaped token of
    the branch name, else UNATTRIBUTED; with the source of the decision."""
    from_flag = C.blank_to_null(F.col(flag))
    from_branch = C.issue_key_from_branch(F.col(branch))
    return sessions.withColumn("issue_key", F.coalesce(from_flag, from_branch, F.lit(UNATTRIBUTED))).withColumn(
        "issue_key_source",
        F.when(from_flag.isNotNull(), "flag").when(from_branch.isNotNull(), "git-branch").otherwise("fallback"),
    )


def resolve_developer(identities: DataFrame, email: str = "git_email", name: str = "git_name") -> DataFrame:
    """P21: developer identity from the git e-mail, else the git name, else
    UNATTRIBUTED; with the source and whether it is an e-mail."""
    e, n = C.blank_to_null(F.col(email)), C.blank_to_null(F.col(name))
    return identities.withColumn("raw_developer_id", F.coalesce(e, n, F.lit(UNATTRIBUTED))).withColumn(
        "is_email", e.isNotNull()
    ).withColumn("developer_source", F.when(e.isNotNull(), "git-email").when(n.isNotNull(), "git-name").otherwise("fallback"))


def _attributed_keys(df: DataFrame, since_col: str | None, since) -> DataFrame:
    keys = df.filter(F.col("issue_key").isNotNull() & (F.col("issue_key") != UNATTRIBUTED))
    if since is not None and since_col is not None:
        keys = keys.filter(F.col(since_col) > F.lit(since))
    return keys.select("issue_key")


def missing_issue_keys(spans: DataFrame, events: DataFrame, commits: DataFrame, issues: DataFrame,
                       since=None, since_col: str | None = None) -> DataFrame:
    """C8: ticket keys seen in spans, events or commits (since a watermark
    when given) that have no issue row yet — the fetch work list."""
    seen = (
        _attributed_keys(spans, since_col, since)
        .union(_attributed_keys(events, since_col, since))
        .union(_attributed_keys(commits, since_col, since))
        .distinct()
    )
    return seen.join(issues.select("issue_key"), "issue_key", "left_anti")


def unattributed_sessions(rollups: DataFrame) -> DataFrame:
    """F8: sessions costed without a ticket — the follow-up list."""
    return rollups.filter(F.col("issue_key") == UNATTRIBUTED).select("session_id", "developer_id", "token_cost_usd")


def touched_sessions(*frames: DataFrame) -> DataFrame:
    """U1: distinct non-null session ids of new rows."""
    out = None
    for f in frames:
        s = f.filter(F.col("session_id").isNotNull()).select("session_id")
        out = s if out is None else out.union(s)
    return out.distinct()


def commits_by_ticket(commits: DataFrame, rollups: DataFrame) -> DataFrame:
    """J9: commits joined to their session's ticket; per ticket totals."""
    j = commits.join(rollups.select("session_id", F.col("issue_key").alias("ticket")), "session_id", "inner")
    return j.groupBy(F.col("ticket").alias("issue_key")).agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.sum("files_changed").cast("bigint").alias("files_changed"),
        F.sum("insertions").cast("bigint").alias("insertions"),
        F.sum("deletions").cast("bigint").alias("deletions"),
    )


def ci_outcomes_by_ticket(ci_runs: DataFrame, commits: DataFrame, rollups: DataFrame) -> DataFrame:
    """J10: CI runs → commit → session → ticket; runs per ticket and status."""
    c = commits.select("commit_sha", "session_id").join(
        rollups.select("session_id", F.col("issue_key").alias("ticket")), "session_id", "inner")
    j = ci_runs.select("commit_sha", "status").join(c.select("commit_sha", "ticket"), "commit_sha", "inner")
    return j.groupBy(F.col("ticket").alias("issue_key"), "status").agg(F.count(F.lit(1)).alias("run_count"))


def session_signal_mix(rollups: DataFrame, prompt_signals: DataFrame, tool_signals: DataFrame) -> DataFrame:
    """J11: per session of the rollups, prompt and tool-call signal counts.
    Each signal side is reduced per session before the join."""
    p = prompt_signals.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("prompt_signals"),
        F.count_if(F.col("mentions_tests")).alias("test_prompts"),
    )
    t = tool_signals.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("tool_calls"),
        F.count_if(F.col("category") == "test").alias("test_runs"),
    )
    j = rollups.select("session_id", "issue_key").join(p, "session_id", "left").join(t, "session_id", "left")
    return j.select(
        "session_id", "issue_key",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("prompt_signals", "test_prompts", "tool_calls", "test_runs")],
    )


def single_candidate_suggestions(rollups: DataFrame, identity_map: DataFrame, issues: DataFrame,
                                 active_statuses: list[str]) -> DataFrame:
    """J12: for unattributed sessions, the developer's only open ticket.

    ``identity_map`` (developer_id, assignee_email) is an explicit mapping;
    e-mail equality between systems is not assumed. A developer may have
    several addresses: tickets are counted over all of them, and a ticket
    that several of them reach counts once. Counts are partial aggregates
    (lowest and highest key), so a developer with many tickets costs one row
    per map task."""
    open_issues = issues.filter(F.col("status").isin(*active_statuses) & F.col("assignee_email").isNotNull())
    one_open = (
        identity_map.select("developer_id", "assignee_email").distinct()
        .join(open_issues.select("assignee_email", "issue_key"), "assignee_email", "inner")
        .groupBy("developer_id").agg(F.min("issue_key").alias("only_key"), F.max("issue_key").alias("last_key"))
        .filter(F.col("only_key") == F.col("last_key"))
    )
    s = rollups.filter(F.col("issue_key") == UNATTRIBUTED).select("session_id", "developer_id")
    return s.join(one_open, "developer_id", "inner").select(
        "session_id", "developer_id", F.col("only_key").alias("suggested_issue_key")
    )
