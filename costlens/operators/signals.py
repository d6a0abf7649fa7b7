"""Privacy-safe signals derived from hook payloads and commit logs.

The raw prompt / command text is consumed by the classifying projection
and never appears in an output frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.functions import columns as C
from costlens.functions import rules


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _context(df: DataFrame) -> list[Column]:
    """Session / issue / developer from the wrapper context, falling back to
    the hook's own session id (P30)."""
    return [
        C.first_present(_opt(df, "wrapper_session_id"), _opt(df, "session_id")).alias("session_id"),
        C.blank_to_null(_opt(df, "wrapper_issue_key")).alias("issue_key"),
        C.blank_to_null(_opt(df, "developer_email")).alias("developer_email"),
    ]


def prompt_signals(payloads: DataFrame) -> DataFrame:
    """Prompt hook payloads (session_id, prompt, ts [, wrapper_* , developer_email])
    → (session_id, issue_key, developer_email, intent, mentions_tests,
    prompt_length, ts). Empty prompts give no row."""
    p = F.col("prompt")
    return payloads.filter(p.isNotNull() & (F.length(p) > 0)).select(
        *_context(payloads),
        C.prompt_intent(p).alias("intent"),
        C.mentions_tests(p).alias("mentions_tests"),
        C.utf16_length(p).alias("prompt_length"),
        F.col("ts"),
    )


def tool_signals(payloads: DataFrame) -> DataFrame:
    """Tool hook payloads (session_id, tool_name, command, ts [, ...]) →
    (session_id, issue_key, developer_email, category, ts); only non-empty
    Bash commands give a row."""
    cmd = F.col("command")
    return payloads.filter((F.col("tool_name") == "Bash") & cmd.isNotNull() & (F.length(cmd) > 0)).select(
        *_context(payloads),
        C.command_category(cmd).alias("category"),
        F.col("ts"),
    )


def commit_records(log: DataFrame) -> DataFrame:
    """Commit log (commit_sha, author_email, committed_at, body, shortstat
    [, subject]) → commit records; commits without a session trailer are
    not attributable and give no row."""
    body = F.col("body")
    subject = (F.col("subject") if "subject" in log.columns
               else F.regexp_replace(F.split(F.coalesce(body, F.lit("")), "\n\n").getItem(0), "\n", " "))
    session = C.trailer(body, rules.SESSION_TRAILER_PATTERN)
    return log.select(
        "commit_sha",
        session.alias("session_id"),
        C.trailer(body, rules.ISSUE_TRAILER_PATTERN).alias("issue_key"),
        F.col("author_email").alias("developer_email"),
        subject.alias("subject"),
        C.shortstat_part(F.col("shortstat"), rules.SHORTSTAT_FILES_PATTERN).alias("files_changed"),
        C.shortstat_part(F.col("shortstat"), rules.SHORTSTAT_INSERTIONS_PATTERN).alias("insertions"),
        C.shortstat_part(F.col("shortstat"), rules.SHORTSTAT_DELETIONS_PATTERN).alias("deletions"),
        F.col("committed_at"),
    ).filter(F.col("session_id").isNotNull())


def as_json_lines(df: DataFrame, order: str | None = None) -> DataFrame:
    """Rows as JSON lines (the landed form of signals and commit records). The
    generator keeps the optimizer from writing a line anew for every filter on it."""
    cols = [F.explode(F.array(F.to_json(F.struct(*[F.col(c) for c in df.columns if c != order])))).alias("value")]
    if order:
        cols.append(F.col(order).alias("seq"))
    return df.select(*cols)
