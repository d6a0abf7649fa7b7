"""Flat JSON records: commit records, prompt/tool signals, CI and issue payloads.

Each parser takes a frame of lines (``value`` [, ``seq``]) and returns
``Parsed``: good rows, quarantine, identities and all of them in one frame.
Bad rows are kept with a reason instead of aborting the batch; blank lines are
skipped; every line is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens import schemas
from costlens.config import EngineConfig
from costlens.functions import columns as C
from costlens.functions import rules
from costlens.sources.otlp import CORRUPT, Parsed, _blank, _documents, _once, _reason, split


def _checked(rows: DataFrame, checks: list[tuple[str, Column]], drop: list[str]) -> DataFrame:
    """Rows with the first failing check as their ``_reason``."""
    return rows.withColumn("_reason", _reason(checks)).drop(*drop)


def _malformed() -> tuple[str, Column]:
    return "malformed_line", F.col("_malformed")


def _identity(email: Column) -> Column:
    return C.or_unattributed(email)


def _ts(raw: Column) -> Column:
    return C.blank_to_null(raw).try_cast("timestamp")


def _bad_ts(raw: Column) -> Column:
    return C.blank_to_null(raw).isNotNull() & raw.try_cast("timestamp").isNull()


def parse_commit_records(lines: DataFrame, cfg: EngineConfig) -> Parsed:
    docs = _documents(lines, schemas.COMMIT_RECORD)
    d = lambda f: F.col(f"doc.{f}")
    rows = docs.select(
        C.blank_to_null(d("commit_sha")).alias("commit_sha"),
        C.blank_to_null(d("session_id")).alias("session_id"),
        C.blank_to_null(d("issue_key")).alias("issue_key"),
        C.pseudonym(_identity(d("developer_email")), cfg.salt).alias("developer_id"),
        C.blank_to_null(d("subject")).alias("subject"),
        *[C.number_or_zero(d(f), "int").alias(f) for f in ("files_changed", "insertions", "deletions")],
        _ts(d("committed_at")).alias("committed_at"),
        F.col("seq").alias("_seq"),
        _identity(d("developer_email")).alias("raw_developer_id"),
        C.blank_to_null(d("developer_email")).alias("developer_email"),
        F.col("value").alias("_raw"),
        F.col(f"doc.{CORRUPT}").isNotNull().alias("_malformed"),
        (C.number_is_bad(d("files_changed"), "int") | C.number_is_bad(d("insertions"), "int")
         | C.number_is_bad(d("deletions"), "int")).alias("_bad_num"),
        _bad_ts(d("committed_at")).alias("_bad_ts"),
    )
    checks = [
        _malformed(),
        ("missing_commit_sha", F.col("commit_sha").isNull()),
        ("bad_number", F.col("_bad_num")),
        ("bad_time", F.col("_bad_ts")),
    ]
    return split(_checked(rows, checks, ["_malformed", "_bad_num", "_bad_ts"]), "git_commits")


def _signal_common(d, cfg: EngineConfig) -> list[Column]:
    return [
        C.blank_to_null(d("session_id")).alias("session_id"),
        C.blank_to_null(d("issue_key")).alias("issue_key"),
        C.pseudonym(_identity(d("developer_email")), cfg.salt).alias("developer_id"),
    ]


def parse_prompt_signals(lines: DataFrame, cfg: EngineConfig) -> Parsed:
    docs = _documents(lines, schemas.PROMPT_SIGNAL_RECORD)
    d = lambda f: F.col(f"doc.{f}")
    rows = docs.select(
        *_signal_common(d, cfg),
        C.blank_to_null(d("intent")).alias("intent"),
        C.truthy_flag(d("mentions_tests")).alias("mentions_tests"),
        C.number_or_zero(d("prompt_length"), "int").alias("prompt_length"),
        _ts(d("ts")).alias("ts"),
        F.col("seq").alias("_seq"),
        _identity(d("developer_email")).alias("raw_developer_id"),
        C.blank_to_null(d("developer_email")).alias("developer_email"),
        F.col("value").alias("_raw"),
        F.col(f"doc.{CORRUPT}").isNotNull().alias("_malformed"),
        C.number_is_bad(d("prompt_length"), "int").alias("_bad_num"),
        _bad_ts(d("ts")).alias("_bad_ts"),
    )
    checks = [_malformed(), ("bad_number", F.col("_bad_num")), ("bad_time", F.col("_bad_ts")), ("missing_time", F.col("ts").isNull())]
    return split(_checked(rows, checks, ["_malformed", "_bad_num", "_bad_ts"]), "prompt_signals")


def parse_tool_signals(lines: DataFrame, cfg: EngineConfig) -> Parsed:
    docs = _documents(lines, schemas.TOOL_SIGNAL_RECORD)
    d = lambda f: F.col(f"doc.{f}")
    rows = docs.select(
        *_signal_common(d, cfg),
        C.blank_to_null(d("category")).alias("category"),
        _ts(d("ts")).alias("ts"),
        F.col("seq").alias("_seq"),
        _identity(d("developer_email")).alias("raw_developer_id"),
        C.blank_to_null(d("developer_email")).alias("developer_email"),
        F.col("value").alias("_raw"),
        F.col(f"doc.{CORRUPT}").isNotNull().alias("_malformed"),
        _bad_ts(d("ts")).alias("_bad_ts"),
    )
    checks = [_malformed(), ("bad_time", F.col("_bad_ts")), ("missing_time", F.col("ts").isNull())]
    return split(_checked(rows, checks, ["_malformed", "_bad_ts"]), "tool_signals")


def parse_guardrail_blocks(lines: DataFrame) -> Parsed:
    """Guardrail blocks: a time is required; a block without an id gets one
    from the place of its line."""
    docs = _documents(lines, schemas.GUARDRAIL_BLOCK_RECORD)
    d = lambda f: F.col(f"doc.{f}")
    rows = docs.select(
        F.coalesce(C.blank_to_null(d("block_id")), C.surrogate_id(F.struct("seq"))).alias("block_id"),
        *[C.blank_to_null(d(f)).alias(f) for f in ("session_id", "issue_key", "reason")],
        _ts(d("blocked_at")).alias("blocked_at"),
        F.col("seq").alias("_seq"),
        F.col("value").alias("_raw"),
        F.col(f"doc.{CORRUPT}").isNotNull().alias("_malformed"),
        _bad_ts(d("blocked_at")).alias("_bad_ts"),
    )
    checks = [_malformed(), ("bad_time", F.col("_bad_ts")), ("missing_time", F.col("blocked_at").isNull())]
    return split(_checked(rows, checks, ["_malformed", "_bad_ts"]), "guardrail_blocks")


def parse_rates(lines: DataFrame) -> Parsed:
    """Hourly rates by team; a rate is required and may not be negative."""
    docs = _documents(lines, schemas.RATE_RECORD)
    rate = F.col("doc.hourly_rate_usd").try_cast("decimal(10,2)")
    rows = docs.select(
        C.blank_to_null(F.col("doc.team")).alias("team"),
        rate.alias("hourly_rate_usd"),
        F.col("seq").alias("_seq"),
        F.col("value").alias("_raw"),
        F.col(f"doc.{CORRUPT}").isNotNull().alias("_malformed"),
    )
    checks = [
        _malformed(),
        ("missing_team", F.col("team").isNull()),
        ("bad_rate", F.coalesce(F.col("hourly_rate_usd") < 0, F.lit(True))),
    ]
    return split(_checked(rows, checks, ["_malformed"]), "rates")


def parse_ci_payloads(lines: DataFrame) -> Parsed:
    """CI completion payloads → ci rows, rejects with reason."""
    docs = _documents(lines, schemas.CI_PAYLOAD)
    d = lambda f: F.col(f"doc.{f}")
    return split(_ci_rows(docs.select(
        "seq", F.col("value").alias("_raw"), F.col(f"doc.{CORRUPT}").isNotNull().alias("_malformed"),
        *[d(f).alias(f) for f in ("commit_sha", "check_name", "status", "url", "started_at", "completed_at")],
    )), "ci_runs")


def validate_ci(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules of CI payloads on a frame of them: (ci rows, rejects)."""
    parsed = split(_ci_rows(payloads), "ci_runs")
    return parsed.good, parsed.quarantine


def _ci_rows(payloads: DataFrame) -> DataFrame:
    """CI payload rules: commit sha required; status lower-cased and one of the
    accepted set; a missing check name is 'default'; empty optional fields are null."""
    raw = F.col("_raw") if "_raw" in payloads.columns else F.to_json(F.struct(*payloads.columns))
    seq = F.col("seq") if "seq" in payloads.columns else F.lit(None).cast("long")
    status = F.lower(F.col("status"))
    rows = payloads.select(
        C.blank_to_null(F.col("commit_sha")).alias("commit_sha"),
        F.coalesce(C.blank_to_null(F.col("check_name")), F.lit(rules.CI_DEFAULT_CHECK)).alias("check_name"),
        status.alias("status"),
        C.blank_to_null(F.col("url")).alias("url"),
        _ts(F.col("started_at")).alias("started_at"),
        _ts(F.col("completed_at")).alias("completed_at"),
        seq.alias("_seq"),
        raw.alias("_raw"),
        (F.col("_malformed") if "_malformed" in payloads.columns else F.lit(False)).alias("_malformed"),
        (_bad_ts(F.col("started_at")) | _bad_ts(F.col("completed_at"))).alias("_bad_ts"),
    )
    checks = [
        _malformed(),
        ("missing_commit_sha", F.col("commit_sha").isNull()),
        ("bad_status", ~F.coalesce(F.col("status").isin(*rules.CI_STATUSES), F.lit(False))),
        ("bad_time", F.col("_bad_ts")),
    ]
    return _checked(rows, checks, ["_malformed", "_bad_ts"])


def parse_issue_payloads(lines: DataFrame, cfg: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(issue rows, rejects) of ``parse_issues``."""
    parsed = parse_issues(lines, cfg)
    return parsed.good, parsed.quarantine


def parse_issues(lines: DataFrame, cfg: EngineConfig) -> Parsed:
    """Issue webhook bodies (``{"issue": {...}}``) or REST bodies (``{key, fields}``)
    → (issue rows, rejects). Story points count only when the field holds a
    JSON number."""
    v = F.col("doc")
    issue = F.coalesce(F.try_variant_get(v, "$.issue", "variant"), v)
    get = lambda path: F.try_variant_get(issue, path, "string")
    points = F.try_variant_get(issue, f"$.fields.{cfg.story_points_field}", "variant")
    kind = F.schema_of_variant(points)
    numeric = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    seq = F.col("seq") if "seq" in lines.columns else F.monotonically_increasing_id()
    docs = lines.filter(~_blank()).select("value", seq.alias("seq"), _once(F.try_parse_json("value")).alias("doc"))
    rows = docs.select(
        C.blank_to_null(get("$.key")).alias("issue_key"),
        C.blank_to_null(get("$.fields.summary")).alias("summary"),
        C.blank_to_null(get("$.fields.status.name")).alias("status"),
        F.when(numeric, F.try_variant_get(points, "$", "decimal(38,6)")).alias("story_points"),
        C.blank_to_null(get("$.fields.issuetype.name")).alias("issue_type"),
        C.blank_to_null(get("$.fields.assignee.emailAddress")).alias("assignee_email"),
        F.col("seq").alias("_seq"),
        F.col("value").alias("_raw"),
        v.isNull().alias("_malformed"),
    )
    checks = [_malformed(), ("missing_issue_key", F.col("issue_key").isNull())]
    return split(_checked(rows, checks, ["_malformed"]), "issues")
