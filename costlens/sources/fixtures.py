"""Adapters that derive the pipeline's inputs from the driver tables.

They stand in for landed telemetry in tests, the bench and the query
registry; each is a plain projection over a whole table, so its work
grows with the table. The DuckDB twins live in ``plans/oracle.py``.

events        → raw_events (typed), spans (typed), OTLP log/trace lines,
                guardrail blocks, command hook payloads
part          → issue payloads
conversations → prompt hook payloads
orders        → commit log and CI payloads
lineitem      → a large span set for the bench
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.config import UNATTRIBUTED

MICROS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts(c: str):
    """Driver tables store timestamp_ntz; the engine works in UTC timestamps."""
    return F.col(c).cast("timestamp")


def _user_keys(user):
    return (
        F.concat(F.lit("s"), user.cast("string")).alias("session_id"),
        F.when(user % 7 == 0, F.lit(UNATTRIBUTED))
        .otherwise(F.concat(F.lit("PROJ-"), (user % 97).cast("string"))).alias("issue_key"),
        F.concat(F.lit("d"), (user % 12).cast("string")).alias("developer_id"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    et, eid = F.col("event_type"), F.col("event_id")
    return e.select(
        eid.alias("event_id"),
        *_user_keys(F.col("user_id")),
        F.when(et == "click", "user_prompt").when(et == "view", "stop").when(et == "purchase", "api_request")
        .when(et == "error", "tool_result").otherwise("tool_decision").alias("event_name"),
        _ts("ts").alias("ts"),
        F.col("value").cast("decimal(12,6)").alias("cost_usd"),
        F.when(et == "error", F.when(eid % 3 == 0, "Bash").when(eid % 3 == 1, "Edit").otherwise("Write"))
        .alias("tool_name"),
        F.when((et == "error") & (eid % 3 == 0),
               F.when(eid % 4 == 0, "pytest -q").when(eid % 4 == 1, "git commit -m x")
               .when(eid % 4 == 2, "NPM TEST").otherwise("ls")).alias("full_command"),
        (eid % 2 == 0).alias("success"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a span. Users divisible by 5 run outside any session (a
    null one), which exercises the outer merge; each user has three traces."""
    e = table(spark, sf_dir, "events")
    et, user = F.col("event_type"), F.col("user_id")
    start = _ts("ts")
    end = F.timestamp_micros(F.unix_micros(start) + F.round(F.col("value") * 1000).cast("bigint") * 1000)
    session, *rest = _user_keys(user)
    return e.select(
        F.concat(F.lit("sp"), F.col("event_id").cast("string")).alias("span_id"),
        F.when(user % 5 != 0, session).alias("session_id"),
        *rest,
        F.concat(F.lit("t"), user.cast("string"), F.lit("-"), (F.col("event_id") % 3).cast("string")).alias("trace_id"),
        F.when(et == "error", "tool").when(et == "purchase", "llm_request").when(et == "signup", "other")
        .otherwise("interaction").alias("span_kind"),
        start.alias("start_ts"),
        end.alias("end_ts"),
    )


def spans_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as spans; (l_orderkey, l_linenumber) repeats, so span_id is not unique."""
    li = table(spark, sf_dir, "lineitem")
    base = F.unix_micros(_ts("l_shipdate")) + F.col("l_linenumber").cast("bigint") * 60 * MICROS
    ln = F.col("l_linenumber")
    return li.select(
        F.concat(F.lit("sp"), F.col("l_orderkey").cast("string"), F.lit("-"), ln.cast("string")).alias("span_id"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("session_id"),
        F.concat(F.lit("PROJ-"), (F.col("l_suppkey") % 20).cast("string")).alias("issue_key"),
        F.concat(F.lit("d"), (F.col("l_partkey") % 12).cast("string")).alias("developer_id"),
        F.concat(F.lit("t"), (F.col("l_suppkey") % 3).cast("string")).alias("trace_id"),
        F.when(ln % 3 == 0, "tool").when(ln % 3 == 1, "llm_request").otherwise("interaction").alias("span_kind"),
        F.timestamp_micros(base).alias("start_ts"),
        F.timestamp_micros(base + F.col("l_quantity").cast("bigint") * MICROS).alias("end_ts"),
    )


def issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part becomes a ticket keyed PROJ-<2·partkey>: even keys resolve,
    odd keys (and UNATTRIBUTED) stay without an issue row. Only the largest
    parts (size ≥ 49) have an assignee."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("PROJ-"), (F.col("p_partkey") * 2).cast("string")).alias("issue_key"),
        F.col("p_name").alias("summary"),
        F.col("p_type").alias("status"),
        F.col("p_size").cast("decimal(38,6)").alias("story_points"),
        F.col("p_brand").alias("issue_type"),
        _assignee().alias("assignee_email"),
    )


def _assignee():
    return F.when(F.col("p_size") >= 49,
                  F.concat(F.lit("u"), (F.col("p_partkey") % 12).cast("string"), F.lit("@x.io")))


def issue_payloads(spark: SparkSession, sf_dir: str, done_from_size: int | None = None) -> DataFrame:
    """Issue webhook bodies (``{"issue": {key, fields}}``) as JSON text. With
    ``done_from_size`` the tickets of parts at least that large are re-sent
    with status Done (a later webhook)."""
    p = table(spark, sf_dir, "part")
    status = F.col("p_type")
    if done_from_size is not None:
        p = p.filter(F.col("p_size") >= done_from_size)
        status = F.lit("Done")
    fields = F.struct(
        F.col("p_name").alias("summary"),
        F.struct(status.alias("name")).alias("status"),
        F.struct(F.col("p_brand").alias("name")).alias("issuetype"),
        F.when(_assignee().isNotNull(), F.struct(_assignee().alias("emailAddress"))).alias("assignee"),
        F.col("p_size").alias("customfield_10016"),
    )
    issue = F.struct(F.concat(F.lit("PROJ-"), (F.col("p_partkey") * 2).cast("string")).alias("key"), fields.alias("fields"))
    return p.select(F.to_json(F.struct(issue.alias("issue"))).alias("value"), F.col("p_partkey").alias("seq"))


def prompt_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as prompt-hook payloads; a keyword is prefixed because the
    corpus rarely contains one."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    k = (F.col("conv_id") + F.col("turn")) % 5
    prefix = F.when(k == 0, "fix ").when(k == 1, "add ").when(k == 2, "refactor ").when(k == 3, "test ").otherwise("")
    return c.select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.timestamp_micros(F.lit(1704067200 * MICROS) + F.col("conv_id") * 3600 * MICROS + F.col("turn") * 60 * MICROS)
        .alias("ts"),
        F.concat(prefix, F.col("text")).alias("prompt"),
    )


def command_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool-hook payloads from the tool_result events (all tools; the hook
    itself keeps only Bash)."""
    ev = raw_events(spark, sf_dir).filter(F.col("event_name") == "tool_result")
    return ev.select("session_id", "ts", "tool_name", F.col("full_command").alias("command"))


def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth commit has no trailer, every fourth no issue trailer."""
    o = table(spark, sf_dir, "orders")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    body = F.when(ok % 9 == 0, F.lit("plain subject")).otherwise(F.concat(
        F.lit("subject\n\nSession-Id: s"), (ck % 150).cast("string"),
        F.when(ok % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("\nJira-Issue: PROJ-"), (ck % 20).cast("string"))),
    ))
    return o.select(
        F.concat(F.lit("c"), ok.cast("string")).alias("commit_sha"),
        F.concat(F.lit("u"), (ck % 12).cast("string"), F.lit("@x.io")).alias("author_email"),
        _ts("o_orderdate").alias("committed_at"),
        body.alias("body"),
        F.concat(F.lit(" "), (ok % 7 + 1).cast("string"), F.lit(" files changed, "), (ok % 50).cast("string"),
                 F.lit(" insertions(+)")).alias("shortstat"),
    )


def ci_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'passed' must be rejected; a missing check name becomes 'default'."""
    o = table(spark, sf_dir, "orders")
    ok, st = F.col("o_orderkey"), F.col("o_orderstatus")
    return o.select(
        F.concat(F.lit("c"), ok.cast("string")).alias("commit_sha"),
        F.when(ok % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("unit-tests")).alias("check_name"),
        F.when(ok % 17 == 0, "passed").when(st == "F", "SUCCESS").when(st == "O", "failure").otherwise("pending")
        .alias("status"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("started_at"),
        F.lit(None).cast("string").alias("completed_at"),
    )


def guardrail_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return e.select(
        F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("block_id"),
        *_user_keys(F.col("user_id"))[:2],
        F.when(F.col("event_id") % 2 == 0, "budget_exceeded").otherwise("thrash_detected").alias("reason"),
        _ts("ts").alias("blocked_at"),
    )


def session_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session launches (launch_id, issue_flag, branch) from part: every
    fourth size carries an explicit ticket flag; branch names embed the
    brand number, upper case (a ticket key) or lower case (not a key)."""
    p = table(spark, sf_dir, "part")
    brand = F.regexp_replace(F.col("p_brand"), "Brand#", "BR-")
    branch = F.concat(F.lower(F.col("p_type")), F.lit("/"),
                      F.when(F.col("p_size") % 3 == 0, F.lower(brand)).otherwise(brand), F.lit("-"),
                      F.regexp_replace(F.col("p_name"), " ", "-"))
    return p.select(
        F.col("p_partkey").alias("launch_id"),
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("OPS-"), F.col("p_partkey").cast("string"))).alias("issue_flag"),
        branch.alias("branch"),
    )


def git_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Git identities (identity_id, git_email, git_name) from customer: some
    have no e-mail, some neither e-mail nor name."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("identity_id"),
        F.when(k % 3 != 0, F.concat(F.lit("u"), (k % 12).cast("string"), F.lit("@x.io"))).alias("git_email"),
        F.when(k % 5 != 0, F.col("c_name")).otherwise(F.lit("")).alias("git_name"),
    )


def rate_config(spark: SparkSession) -> DataFrame:
    from decimal import Decimal

    from costlens import schemas

    return spark.createDataFrame([("default", Decimal("75.00"))], schemas.RATE_CONFIG)


def as_raw(df: DataFrame, schema) -> DataFrame:
    """Adapter rows in the stored shape of a table (missing columns null)."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def as_landed(lines: DataFrame, kind: str, load: int = 1) -> DataFrame:
    """Lines (value, seq) as if they stood in one file of the landing folder:
    with the file, its mark and a place that follows ``seq``."""
    if isinstance(lines.schema["seq"].dataType, T.LongType):
        place = F.abs("seq")
    else:
        place = F.regexp_replace(F.col("seq").cast("string"), "[^0-9]", "").cast("long")
    return lines.select("value", F.lit(f"/landing/{kind}/load{load}.jsonl").alias("file"), F.lit(f"{kind}{load}").alias("mark"),
                        place.alias("offset"))


# ---- OTLP serialisation (round-trip fixtures) ---------------------------

def spread(rows: DataFrame) -> DataFrame:
    """Spread the rows to serialise like a directory of many landed files
    would be (a driver table is one small file, i.e. one scan task). By their
    hash, as dealing them out in turn sorts them first."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *rows.columns)


_SLOTS = ("stringValue", "intValue", "doubleValue", "boolValue", "arrayValue")


def _kv(key: str, value, slot: str = "stringValue"):
    slots = [(value if s == slot else F.lit(None)).cast("string").alias(s) for s in _SLOTS]
    return F.struct(F.lit(key).alias("key"), F.struct(*slots).alias("value"))


def _if_present(name: str, kv):
    """A list of ``kv``, or of nothing where the column is null."""
    one = F.array(kv)
    return F.when(F.col(name).isNotNull(), one).otherwise(F.slice(one, 1, 0))


def events_as_log_lines(spark: SparkSession, sf_dir: str, cfg, bad_cost_over: float | None = None,
                        rows: DataFrame | None = None) -> DataFrame:
    """The raw_events adapter (or some ``rows`` of it) written as OTLP log
    lines, one record per line. With ``bad_cost_over`` larger API costs are
    landed as text like ``$45.5``."""
    a = cfg.attributes
    ev = rows if rows is not None else raw_events(spark, sf_dir)
    cost_text = F.col("cost_usd").cast("double").cast("string")
    if bad_cost_over is not None:
        bad = (F.col("event_name") == "api_request") & (F.col("cost_usd") > F.lit(bad_cost_over))
        cost_text = F.when(bad, F.concat(F.lit("$"), cost_text)).otherwise(cost_text)
    nanos = (F.unix_micros(F.col("ts")) * 1000).cast("string")
    resource = F.struct(F.array(
        _kv(a.issue_key, F.col("issue_key")),
        _kv(a.developer_id, F.col("developer_id")),
        _kv(a.session_id, F.col("session_id")),
    ).alias("attributes"))
    parameters = F.to_json(F.struct(F.col("full_command").alias("full_command")))
    attrs = F.concat(
        F.array(_kv(a.event_name, F.col("event_name"))),
        _if_present("tool_name", _kv(a.tool_name, F.col("tool_name"))),
        _if_present("full_command", _kv(a.tool_parameters, parameters)),
        F.array(_kv(a.success, F.col("success").cast("string"), "boolValue"), _kv(a.cost_usd, cost_text, "doubleValue")),
    )
    record = F.struct(nanos.alias("timeUnixNano"), attrs.alias("attributes"))
    doc = F.struct(F.array(F.struct(
        resource.alias("resource"),
        F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"),
    )).alias("resourceLogs"))
    return spread(ev).select(F.to_json(doc).alias("value"), F.col("event_id").alias("seq"))


def spans_as_trace_lines(spark: SparkSession, sf_dir: str, cfg, rows: DataFrame | None = None) -> DataFrame:
    """The spans adapter (or some ``rows`` of it) written as OTLP trace lines."""
    a = cfg.attributes
    sp = rows if rows is not None else spans(spark, sf_dir)
    resource = F.struct(F.array(
        _kv(a.issue_key, F.col("issue_key")),
        _kv(a.developer_id, F.col("developer_id")),
    ).alias("attributes"))
    span = F.struct(
        F.col("span_id").alias("spanId"),
        F.col("trace_id").alias("traceId"),
        F.concat(F.lit("claude_code."), F.col("span_kind")).alias("name"),
        (F.unix_micros(F.col("start_ts")) * 1000).cast("string").alias("startTimeUnixNano"),
        (F.unix_micros(F.col("end_ts")) * 1000).cast("string").alias("endTimeUnixNano"),
        F.array(_kv(a.session_id, F.col("session_id"))).alias("attributes"),
    )
    doc = F.struct(F.array(F.struct(
        resource.alias("resource"),
        F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"),
    )).alias("resourceSpans"))
    return spread(sp).select(F.to_json(doc).alias("value"), F.col("span_id").alias("seq"))
