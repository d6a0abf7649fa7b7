"""Explicit schemas: landed inputs (read as text, never inferred) and tables."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

# Every typed OTLP value slot is read as text: numbers and number-like
# strings both arrive as text; arrays keep their JSON. Spans and records
# themselves are read from VARIANT by path (sources.otlp).
ANY_VALUE = T.StructType([
    T.StructField("stringValue", S), T.StructField("intValue", S), T.StructField("doubleValue", S),
    T.StructField("boolValue", S), T.StructField("arrayValue", S),
])
KEY_VALUE = T.StructType([T.StructField("key", S), T.StructField("value", ANY_VALUE)])
ATTRIBUTES = T.ArrayType(KEY_VALUE)

COMMIT_RECORD = T.StructType([
    T.StructField("commit_sha", S), T.StructField("session_id", S), T.StructField("issue_key", S),
    T.StructField("developer_email", S), T.StructField("subject", S),
    T.StructField("files_changed", S), T.StructField("insertions", S), T.StructField("deletions", S),
    T.StructField("committed_at", S),
])
PROMPT_SIGNAL_RECORD = T.StructType([
    T.StructField("session_id", S), T.StructField("issue_key", S), T.StructField("developer_email", S),
    T.StructField("intent", S), T.StructField("mentions_tests", S), T.StructField("prompt_length", S),
    T.StructField("ts", S),
])
TOOL_SIGNAL_RECORD = T.StructType([
    T.StructField("session_id", S), T.StructField("issue_key", S), T.StructField("developer_email", S),
    T.StructField("category", S), T.StructField("ts", S),
])
CI_PAYLOAD = T.StructType([
    T.StructField("commit_sha", S), T.StructField("check_name", S), T.StructField("status", S),
    T.StructField("url", S), T.StructField("started_at", S), T.StructField("completed_at", S),
])

TS = T.TimestampType()
COST = T.DecimalType(12, 6)
SECONDS = T.DecimalType(38, 6)

RAW_SPANS = T.StructType([
    T.StructField("span_id", S), T.StructField("parent_span_id", S), T.StructField("trace_id", S),
    T.StructField("session_id", S), T.StructField("prompt_id", S), T.StructField("issue_key", S),
    T.StructField("developer_id", S), T.StructField("span_name", S), T.StructField("span_kind", S),
    T.StructField("tool_name", S), T.StructField("start_ts", TS), T.StructField("end_ts", TS),
    T.StructField("duration_ms", T.DecimalType(38, 3)), T.StructField("cost_usd", COST),
    T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()),
    T.StructField("raw_payload", S),
])
RAW_EVENTS = T.StructType([
    T.StructField("event_id", S), T.StructField("session_id", S), T.StructField("prompt_id", S),
    T.StructField("issue_key", S), T.StructField("developer_id", S), T.StructField("event_name", S),
    T.StructField("ts", TS), T.StructField("tool_name", S), T.StructField("full_command", S),
    T.StructField("decision", S), T.StructField("success", T.BooleanType()), T.StructField("cost_usd", COST),
    T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()),
    T.StructField("raw_payload", S),
])
SESSION_ROLLUPS = T.StructType([
    T.StructField("session_id", S), T.StructField("issue_key", S), T.StructField("developer_id", S),
    T.StructField("active_time_sec", SECONDS), T.StructField("wait_time_sec", SECONDS),
    T.StructField("token_cost_usd", T.DecimalType(38, 6)), T.StructField("session_start", TS),
    T.StructField("session_end", TS), T.StructField("attribution_source", S),
])
ISSUES = T.StructType([
    T.StructField("issue_key", S), T.StructField("summary", S), T.StructField("status", S),
    T.StructField("story_points", T.DecimalType(38, 6)), T.StructField("issue_type", S),
    T.StructField("assignee_email", S),
])
GUARDRAIL_BLOCK_RECORD = T.StructType([
    T.StructField("block_id", S), T.StructField("session_id", S), T.StructField("issue_key", S),
    T.StructField("reason", S), T.StructField("blocked_at", S),
])
RATE_RECORD = T.StructType([T.StructField("team", S), T.StructField("hourly_rate_usd", S)])
GUARDRAIL_BLOCKS = T.StructType([
    T.StructField("block_id", S), T.StructField("session_id", S), T.StructField("issue_key", S),
    T.StructField("reason", S), T.StructField("blocked_at", TS),
])
GIT_COMMITS = T.StructType([
    T.StructField("commit_sha", S), T.StructField("session_id", S), T.StructField("issue_key", S),
    T.StructField("developer_id", S), T.StructField("subject", S), T.StructField("files_changed", T.IntegerType()),
    T.StructField("insertions", T.IntegerType()), T.StructField("deletions", T.IntegerType()),
    T.StructField("committed_at", TS), T.StructField("ingested_batch", T.LongType()),
])
PROMPT_SIGNALS = T.StructType([
    T.StructField("session_id", S), T.StructField("issue_key", S), T.StructField("developer_id", S),
    T.StructField("intent", S), T.StructField("mentions_tests", T.BooleanType()),
    T.StructField("prompt_length", T.IntegerType()), T.StructField("ts", TS),
])
TOOL_SIGNALS = T.StructType([
    T.StructField("session_id", S), T.StructField("issue_key", S), T.StructField("developer_id", S),
    T.StructField("category", S), T.StructField("ts", TS),
])
RATE_CONFIG = T.StructType([T.StructField("team", S), T.StructField("hourly_rate_usd", T.DecimalType(10, 2))])
QUARANTINE = T.StructType([
    T.StructField("source", S), T.StructField("reason", S), T.StructField("raw", S),
])
