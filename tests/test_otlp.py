"""OTLP line parsing: edge cases of the landed shapes."""

import json

from costlens.sources import otlp


def kv(k, v, slot="stringValue"):
    return {"key": k, "value": {slot: v}}


def log_line(records, resource=None):
    res = {"attributes": resource} if resource is not None else None
    return json.dumps({"resourceLogs": [{"resource": res, "scopeLogs": [{"logRecords": records}]}]})


def span_line(spans, resource=None):
    return json.dumps({"resourceSpans": [{"resource": {"attributes": resource or []}, "scopeSpans": [{"spans": spans}]}]})


def lines_df(spark, lines):
    return spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, seq long")


RES = [kv("jira.issue_key", "PROJ-1"), kv("developer.id", "dev@x.io"), kv("session.id", "s-res")]


def test_logs_edge_cases(spark, cfg):
    good_rec = {"timeUnixNano": "1704067200000000000", "attributes": [kv("event.name", "user_prompt"), kv("session.id", "s1")]}
    lines = [
        log_line([good_rec], RES),
        "",                       # blank: skipped
        "   ",                    # whitespace only: skipped
        '{"resourceLogs": [',     # truncated: quarantined
        "not json",               # malformed
        log_line([{"timeUnixNano": "0", "attributes": []}], RES),       # zero time: no row
        log_line([{"timeUnixNano": "12ab", "attributes": []}], RES),    # bad time: quarantine
        log_line([{"timeUnixNano": "1704067200000000000", "body": {"stringValue": "stop"},
                   "attributes": [kv("cost_usd", "abc")]}], RES),       # bad cost: quarantine
        log_line([{"timeUnixNano": "1704067201000000000", "body": {"stringValue": "stop"},
                   "attributes": [kv("input_tokens", 7, "intValue"), kv("input_tokens", "9", "intValue"),
                                  kv("success", True, "boolValue"), kv("tool_name", "")]}], None),  # no resource
    ]
    parsed = otlp.parse_logs(lines_df(spark, lines), cfg)
    good = sorted(parsed.good.collect(), key=lambda r: r["ts"])
    assert len(good) == 2
    first, second = good
    assert first["event_name"] == "user_prompt" and first["session_id"] == "s1" and first["issue_key"] == "PROJ-1"
    assert first["success"] is False and first["cost_usd"] == 0
    assert len(first["developer_id"]) == 16
    # body fallback, duplicate key (later wins), missing resource → UNATTRIBUTED, empty tool name → null
    assert second["event_name"] == "stop" and second["input_tokens"] == 9 and second["success"] is True
    assert second["issue_key"] == "UNATTRIBUTED" and second["developer_id"] == "UNATTRIBUTED"
    assert second["tool_name"] is None and second["session_id"] is None
    reasons = sorted(r["reason"] for r in parsed.quarantine.collect())
    assert reasons == ["bad_cost", "bad_time", "malformed_line", "malformed_line", "missing_time"]


def test_wrapper_session_wins_and_empty_is_missing(spark, cfg):
    res = [kv(cfg.attributes.wrapper_session_id, "w-1"), kv("session.id", "r-1")]
    rec = {"timeUnixNano": "1704067200000000000", "attributes": [kv("session.id", "l-1")]}
    rec2 = {"timeUnixNano": "1704067200000000000", "attributes": [kv("session.id", "")]}
    lines = [log_line([rec], res), log_line([rec2], [kv("session.id", "r-2")])]
    got = {r["session_id"] for r in otlp.parse_logs(lines_df(spark, lines), cfg).good.collect()}
    assert got == {"w-1", "r-2"}


def test_spans_kind_duration_and_duplicates(spark, cfg):
    def span(sid, name, start, end, **attrs):
        return {"spanId": sid, "traceId": "t1", "name": name, "startTimeUnixNano": start, "endTimeUnixNano": end,
                "attributes": [kv(k, v) for k, v in attrs.items()]}

    lines = [
        span_line([span("a", "claude_code.tool", "1704067200000000000", "1704067201500000000", tool_name="Bash")], RES),
        span_line([span("a", "claude_code.llm_request", "1704067300000000000", "1704067301000000000")], RES),
        span_line([span("b", "x", "1704067200000000000", None)], RES),
        span_line([span(None, "y", "1704067200000000000", "1704067200000000000")], RES),
    ]
    parsed = otlp.parse_traces(lines_df(spark, lines), cfg)
    rows = parsed.good.orderBy("_seq").collect()
    assert [r["span_id"] for r in rows] == ["a", "a"]
    assert rows[0]["span_kind"] == "tool" and float(rows[0]["duration_ms"]) == 1500.0
    assert rows[0]["tool_name"] == "Bash" and rows[0]["session_id"] == "s-res"
    from costlens.operators import merge

    kept = merge.spans_to_append(None, parsed.good).collect()
    assert len(kept) == 1 and kept[0]["span_kind"] == "tool"  # first in file order wins
    assert sorted(r["reason"] for r in parsed.quarantine.collect()) == ["missing_span_id", "missing_time"]


def test_raw_payload_keeps_the_whole_item(spark, cfg):
    span = {"spanId": "a", "traceId": "t", "name": "x", "kind": 3, "startTimeUnixNano": 1704067200000000000,
            "endTimeUnixNano": "1704067201000000000", "status": {"code": 2, "message": "é \"q\""},
            "events": [{"name": "e", "attributes": [kv("k", 1.50, "doubleValue")]}], "links": [{"traceId": "z"}],
            "attributes": [{"key": "m", "value": {"kvlistValue": {"values": [kv("n", "v")]}}}, kv("b", "AAE=", "bytesValue")]}
    record = {"timeUnixNano": "1704067200000000000", "severityNumber": 9, "severityText": "INFO",
              "body": {"kvlistValue": {"values": [kv("n", "v")]}}, "attributes": [kv("event.name", "stop")]}
    bad = dict(span, spanId=None)
    lines = lines_df(spark, [span_line([span, bad], RES), span_line([dict(span, spanId="b")], RES)])
    traces = otlp.parse_traces(lines, cfg)
    got = [json.loads(r["raw_payload"]) for r in traces.good.orderBy("_seq").collect()]
    assert got == [span, dict(span, spanId="b")]
    assert [json.loads(r["raw"]) for r in traces.quarantine.collect()] == [bad]
    logs = otlp.parse_logs(lines_df(spark, [log_line([record, dict(record, severityNumber=1)], None)]), cfg)
    assert [json.loads(r["raw_payload"]) for r in logs.good.orderBy("_seq").collect()] == [record, dict(record, severityNumber=1)]


def test_fields_of_an_item_are_read_once_whatever_their_type(spark, cfg):
    """Its texts are not cast one by one, and parts of another type read as the cast gives them."""
    def line(**more):
        span = {"spanId": "a", "traceId": "t", "name": "tool", "startTimeUnixNano": 1704067200000000000,
                "endTimeUnixNano": "1704067201000000000", "attributes": []} | more
        return json.dumps({"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": [span]}]}]})

    attrs = [5, None, {"key": "tool_name", "value": {"stringValue": {"b": 1, "a": [2.50]}}}, {"key": "cost_usd", "value": {"doubleValue": 1.50}},
             {"key": "session.id", "value": "s"}]
    lines = [line(attributes=attrs), line(spanId=7.10, name=True), line(spanId={"z": 1, "y": None}), line(spanId=None), line(spanId="")]
    rows = otlp.parse_traces(spark.createDataFrame(list(enumerate(lines)), "seq long, value string"), cfg).rows
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("variant_get(item") <= 1
    found = {r["_seq"]["seq"]: r for r in rows.collect()}
    assert [found[n]["span_id"] for n in range(5)] == ["a", "7.1", '{"y":null,"z":1}', None, ""]
    assert [found[n]["_reason"] for n in range(5)] == [None, None, None, "missing_span_id", "missing_span_id"]
    assert found[0]["tool_name"] == '{"a":[2.5],"b":1}' and str(found[0]["cost_usd"]) == "1.500000"
    assert found[0]["session_id"] is None and found[1]["span_name"] == "true"
