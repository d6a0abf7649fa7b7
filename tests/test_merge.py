"""Merge semantics: insert-ignore, upserts, pins, reviews, developers."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from costlens.operators import merge

T0 = dt.datetime(2024, 1, 1)
EV = "session_id string, event_name string, ts timestamp, tool_name string, cost_usd decimal(12,6), _seq long"


def test_events_dedup_null_session_and_tool_key(spark):
    batch = spark.createDataFrame([
        ("s1", "tool_result", T0, None, Decimal(1), 1),
        ("s1", "tool_result", T0, None, Decimal(2), 2),     # duplicate of 1 (null tool = '')
        ("s1", "tool_result", T0, "Bash", Decimal(3), 3),   # differs by tool name
        (None, "stop", T0, None, Decimal(0), 4),
        (None, "stop", T0, None, Decimal(0), 5),            # null session: never a duplicate
    ], EV)
    first = merge.events_to_append(None, batch)
    assert first.count() == 4
    assert first.filter(F.col("session_id") == "s1").agg(F.sum("cost_usd")).first()[0] == Decimal(4)
    replay = merge.events_to_append(first, batch)
    assert replay.count() == 2  # only the null-session rows come in again


def test_upsert_last_wins_and_keeps_first_batch(spark):
    b1 = spark.createDataFrame([("c1", "a", 1), ("c2", "b", 2)], "commit_sha string, subject string, _seq long")
    t1 = merge.upsert_commits(None, b1, 1)
    b2 = spark.createDataFrame([("c1", "x", 1), ("c1", "y", 2), ("c3", "z", 3)], "commit_sha string, subject string, _seq long")
    t2 = {r["commit_sha"]: r for r in merge.upsert_commits(t1, b2, 2).collect()}
    assert t2["c1"]["subject"] == "y" and t2["c1"]["ingested_batch"] == 1
    assert t2["c2"]["subject"] == "b" and t2["c3"]["ingested_batch"] == 2
    again = {r["commit_sha"]: r for r in merge.upsert_commits(t1, b2, 2).collect()}
    assert again == t2  # replaying batch 2 against version 1 gives the same table


RU = ("session_id string, issue_key string, developer_id string, active_time_sec decimal(38,6), "
      "wait_time_sec decimal(38,6), token_cost_usd decimal(38,6), session_start timestamp, session_end timestamp")


def test_pinned_upsert_keeps_confirmed_key(spark):
    target = spark.createDataFrame(
        [("s1", "PROJ-9", "d", Decimal(1), Decimal(1), Decimal(0), T0, T0, "ai_confirmed"),
         ("s2", "UNATTRIBUTED", "d", Decimal(1), Decimal(1), Decimal(0), T0, T0, "explicit"),
         ("s4", "PROJ-4", "d", Decimal(1), Decimal(1), Decimal(0), T0, T0, "explicit")],
        RU + ", attribution_source string")
    fresh = spark.createDataFrame(
        [("s1", "UNATTRIBUTED", "d", Decimal(5), Decimal(5), Decimal(1), T0, T0),
         ("s2", "PROJ-2", "d", Decimal(5), Decimal(5), Decimal(1), T0, T0),
         ("s3", "PROJ-3", "d", Decimal(5), Decimal(5), Decimal(1), T0, T0)], RU)
    out = {r["session_id"]: r for r in merge.pinned_upsert(target, fresh).collect()}
    assert out["s1"]["issue_key"] == "PROJ-9" and out["s1"]["active_time_sec"] == Decimal(5)
    assert out["s1"]["attribution_source"] == "ai_confirmed"
    assert out["s2"]["issue_key"] == "PROJ-2" and out["s3"]["attribution_source"] == "explicit"
    assert out["s4"]["active_time_sec"] == Decimal(1)  # untouched row kept


def test_apply_reviews(spark):
    rollups = spark.createDataFrame([("s1", "UNATTRIBUTED", "explicit"), ("s2", "UNATTRIBUTED", "explicit")],
                                    "session_id string, issue_key string, attribution_source string")
    sugg = spark.createDataFrame(
        [("g1", "s1", "PROJ-1", "pending", None, None), ("g2", "s1", "PROJ-2", "pending", None, None),
         ("g3", "s2", "PROJ-3", "pending", None, None)],
        "suggestion_id string, session_id string, suggested_issue_key string, status string, reviewed_by string, "
        "reviewed_at timestamp")
    dec = spark.createDataFrame([("g1", "confirmed", "r", 1), ("g2", "confirmed", "r", 2), ("g3", "rejected", "r", 3),
                                 ("g3", "confirmed", "r", 0)],
                                "suggestion_id string, status string, reviewed_by string, decided_seq long")
    r, s = merge.apply_reviews(rollups, sugg, dec, F.lit(T0).cast("timestamp"))
    r = {x["session_id"]: x for x in r.collect()}
    assert r["s1"]["issue_key"] == "PROJ-2" and r["s1"]["attribution_source"] == "ai_confirmed"
    assert r["s2"]["issue_key"] == "UNATTRIBUTED" and r["s2"]["attribution_source"] == "explicit"
    s = {x["suggestion_id"]: x for x in s.collect()}
    assert s["g3"]["status"] == "rejected" and s["g3"]["reviewed_by"] == "r" and s["g1"]["reviewed_at"] == T0


def test_developers_first_seen_and_display_name(spark):
    ids_a = spark.createDataFrame([(1, 0, "dev@x.io", "dev@x.io"), (2, 0, "Jane", None), (3, 0, "UNATTRIBUTED", None)],
                                  "seq long, ri int, raw_developer_id string, developer_email string")
    ids_b = spark.createDataFrame([(1, 0, "Jane", "jane@x.io")], "seq long, ri int, raw_developer_id string, developer_email string")
    out = merge.developers_to_append(None, [ids_a, ids_b], "s").collect()
    by = {r["git_email"] or r["display_name"]: r for r in out}
    assert len(out) == 2 and "UNATTRIBUTED" not in by
    assert by["Jane"]["git_email"] is None  # first source seen wins
    again = merge.developers_to_append(spark.createDataFrame(out), [ids_a, ids_b], "s")
    assert again.count() == 0


def test_first_wins_hot_key_is_partial_aggregate(spark):
    """A key holding most rows is reduced map-side (no row_number window)."""
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.col("id").cast("string"))
                                     .alias("span_id"), F.col("id").alias("_seq"))
    out = merge.first_wins(df, ["span_id"], [F.col("_seq")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan.replace(" ", "")
    assert out.filter(F.col("span_id") == "hot").count() == 1


def test_duplicate_emails_reported(spark):
    devs = spark.createDataFrame([("a", "x@y.io", None), ("b", "x@y.io", None), ("c", None, "n")],
                                 "developer_id string, git_email string, display_name string")
    out = merge.duplicate_emails(devs).collect()
    assert [(r["git_email"], r["developer_ids"]) for r in out] == [("x@y.io", 2)]
