"""Steps of a batch side by side, files of passing tables, narrow first places."""

import datetime as dt
import json
import threading

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from costlens import schemas
from costlens.config import DEFAULT_SETTINGS, configure_session
from costlens.functions import columns as C
from costlens.operators import merge
from costlens.sinks.tables import TableStore
from costlens.sources import fixtures as fx
from costlens.streaming import ingest

LANDED = "value string, file string, mark string, offset long"
IDS = "seq struct<file string, mark string, offset long>, ri int, raw_developer_id string, developer_email string"


def rule(sha, **more):
    return json.dumps({"commit_sha": sha, "session_id": "s1", "developer_email": "a@x.io", "committed_at": "2024-01-01T00:00:00Z", **more})


def test_steps_overlap_and_errors_wait_for_all(spark):
    met, ended = threading.Barrier(2, timeout=60), []
    assert ingest._together(spark, [lambda: met.wait() >= 0, lambda: met.wait() >= 0]) == [True, True]

    def fails():
        raise ValueError("first")

    def slow():
        threading.Event().wait(0.5)
        ended.append(True)

    with pytest.raises(ValueError, match="first"):
        ingest._together(spark, [fails, slow])
    assert ended == [True]


def test_kinds_are_parsed_at_the_same_time(spark, cfg, tmp_path, monkeypatch):
    """Two kinds wait for each other; one after another they would never meet."""
    met, parse = threading.Barrier(2, timeout=120), ingest._parse

    def meets(kind, *more):
        if kind in ("issues", "git_commits"):
            met.wait()
        return parse(kind, *more)

    monkeypatch.setattr(ingest, "_parse", meets)
    lines = [(rule("c1"), "/l/git_commits/a", "m", 0), (json.dumps({"issue": {"key": "P-1", "fields": {}}}), "/l/issues/a", "m", 0)]
    store = TableStore(spark, str(tmp_path), rollup_buckets=4)
    # issues and git_commits are far apart in the list: let every kind begin
    monkeypatch.setattr(ingest, "SIDE_BY_SIDE", len(ingest.KINDS))
    ingest.ingest_batch(spark.createDataFrame(lines, LANDED), store.allot("t", 0), store, cfg)
    assert store.read_keyed("git_commits").count() == 1 and store.read_keyed("issues").count() == 1


def test_a_failed_step_leaves_the_batch_open(spark, cfg, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path), rollup_buckets=4)
    lines = spark.createDataFrame([(rule("c1"), "/l/git_commits/a", "m", 0)], LANDED)
    upsert, write = store.upsert, store.write_batch

    def fails(*a, **k):
        raise OSError("full")

    monkeypatch.setattr(store, "upsert", fails)
    with pytest.raises(OSError):
        ingest.ingest_batch(lines, store.allot("t", 0), store, cfg)
    assert store.open_batches() == [0] and write
    monkeypatch.setattr(store, "upsert", upsert)
    ingest.ingest_batch(lines, store.allot("t", 0), store, cfg)
    assert store.open_batches() == [] and store.read_keyed("git_commits").count() == 1


def test_passing_tables_are_written_without_dictionaries(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = spark.range(1000).select(F.lit("same").alias("text"))
    found = {}
    for name, passing in (("kept", False), ("gone", True)):
        store.write_batch(name, rows, 0, passing=passing)
        file = next((tmp_path / name / "batch=0").glob("part-*"))
        found[name] = pq.ParquetFile(file).metadata.row_group(0).column(0).has_dictionary_page
        assert store.read_batch(name, 0).count() == 1000
    assert found == {"kept": True, "gone": False}


def test_a_deployments_own_split_size_stays(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "256m")
        configure_session(spark)
        assert spark.conf.get(key) == "256m"
        spark.conf.unset(key)
        configure_session(spark)
        assert spark.conf.get(key) == DEFAULT_SETTINGS[key]
    finally:
        if before is not None:
            spark.conf.set(key, before)


def test_integral_division_is_exact_without_decimals(spark):
    n = [0, 1, -1, 999_999, -999_999, 1_000_000, -1_000_001, 2**63 - 1, -(2**63), None]
    df = spark.createDataFrame([(x,) for x in n], "n long").select(C.int_div(F.col("n"), 1_000_000).alias("q"))
    want = [None if x is None else abs(x) // 1_000_000 * (1 if x >= 0 else -1) for x in n]
    assert [r[0] for r in df.collect()] == want and dict(df.dtypes) == {"q": "bigint"}
    assert "decimal" not in df._jdf.queryExecution().toString()


def test_developers_are_first_seen_by_file_byte_and_resource(spark):
    """Raw rows meet in a hash aggregation; the row that comes first still wins."""
    rows = [
        (("b", "m", 1), 0, "a@x.io", "a@x.io"), (("a", "m", 9), 1, "a@x.io", None), (("a", "m", 9), 0, "a@x.io", "a@x.io"),
        (("a", "m", 10), 0, "Jane", None), (("a", "m", 2), 0, "Jane", "jane@x.io"),
        (("c", "m", 5), 0, "Tom", None), (("c", "m", None), 0, "Tom", "tom@x.io"), (("c", "m", 1), 0, "UNATTRIBUTED", None),
    ]
    ids = spark.createDataFrame(rows, IDS)
    out = {r["developer_id"]: (r["git_email"], r["display_name"]) for r in merge.developers_to_append(None, [ids], "s").collect()}
    known = {r[0]: r[1] for r in spark.createDataFrame([("a@x.io",), ("Jane",), ("Tom",)], "n string").select(
        "n", C.pseudonym(F.col("n"), "s")).collect()}
    assert out == {known["a@x.io"]: ("a@x.io", None), known["Jane"]: ("jane@x.io", None), known["Tom"]: ("tom@x.io", None)}
    first = merge._first_places(ids, ["raw_developer_id", "developer_email"])
    assert "HashAggregate" in (plan := first._jdf.queryExecution().executedPlan().toString()) and "SortAggregate" not in plan


def test_spread_and_place_do_not_depend_on_the_order_of_rows(spark):
    rows = spark.range(100).select("id", F.lit(None).cast("string").alias("x"))
    plan = fx.spread(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and "RoundRobin" not in plan
    assert sorted(r[0] for r in fx.spread(rows).collect()) == list(range(100))
    for seq, kind in ((-7, "long"), ("sp7x", "string")):
        lines = spark.createDataFrame([("v", seq)], f"value string, seq {kind}")
        assert fx.as_landed(lines, "logs").first()["offset"] == 7


def test_slices_of_a_first_batch_need_no_keys_and_later_ones_do(spark, cfg, tmp_path):
    """A store without a ledger (rows written by hand): the second batch leaves
    sessions that it does not touch as they are."""
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s, tzinfo=dt.UTC)
    ev = "session_id string, event_name string, ts timestamp, issue_key string, developer_id string"
    turns = lambda s, at: [(s, "stop", t(at), "P-1", "d"), (s, "user_prompt", t(at + 5), "P-1", "d")]
    store = TableStore(spark, str(tmp_path), rollup_buckets=64)
    none = spark.createDataFrame([], schemas.RAW_SPANS)
    first = [r for i in range(20) for r in turns(f"s{i}", 0)]
    for batch, rows in ((0, first), (1, turns("s3", 20))):
        store.write_batch("raw_events", fx.as_raw(spark.createDataFrame(rows, ev), schemas.RAW_EVENTS), batch, day_of="ts")
        store.write_batch("raw_spans", none, batch, day_of="start_ts")
        assert store.holds_only("raw_events", "day", [dt.date(2024, 1, 1)], batch) == (batch == 0)
        ingest.refresh_touched(store, batch, cfg)
    got = {r["session_id"]: float(r["active_time_sec"]) for r in store.read_rollups().collect()}
    assert got == {f"s{i}": 10.0 if i == 3 else 5.0 for i in range(20)}
