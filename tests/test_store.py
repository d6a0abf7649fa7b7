"""The stored path loses nothing: batch ids, read errors, odd folders, J12."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from costlens.operators import context, merge, privacy
from costlens.sinks import tables
from costlens.sinks.span_index import SpanIndex
from costlens.sinks.tables import TableStore, local_scratch
from costlens.sources import otlp
from costlens.streaming import ingest


def span(span_id, start_s, **more):
    nano = str(start_s * 10**9)
    return {"traceId": "t" + span_id, "spanId": span_id, "name": "x", "startTimeUnixNano": nano, "endTimeUnixNano": str(start_s * 10**9 + 10**10), **more}


def trace_line(*spans):
    attrs = [{"key": "session.id", "value": {"stringValue": "s1"}}]
    return json.dumps({"resourceSpans": [{"resource": {"attributes": attrs}, "scopeSpans": [{"spans": list(spans)}]}]})


def put(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


DAY1, DAY3 = 1704067200, 1704067200 + 2 * 86400


def test_lost_checkpoint_keeps_earlier_batches(spark, cfg, tmp_path):
    root = str(tmp_path)
    landing, scratch = f"{root}/landing", local_scratch(root)
    store = TableStore(spark, f"{root}/tables", rollup_buckets=4)
    put(f"{landing}/traces", "a.jsonl", trace_line(span("a", DAY1)))
    put(f"{landing}/elsewhere", "x.jsonl", '{"lost": 1}', "")
    ingest.run_full(spark, landing, store, cfg, scratch)
    with pytest.raises(ValueError):
        ingest.run_full(spark, landing, store, cfg, scratch)
    quarantine = store.read("quarantine").collect()
    assert [(r.reason, r.raw) for r in quarantine] == [("unknown_kind", '{"lost": 1}')]
    # A stream that starts anew counts from 0; "a" comes again two days apart.
    put(f"{landing}/traces", "b.jsonl", trace_line(span("b", DAY1), span("a", DAY3)))
    for checkpoint in ("one", "two"):  # the second stands for a lost checkpoint
        ingest.run_stream(spark, landing, store, cfg, f"{root}/{checkpoint}", scratch=scratch).awaitTermination()
    assert sorted(r.span_id for r in store.read("raw_spans").select("span_id").collect()) == ["a", "b"]
    assert store.committed() == [0, 1, 2] and store.open_batches() == []


def test_ledger_replays_the_same_batch(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"))
    assert store.is_empty()
    assert [store.allot("x", 0), store.allot("x", 1), store.allot("y", 0), store.allot("x", 1)] == [0, 1, 2, 1]
    assert not store.is_empty()


def test_broken_version_raises(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), rollup_buckets=2)
    assert store.read("missing") is None and store.read_version("missing") is None
    store.upsert("issues", spark.range(30), ["id"], 0, lambda old, new: new)
    folder = tmp_path / "t" / "issues" / "bucket=1" / "version=0"
    for f in folder.iterdir():
        if "part-" in f.name:
            os.remove(f)
    with pytest.raises(Exception):
        store.read_version("issues")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), rollup_buckets=8)
    put_rows = lambda batch, ids: store.upsert(
        "kv", spark.createDataFrame([(i, batch, 0) for i in ids], "id long, v int, _seq int"), ["id"], batch,
        lambda old, new: merge.upsert(old, new, ["id"]))
    files = lambda: {str(f) for f in (tmp_path / "t" / "kv").rglob("part-*.parquet")}
    put_rows(0, range(64))
    store.commit(0)
    before = files()
    assert len(store._versions("kv")) == 8
    put_rows(1, [5])
    store.commit(1)
    assert before < files() and len(files()) == len(before) + 1
    for batch in (2, 3, 4):  # one bucket again and again: two versions of it stay
        put_rows(batch, [5, 100 + batch] if batch == 2 else [5])
        store.commit(batch)
    sizes = {b: len(v) for b, v in store._versions("kv").items()}
    assert sorted(sizes.values())[-1] == 2 and sum(sizes.values()) <= 8 + 2
    want = {i: 0 for i in range(64)} | {5: 4, 102: 2}
    assert dict(rows_of(store.read_keyed("kv"))) == want
    assert dict(rows_of(store.read_keyed("kv", before_batch=4))) == want | {5: 3}
    put_rows(5, [])  # a batch without rows writes nothing
    assert 5 not in {v for versions in store._versions("kv").values() for v in versions}


def test_an_open_batch_is_hidden_and_others_wait(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), rollup_buckets=2)
    first = store.allot("a", 0)
    store.write_batch("rows", spark.range(3), first)
    store.write_keyed("keyed", spark.range(3), ["id"], first, [0, 1])
    store.commit(first)
    second = store.allot("a", 1)
    store.write_batch("rows", spark.range(3, 9), second)
    store.upsert("keyed", spark.range(3, 9), ["id"], second, lambda old, new: old.union(new))
    assert store.read("rows").count() == 3 and store.read_keyed("keyed").count() == 3
    assert store.read_keyed("keyed", own=second).count() == 9
    other = TableStore(spark, str(tmp_path / "t"), rollup_buckets=2)
    third = other.allot("b", 0)
    assert (first, second, third) == (0, 1, 2) and other.open_batches() == [1, 2]
    with pytest.raises(tables.BatchOpen):
        other.begin(third)
    store.begin(second)  # the repeated batch itself need not wait
    store.commit(second)
    other.begin(third)
    assert other.read("rows").count() == 9 and other.read_keyed("keyed").count() == 9
    other.write_batch("rows", spark.range(100), third)
    other.abandon(third)
    assert store.read("rows").count() == 9
    fourth = store.allot("a", 2)
    store.begin(fourth)
    assert fourth == 3
    with pytest.raises(ValueError):
        TableStore(spark, str(tmp_path / "t"), rollup_buckets=4).allot("a", 3)


def test_the_ledger_is_folded(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), rollup_buckets=2)
    owners = [("a", n) for n in range(6)] + [("b", 0)] + [("a", n) for n in range(6, 12)]
    for stream, n in owners:
        batch = store.allot(stream, n)
        store._put(f"{store.path(tables.LEDGER)}/{batch}.done.{store._owner(stream, n)}", "", exclusive=False)
    store._fold(keep=4)
    names = store._names(store.path(tables.LEDGER))
    assert len(names) == 1 + 1 + 2 * 2  # buckets, floor, the last batch of each stream
    assert store.allot("a", 11) == 12 and store.allot("b", 0) == 6 and store.allot("a", 12) == 13
    assert store.committed() == list(range(13)) and store.hidden() == [13]


def test_two_drivers_never_share_a_batch(spark, tmp_path):
    stores = [TableStore(spark, str(tmp_path / "t"), rollup_buckets=2) for _ in range(2)]
    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(lambda k: [stores[k].allot(f"s{k}", n) for n in range(12)], range(2)))
    assert sorted(got[0] + got[1]) == list(range(24))
    assert [stores[0].allot("s1", n) for n in range(12)] == got[1]


def test_a_full_run_that_failed_is_repeated(spark, cfg, tmp_path, monkeypatch):
    root = str(tmp_path)
    store = TableStore(spark, f"{root}/tables", rollup_buckets=2)
    put(f"{root}/landing/traces", "a.jsonl", trace_line(span("a", DAY1), span("b", DAY3)))
    with monkeypatch.context() as m:
        m.setattr(ingest, "refresh_touched", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.run_full(spark, f"{root}/landing", store, cfg)
    assert store.read("raw_spans").count() == 0  # written, not committed
    ingest.run_full(spark, f"{root}/landing", store, cfg)
    assert rows_of(store.read("raw_spans").select("span_id")) == [("a",), ("b",)]
    with pytest.raises(ValueError):
        ingest.run_full(spark, f"{root}/landing", store, cfg)
    assert store._names(store.path("landed")) == [] or not list((tmp_path / "tables" / "landed").rglob("part-*"))


# ---- the span index ------------------------------------------------------------

def some_spans(spark, ids, batch):
    return spark.createDataFrame([(f"id{i}", batch, n) for n, i in enumerate(ids)], "span_id string, batch_no int, _seq long")


def test_span_index_keeps_the_first_of_all_history(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), rollup_buckets=4)
    index = SpanIndex(store, filter_words=64)  # crowded on purpose: many ids need the exact test
    rng = np.random.default_rng(3)
    seen: dict[str, tuple] = {}
    for batch in range(4):
        ids = rng.integers(0, 900, 400).tolist()
        index.append(some_spans(spark, ids, batch), batch, day_of=None)
        store.commit(batch)
        for n, i in enumerate(ids):
            seen.setdefault(f"id{i}", batch)
    got = {r.span_id: r.batch_no for r in store.read("raw_spans").collect()}
    assert got == seen and store.read("raw_spans").count() == len(seen)


def test_span_index_reads_do_not_grow_with_history(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), rollup_buckets=4)
    index = SpanIndex(store, filter_words=4096)
    for batch in range(3):
        index.append(some_spans(spark, range(batch * 1000, batch * 1000 + 1000), batch), batch, day_of=None)
        store.commit(batch)
        assert index.opened == []  # new ids: no stored id is read
        words = store.read_keyed("span_filter")
        assert words.count() <= 4 * 4096
    index.append(some_spans(spark, [5000], 3), 3, day_of=None)
    assert len(index.buckets) == 1  # one id: one bucket of the filter
    store.commit(3)
    index.append(some_spans(spark, [5000, 6000], 4), 4, day_of=None)
    assert len(index.opened) == 1  # only where an id may have been stored
    store.commit(4)
    assert store.read("raw_spans").count() == 3002


def test_an_upsert_reads_its_batch_from_files(spark, tmp_path):
    """Buckets and rows come from one evaluation of the batch, written once."""
    store = TableStore(spark, f"{tmp_path}/tables", rollup_buckets=4)
    found = []
    for batch, values in ((1, [("a", 1), ("b", 1)]), (2, [("b", 2), ("c", 2)])):
        # The order is a number in one batch and text in the other.
        kind, place = ("long", batch) if batch == 1 else ("string", str(batch))
        rows = spark.createDataFrame([(k, v, place) for k, v in values], f"k string, v int, _seq {kind}")

        def merged(old, new):
            found.append(new.inputFiles())
            return merge.upsert(old, new, ["k"])

        store.upsert("things", rows, ["k"], batch, merged)
        store.commit(batch)
    store.upsert("things", rows.limit(0), ["k"], 3, merged)
    assert len(found) == 2 and all(files and all("things_batch" in f for f in files) for files in found)
    assert rows_of(store.read_keyed("things")) == sorted([("a", 1), ("b", 2), ("c", 2)])
    assert store._glob(f"{store.path('things_batch')}/batch=*") == []


def test_many_repeated_spans_are_shuffled_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("costlens.sinks.span_index.MAX_BROADCAST", 0)
    store = TableStore(spark, f"{tmp_path}/tables", rollup_buckets=4)
    index, plans, write = SpanIndex(store, filter_words=64), [], store.write_batch

    def noted(name, df, *args, **more):
        if name == "raw_spans":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        write(name, df, *args, **more)

    monkeypatch.setattr(store, "write_batch", noted)
    for batch, rows in ((0, [("x", 2), ("x", 1), ("y", 1), (None, 1), (None, 1)]), (1, [("y", 5), ("z", 6), ("z", 5), (None, 1)])):
        index.append(spark.createDataFrame([(i, n, n) for i, n in rows], "span_id string, v int, _seq int"), batch, day_of=None)
        store.commit(batch)
    found = [tuple(r) for r in store.read("raw_spans").select("span_id", "v").collect()]
    assert sorted(found, key=str) == sorted([("x", 1), ("y", 1), ("z", 5), (None, 1), (None, 1), (None, 1)], key=str)
    assert all("LeftSemi" not in plan for plan in plans)


def test_half_bad_line_is_quarantined_whole(spark, cfg):
    good = json.loads(trace_line(span("g", DAY1)))["resourceSpans"][0]
    half = json.dumps({"resourceSpans": [good, {"scopeSpans": 5}]})
    lines = spark.createDataFrame([(half,), (trace_line(span("w", DAY1)),)], "value string")
    parsed = otlp.parse_traces(lines, cfg)
    assert [r.span_id for r in parsed.good.collect()] == ["w"]
    assert [r.reason for r in parsed.quarantine.collect()] == ["malformed_line"]


def test_single_candidate_counts_over_all_addresses(spark):
    rollups = spark.createDataFrame([(f"s{i}", "UNATTRIBUTED", f"d{i}") for i in range(4)], "session_id string, issue_key string, developer_id string")
    identity = spark.createDataFrame([("d0", "a"), ("d0", "b"), ("d1", "c"), ("d1", "e"), ("d2", "f"), ("d2", "f"), ("d3", "zz")], "developer_id string, assignee_email string")
    issues = spark.createDataFrame(
        [("P-1", "a", "open"), ("P-2", "b", "open"), ("P-3", "c", "open"), ("P-4", "e", "done"), ("P-5", "f", "open"), ("P-5", "f", "open")],
        "issue_key string, assignee_email string, status string",
    )
    got = context.single_candidate_suggestions(rollups, identity, issues, ["open"]).collect()
    assert sorted((r.session_id, r.suggested_issue_key) for r in got) == [("s1", "P-3"), ("s2", "P-5")]


def test_identity_prefers_a_known_address(spark):
    rows = spark.createDataFrame([("Ann", None), ("Ann", "z@x"), ("Ann", "b@x")], "name string, mail string")
    _, ids = privacy.pseudonymise(rows, "name", "salt", "mail")
    assert [r.git_email for r in ids.collect()] == ["b@x"]
