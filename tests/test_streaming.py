"""File-stream ingest with foreachBatch: two runs of landed files equal a full run."""

import os

from pyspark.sql import functions as F

from costlens.operators import rollup
from costlens.sinks.tables import TableStore, local_scratch
from costlens.sources import fixtures as fx
from costlens.sources import otlp
from costlens.streaming import ingest
from tests.conftest import SF_SMALL

COLS = ["session_id", "issue_key", "developer_id", "active_time_sec", "wait_time_sec", "token_cost_usd"]


def land(df, folder, name):
    """Write lines as one closed .jsonl file (written elsewhere, then renamed in)."""
    tmp = folder + "_tmp_" + name
    df.select("value").coalesce(1).write.mode("overwrite").text(tmp)
    part = [f for f in os.listdir(tmp) if f.startswith("part-")][0]
    os.makedirs(folder, exist_ok=True)
    os.rename(os.path.join(tmp, part), os.path.join(folder, name + ".jsonl"))


def test_stream_two_loads_equal_full(spark, cfg, tmp_path):
    root = str(tmp_path)
    landing, scratch = f"{root}/landing", local_scratch(root)
    logs = fx.events_as_log_lines(spark, SF_SMALL, cfg)
    traces = fx.spans_as_trace_lines(spark, SF_SMALL, cfg)
    # the log lines of the first two weeks, then the rest
    ts = F.get_json_object("value", "$.resourceLogs[0].scopeLogs[0].logRecords[0].timeUnixNano").cast("long")
    split = 1705276800 * 10**9  # 2024-01-15
    land(logs.filter(ts < split), f"{landing}/logs", "a")
    land(traces, f"{landing}/traces", "a")
    store = TableStore(spark, f"{root}/tables", rollup_buckets=8)
    q = ingest.run_stream(spark, landing, store, cfg, f"{root}/stream_ckpt", scratch=scratch)
    q.awaitTermination()
    land(logs.filter(ts >= split), f"{landing}/logs", "b")
    land(logs.filter(ts >= split), f"{landing}/logs", "c")  # a re-delivered file: ignored by insert-ignore
    q = ingest.run_stream(spark, landing, store, cfg, f"{root}/stream_ckpt", scratch=scratch)
    q.awaitTermination()

    got = sorted(tuple(r) for r in store.read_rollups().select(*COLS).collect())
    full = rollup.session_rollups(otlp.parse_traces(traces, cfg).good, otlp.parse_logs(logs, cfg).good)
    want = sorted(tuple(r) for r in full.select(*COLS).collect())
    assert got == want and len(got) > 0
    assert store.read("raw_events").count() == logs.count()


def test_batch_replay_is_idempotent(spark, cfg, tmp_path):
    root = str(tmp_path)
    landing, scratch = f"{root}/landing", local_scratch(root)
    land(fx.events_as_log_lines(spark, SF_SMALL, cfg), f"{landing}/logs", "a")
    store = TableStore(spark, f"{root}/tables", rollup_buckets=4)
    lines = ingest.landed_lines(spark, landing)
    ingest.ingest_batch(lines, 0, store, cfg, scratch)
    first = sorted(tuple(r) for r in store.read_rollups().select(*COLS).collect())
    ingest.ingest_batch(lines, 0, store, cfg, scratch)  # the same batch again (replay after a failure)
    again = sorted(tuple(r) for r in store.read_rollups().select(*COLS).collect())
    assert first == again
    assert store.read("raw_events").count() == fx.raw_events(spark, SF_SMALL).count()


def test_all_kinds_land_and_merge(spark, cfg, tmp_path):
    from costlens.operators import signals
    from costlens.sinks.jsonl import write_jsonl

    root = str(tmp_path)
    landing, scratch = f"{root}/landing", local_scratch(root)
    commits = signals.commit_records(fx.commit_log(spark, SF_SMALL))
    write_jsonl(commits, f"{landing}/git_commits", 0)
    write_jsonl(signals.prompt_signals(fx.prompt_payloads(spark, SF_SMALL)), f"{landing}/prompt_signals", 0)
    write_jsonl(signals.tool_signals(fx.command_payloads(spark, SF_SMALL)), f"{landing}/tool_signals", 0)
    write_jsonl(fx.ci_payloads(spark, SF_SMALL), f"{landing}/ci", 0)
    issues = fx.issue_payloads(spark, SF_SMALL)
    issues.select("value").write.text(f"{landing}/issues/batch=0")
    store = TableStore(spark, f"{root}/tables", rollup_buckets=4)
    ingest.run_full(spark, landing, store, cfg, scratch)

    assert store.read_version("git_commits").count() == commits.count()
    assert store.read("prompt_signals").count() == signals.prompt_signals(fx.prompt_payloads(spark, SF_SMALL)).count()
    assert store.read_version("issues").count() == issues.count()
    ci = store.read_version("ci_runs")
    assert ci.filter(F.col("status") == "passed").count() == 0 and ci.count() > 0
    q = store.read("quarantine")
    assert q.filter(F.col("reason") == "bad_status").count() > 0
    devs = store.read("developers")
    assert devs.count() > 0 and devs.filter(F.col("git_email").isNull() & F.col("display_name").isNull()).count() == 0


def test_missing_landing_is_empty(spark):
    assert ingest.landed_lines(spark, "/tmp/costlens-no-such-folder-xyz").count() == 0


def test_late_rows_inside_history_equal_full(spark, cfg, tmp_path):
    """Load 2 interleaves with load 1 in time (late data): touched slices in
    the middle of sessions are recomputed and re-linked."""
    root = str(tmp_path)
    landing, scratch = f"{root}/landing", local_scratch(root)
    logs = fx.events_as_log_lines(spark, SF_SMALL, cfg)
    traces = fx.spans_as_trace_lines(spark, SF_SMALL, cfg)
    land(logs.filter(F.col("seq") % 2 == 0), f"{landing}/logs", "a")
    land(traces.filter(F.length("seq") % 2 == 0), f"{landing}/traces", "a")
    store = TableStore(spark, f"{root}/tables", rollup_buckets=4)
    ingest.run_stream(spark, landing, store, cfg, f"{root}/ckpt", scratch=scratch).awaitTermination()
    land(logs.filter(F.col("seq") % 2 == 1), f"{landing}/logs", "b")
    land(traces.filter(F.length("seq") % 2 == 1), f"{landing}/traces", "b")
    ingest.run_stream(spark, landing, store, cfg, f"{root}/ckpt", scratch=scratch).awaitTermination()
    got = sorted(tuple(r) for r in store.read_rollups().select(*COLS).collect())
    full = rollup.session_rollups(otlp.parse_traces(traces, cfg).good, otlp.parse_logs(logs, cfg).good)
    assert got == sorted(tuple(r) for r in full.select(*COLS).collect())


def test_rebuild_state_equals_incremental(spark, cfg, tmp_path):
    root = str(tmp_path)
    landing, scratch = f"{root}/landing", local_scratch(root)
    land(fx.events_as_log_lines(spark, SF_SMALL, cfg), f"{landing}/logs", "a")
    store = TableStore(spark, f"{root}/tables", rollup_buckets=4)
    ingest.run_full(spark, landing, store, cfg, scratch)
    before = sorted(tuple(r) for r in store.read_rollups().select(*COLS).collect())
    ingest.rebuild_state(store, cfg, scratch)
    assert sorted(tuple(r) for r in store.read_rollups().select(*COLS).collect()) == before
