"""Benchmark of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is fully materialised with the ``noop`` sink (every column is
computed, nothing is collected), once to warm up and then BENCH_RUNS
times; the median is reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from costlens import schemas  # noqa: E402
from costlens.config import configure_session  # noqa: E402
from costlens.operators import economics, hygiene, merge, rollup  # noqa: E402
from costlens.plans import registry  # noqa: E402
from costlens.sinks.tables import TableStore, local_scratch  # noqa: E402
from costlens.streaming import ingest  # noqa: E402
from costlens.sources import fixtures as fx  # noqa: E402
from costlens.sources import otlp  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
CFG = registry.CFG
# the last 1 % of the month (7.2 hours) of one session in a hundred, chosen
# by a hash of the session id; every other row is the earlier load.
LATEST_LOAD_FROM = "2024-01-30 16:48:00"
TOUCHED_SHARE = 100


class _Action:
    """A timed step that writes tables itself (the incremental refresh)."""

    def __init__(self, fn):
        self.fn = fn


def _run(q) -> None:
    if isinstance(q, _Action):
        q.fn()
    else:
        q.write.format("noop").mode("overwrite").save()


def _as_raw(df, schema):
    """Adapter rows in the stored raw-table shape (missing columns null)."""
    cols = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields]
    return df.select(*[c.alias(f.name) for c, f in zip(cols, schema.fields)])


def build_session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("costlens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(CPUS * 2))
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure_session(spark)


def main() -> None:
    spark = build_session()
    sf = SF_DIR
    scratch = tempfile.mkdtemp(prefix="costlens-bench-")

    # Stored state for the incremental refresh: raw tables by day and batch
    # (batch 0 = everything before the latest load, batch 1 = the latest 1 %),
    # and the slice state + rollups as of batch 0. The timed step is the
    # refresh of batch 1 (replay-safe, so it can be repeated).
    store = TableStore(spark, f"{scratch}/tables", rollup_buckets=CPUS * 8)
    ckpt = local_scratch(scratch)
    sp, ev = fx.spans(spark, sf), fx.raw_events(spark, sf)
    late = F.lit(LATEST_LOAD_FROM).cast("timestamp")
    picked = F.pmod(F.xxhash64("session_id"), F.lit(TOUCHED_SHARE)) == 0
    new_s, new_e = (F.col("start_ts") >= late) & picked, (F.col("ts") >= late) & picked
    for bid, cond_s, cond_e in ((0, ~new_s, ~new_e), (1, new_s, new_e)):
        store.write_batch("raw_spans", _as_raw(sp.filter(cond_s), schemas.RAW_SPANS), bid, day_of="start_ts")
        store.write_batch("raw_events", _as_raw(ev.filter(cond_e), schemas.RAW_EVENTS), bid, day_of="ts")
    ingest.refresh_touched(store, 0, CFG, ckpt)

    queries = {
        "parse_otlp_logs": lambda: otlp.parse_logs(fx.events_as_log_lines(spark, sf, CFG), CFG).good,
        "session_rollups": lambda: rollup.session_rollups(fx.spans(spark, sf), fx.raw_events(spark, sf)),
        "ticket_rollup": lambda: economics.ticket_rollup(
            rollup.session_rollups(fx.spans(spark, sf), fx.raw_events(spark, sf)),
            fx.issue_rows(spark, sf), fx.rate_config(spark)),
        "testing_discipline": lambda: hygiene.testing_discipline_daily(fx.raw_events(spark, sf)),
        "refresh_1pct": lambda: _Action(lambda: ingest.refresh_touched(store, 1, CFG, ckpt)),
        "big_span_rollups": lambda: rollup.session_rollups(fx.spans_big(spark, sf), None),
        "big_span_dedup": lambda: merge.spans_to_append(
            None, fx.spans_big(spark, sf).withColumn("_seq", F.struct("session_id", "trace_id", "start_ts"))),
        "big_fanout": lambda: hygiene.subagent_fanout_by_session(fx.spans_big(spark, sf)),
    }
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    timings = {}
    for name, build in queries.items():
        if only and name not in only:
            continue
        _run(build())  # warm-up
        runs = []
        for _ in range(RUNS):
            t0 = time.perf_counter()
            _run(build())
            runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs), 4)
    total = round(sum(timings.values()), 4)
    sf_name = os.path.basename(os.path.normpath(sf)).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": timings,
        "sf": float(sf_name) if sf_name.replace(".", "").isdigit() else sf_name,
        "cpus": CPUS,
        "runs": RUNS,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
