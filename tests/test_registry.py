"""Every registered query against its DuckDB twin on the sf0.001 tables
(the driver's check, at the smallest scale)."""

import datetime as dt
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from costlens.plans import registry
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF_SMALL}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "c_total_usd" in df.columns


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, duck, name):
    sdf = registry.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in sdf.collect())
    cur = duck.execute(registry.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(ocols) == cols
    want = Counter(tuple(norm(dict(zip(ocols, r))[c]) for c in cols) for r in cur.fetchall())
    assert got == want
