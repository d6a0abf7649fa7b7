"""op13 against a plain computation over words as text."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest

from costlens.llm import importance
from tests.llm.test_operators import ALNUM, LOWER, prose


def features(text: str | None, ngrams: int) -> list[str]:
    w = ALNUM.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, ngrams, buckets, percent=10, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, ngrams))
    t = Counter(bucket(f) for x in target for f in features(x, ngrams))
    all_s, all_t = s.total() + buckets, t.total() + buckets
    out = []
    for i, text in rows:
        found = features(text, ngrams)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(found), weight, score, len(features(text, 1)) >= min_words))
    order = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = [x[:4] for x in order[: len(order) * percent // 100]]
    ranks = Counter()
    rows = []
    for x in out:
        rank = None
        if x[4] and x[:4] in drawn:  # repeated rows take ranks one after another
            places = [n + 1 for n, y in enumerate(drawn) if y == x[:4]]
            rank = places[ranks[x[:4]]] if ranks[x[:4]] < len(places) else None
            ranks[x[:4]] += 1
        rows.append((*x[:4], rank))
    return Counter(rows)


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(i, 10 + 3 * i)) for i in range(60)]
    out += [(100 + i, out[50][1]) for i in range(40)]
    out += [(200, None), (201, ""), (202, " \x00 .,"), (None, out[40][1]), (7, out[45][1]), (7, out[45][1]), (203, "A b-C\x7fd É" * 9)]
    return out


@pytest.fixture(scope="module")
def target(rows):
    return [rows[50][1], rows[3][1], None, "", "É é a b"]


def frames(spark, rows, target):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, score int, key string")
    return docs.repartition(3), spark.createDataFrame([(t, 3) for t in target], "text string, n int")


@pytest.mark.parametrize("ngrams,buckets,percent", [(1, 10000, 10), (1, 13, 50), (3, 997, 30), (2, 10000, 100)])
def test_report(spark, rows, target, ngrams, buckets, percent):
    docs, wanted = frames(spark, rows, target)
    found = importance.report(docs, wanted, ngrams=ngrams, buckets=buckets, percent=percent)
    got = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect())
    assert got == brute(rows, target, ngrams, buckets, percent)


def test_resample_keeps_whole_rows(spark, rows, target):
    docs, wanted = frames(spark, rows, target)
    kept = importance.resample(docs, wanted, percent=30)
    assert kept.columns == docs.columns
    ranked = [r for r in brute(rows, target, 1, 10000, 30).elements() if r[4]]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in ranked)


def test_pieces_of_a_long_text(monkeypatch):
    text = prose(5, 4000)
    whole = [f for _, part in importance.buckets_of(text.encode(), 3, 10000) for f in part]
    monkeypatch.setattr(importance, "PIECE", 64)
    pieces = list(importance.buckets_of(text.encode(), 3, 10000))
    assert len(pieces) > 50 and sum(n for n, _ in pieces) == len(features(text, 1))
    assert Counter(f for _, part in pieces for f in part) == Counter(whole) == Counter(
        zlib.crc32(f.encode()) % 10000 for f in features(text, 3)
    )


def test_empty(spark, rows, target):
    docs, wanted = frames(spark, rows, target)
    assert importance.report(docs.limit(0), wanted).collect() == []
    assert importance.resample(docs.limit(0), wanted).collect() == []
    got = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in importance.report(docs, wanted.limit(0)).collect())
    assert got == brute(rows, [], 1, 10000)


def test_places_follow_the_order(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS g").repartition(5)
    placed = importance.numbered(df, df["g"].desc(), df["id"]).collect()
    assert [(r["g"], r["id"]) for r in sorted(placed, key=lambda r: r["place"])] == sorted(((i % 7, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    assert sorted(r["place"] for r in placed) == list(range(1, 5001))
