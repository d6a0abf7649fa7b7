"""op11 against a search that scores every document for every item."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from costlens.llm import lexical
from tests.llm.test_operators import LOWER, frame, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows: list[tuple], items: list[tuple], k: int = 20) -> set[tuple]:
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    found = set()
    for item, text in set(items):
        scored = []
        for i, c in docs:
            m = 75 + (25 * c.total() * n_docs) // total
            score = sum(
                r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, r in Counter(TERM.findall((text or "").translate(LOWER))).items()
                if t in c
            )
            scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1):
            found.add((item, rank, i, -score))
    return found


def rows_of(df):
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = np.arange(60, 0, -1) ** 2.0
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 80), p=weights / weights.sum()))) for i in range(400)]
    rows += [(1000 + i, rows[7][1].upper()) for i in range(60)]  # one large tie
    rows += [(2000, None), (2001, ""), (2002, " -- !"), (None, rows[3][1]), (5, rows[5][1]), (2003, "É é ñ w1é Ç" * 4)]
    return rows


@pytest.fixture(scope="module")
def items(corpus):
    return [
        (1, corpus[7][1]), (2, "W1 w2, w59-w59 w58"), (3, "absent terms"), (4, None), (5, "?"), (6, "w0"), (6, "w0"), (6, "w3"),
        (None, "w57 w56"), (8, "É é w1é"),
    ]


def test_all_scores(spark, corpus, items):
    docs = spark.createDataFrame([(i, t, 9, "q") for i, t in corpus], "doc_id long, text string, rank int, query string")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    want = brute(corpus, items)
    assert len(want) > 80
    assert rows_of(lexical.top_documents(docs.repartition(3), asked)) == want
    # several blocks of queries
    assert rows_of(lexical.top_documents(docs, asked, block_bytes=40)) == want
    assert rows_of(lexical.top_documents(docs, asked, k=3)) == brute(corpus, items, 3)


def test_no_rows(spark, corpus, items):
    none = frame(spark, {1: "x"}).limit(0)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.top_documents(none, asked).collect() == []
    assert lexical.top_documents(frame(spark, {1: "w1"}), asked.limit(0)).collect() == []
    assert lexical.top_documents(frame(spark, {1: None}), asked).collect() == []


def test_very_long_text(spark):
    long = "aa bb " * 400_000 + "cc"
    rows = {1: long, 2: "cc dd", 3: prose(1, 50)}
    asked = spark.createDataFrame([(1, "cc dd aa")], "item_id long, text string")
    assert rows_of(lexical.top_documents(frame(spark, rows), asked)) == brute(list(rows.items()), [(1, "cc dd aa")])


def block_of(n_docs: int, seed: int) -> tuple[lexical.Block, np.ndarray]:
    rng = np.random.default_rng(seed)
    terms = [np.sort(rng.choice(30, rng.integers(1, 12), replace=False)) for _ in range(n_docs)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    tfs = rng.integers(1, 5, ends[-1]).astype(np.int32)
    lengths = rng.integers(12, 90, n_docs)
    weights = rng.integers(100, 6000, 30)
    ids, nulls = rng.permutation(n_docs), np.zeros(n_docs, bool)
    block = lexical.Block(ids, nulls, lengths, ends, np.concatenate(terms).astype(np.int32), tfs, weights, n_docs, int(lengths.sum()))
    return block, ids


@pytest.mark.parametrize("seed", range(6))
def test_stops_early_and_rightly(seed):
    """With short steps the search meets a part of the documents, and what it
    has not met could not have won."""
    block, ids = block_of(3000, seed)
    for query in ([(3, 1)], [(1, 1), (2, 2)], [(4, 1), (5, 1), (6, 3), (7, 1)]):
        best, all_of_them = lexical.Best(5), lexical.Best(5)
        met = block.search(query, best, step=4)
        scores = np.zeros(len(ids), np.int64)
        for t, r in query:
            part = slice(block.starts[t], block.starts[t + 1])
            scores[block.doc[part]] += r * block.impact[part]
        all_of_them.offer(scores, block.ids, block.nulls)
        assert best.scores.tolist() == all_of_them.scores.tolist() and best.ids.tolist() == all_of_them.ids.tolist()
        assert met < np.count_nonzero(scores)


def test_a_better_kth_stops_sooner():
    block, _ = block_of(3000, 1)
    best = lexical.Best(5)
    first = block.search([(4, 1), (5, 1)], best, step=4)
    assert 0 < block.search([(4, 1), (5, 1)], best, step=4) <= first


def test_equal_scores_at_the_bound_are_read_on():
    """All documents score alike: only a bound strictly below may stop."""
    n = 500
    ends, ids = np.arange(n + 1), np.arange(n)[::-1].copy()
    one = np.ones(n, np.int32)
    block = lexical.Block(ids, np.zeros(n, bool), one.astype(np.int64), ends, np.zeros(n, np.int32), one, np.array([1000]), n, n)
    best = lexical.Best(3)
    assert block.search([(0, 1)], best, step=4) == n
    assert best.ids.tolist() == [0, 1, 2]
