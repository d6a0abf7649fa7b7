"""What the Jaccard join sends of a set, and that linked sets still meet."""

import random

import numpy as np

from costlens.llm import jaccard


def test_a_set_sends_a_fifth_of_its_n_grams(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(300))) for i in range(20)], "doc_id long, text string")
    for r in jaccard.describe(docs, 5, 80).collect():
        assert 0 < len(r.marks) <= r.n * 20 // 100 + 1


def test_linked_sets_share_a_first_n_gram_in_any_order():
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        for n in (1, 2, 9, 10, 47, 300):
            late = rng.integers(0, 9, jaccard.COUNTERS).astype(np.uint8)
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = n * (100 - percent) // (100 + percent)
            b = np.unique(np.concatenate([a[rng.permutation(n)[most:]], rng.integers(0, 2**63, most).astype(np.uint64)]))
            assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
            assert np.intersect1d(jaccard.first_grams(a, late, percent), jaccard.first_grams(b, late, percent)).size
