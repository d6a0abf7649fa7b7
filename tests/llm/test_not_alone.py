"""Sets with many n-grams of their own leave although chance shares the others."""

import random

from pyspark.sql import functions as F

from costlens.llm import jaccard


def test_half_shared_texts_leave_and_copies_stay(spark):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(240)]
    halves = [passage + [f"own{k}-{i}" for i in range(170)] for k in range(4)]
    copy = [f"c{i}" for i in range(300)]
    edited = list(copy)
    edited[rng.randrange(300)] = "other"
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([*halves, copy, edited])], "doc_id long, text string")
    sets = jaccard.describe(docs, 3, 90).select("doc_id", F.xxhash64("key").alias("id"), "key", "n", "row")
    left = jaccard._not_alone(docs, sets.drop("doc_id"), 3, 90)
    assert left.columns == ["id", "key", "n"]
    assert {r.doc_id for r in sets.join(left.select("key"), "key").collect()} == {4, 5}
    found = {r.doc_id: r.component_id for r in jaccard.components_of(docs, 3, 90).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
