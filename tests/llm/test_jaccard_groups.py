"""A large group of copies that were edited each in its own way."""

import random

from costlens.llm import jaccard


def test_edited_copies_equal_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = f"x{i}-{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(148)} for t in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs, 3, 90).collect()}
    assert found == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert 1 < len(set(root)) < len(root)


def linked_texts():
    """B is near A and near C, which are not near each other (5 words, 0.8)."""
    a = [f"w{i}" for i in range(100)]
    b, c = list(a), list(a)
    for place in (20, 50):
        b[place] = c[place] = f"x{place}"
    for place in (65, 80):
        c[place] = f"y{place}"
    return [" ".join(w) for w in (a, b, c)]


def test_null_doc_ids_carry_links(spark):
    a, b, c = linked_texts()
    grams = [{tuple(t.split()[k : k + 5]) for k in range(96)} for t in (a, b, c)]
    near = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    assert near(grams[0], grams[1]) and near(grams[1], grams[2]) and not near(grams[0], grams[2])
    docs = spark.createDataFrame([(1, a), (None, b), (3, c), (None, None), (7, "alone")], "doc_id long, text string")
    found = sorted((r.component_id is None, r.component_id, r.doc_id or 0) for r in jaccard.components_of(docs).collect() if r.n_shingles)
    assert found == [(False, 1, 0), (False, 1, 1), (False, 1, 3), (False, 7, 7)]
    kept = jaccard.keep_one(docs).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (1, a), (7, "alone")]


def test_repeated_doc_ids_keep_their_other_texts(spark):
    a, b, _ = linked_texts()
    rows = [(1, a, "r"), (2, b, "r"), (2, "an unrelated text", "r"), (2, "an unrelated text", "r"), (None, "words of nobody", "r"), (5, "", "r"), (5, "", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["row"] for r in kept.collect()} == {"r"}
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "words of nobody"), (1, a), (2, "an unrelated text"), (5, "")]
