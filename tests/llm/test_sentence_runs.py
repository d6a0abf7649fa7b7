"""What the sentence dedup sends, and its result on odd rows."""

import random

import pyarrow as pa

from costlens.llm import sentences


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def sent(rows):
    """Numbers of elements that carry a run, of all rows of one batch."""
    batch = pa.RecordBatch.from_pylist(
        [{"doc_id": i, "key": hash(t) if t else 42, "text": t} for i, t in rows],
        pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("text", pa.string())]),
    )
    (out,) = sentences._hash_runs(2, 16)(iter([batch]))
    return [sum(e["h"] is not None for e in r) for r in out.column(2).to_pylist()]


def test_a_batch_sends_a_run_once():
    passage = ". ".join(words(s, 12) for s in range(20))
    alone = sent([(1, passage)])[0]
    assert alone > 20
    # The least doc_id's are sent, wherever it stands; one without comes last.
    assert sent([(None, passage), *((i, passage) for i in range(300, 0, -1))]) == [0] * 300 + [alone]
    # Rows that repeat doc_id and text have one place: neither goes before the other.
    assert sent([(1, passage), (1, passage)]) == [alone, alone]
    assert sent([(1, None), (2, ""), (3, "few words")]) == [0, 0, 0] and sent([]) == []


def test_nulls_repeats_and_batches_equal_brute_force(spark):
    rng = random.Random(3)
    passages = [". ".join(words(100 + s, 15) for _ in range(2)) for s in range(12)]
    rows = [(i % 900 if i % 7 else None, f"{words(5000 + i, rng.randrange(40))}.\n{rng.choice(passages)}.\n{rng.choice(passages)}") for i in range(1500)]
    rows += [(None, None), (None, None), (None, ""), (3, ""), (4, " \n two words"), (5, "İstanbul ΣΑΣ " * 30), (6, "İstanbul ΣΑΣ " * 30), rows[8], rows[8], rows[14]]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys = {r.text: r.key for r in docs.selectExpr("text", "xxhash64(text) as key").collect()}
    seen, want = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, keys[r[1]])):
        bounds = sentences.sentences_of(text) if text else []
        parts = [text[a:b].lower().split() for a, b in bounds]
        gone = set()
        for first, after in sorted(sentences.runs_of([len(p) for p in parts], 2, 16)):
            run = "\n".join(" ".join(p) for p in parts[first:after])
            if run in seen:
                gone.update(range(first, after))
            seen.add(run)
        left = text if not gone else "".join(text[a:b] for k, (a, b) in enumerate(bounds) if k not in gone)
        want[doc_id, text] = (doc_id, left, len(bounds), len(gone), sorted(gone))
    found = [tuple(r) for r in sentences.remove_repeats(docs).collect()]
    assert sorted(found, key=str) == sorted((want[r] for r in rows), key=str)
    plan = sentences.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1  # runs are made and sent once
