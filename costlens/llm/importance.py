"""Importance resampling towards a target distribution.

Texts become bags of hashed n-grams. One ``bytes.translate`` with a 256-byte
table lower-cases A-Z and blanks every separator of the UTF-8 text and
``bytes.split`` yields the words. A word's crc32 seeds the crc32 of the n-gram
that goes on with the next word, so longer n-grams cost one call a word. Each
task adds its features up in one Counter of at most ``buckets`` entries, which
are reduced by a shuffle of as many rows a task. The gain of a bucket is the
log ratio of its smoothed shares in the target and in the corpus; a document
weighs the sum of its features' gains, and the highest weights with Gumbel
noise are a weighted draw without replacement.

Texts are read twice (counts, then weights) and never shuffled; what is ordered
are the scores. The table of gains has ``buckets`` longs and is the only thing
that travels to the tasks.

Defined results: null, empty and word-less texts have no features and weight 0;
a null doc_id takes its noise from the seed and an empty id and comes last among
equal scores; rows that repeat a document are drawn one by one; an empty target
leaves the corpus' own shares to decide; an empty corpus gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm import hashing
from costlens.llm.common import materialise, small_batches

#: Lower-cases A-Z and turns every ASCII character but letters and digits into
#: a blank; bytes of longer characters stay.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


#: Texts are split in pieces of about so many bytes, cut at blanks.
PIECE = 1 << 20


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text, piece by piece."""
    data = text.translate(WORD_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield (data[at:end] if at or end < len(data) else data).split()
        at = end


def buckets_of(text: bytes, ngrams: int, buckets: int) -> Iterator[tuple[int, list[int]]]:
    """Of each piece of a text its number of words and the bucket of every run
    of 1 to ``ngrams`` words that ends in it."""
    before: list[bytes] = []
    for piece in word_lists(text):
        words = before + piece
        seeds = [crc32(w) for w in words]
        found = [s % buckets for s in seeds[len(before) :]]
        for n in range(1, ngrams):
            seeds = [crc32(w, crc32(b" ", s)) for s, w in zip(seeds, words[n:])]
            found += [s % buckets for s in seeds[max(len(before) - n, 0) :]]
        yield len(piece), found
        before = words[max(len(words) - ngrams + 1, 0) :]


def _count_task(ngrams: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in hashing.texts(batch.column(0)):
                for _, found in buckets_of(b"" if text is None else text.tobytes(), ngrams, buckets):
                    counts.update(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"]
        )

    return run


def feature_counts(texts: DataFrame, ngrams: int, buckets: int) -> DataFrame:
    """(bucket, n) over all rows of ``texts``: at most ``buckets`` rows."""
    small_batches(texts.sparkSession)
    counted = texts.select("text").mapInArrow(_count_task(ngrams, buckets), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln(target share / corpus share)) of every bucket, each share
    smoothed by one count a bucket."""
    in_corpus, in_target = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1) * in_corpus / ((corpus.get(b, 0) + 1) * in_target)))
        for b in range(buckets)
    ]


def _weigh_task(shared, ngrams: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.__getitem__
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for text in hashing.texts(batch.column(1)):
                words = features = weight = 0
                for n, found in buckets_of(b"" if text is None else text.tobytes(), ngrams, buckets):
                    words, features, weight = words + n, features + len(found), weight + sum(map(gain, found))
                n_words.append(words)
                n_features.append(features)
                weights.append(weight)
            numbers = [pa.array(x, pa.int64()) for x in (n_words, n_features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers], ["row", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from the document's id and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(rows: DataFrame, corpus: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = 10000) -> DataFrame:
    """``rows`` has columns row (a struct, passed through) and text; returns row,
    n_words, n_features and weight against the shares of ``corpus`` and ``target``."""
    small_batches(rows.sparkSession)
    # Both tables hold at most one row a bucket.
    counts = [{r["bucket"]: r["n"] for r in feature_counts(t, ngrams, buckets).collect()} for t in (corpus, target)]
    shared = rows.sparkSession.sparkContext.broadcast(gains_of(*counts, buckets))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "text").mapInArrow(
        _weigh_task(shared, ngrams, buckets), f"row {kind}, n_words long, n_features long, weight long"
    )


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``place`` (from 1) along ``order`` over all rows.

    Rows are dealt by ranges of the order and sorted there; the written table's
    partition sizes, one number a partition, place each range."""
    at = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    placed = materialise(ordered, "ordered").withColumn("range", F.shiftright("at", 33))
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("range", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "range").withColumn("place", F.col("before") + inside + 1).drop("range", "before", "at")


def scores(
    docs: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = 10000, seed: str = "2024", percent: int = 10,
    min_words: int = 20, columns: list[str] | None = None,
) -> DataFrame:
    """Every document's row (the named columns), n_features, weight, score and
    rank; the rank is null where the draw of ``percent`` in a hundred of the
    documents with ``min_words`` words leaves it out."""
    kept = columns or ["doc_id"]
    rows = docs.select(
        F.struct(F.col("doc_id").alias("key"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept")).alias("row"), "text"
    )
    weighed = weigh(rows, docs, target, ngrams, buckets)
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(F.col("row.key"), seed)), "importance")
    candidates = scored.filter(F.col("n_words") >= min_words).count()
    drawn = candidates * percent // 100
    placed = numbered(
        scored,
        (F.col("n_words") >= min_words).desc(),
        F.col("score").desc(),
        F.col("row.key").asc_nulls_last(),
        F.col("weight"),
        F.col("n_features"),
    )
    return placed.select(
        F.col("row.kept").alias("row"), "n_features", "weight", "score",
        F.when(F.col("place") <= drawn, F.col("place")).alias("rank"),
    )


def report(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    found = scores(docs, target, **options)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, whole rows."""
    return scores(docs, target, columns=docs.columns, **options).filter("rank IS NOT NULL").select("row.*")
