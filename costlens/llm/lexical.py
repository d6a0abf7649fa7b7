"""Ranked lexical search by the Best Position Algorithm.

Every query term has an impact list: the documents that hold it, by what the
term adds to their score, greatest first. A query reads its lists in parallel
from the front. Each document met is looked up in all the query's lists at once
(direct access), which gives its whole score and its positions there. The best
position of a list is the last one before which every position has been seen,
by reading or by direct access; no document that has not been met stands before
it. The sum of the impacts at the best positions therefore bounds every unmet
document, more tightly than the positions last read do, and a query stops as
soon as that bound is strictly below its kth score (an equal score may still win
by its smaller doc_id).

Documents are spread over tasks, each of which runs the algorithm over blocks of
its documents and hands the kth score on from block to block; the tasks' k best
are merged per query. Texts are read once: a written forward index keeps each
document's length and its counts of query terms, from which N, L and df come
as well. Queries travel to the tasks in blocks of about ``block_bytes`` of text,
measured before; each block of queries searches all documents.

Defined results: null, empty and word-less texts are no documents and no
queries; rows that repeat a doc_id are documents of their own; a null doc_id
comes last among equal scores; rows that repeat an item_id and its text are one
query, other texts of that item_id queries of their own; no documents or no
queries give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm import hashing
from costlens.llm.common import materialise, small_batches
from costlens.llm.importance import word_lists

#: A block of documents ends at so many postings or documents.
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 21, 1 << 17
_LAST = np.iinfo(np.int64).max


def term_counts(text: bytes) -> Counter[bytes]:
    """The terms of a whole text (all are alphanumeric ASCII or beyond ASCII)."""
    counts: Counter[bytes] = Counter()
    for words in word_lists(text):
        counts.update(words)
    return counts


# ---- forward index -------------------------------------------------------------
def _index_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            lengths, terms, tfs, ends = [], [], [], [0]
            for text in hashing.texts(batch.column(1)):
                counts = term_counts(b"" if text is None else text.tobytes())
                lengths.append(counts.total())
                for term in counts.keys() & number.keys():
                    terms.append(number[term])
                    tfs.append(counts[term])
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


def forward_index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms and tfs (those that ``number`` knows) of
    every document with at least one term, written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(number)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = "doc_id long, n long, terms array<int>, tfs array<int>"
    return materialise(rows.mapInArrow(_index_task(shared), kept).filter("n > 0"), "forward-index")


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0)))


# ---- the search ------------------------------------------------------------------
class Best:
    """The k best (score, doc_id) of one query so far."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def kth(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        some = np.flatnonzero(scores >= max(self.kth, 1))
        if not len(some):
            return
        scores = np.concatenate([self.scores, scores[some]])
        ids, nulls = np.concatenate([self.ids, ids[some]]), np.concatenate([self.nulls, nulls[some]])
        first = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[first], ids[first], nulls[first]


class Block:
    """Impact lists of one block of documents, with direct access by document."""

    def __init__(self, ids, nulls, lengths, ends, terms, tfs, weights, n_docs, total):
        self.ids, self.nulls = ids, nulls
        doc = np.repeat(np.arange(len(ids)), np.diff(ends))
        m = 75 + (25 * lengths * n_docs) // total
        tf = tfs.astype(np.int64)
        impact = weights[terms] * ((1000000000 * tf) // (1000 * tf + 12 * m[doc]))
        by_doc = np.argsort(terms, kind="stable")  # by term, then document
        terms, self.doc, self.impact = terms[by_doc], doc[by_doc], impact[by_doc]
        self.starts = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.by_impact = np.lexsort((-self.impact, terms))  # by term, then impact from the greatest
        self.position = np.empty(len(terms), np.int64)
        self.position[self.by_impact] = np.arange(len(terms))
        self.position -= self.starts[terms]

    def search(self, query: list[tuple[int, int]], best: Best, step: int = 64) -> int:
        """Offer ``best`` what it needs of this block; returns how many
        documents were met. ``query`` has (term, repeats)."""
        lists = [(self.starts[t], self.starts[t + 1], r) for t, r in query if self.starts[t] < self.starts[t + 1]]
        if not lists:
            return 0
        met = np.zeros(len(self.ids), bool)
        seen = [np.zeros(end - start, bool) for start, end, _ in lists]
        best_position = [0] * len(lists)
        depth, longest = 0, max(len(s) for s in seen)
        while depth < longest:
            read = [self.doc[self.by_impact[start + depth : min(start + depth + step, end)]] for start, end, _ in lists]
            fresh = np.unique(np.concatenate(read))
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            scores = np.zeros(len(fresh), np.int64)
            bound = 0
            for i, (start, end, repeats) in enumerate(lists):
                docs = self.doc[start:end]
                at = np.searchsorted(docs, fresh)
                at[at == len(docs)] = 0
                there = docs[at] == fresh
                at = at[there] + start
                scores[there] += repeats * self.impact[at]
                seen[i][self.position[at]] = True
                ahead = seen[i][best_position[i] :]
                gap = int(np.argmin(ahead)) if len(ahead) else 0
                best_position[i] += len(ahead) if len(ahead) and ahead[gap] else gap
                if best_position[i] < end - start:  # what no document met stands behind the best position
                    bound += repeats * int(self.impact[self.by_impact[start + best_position[i] - 1]])
            best.offer(scores, self.ids[fresh], self.nulls[fresh])
            if bound < best.kth:
                break
            depth, step = depth + step, step * 2
        return int(met.sum())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """ids, nulls, lengths, ends, terms, tfs of a block of documents at a time."""
    held, postings, docs = [], 0, 0
    for batch in batches:
        held.append(batch)
        postings, docs = postings + len(batch.column(2).flatten()), docs + batch.num_rows
        if postings >= BLOCK_POSTINGS or docs >= BLOCK_DOCS:
            yield _arrays(held)
            held, postings, docs = [], 0, 0
    if held:
        yield _arrays(held)


def _arrays(held: list[pa.RecordBatch]) -> tuple:
    table = pa.Table.from_batches(held).combine_chunks()
    ids, n, terms, tfs = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns)
    ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False))]).astype(np.int64)
    nulls = ids.is_null().to_numpy(zero_copy_only=False)
    return (
        ids.fill_null(_LAST).to_numpy(zero_copy_only=False), nulls, n.to_numpy(zero_copy_only=False), ends,
        terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False),
    )


def _search_task(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n_docs, total = shared.value
        best = [Best(k) for _ in queries]
        for arrays in _blocks(batches):
            block = Block(*arrays, weights, n_docs, total)
            for query, found in zip(queries, best):
                block.search(query, found)
        sizes = [len(b.scores) for b in best]
        if not sum(sizes):
            return
        number = np.repeat(np.arange(len(best), dtype=np.int32), sizes)
        ids, nulls, scores = (np.concatenate([getattr(b, part) for b in best]) for part in ("ids", "nulls", "scores"))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids, mask=nulls), pa.array(scores)], ["query", "doc_id", "score"])

    return run


def _query_blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Distinct items with a text, in blocks of about ``block_bytes``."""
    texts = items.select("item_id", "text").filter("text IS NOT NULL AND text != ''").distinct()
    total = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(1, -(-total // block_bytes))
    return [texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def _block_top(docs: DataFrame, block: DataFrame, k: int) -> DataFrame | None:
    items = [(r["item_id"], term_counts(r["text"].encode())) for r in block.collect()]
    items = [(item, counts) for item, counts in items if counts]
    if not items:
        return None
    spark = docs.sparkSession
    number = {term: i for i, term in enumerate(sorted(set().union(*(counts for _, counts in items))))}
    index = forward_index(docs, number)
    sizes = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    # At most one row a term of this block.
    found = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    dfs = {r["term"]: r["df"] for r in found}
    weights = np.array([weight_of(sizes["docs"], dfs.get(i, 0)) for i in range(len(number))], np.int64)
    queries = [sorted((number[t], r) for t, r in counts.items()) for _, counts in items]
    shared = spark.sparkContext.broadcast((queries, weights, sizes["docs"], sizes["terms"] or 1))
    best = index.mapInArrow(_search_task(shared, k), "query int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    kind = block.schema["item_id"].dataType.simpleString()
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], f"query int, item_id {kind}")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = 8 << 20) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = [p for b in _query_blocks(items, block_bytes) if (p := _block_top(docs, b, k)) is not None]
    if not parts:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united
