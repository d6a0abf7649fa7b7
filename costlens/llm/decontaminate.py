"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is the set of its windows (``window`` consecutive words; an
item of fewer words is one window), a document contains a window if the
window's words stand in it in a row. Each window is a sequence of word
shingles. The shingles are ordered by rarity over *all* documents; full
containment makes the necessary prefix one token long, so a window is joined
with the documents through its rarest shingle only. A match must leave room
for the rest of the window: the shingle's place in the window and in the
document bound where the window begins (position) and how many words must
follow (length). What passes is verified word for word.

Documents are read twice (shingle counts, then the join) and never shuffled.
The benchmark's side travels to the tasks in blocks of about ``block_bytes``
of text, measured before; a benchmark beyond one block is processed block by
block against all documents and the blocks' hits are merged per document.

Defined results: null, empty and word-less texts have no words and no hits;
items without words never occur; rows that repeat an item_id are one item (a
null item_id is named by the empty string);
repeated documents are judged one by one; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm import hashing
from costlens.llm.common import materialise, small_batches

SHINGLE = 5
_BITS = 20


class Members:
    """Is a hash one of a sorted set? A bit table answers most lookups."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.table = np.zeros(1 << _BITS, dtype=bool)
        self.table[self.values >> np.uint64(64 - _BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are members, and which members."""
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - _BITS)])
        if not len(at):
            return at, at
        slot = np.searchsorted(self.values, hashes[at])
        slot[slot == len(self.values)] = 0
        same = self.values[slot] == hashes[at]
        return at[same], slot[same]


def _words(text: np.ndarray | None) -> tuple[np.ndarray, list[bytes] | None, tuple]:
    if text is None:
        empty = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), None, (b"", empty, empty)
    data = hashing.lower_ascii(text)
    h, starts, ends = hashing.word_hashes(data, hashing.ALPHANUMERIC)
    return h, None, (data, starts, ends)


def _phrase(place: tuple, start: int, length: int) -> bytes:
    data, starts, ends = place
    return b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(start, start + length))


@dataclass
class Window:
    item: str
    words: bytes
    length: int
    shingles: np.ndarray


def windows_of(item: str, text: str | None, window: int) -> list[Window]:
    raw = None if text is None else np.frombuffer(text.encode(), dtype=np.uint8)
    h, _, place = _words(raw)
    if not len(h):
        return []
    length = min(window, len(h))
    size = min(SHINGLE, length)
    return [
        Window(item, _phrase(place, i, length), length, hashing.sequence_hashes(h[i : i + length], size))
        for i in range(len(h) - length + 1)
    ]


def _count_task(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = {size: Members(v) for size, v in tables.value.items()}
        counts = {size: np.zeros(len(m.values), dtype=np.int64) for size, m in members.items()}
        for batch in batches:
            for text in hashing.texts(batch.column(0)):
                h, _, _ = _words(text)
                for size, m in members.items():
                    _, slots = m.find(hashing.sequence_hashes(h, size))
                    if len(slots):
                        np.add.at(counts[size], slots, 1)
        for size, m in members.items():
            some = np.flatnonzero(counts[size])
            yield pa.RecordBatch.from_arrays(
                [pa.array(m.values[some].view(np.int64)), pa.array(counts[size][some])], ["shingle", "n"]
            )

    return run


def _join_task(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, windows, by_size = index.value
        members = {size: Members(np.array(list(d), dtype=np.uint64)) for size, d in by_size.items()}
        for batch in batches:
            n_words, spans, found = [], [], []
            for text in hashing.texts(batch.column(1)):
                h, _, place = _words(text)
                hits: set[tuple[int, int]] = set()
                occurring: set[int] = set()
                for size, m in members.items():
                    at, slots = m.find(hashing.sequence_hashes(h, size))
                    for p, slot in zip(at.tolist(), slots.tolist()):
                        for w, offset in by_size[size][int(m.values[slot])]:
                            item, words, length = windows[w]
                            start = p - offset
                            if start < 0 or start + length > len(h):
                                continue
                            if (start, length) in hits and item in occurring:
                                continue
                            if _phrase(place, start, length) == words:
                                hits.add((start, length))
                                occurring.add(item)
                n_words.append(len(h))
                spans.append([{"start": s, "end": s + n} for s, n in sorted(hits)])
                found.append([items[i] for i in sorted(occurring)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(found, pa.list_(pa.string())),
                ],
                ["row", "n_words", "spans", "items"],
            )

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark cut by item into blocks of about ``block_bytes``."""
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    items = benchmark.select(name.alias("item"), "text").filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(1, -(-total // block_bytes))
    return [items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == b) for b in range(n)]


def _block_hits(rows: DataFrame, schema: str, block: DataFrame, window: int) -> DataFrame:
    """(row, n_words, spans, items) of every document against one block."""
    spark = rows.sparkSession
    windows = [w for r in block.distinct().collect() for w in windows_of(r["item"], r["text"], window)]
    tables: dict[int, np.ndarray] = {}
    for w in windows:
        tables.setdefault(min(SHINGLE, w.length), []).append(w.shingles)
    tables = {size: np.unique(np.concatenate(v)) for size, v in tables.items()}
    counts: dict[int, int] = {}
    if windows:
        shared = spark.sparkContext.broadcast(tables)
        counted = rows.select("text").mapInArrow(_count_task(shared), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        # At most one row per shingle of this block.
        counts = {int(np.uint64(r["shingle"] & 0xFFFFFFFFFFFFFFFF)): r["n"] for r in counted.collect()}
    names = sorted({w.item for w in windows})
    number = {name: i for i, name in enumerate(names)}
    by_size: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for k, w in enumerate(windows):
        order = [(counts.get(int(h), 0), int(h), i) for i, h in enumerate(w.shingles)]
        rare, token, offset = min(order)
        if rare:  # a shingle that no document has ends the window here
            by_size.setdefault(min(SHINGLE, w.length), {}).setdefault(token, []).append((k, offset))
    index = spark.sparkContext.broadcast((names, [(number[w.item], w.words, w.length) for w in windows], by_size))
    return rows.mapInArrow(
        _join_task(index), f"row {schema}, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    )


def hits(rows: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """``rows`` has columns row (a struct, passed through) and text. Returns
    row, n_words, spans (start and end word of each occurrence) and items."""
    small_batches(rows.sparkSession)
    schema = rows.schema["row"].dataType.simpleString()
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        return _block_hits(rows, schema, blocks[0], window)
    keyed = rows.select(F.struct("row", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).alias("row"), "text")
    inner = keyed.schema["row"].dataType.simpleString()
    parts = [_block_hits(keyed, inner, b, window).withColumn("block", F.lit(i)) for i, b in enumerate(blocks)]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    # A document meets itself in at most one row a block and copy.
    merged = materialise(united, "benchmark-hits").groupBy("row").agg(
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.sum((F.col("block") == 0).cast("int")).alias("copies"),
    )
    again = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return again.select(F.col("row.row").alias("row"), "n_words", "spans", "items")


def covered(spans: Column) -> Column:
    """Number of words inside any of the spans."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.sort_array(spans),
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """One row per document: words, hit words, items, verdict."""
    rows = docs.select(F.struct("doc_id").alias("row"), "text")
    n_hit = covered(F.col("spans"))
    return hits(rows, benchmark, window).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
        "items",
    )


def filter_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The documents that are not contaminated, whole rows."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    found = hits(rows, benchmark, window)
    return found.filter(~is_contaminated(covered(F.col("spans")), F.col("n_words"))).select("row.*")
