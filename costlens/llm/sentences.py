"""Substring dedup by sliding sentence spans.

A text is cut into sentences, and long sentences into parts at words that their
own content chooses (both are called sentences below), so that a repeated
passage of 50 words or more always holds a run, whatever its marks. From every sentence on, and up to every
sentence, the shortest run of at least ``sentences`` consecutive sentences
with at least ``words`` words is hashed (both ways, so that the ends of a
repeated passage are covered too). Runs are joined globally by their hash. The
first occurrence of a run (smallest doc_id, then place) stays; sentences that
any later occurrence covers are removed, in other documents or further down
the same one.

Each batch of rows compares its own runs first: an occurrence after another
one of the batch is surely removed, so a run that very many documents share is
sent to the join once a batch, and no task gets all its occurrences. Runs are
sent once, and the texts once, to the join with what is removed from them; the
sentences' bounds come along, so that no text is cut into sentences twice.
Hashes have 96 bits.

Defined results: null texts stay null, with no sentences; empty texts stay;
a text of fewer words than a run has none and stays; rows that repeat doc_id
and text are one document and get the same result each; other ties in doc_id
are ordered by a hash of the text; a null doc_id sorts last; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm.common import small_batches

# A sentence ends after its marks and closing quotes at white space, or at a
# line feed; the white space belongs to it.
END = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|\n\s*")
WORD = re.compile(r"\S+")
#: With it any repeated passage of 50 words holds, wherever it starts, a run
#: of two parts and 16 words: the parts' bounds in its words 10 to 42 are the
#: same in all copies, the first of them among the first 9, the last as well.
WINDOW = 9


#: Words whose hash a task remembers.
REMEMBERED = 1 << 16
_crc: dict[str, int] = {}


def _word_hashes(lowered: list[str]) -> np.ndarray:
    if len(_crc) > REMEMBERED:
        _crc.clear()
    hashes = []
    for w in lowered:
        h = _crc.get(w)
        if h is None:
            h = _crc[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        hashes.append(h)
    return np.array(hashes, dtype=np.int64)


def _bounds(text: str, starts: np.ndarray, lowered: list[str]) -> np.ndarray:
    """Bounds of the sentences and parts of ``text``, whose lower-case words
    are ``lowered`` and begin at ``starts``."""
    ends = [m.end() for m in END.finditer(text)]
    cuts = np.array([0, *ends, len(text)], dtype=np.int64)
    if len(starts) > WINDOW:
        begins = np.zeros(len(starts), dtype=bool)
        if ends:
            at = np.searchsorted(starts, ends)
            inner = at < len(starts)
            at, ends = at[inner], np.array(ends)[inner]
            begins[at[starts[at] == ends]] = True
        begins[0] = True
        windows = np.lib.stride_tricks.sliding_window_view(_word_hashes(lowered), WINDOW)
        total = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(begins, out=total[1:])
        inside = np.flatnonzero(total[WINDOW:] == total[:-WINDOW])
        if len(inside):
            cuts = np.concatenate([cuts, starts[inside + windows[inside].argmin(axis=1)]])
    cuts.sort()
    return cuts[np.concatenate([[True], cuts[1:] != cuts[:-1]])]


def _words(text: str) -> tuple[np.ndarray, list[str]]:
    # Lower-casing neither makes nor takes white space, so the words are the same.
    return np.array([m.start() for m in WORD.finditer(text)], dtype=np.int64), text.lower().split()


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Bounds of the sentences, and of the parts of long ones, in characters;
    together they are the text.

    A sentence is also cut before every word that has the least hash among
    ``WINDOW`` words in a row of which none begins a sentence. Cuts thus depend
    on the words near them only, copies are cut alike, and no part has more
    than ``WINDOW`` words."""
    bounds = _bounds(text, *_words(text)).tolist()
    return list(zip(bounds, bounds[1:]))


def runs_of(counts: list[int] | np.ndarray, sentences: int, words: int) -> set[tuple[int, int]]:
    """The shortest runs (first, after last) that start or end at each
    sentence and have enough sentences and words."""
    n = len(counts)
    total = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(counts, out=total[1:])
    at = np.arange(n + 1)
    after = np.maximum(at + sentences, np.searchsorted(total, total + words))
    first = np.minimum(at - sentences, np.searchsorted(total, total - words, side="right") - 1)
    forward, backward = after <= n, first >= 0
    found = set(zip(at[forward].tolist(), after[forward].tolist()))
    found.update(zip(first[backward].tolist(), at[backward].tolist()))
    return found


def _runs_of_text(text: str, sentences: int, words: int) -> tuple[list[int], list[tuple[int, int]], list[bytes]]:
    """A text's bounds, its runs and their digests: of the lower-case words,
    with blanks inside sentences and line feeds between them."""
    starts, lowered = _words(text)
    bounds = _bounds(text, starts, lowered)
    cuts = np.searchsorted(starts, bounds)
    runs = sorted(runs_of(np.diff(cuts), sentences, words))
    digests = []
    if runs:
        at = cuts.tolist()
        joined = [" ".join(lowered[a:b]).encode() for a, b in zip(at, at[1:])]
        begin = [0]
        for part in joined:
            begin.append(begin[-1] + len(part) + 1)
        data = memoryview(b"\n".join(joined))
        digests = [xxhash.xxh3_128_digest(data[begin[first] : begin[after] - 1]) for first, after in runs]
    return bounds.tolist(), runs, digests


def _later(order: np.ndarray, digests: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which runs have an equal one at a smaller place (its document's order,
    then its number there)."""
    place = (order << 32) | number
    by = np.lexsort((place, digests[:, 1], digests[:, 0]))
    ordered, at = digests[by], place[by]
    fresh = np.ones(len(by), dtype=bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    least = at[np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))]
    found = np.zeros(len(by), dtype=bool)
    found[by] = at != least
    return found


def _packed(bounds: list[int], runs: list[tuple[int, int]]) -> bytes:
    """A text's bounds and runs, as compressed differences."""
    span = np.array(runs, dtype=np.int32).reshape(-1, 2)
    steps = [np.diff(np.array(bounds, dtype=np.int32)), np.diff(span[:, 0], prepend=np.int32(0)), span[:, 1] - span[:, 0]]
    return zlib.compress(np.concatenate([[max(0, len(bounds) - 1)], *steps]).astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bounds and the runs (first, after) of ``_packed``."""
    n, *_ = values = np.frombuffer(zlib.decompress(data), dtype="<i4").astype(np.int64)
    bounds, (first, size) = np.concatenate([[0], np.cumsum(values[1 : n + 1])]), values[n + 1 :].reshape(2, -1)
    first = np.cumsum(first)
    return bounds, np.stack([first, first + size], axis=1)


def _hash_runs(sentences: int, words: int):
    """Per row its runs that may be first ones (64 bits of the hash, then 32
    bits of it and the run's number) and, as one more element without a hash,
    the row's bounds and runs and the sentences that surely go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            # Rows that repeat doc_id and text have one place.
            known = sorted({r for r in rows if r[0] is not None}) + sorted({r for r in rows if r[0] is None}, key=lambda r: r[1])
            order = {r: i for i, r in enumerate(known)}
            own, runs, digests = [], [], []
            for text in batch.column(2).to_pylist():
                bounds, found, its = _runs_of_text(text, sentences, words) if text else ([], [], [])
                own.append(_packed(bounds, found))
                runs.append(found)
                digests += its
            sizes = np.array([len(r) for r in runs], dtype=np.int64)
            hashes = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2).copy()
            hashes[:, 1] &= ~np.int64(0xFFFFFFFF)
            number = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            later = _later(np.repeat(np.array([order[r] for r in rows], dtype=np.int64), sizes), hashes, number)
            row_of = np.repeat(np.arange(len(rows)), sizes)
            sure = [_merged([r[i] for i in n]) for r, n in zip(runs, np.split(number[later], np.cumsum(np.bincount(row_of[later], minlength=len(rows)))[:-1]))]
            # Elements: each row's possible first runs, then its own element.
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row_of[~later], minlength=len(rows)) + 1)])
            is_run = np.ones(offsets[-1], dtype=bool)
            is_run[offsets[1:] - 1] = False

            def numbers(values: np.ndarray) -> pa.Array:
                out = np.zeros(len(is_run), dtype=np.int64)
                out[is_run] = values[~later]
                return pa.array(out, mask=~is_run)

            def others(values: list, kind: pa.DataType) -> pa.Array:
                return pa.array(values, kind).take(pa.array(np.cumsum(~is_run) - 1, mask=is_run))

            element = pa.StructArray.from_arrays(
                [numbers(hashes[:, 0]), numbers(hashes[:, 1] | number), others(sure, pa.list_(pa.int32())), others(own, pa.binary())],
                ["h", "at", "sure", "own"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), element)],
                ["doc_id", "key", "runs"],
            )

    return run


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """First and after of sorted spans, put together where they overlap or meet."""
    out: list[int] = []
    for first, after in spans:
        if out and first <= out[-1]:
            out[-1] = max(out[-1], after)
        else:
            out += [first, after]
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their removed sentences, and which these are."""
    for batch in batches:
        texts, sizes, spans = [], [], []
        columns = [batch.column(i).to_pylist() for i in range(1, 5)]
        for text, own, sure, numbers in zip(*columns):
            bounds, runs = _unpacked(own)
            n = len(bounds) - 1
            sizes.append(n)
            if not sure and not numbers:
                texts.append(text)
                spans.append([])
                continue
            covered = np.concatenate([runs[np.array(numbers, dtype=np.int64)], np.array(sure, dtype=np.int64).reshape(-1, 2)])
            gone = np.zeros(n + 1, dtype=np.int64)
            np.add.at(gone, covered[:, 0], 1)
            np.add.at(gone, covered[:, 1], -1)
            out = np.cumsum(gone[:-1]) > 0
            ends = bounds.tolist()
            texts.append("".join(text[ends[i] : ends[i + 1]] for i in np.flatnonzero(~out).tolist()))
            spans.append(np.flatnonzero(out).tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int32()))],
            ["doc_id", "text", "n_sentences", "removed"],
        )


def remove_repeats(docs: DataFrame, sentences: int = 2, words: int = 16) -> DataFrame:
    """One row per document: doc_id, text without repeated runs, n_sentences,
    n_removed and removed (the removed sentences' numbers)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Rows are known by doc_id and a hash of their text, so texts need no copy.
    named = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    element = "struct<h:long,at:long,sure:array<int>,own:binary>"
    hashed = named.mapInArrow(_hash_runs(sentences, words), f"doc_id {kind}, key long, runs array<{element}>")
    runs = hashed.select("doc_id", "key", F.explode("runs").alias("r")).select(
        "doc_id", "key", F.coalesce("r.h", F.xxhash64("doc_id", "key")).alias("h"), "r.at", "r.sure", "r.own"
    )
    # Smallest doc_id first, rows without one last; equal places are one.
    same = Window.partitionBy("h", "low").orderBy(F.col("doc_id").asc_nulls_last(), "key", "at")
    placed = runs.repartition("h").withColumn("low", F.shiftright("at", 32)).withColumn("rank", F.rank().over(same))
    number = F.when(F.col("at").isNotNull(), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))).alias("number")
    row = F.struct("doc_id", "key").alias("row")
    later = placed.filter("own is not null or rank > 1").select(row, number, "sure", "own")
    gone = later.groupBy("row").agg(
        F.first("own", ignorenulls=True).alias("own"), F.flatten(F.collect_list("sure")).alias("sure"), F.collect_list("number").alias("numbers")
    )
    joined = named.select(row, "text").join(gone, "row").select("row.doc_id", "text", "own", "sure", "numbers")
    cut = joined.mapInArrow(_cut, f"doc_id {kind}, text string, n_sentences long, removed array<int>")
    return cut.select("doc_id", "text", "n_sentences", F.size("removed").cast("long").alias("n_removed"), "removed")
