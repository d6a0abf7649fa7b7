"""Best-fit packing of token sequences by linear grouping.

Documents become token ids (an end id follows each), are cut at ``capacity``
where longer, and the pieces are packed into as few sequences as possible:

1. Lengths above ``capacity / 3`` are large. In order of length they fall
   into groups of equal cardinality and are rounded up to the group's longest.
2. Over these few sizes the best mixture of configurations (multisets of
   sizes that fit one sequence) is found by column generation.
3. The actual pieces take the places of the rounded ones, which leaves the
   difference free.
4. Small pieces, and what whole configurations did not take, go best-fit in
   order of decreasing length into the free room, then into new sequences.

A length is an integer up to ``capacity``, so the plan needs only the number
of pieces of each length. It is made on the driver from that histogram (at
most ``capacity`` rows) and speaks of *ranges* of pieces and sequences: its
size depends on the capacity, not on the data. A piece finds its place by its
length and its rank among pieces of that length; ranks are counted in
``(length, salt)`` groups of bounded size and offset by the groups before.

Defined results: a null text is empty; an empty text is the end id alone;
repeated rows and doc_ids are packed row by row; an empty table packs to
nothing.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm.common import materialise, small_batches

CAPACITY = 2048
#: Rows of one (length, salt) group, about.
GROUP_ROWS = 200_000
#: Distinct words a Python worker remembers the ids of, from task to task.
REMEMBERED_WORDS = 200_000

#: Bytes of text that are tokenised together; longer texts are cut.
LONG = 1 << 22
_SEPARATOR = re.compile(r"[ \n]")
#: ASCII punctuation between a letter (but U+0130, whose lower case ends in a
#: mark that would join the run) and a part's end.
_LAST_PUNCTUATION = r"([^\PL\x{0130}])([[:punct:]]+)( |$)"

PLACE = "length long, rank_from long, rank_to long, sequence_from long, per_sequence long, offset long"


def _byte_characters() -> dict[int, str]:
    """The characters by which byte-level models write bytes: printable Latin-1
    stands for itself, the rest for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


_BYTES = _byte_characters()


def byte_level(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)


class WordEncoder:
    """Token ids of whole columns of texts.

    The tokenizer's pattern never joins characters across a blank or a line
    feed, so the ids of a text are those of its blank-separated parts in
    order. Arrow splits a batch and numbers its distinct parts; only those are
    looked up, and new ones tokenised. Their ids stand one after another in
    ``flat``, from which one gather makes the ids of all texts. Most parts of
    a large input come once; where too many are remembered, those that came in
    several batches stay."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A lower-case word of letters alone can go to the model at once where the
        # tokenizer does nothing but hand its bytes on.
        probe = ["hello", "überfällig", "naïveté"]
        self.by_model = all(
            [t.id for t in self.tokenizer.model.tokenize(byte_level(w))] == self.tokenizer.encode(w, add_special_tokens=False).ids
            for w in probe
        )
        self.forget()

    def forget(self) -> None:
        """Slot 0 is the end id, slot 1 the empty part."""
        self.slot_of: dict[str, int] = {"": 1}
        self.starts, self.lengths = np.array([0, 1], np.int64), np.array([1, 0], np.int64)
        self.flat = np.zeros(1, np.uint32)
        self.seen = np.zeros(2, np.uint32)

    def make_room(self) -> None:
        """Keep the parts that came in several batches since room was last made,
        the most frequent ones, up to half of what may be remembered."""
        names = list(self.slot_of)  # in the order of their slots, from 1 on
        slots = np.argsort(self.seen, kind="stable")[::-1][: REMEMBERED_WORDS // 2]
        slots = np.sort(slots[self.seen[slots] > 1])
        starts, lengths, flat = self.starts[slots], self.lengths[slots], self.flat
        self.forget()
        self._add([names[s - 1] for s in slots.tolist()], [flat[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())])

    def _add(self, parts: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.slot_of.update(zip(parts, range(len(self.starts), len(self.starts) + len(parts))))
        ends = len(self.flat) + np.cumsum(sizes)
        self.starts = np.concatenate([self.starts, ends - sizes])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.seen = np.concatenate([self.seen, np.zeros(len(parts), np.uint32)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])

    def learn(self, new: list[str]) -> None:
        words = [p for p in new if self.by_model and p.isalpha() and p == p.lower() and is_normalized("NFC", p)]
        tokenize = self.tokenizer.model.tokenize
        self._add(words, [[t.id for t in tokenize(byte_level(w))] for w in words])
        others = [p for p in new if p not in self.slot_of]
        for at in range(0, len(others), 2_000):
            batch = others[at : at + 2_000]
            self._add(batch, [e.ids for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)])

    def _slots(self, parts: list[str]) -> np.ndarray:
        new = [p for p in parts if p not in self.slot_of]
        if new:
            if len(self.slot_of) + len(new) > REMEMBERED_WORDS:
                self.make_room()
                if len(self.slot_of) + len(new) > REMEMBERED_WORDS:
                    self.forget()
                new = [p for p in parts if p not in self.slot_of]
            self.learn(new)
        slots = np.fromiter(map(self.slot_of.__getitem__, parts), np.int64, len(parts))
        self.seen[slots[slots > 1]] += 1
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, an end id after each, and where each one ends."""
        plain = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        # What the tokenizer does anyway, done first so that fewer parts differ:
        # it lower-cases (but finds special tokens before), and the punctuation
        # that ends a part is a run of its own.
        eased = pc.replace_substring_regex(pc.ascii_lower(plain), _LAST_PUNCTUATION, r"\1 \2\3")
        plain = pc.if_else(pc.match_substring(plain, "<|"), plain, eased)
        lists = pc.split_pattern(plain, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        named = lists.flatten().dictionary_encode()
        slots = self._slots(named.dictionary.to_pylist())[named.indices.to_numpy()]
        slots = np.insert(slots, bounds[1:] - bounds[0], 0)
        sizes = self.lengths[slots]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[slots] - (ends - sizes), sizes)
        ids = self.flat[shift + np.arange(len(shift))]
        return ids, ends[bounds[1:] - bounds[0] + np.arange(len(texts))]

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode`` over runs of rows of about LONG bytes; a longer text goes
        alone, in pieces cut at blanks."""
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(column):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), LONG)) + at)
            if sizes[at] > LONG:
                upto = at + 1
                parts = [self.encode(pa.array([p]))[0][:-1] for p in _cut(column[at].as_py())]
                ids = np.concatenate([*parts, np.zeros(1, np.uint32)])
                yield ids, np.array([len(ids)])
            else:
                yield self.encode(column.slice(at, upto - at))
            at = upto


def _cut(text: str) -> Iterator[str]:
    """Pieces of about LONG characters that end before a blank or line feed."""
    at = 0
    while at < len(text):
        end = _SEPARATOR.search(text, at + LONG)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


_encoders: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _tokenise(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in batches:
            row = 0
            for ids, ends in encoder.texts(batch.column(1)):
                ids = np.ascontiguousarray(ids, dtype="<u4")
                sizes = np.diff(ends, prepend=0)
                n_pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(ends)), n_pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                first = (ends - sizes)[owner] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
                columns = [
                    batch.column(0).take(pa.array(owner + row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:  # the pieces of a run of texts are all its ids in order
                    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                row += len(ends)

    return run


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_tokenise(tokenizer, capacity, with_ids), schema)


# --- The plan: from the histogram of lengths to ranges of places -------------


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int, int]]]:
    """Runs (length, rank_from, count) of each group, longest group first,
    all groups of (nearly) equal cardinality."""
    total = sum(counts.values())
    out: list[list[tuple[int, int, int]]] = [[]]
    size = -(-total // groups)
    room = size
    for length in sorted(counts, reverse=True):
        at, left = 0, counts[length]
        while left:
            if room == 0:
                out.append([])
                room = size
            take = min(left, room)
            out[-1].append((length, at, take))
            at, left, room = at + take, left - take, room - take
    return out


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The multiset of sizes within ``capacity`` of the greatest worth (an
    unbounded knapsack, one layer per item; large items make few layers)."""
    layers, chosen = [np.zeros(capacity + 1)], []
    for _ in range(capacity // int(sizes.min())):
        best, pick = layers[-1].copy(), np.full(capacity + 1, -1)
        for i, (s, w) in enumerate(zip(sizes, worth)):
            value = np.full(capacity + 1, -np.inf)
            value[s:] = layers[-1][: capacity + 1 - s] + w
            better = value > best + 1e-12
            best[better], pick[better] = value[better], i
        layers.append(best)
        chosen.append(pick)
    at, items = capacity, []
    for layer in range(len(chosen) - 1, -1, -1):
        i = int(chosen[layer][at])
        if i >= 0:
            items.append(i)
            at -= int(sizes[i])
    return float(layers[-1][capacity]), items


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[list[int], float]]:
    """Column generation: configurations (item counts by size) and how often
    each is used, in the best fractional solution found."""
    n = len(sizes)
    s = np.array(sizes)
    columns = [np.eye(n)[i] * (capacity // sizes[i]) for i in range(n)]
    basis = np.array(columns).T
    # Small dense algebra without BLAS, whose threads can stall beside a JVM.
    inverse = np.diag(1 / np.diag(basis))
    level = np.diag(inverse) * np.array(demand, dtype=float)
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        worth, items = best_configuration(s, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        column = np.bincount(items, minlength=n).astype(float)
        step = np.einsum("ij,j->i", inverse, column)
        ratios = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratios))
        if not np.isfinite(ratios[leave]):
            break
        basis[:, leave] = column
        level = level - ratios[leave] * step
        level[leave] = ratios[leave]
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
    return [([int(round(x)) for x in basis[:, j]], float(level[j])) for j in range(n)]


class Plan:
    """Ranges of places. ``free`` holds ranges of sequences by free room."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.places: list[tuple[int, int, int, int, int, int]] = []
        self.free: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def open(self, count: int) -> int:
        first, self.sequences = self.sequences, self.sequences + count
        return first

    def release(self, first: int, count: int, room: int) -> None:
        if room > 0 and count > 0:
            if room not in self.free:
                self.free[room] = []
                insort(self.rooms, room)
            self.free[room].append((first, count))

    def configuration(self, slots: list[list[tuple[int, int, int]]], count: int) -> None:
        """``count`` sequences, one piece of each slot's runs (length,
        rank_from, count) in each; ranges split where a run ends."""
        parts = [(self.open(count), count, 0)]
        for runs in slots:
            runs, new = list(runs), []
            for first, size, used in parts:
                while size:
                    length, rank, have = runs[0]
                    take = min(size, have)
                    self.places.append((length, rank, rank + take, first, 1, used))
                    new.append((first, take, used + length))
                    runs[0:1] = [(length, rank + take, have - take)] if have > take else []
                    first, size = first + take, size - take
            parts = new
        for first, size, used in parts:
            self.release(first, size, self.capacity - used)

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Pieces of one length, each where least room stays; a sequence that
        was the tightest stays the tightest until the next does not fit."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                n = -(-count // each)
                self.release(self.open(n), n, self.capacity)
                continue
            room = self.rooms[at]
            first, have = self.free[room].pop()
            if not self.free[room]:
                del self.free[room]
                self.rooms.pop(at)
            each = min(room // length, count)
            full = min(have, count // each)
            used = self.capacity - room
            self.places.append((length, rank, rank + full * each, first, each, used))
            self.release(first, full, room - each * length)
            self.release(first + full, have - full, room)
            rank, count = rank + full * each, count - full * each


def _take(runs: list[tuple[int, int, int]], count: int) -> list[tuple[int, int, int]]:
    """The first ``count`` pieces of the runs, removed from them."""
    out = []
    while count:
        length, rank, have = runs[0]
        take = min(count, have)
        out.append((length, rank, take))
        runs[0:1] = [(length, rank + take, have - take)] if have > take else []
        count -= take
    return out


def plan_places(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 200) -> Plan:
    plan = Plan(capacity)
    counts = {n: c for n, c in histogram.items() if c}
    large = {n: c for n, c in counts.items() if capacity // 3 < n < capacity}
    rest = [(n, 0, c) for n, c in counts.items() if n not in large and n < capacity]
    if counts.get(capacity):
        plan.places.append((capacity, 0, counts[capacity], plan.open(counts[capacity]), 1, 0))
    if large:
        runs = linear_groups(large, min(groups, sum(large.values())))
        # Groups that round up to the same length are one size.
        sizes: dict[int, list[tuple[int, int, int]]] = {}
        for group in runs:
            sizes.setdefault(group[0][0], []).extend(group)
        names = list(sizes)
        demand = [sum(r[2] for r in sizes[n]) for n in names]
        found = configurations(names, demand, capacity)
        for config, level in sorted(found, key=lambda x: -sum(c * n for c, n in zip(x[0], names))):
            left = [sum(r[2] for r in sizes[n]) for n in names]
            count = min([int(level + 1e-6), *(a // c for a, c in zip(left, config) if c)])
            if count > 0:
                plan.configuration([_take(sizes[n], count) for n, c in zip(names, config) for _ in range(c)], count)
        rest += [r for n in names for r in sizes[n]]
    for length, rank, count in sorted(rest, reverse=True):
        plan.best_fit(length, rank, count)
    return plan


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences over a few group counts."""
    return min((plan_places(histogram, capacity, g) for g in (100, 200, 300)), key=lambda p: p.sequences)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table with a length column. The table
    must be stable when read again (a file, or materialised)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_plan(histogram, capacity)
    salts = sum(histogram.values()) // GROUP_ROWS + 16
    row = "__packing_row"
    salted = pieces.withColumn(row, F.monotonically_increasing_id()).withColumn("__salt", F.pmod(F.xxhash64(row), F.lit(salts)))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("length", "__salt").orderBy(row)
    ranked = (
        salted.withColumn("__rank", F.row_number().over(within) - 1)
        .join(starts, ["length", "__salt"])
        .withColumn("__rank", F.col("__rank") + F.col("__start"))
    )
    # Bounded by the capacity and the number of groups, whatever the data.
    places = F.broadcast(spark.createDataFrame(plan.places, PLACE).withColumnRenamed("length", "__length"))
    found = ranked.join(
        places, (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("rank_from")) & (F.col("__rank") < F.col("rank_to"))
    )
    nth = F.col("__rank") - F.col("rank_from")
    return found.select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        (F.col("sequence_from") + F.expr("(__rank - rank_from) div per_sequence")).alias("sequence_id"),
        (F.col("offset") + nth % F.col("per_sequence") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return place(materialise(pieces_of(docs, tokenizer, capacity, with_ids), "packing-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (``pack(..., with_ids=True)``): their
    ids in order and the bounds of the pieces in them. A sequence holds at
    most ``capacity`` ids, so the groups are bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("pieces"),
    )
