"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to ``bits`` bits each, a document's
cell gets its index on the Hilbert curve through the grid, and the documents
are cut into shards as runs of the curve. Documents of one shard are close in
all dimensions, so a reader that filters by any of them opens few shards.

Only DataFrame functions run here. The curve index is folded over the bits
with small lookup arrays that are made by rule. Ranks along the curve need no
global sort: counts per (cell, salt) are summed up cell by cell (at most
2**(dims * bits) cells) and salt by salt inside a cell (at most ``SALTS``),
and only rows of one (cell, salt) group are ordered with each other. A cell
that holds a third of all rows is so dealt over all salts.

Defined results: a null text has size 8 and the checksum of the empty text; a
null in a dimension is its own cell (0); ties in all dimensions are ordered by
a hash of doc_id and text, and equal rows are interchangeable; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm.common import materialise, text_or_empty

SALTS = 4096


def gray_tables(dims: int) -> tuple[list[int], list[int], list[int]]:
    """For each digit w of 0 .. 2**dims - 1: the inverse of the Gray code, the
    entry corner and the direction of the sub-cube that the curve passes as
    its w-th (Hamilton's construction)."""
    size = 1 << dims
    gray = [w ^ (w >> 1) for w in range(size)]
    inverse = [gray.index(g) for g in range(size)]

    def trailing_ones(w: int) -> int:
        n = 0
        while w & 1:
            n, w = n + 1, w >> 1
        return n

    entry = [0] + [gray[2 * ((w - 1) // 2)] for w in range(1, size)]
    turn = [0] + [trailing_ones(w if w % 2 else w - 1) % dims for w in range(1, size)]
    return inverse, entry, turn


def _pick(table: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in table]), at)


def _rotate_left(x: Column, by: Column, dims: int) -> Column:
    by = by % dims
    both = F.call_function("shiftleft", x, by).bitwiseOR(F.call_function("shiftright", x, F.lit(dims) - by))
    return both.bitwiseAND(F.lit((1 << dims) - 1))


def curve_index(coordinates: Column, dims: int, bits: int) -> Column:
    """Hilbert index (long) of an array of ``dims`` coordinates below 2**bits."""
    inverse, entry, turn = gray_tables(dims)

    def digit(level: Column) -> Column:
        """Bit ``level`` of all coordinates as one number."""
        found = F.lit(0)
        for j in range(dims):
            bit = F.call_function("shiftright", F.get(coordinates, F.lit(j)), level).bitwiseAND(F.lit(1))
            found = found.bitwiseOR(F.call_function("shiftleft", bit, F.lit(j)))
        return found

    def step(acc: Column, level: Column) -> Column:
        rotation = acc["d"] + 1
        turned = _rotate_left(digit(level).bitwiseXOR(acc["e"]), F.lit(2 * dims) - rotation, dims)
        w = _pick(inverse, turned)
        return F.struct(
            (acc["h"] * (1 << dims) + w).alias("h"),
            acc["e"].bitwiseXOR(_rotate_left(_pick(entry, w), rotation, dims)).alias("e"),
            ((acc["d"] + _pick(turn, w) + 1) % dims).alias("d"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["h"])


def by_hash(value: Column, bits: int) -> Column:
    """Categories: equal values share a coordinate; null is 0."""
    return F.when(value.isNull(), F.lit(0)).otherwise((F.pmod(F.xxhash64(value), F.lit((1 << bits) - 1)) + 1).cast("int"))


def by_magnitude(value: Column, bits: int, per_doubling: int = 2) -> Column:
    """Sizes: ``per_doubling`` steps for each power of two; null is 0."""
    step = F.floor(F.log2(F.greatest(value, F.lit(0)).cast("double") + 1) * per_doubling) + 1
    return F.when(value.isNull(), F.lit(0)).otherwise(F.least(step, F.lit((1 << bits) - 1)).cast("int"))


def document_dimensions(bits: int) -> list[Column]:
    """Language, source and length of a row of ``documents``."""
    return [by_hash(F.col("lang"), bits), by_hash(F.col("source"), bits), by_magnitude(F.col("n_chars"), bits)]


def ranks(rows: DataFrame) -> DataFrame:
    """Adds ``rank`` (0 to rows - 1) along the curve to a table with columns
    cell and tie (a long); the table must be stable when read again."""
    salted = rows.withColumn("salt", F.pmod(F.call_function("shiftrightunsigned", F.col("tie"), F.lit(20)), F.lit(SALTS)))
    groups = salted.groupBy("cell", "salt").agg(F.count("*").alias("n"))
    earlier = (Window.unboundedPreceding, -1)
    # One row for each cell of the grid at most.
    cells = groups.groupBy("cell").agg(F.sum("n").alias("n")).select(
        "cell", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(*earlier)), F.lit(0)).alias("cells_before")
    )
    inside = F.sum("n").over(Window.partitionBy("cell").orderBy("salt").rowsBetween(*earlier))
    starts = groups.select("cell", "salt", F.coalesce(inside, F.lit(0)).alias("salts_before")).join(cells, "cell")
    order = Window.partitionBy("cell", "salt").orderBy("tie", "doc_id", "text_crc32", "size")
    return (
        salted.withColumn("nth", F.row_number().over(order) - 1)
        .join(starts, ["cell", "salt"])
        .withColumn("rank", F.col("cells_before") + F.col("salts_before") + F.col("nth"))
        .drop("salt", "nth", "cells_before", "salts_before")
    )


def shard_rows(docs: DataFrame, shards: int = 24, bits: int = 5, dimensions: list[Column] | None = None) -> DataFrame:
    """Every row's shard and its place in it; counts of shards differ by one
    at most (the law ``rows``)."""
    dims = dimensions or document_dimensions(bits)
    text = text_or_empty()
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.array(*dims).alias("at"),
        F.xxhash64(F.col("doc_id"), text).alias("tie"),
    ).withColumn("cell", curve_index(F.col("at"), len(dims), bits))
    rows = materialise(keyed.drop("at"), "hilbert-rows")
    total = rows.count()
    ranked = ranks(rows)
    shard = F.expr(f"rank * {shards}L div {max(total, 1)}L")
    # The first rank of a shard is the least r with r * shards >= shard * total.
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("cell").alias("curve_index"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, bits: int = 5) -> None:
    """The shard files themselves: whole rows, one folder a shard, in slot
    order. A row finds its shard by the hash that orders it."""
    placed = shard_rows(docs, shards, bits).select("doc_id", "text_crc32", "size", "shard", "slot")
    placed = placed.dropDuplicates(["doc_id", "text_crc32", "size"])
    text = text_or_empty()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("doc_id"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
    )
    same = rows["doc_id"].eqNullSafe(placed["doc_id"]) & (rows["text_crc32"] == placed["text_crc32"]) & (rows["size"] == placed["size"])
    found = rows.join(placed, same).select("row", "shard", "slot")
    found.repartition("shard").sortWithinPartitions("shard", "slot").select("shard", "row.*").write.partitionBy("shard").parquet(path)
