"""N-gram Jaccard join by vertical partitioning.

Every document is its set of distinct word n-grams; two documents link when
``100 * |A & B| >= percent * |A | B|``. The n-grams' 64-bit hashes are cut
into fragments, so a document's set falls into segments; segments of one
fragment are compared with each other only, and a pair's overlap is the sum of
its fragments' partial overlaps.

*Which pairs are counted.* The n-grams have one global order, in which linked
sets share one of their first ``n * (100 - percent) / 100 + 1`` n-grams; only
these are sent, and the places of a shared one bound the overlap from above.
Any order loses no link. Here n-grams that are frequent come last: each task
counts its n-grams in a table of fixed size, and what stands out there is
summed. Sets with too many n-grams that no other of those that met holds leave.
A passage that many documents quote does not bring them together.

*How groups stay linear.* Equal sets are one class, represented once. At first
each set is compared with one hub only, out of those with the first places in
its groups; links become components, and groups inside one component leave.
What is left, such as copies that were edited each in its own way and are no
longer linked, is ordered anew: the n-grams of the open sets by their exact
count among them, rarest first. An edit's n-grams are rare and come first, so
copies with too many of them meet nobody. In a group that holds the same n-gram
the members with the fewest rarer ones (those nearest to what the group has in
common) are hubs, sixteen times more of them each round, until every pair that
meets is counted, ruled out by its bound or inside one component. Nothing is
capped.

Defined results: null and empty texts, and texts of white space only, have an
empty set and link with nothing; a null doc_id is reported, never used as a
component's name unless the component has no other (then null). Repeated rows
are equal sets. Shingle sets are named by 128 bits (64 where
they meet), shingles by 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm import components, hashing
from costlens.llm.common import materialise, small_batches

#: Fragments in which partial overlaps are counted.
COUNT_FRAGMENTS = 4
#: Distinct sets that one task remembers in order to send each set's segments once.
REMEMBERED = 1 << 18
#: Steps of 100 / percent by which size classes grow.
CLASS_STEPS = 3
#: Counters of the table by which frequent n-grams come last.
COUNTERS = 1 << 20
#: Words of 64 bits of the table that rules out rows before they are shuffled.
BLOOM_WORDS = 1 << 18


def next_bound(bound: int, percent: int) -> int:
    """Classes grow by three steps of 100 / percent: members of linked pairs are
    in one class or in neighbouring ones, and two sets in three can only be
    linked to members of their own class or a lower one."""
    return max(bound + 1, bound * 100**CLASS_STEPS // percent**CLASS_STEPS)


def size_classes(percent: int, limit: int) -> np.ndarray:
    """Upper bounds of the classes up to ``limit``."""
    bounds = [1]
    while bounds[-1] < limit:
        bounds.append(next_bound(bounds[-1], percent))
    return np.array(bounds, dtype=np.int64)


def most_different(high: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets of at most ``high``."""
    return 2 * high * (100 - percent) // (100 + percent)


def spare(difference: int) -> int:
    return 1 + difference // 16


def fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    """The global order cut into ``fragments`` equal ranges."""
    return ((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def segment_marks(grams: np.ndarray, percent: int) -> np.ndarray:
    """One number per (class, fragment, content) under which the set with the
    sorted n-grams ``grams`` can meet a linked set."""
    n = len(grams)
    bounds = size_classes(percent, max(1, n * 100 // percent + 1))
    own = int(np.searchsorted(bounds, n))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashing.mix(grams ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    found = []
    # A linked set of the next class is larger than this class's bound.
    hosts = (own, own + 1) if n * 100 // percent > bounds[own] else (own,)
    for host in hosts:
        high = int(bounds[host]) if host < len(bounds) else next_bound(int(bounds[-1]), percent)
        difference = most_different(high, percent)
        if difference == 0:
            continue  # only equal sets link
        k = difference + 1 + spare(difference)
        cuts = np.searchsorted(fragment_of(grams, k), np.arange(k + 1, dtype=np.uint64))
        marks = hashing.mix(
            sums[cuts[1:]] - sums[cuts[:-1]] + hashing.mix(np.arange(k, dtype=np.uint64) + (np.uint64(host) << np.uint64(32)))
        )
        empty = cuts[1:] == cuts[:-1]
        found.append(marks if empty.sum() > spare(difference) else marks[~empty])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def first_grams(grams: np.ndarray, late: np.ndarray, percent: int) -> np.ndarray:
    """Those of the set with the sorted n-grams ``grams`` by which it can meet
    a linked set, in the order of their counters in ``late``, then their own."""
    most = len(grams) * (100 - percent) // 100 + 1
    return grams[np.argsort(late[(grams % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")[:most]]


def grams_of(text: np.ndarray | None, words: int) -> np.ndarray:
    if text is None:
        return np.zeros(0, dtype=np.uint64)
    h, _, _ = hashing.word_hashes(hashing.lower_ascii(text), hashing.BLANK_SEPARATED)
    return hashing.shingles(h, words)


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _counters(words: int):
    """(counter, n) of a task's n-grams, where n is well above the average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for text in hashing.texts(batch.column(0)):
                np.add.at(counts, (grams_of(text, words) % np.uint64(COUNTERS)).astype(np.int64), 1)
        above = np.flatnonzero(counts > 4 + 2 * counts.mean())
        yield pa.RecordBatch.from_arrays([pa.array(above, pa.int64()), pa.array(counts[above], pa.int64())], ["counter", "n"])

    return run


def _late(docs: DataFrame, words: int) -> np.ndarray:
    """Per counter 0, or the binary logarithm of how many n-grams stood out in
    it: at most one byte a counter, whatever the input."""
    small_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(_counters(words), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    table = counted.select(F.col("counter").cast("int").alias("counter"), F.log2("n").cast("byte").alias("n")).toArrow()
    late = np.zeros(COUNTERS, dtype=np.uint8)
    late[table.column("counter").to_numpy()] = table.column("n").to_numpy()
    return late


def _describe(words: int, percent: int, late):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            sizes, keys, lists = [], [], []
            for text in hashing.texts(batch.column(2)):
                grams = grams_of(text, words)
                key = set_key(grams)
                sizes.append(len(grams))
                keys.append(key)
                if key in seen or not len(grams):
                    lists.append(np.zeros(0, dtype=np.int64))
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                lists.append(first_grams(grams, late.value, percent).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            marks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else [], type=pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), marks],
                ["doc_id", "row", "n", "key", "marks"],
            )

    return run


def _part_of_order(words: int, since: int, upto: int):
    """(key, grams) of each text: its n-grams from ``since`` to ``upto`` percent
    of the order of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = [], []
            for text in hashing.texts(batch.column(0)):
                grams = grams_of(text, words)
                keys.append(set_key(grams))
                at = fragment_of(grams, 100)
                lists.append(grams[(at >= since) & (at < upto)].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            values = pa.array(np.concatenate(lists) if lists else [], type=pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["key", "grams"])

    return run


def _segments(words: int):
    """(key, fragment, n, grams) of each text, for counting partial overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts, sizes, lists = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), hashing.texts(batch.column(1))):
                grams = grams_of(text, words)
                if set_key(grams) != key:
                    continue  # another row of the same hash
                cuts = np.searchsorted(fragment_of(grams, COUNT_FRAGMENTS), np.arange(COUNT_FRAGMENTS + 1, dtype=np.uint64))
                for f in range(COUNT_FRAGMENTS):
                    keys.append(key)
                    parts.append(f)
                    sizes.append(len(grams))
                    lists.append(grams[cuts[f] : cuts[f + 1]].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            values = pa.array(np.concatenate(lists) if lists else [], type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(parts, pa.int32()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                ["key", "part", "n", "grams"],
            )

    return run


def row_hash() -> Column:
    """A row by its doc_id and text, also where either is null or repeated."""
    return F.xxhash64("doc_id", "text")


def describe(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, the row's hash, size and key of its set, and the
    n-grams it sends, in order (none where the same task has sent the same set before)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    late = docs.sparkSession.sparkContext.broadcast(_late(docs, words))
    return docs.select("doc_id", row_hash().alias("row"), "text").mapInArrow(
        _describe(words, percent, late), f"doc_id {kind}, row long, n long, key binary, marks array<long>"
    )


def perhaps_among(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Adds ``perhaps``: may the row (column row, a hash) be among ``few``? A
    table of one bit a hash, of BLOOM_WORDS words at most, is joined by
    broadcast. It is never wrong about a row that is among them, and where it
    is crowded only says yes more often."""
    word = F.pmod(F.shiftrightunsigned("row", 6), F.lit(BLOOM_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("row").bitwiseAND(F.lit(63)).cast("int"))
    table = few.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marked = rows.withColumn("word", word).join(F.broadcast(table), "word", "left")
    return marked.withColumn("perhaps", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("word", "bits")


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Linked pairs of ``pairs`` (columns a, b: set keys): partial overlaps of
    each fragment, summed per pair. Only segments of sets that may be in a pair
    on that side are sent."""
    def side(name: str, size: str, grams: str) -> DataFrame:
        hashed = segments.select(F.xxhash64("key").alias("row"), F.col("key").alias(name), "part", F.col("n").alias(size), F.col("grams").alias(grams))
        return perhaps_among(hashed, pairs.select(F.xxhash64(name).alias("row"))).filter("perhaps").drop("row", "perhaps")

    left, right = side("b", "nb", "gb"), side("a", "na", "ga")
    partial = (
        pairs.join(left, "b")
        .join(right, ["a", "part"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("both"))
    )
    summed = partial.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("both").alias("both"))
    return summed.filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def link_sets(docs: DataFrame, described: DataFrame, words: int, percent: int, max_rounds: int = 24) -> DataFrame:
    """(key, root) of every set that links to another one, root being one
    member's key for each component."""
    # Marks travel once, with 64 bits of the key; the few that are shared get
    # the whole key back.
    short = F.xxhash64("key").alias("id")
    # The changing columns stand side by side, which compresses best.
    marks = described.select(short, "n", F.posexplode("marks").alias("pos", "mark")).select("id", "n", "mark", "pos").repartition("mark")
    group = Window.partitionBy("mark")
    shared = marks.select("*", F.min("id").over(group).alias("lo"), F.max("id").over(group).alias("hi"), F.min("n").over(group).alias("least_n"))
    # A set that several tasks sent counts once; groups of one set leave.
    first = shared.filter((F.col("lo") != F.col("hi")) & _possible(percent)).select("mark", "id", "n", F.col("pos").cast("long").alias("pos"))
    first = materialise(first.distinct(), "jaccard-first")
    sets = described.filter("n > 0").select(short, "key", "n", "row").join(first.select("id").distinct(), "id", "left_semi")
    sets = materialise(sets.groupBy("id", "key", "n").agg(F.min("row").alias("row")), "jaccard-sets-met")
    alive = _not_alone(docs, sets, words, percent)
    met = first.drop("n").join(alive, "id").select("mark", "key", "n", "pos", F.col("key").alias("label"))
    met = materialise(_open_groups(met, percent), "jaccard-met")

    chosen = materialise(sets.join(met.select("key").distinct(), "key", "left_semi").select("row", "key"), "jaccard-chosen")
    rows = perhaps_among(docs.select(row_hash().alias("row"), "text"), chosen).filter("perhaps")
    texts = rows.select("row", "text").join(chosen, "row").groupBy("row", "key").agg(F.first("text").alias("text"))
    segments = materialise(
        texts.select("key", "text").mapInArrow(_segments(words), "key binary, part int, n long, grams array<long>"),
        "jaccard-segments",
    )

    pending = met
    links, tried, labels = None, None, None
    hubs = 1
    for turn in range(max_rounds):
        if turn:
            pending = materialise(_open_groups(pending, percent), "jaccard-pending")
            largest = pending.agg(F.max("size")).first()[0]
            if largest is None:
                break
        overlap = F.least(F.col("n") - F.col("pos"), F.col("hub_n") - F.col("hub_pos"))
        near = overlap * 100 >= (F.col("n") + F.col("hub_n") - overlap) * percent
        pairs = pending.join(_hubs(pending, hubs), "mark").filter((F.col("label") != F.col("hub_label")) & near)
        if turn == 0:  # every group is open; one hub a set is enough for most
            pairs = pairs.groupBy("key").agg(F.min("hub").alias("hub"))
        pairs = pairs.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "jaccard-pairs")
        found = materialise(_overlaps(pairs, segments, percent), "jaccard-links")
        tried = pairs if tried is None else tried.union(pairs)
        if links is None or found.limit(1).count():
            links = found if links is None else links.union(found)
            labels = components.stars(links)
            pending = _relabel(pending, labels)
        if turn and hubs >= largest:
            break  # every pair that meets has been counted
        if turn == 0:
            still = _open_groups(pending, percent).select("key", "label").distinct()
            pending = _prefixes(materialise(still, "jaccard-open"), segments, percent)
        else:
            hubs *= 16
    else:
        raise RuntimeError(f"groups of sets that meet are not settled after {max_rounds} rounds")
    if labels is None:
        return met.select("key", F.col("key").alias("root")).limit(0)
    return labels.select(F.col("node").alias("key"), "root")


def _not_alone(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, key, n) of those of ``sets`` that may link. A linked set has at most
    ``n * (100 - percent) / 100`` n-grams that no other one holds. Most texts
    have more already in the first part of the order, half as large again as
    that share, which alone is sent of all sets. The sets that are left send
    twice as much again: where the input is large, chance gives many texts a
    good part of their n-grams in common with some other one."""
    share = min(100, (100 - percent) * 3 // 2 + 1)
    alive = sets.withColumn("alone", F.lit(0).cast("long"))
    since = 0
    for upto in sorted({share, min(100, 3 * share)}):
        rows = perhaps_among(docs.select(row_hash().alias("row"), "text"), alive).filter("perhaps")
        held = rows.select("text").mapInArrow(_part_of_order(words, since, upto), "key binary, grams array<long>")
        held = held.select(F.xxhash64("key").alias("id"), F.explode("grams").alias("mark")).repartition("mark")
        # Rows that are no member's only make n-grams less rare.
        alone = held.groupBy("mark").agg(F.min("id").alias("id"), F.max("id").alias("hi")).filter("id = hi")
        alone = alone.groupBy("id").agg(F.count("*").alias("more"))
        counted = alive.join(alone, "id", "left").withColumn("alone", F.col("alone") + F.coalesce("more", F.lit(0))).drop("more")
        alive = materialise(counted.filter(f"alone <= n * {100 - percent} div 100"), "jaccard-not-alone")
        since = upto
    return alive.select("id", "key", "n")


def _relabel(pending: DataFrame, labels: DataFrame) -> DataFrame:
    return pending.join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "mark", "key", "n", "pos", F.coalesce("root", "key").alias("label")
    )


def _possible(percent: int) -> Column:
    """May a set at ``pos`` of its group link to one of ``least_n`` or more?"""
    return (F.col("n") - F.col("pos")) * 100 >= F.greatest(F.col("n"), F.col("least_n") + F.col("pos")) * percent


def _open_groups(pending: DataFrame, percent: int) -> DataFrame:
    """The members, with their group's ``size``, of groups that are not inside
    one component, less those whose place rules out every member's size."""
    rows = pending.select("mark", "key", "n", "pos", "label")
    spread = rows.groupBy("mark").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.min("n").alias("least_n")
    )
    spread = spread.filter("lo != hi").select("mark", "size", "least_n")
    return rows.join(spread, "mark").filter(_possible(percent)).drop("least_n")


def _prefixes(still: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """(mark, key, n, pos, label): the n-grams of each open set by which it can
    meet a linked one, with their places in its order from the rarest on.
    N-grams that no other open set holds come first and meet nobody."""
    # Two sets with the same 64 bits would only get each other's n-grams too.
    short = F.xxhash64("key").alias("id")
    ids = still.select(short, "key", "label")
    # Sets that only may be open count as well: the order is then that of more
    # sets, and they leave with the last join.
    held = perhaps_among(segments.withColumn("row", F.xxhash64("key")), still.select(F.xxhash64("key").alias("row"))).filter("perhaps")
    held = held.select(F.col("row").alias("id"), F.explode("grams").alias("mark"))
    counted = held.repartition("mark").withColumn("c", F.count("*").over(Window.partitionBy("mark"))).filter("c > 1")
    order = F.sort_array(F.collect_list(F.struct("c", "mark")))
    sizes = segments.filter("part = 0").select(short, "n")
    common = counted.groupBy("id").agg(order.alias("g")).join(sizes, "id")
    most = F.expr(f"n * {100 - percent} div 100")
    alone = F.col("n") - F.size("g")
    first = common.filter(alone <= most).select(
        "id", "n", alone.alias("alone"), F.posexplode(F.slice("g", F.lit(1), (most - alone + 1).cast("int"))).alias("i", "e")
    )
    placed = first.select(F.col("e.mark").alias("mark"), "id", "n", (F.col("alone") + F.col("i")).alias("pos"))
    return materialise(placed.join(ids, "id").select("mark", "key", "n", "pos", "label"), "jaccard-prefixes")


def _hubs(pending: DataFrame, hubs: int) -> DataFrame:
    """The ``hubs`` members of each group with the first places (ties: least
    key), by a map-side top-k."""
    member = F.struct("pos", F.col("key").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"))
    if hubs == 1:
        found = pending.groupBy("mark").agg(F.min(member).alias("h"))
    else:
        ranked = pending.select("mark", member.alias("h")).withColumn(
            "rank", F.row_number().over(Window.partitionBy("mark").orderBy("h"))
        )
        found = ranked.filter(F.col("rank") <= hubs)
    return found.select("mark", "h.hub", "h.hub_n", "h.hub_label", F.col("h.pos").alias("hub_pos"))


def components_of(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest doc_id reachable by links) and class_id (the smallest doc_id with
    the same set; null for empty sets, which are alone)."""
    described = materialise(describe(docs, words, percent), "jaccard-sets")
    rooted = link_sets(docs, described, words, percent)
    rows = described.select("doc_id", "n", "key")
    classes = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("class_id"))
    named = classes.join(rooted, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = materialise(named, "jaccard-classes")
    roots = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    final = named.join(roots, "root").select("key", "class_id", "component_id")
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("class_id"))
    filled = rows.filter("n > 0").join(final, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    return filled.unionByName(empty)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the one with
    the smallest doc_id stays (a row without one only if all are without; of
    several texts with that doc_id one). Rows without words stay. Rows that
    repeat doc_id and text count once.

    Rows go by their doc_id and text, never by the doc_id alone. Only rows that
    may be among those to go are shuffled."""
    described = materialise(describe(docs, words, percent), "jaccard-sets")
    rooted = link_sets(docs, described, words, percent)
    sets = described.filter("n > 0").join(rooted, "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = sets.select("root", "row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("place"))
    kept = rows.groupBy("root").agg(F.min("place").alias("kept"), F.count("*").alias("n")).filter("n > 1").select("root", "kept")
    gone = rows.join(kept, "root").filter("place != kept").select("place.doc_id", "row").distinct()
    again = described.groupBy("row").count().filter("count > 1").select("row")
    again = materialise(again, "jaccard-again")
    gone = materialise(gone, "jaccard-gone")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col("doc_id").alias("its_id"), row_hash().alias("row")
    )
    marked = perhaps_among(packed, gone.select("row").union(again))
    some = marked.filter("perhaps")
    away = gone.select(F.col("row").alias("gone_row"), F.col("doc_id").alias("gone_id"))
    some = some.join(away, (F.col("row") == F.col("gone_row")) & F.col("its_id").eqNullSafe(F.col("gone_id")), "left_anti")
    once = some.dropDuplicates(["row", "its_id"])
    return marked.filter(~F.col("perhaps")).unionByName(once).select("kept.*")
