"""Personal data by bootstrapped contextual extraction.

Four kinds have a fixed form (e-mail, IP address, card, phone) and are found
by patterns over the whole text. They are the seeds: the words around them are
lexical patterns, and patterns and instances (identifier-like tokens) are a
graph that Spark scores in turns. A pattern's confidence for a kind is the
mean score of the distinct instances it meets; an instance's score is the
noisy-or of its confident patterns. Seeds stay at one, so a context that meets
ordinary tokens as well stays weak. Patterns that reach ``confidence`` with at
least ``support`` distinct seeds or accepted instances bring in the unseen
identifiers they meet; those whose own score reaches ``confidence`` are
accepted, support further patterns, and add spans of the pattern's kind, seeds'
spans all stay. The turns go on until no new pattern or instance appears and no
score rises any more.

Only DataFrame functions run here. The base patterns are written so that each
is linear in the text: a match starts where its run of characters starts, and
runs are possessive. Matches are placed inside the row, texts are not
shuffled; the graph holds identifiers only, not words. A pattern or instance
that very many rows share is aggregated on the map side first.

Defined results: null and empty texts hold nothing; repeated rows are scanned
each on its own; overlapping base spans of different kinds all stay; an empty
table gives an empty result. ``redact`` keeps all columns, leaves null texts
null and brings n_chars up to date where the column exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import let, materialise

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Identifier-like tokens: a run without blanks and quotes that holds a digit or @.
TOKEN = r"(?<![^\s\"'<>(),;=|])[^\s0-9@\"'<>(),;=|]*+[0-9@][^\s\"'<>(),;=|]*+"
NAMED = "array<struct<kind:string,start:int,end:int,value:string>>"
SPAN = "array<struct<start:int,end:int,value:string>>"
#: Characters of context that patterns may look at on either side.
REACH = 64
#: Scores that rise by no more than this in a turn have settled.
SETTLED = 1e-6


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    low, high = (13, 19) if kind == "card" else (9, 15)
    fits = F.length(digits).between(low, high)
    return F.when(fits, _luhn(digits)).otherwise(F.lit(False)) if kind == "card" else fits


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points."""

    def placed(found: Column, between: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(between, i))
            value = F.get(found, i)
            end = start + F.length(value)
            one = F.struct(start.alias("start"), end.alias("end"), value.alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["list"], F.array(one)).alias("list"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("list"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["list"])

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(
            let(F.split(text, pattern, -1), lambda between: placed(found, between))
        ),
    )


def base_spans(text: Column) -> Column:
    """All valid base matches: kind, start, end, value."""

    def of_kind(kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        named = F.transform(
            found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))
        )
        # Most texts lack what a kind cannot do without.
        needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
        return F.when(needs, named).otherwise(F.array().cast(NAMED))

    return F.concat(*[of_kind(kind) for kind in KINDS])


def _trimmed(m: Column) -> Column:
    value = F.regexp_replace(m["value"], r"[^A-Za-z0-9]+$", "")
    return F.struct(F.lit("").alias("kind"), m["start"].alias("start"), (m["start"] + F.length(value)).alias("end"), value.alias("value"))


def candidates(text: Column, base: Column) -> Column:
    """Identifier-like tokens that no base span touches."""
    tokens = F.transform(matches(text, TOKEN), _trimmed)
    like = lambda t: (F.length(t["value"]) >= 6) & t["value"].rlike(r"[0-9][^0-9]*[0-9][^0-9]*[0-9][^0-9]*[0-9]|@")
    free = F.filter(tokens, lambda t: like(t) & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return F.when(text.rlike("[0-9@]"), free).otherwise(F.array().cast(NAMED))


def _contexts(text: Column, span: Column) -> Column:
    """The lexical patterns around a span: two words before; a word before
    and one after; a label (a word before that ends in : = or #)."""
    begin = F.greatest(span["start"] - REACH, F.lit(0))
    before = F.lower(F.substring(text, begin + 1, span["start"] - begin))
    after = F.lower(F.substring(text, span["end"] + 1, F.lit(REACH)))
    two = F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1)
    one = F.regexp_extract(before, r"(\S+)\s*$", 1)
    next_one = F.regexp_extract(after, r"^[^\s\w]*\s*(\S+)", 1)
    label = F.regexp_extract(before, r"(\S{2,}\s*[:=#])\s*[\"'(]?$", 1)
    found = F.array(
        F.when(two != "", F.concat(F.lit("2<"), F.regexp_replace(two, r"\s+", " "))),
        F.when((one != "") & (next_one != ""), F.concat(F.lit("1<>1"), one, F.lit(" _ "), next_one)),
        F.when(label != "", F.concat(F.lit("label<"), label)),
    )
    return F.filter(found, lambda x: x.isNotNull())


def scan(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """Materialised: uid, doc_id, base spans and candidates with contexts (and
    the whole row in ``row``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), text.alias("text")]
    if keep_rows:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rest = ["row"] if keep_rows else []
    based = docs.select(*columns).withColumn("base", base_spans(F.col("text")))

    def around(spans: Column) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"), _contexts(F.col("text"), s).alias("patterns")
            ),
        )

    seen = F.concat(F.col("base"), candidates(F.col("text"), F.col("base")))
    return materialise(based.select("uid", "doc_id", *rest, "base", around(seen).alias("seen")), "personal-scan")


def discover(scanned: DataFrame, confidence: float = 0.8, support: int = 3) -> DataFrame:
    """Added spans: uid, kind, start, end."""
    seen = materialise(scanned.select("uid", F.explode("seen").alias("s")).select("uid", "s.*"), "personal-seen")
    edges = materialise(
        seen.select("value", "kind", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "value")
        .agg(F.max("kind").alias("seed")),
        "personal-graph",
    )
    seeds = edges.filter("seed != ''").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score"), F.lit(1).alias("known")).distinct()
    scores, found, known = seeds, None, 0
    while True:
        met = edges.groupBy("pattern").agg(F.count("*").alias("met"))
        confident = (
            edges.join(scores, "value")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("mass"), F.sum("known").alias("known"))
            .join(met, "pattern")
            .withColumn("confidence", F.least(F.col("mass") / F.col("met"), F.lit(1.0)))
            .filter((F.col("confidence") >= confidence) & (F.col("known") >= support))
        )
        strong = materialise(confident.select("pattern", "kind", "confidence"), "personal-patterns")
        scored = (
            edges.filter("seed = ''")
            .join(strong, "pattern")
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("confidence"))))).alias("score"))
        )
        # An instance keeps the kind it first got, so scores only rise.
        if found is None:
            scored = scored.withColumn("old", F.lit(0.0))
        else:
            before = found.select("value", F.col("kind").alias("old_kind"), F.col("score").alias("old"))
            scored = scored.join(before, "value", "left").filter("old_kind IS NULL OR old_kind = kind").withColumn("old", F.coalesce("old", F.lit(0.0)))
        best = scored.groupBy("value").agg(F.max(F.struct("score", "kind", "old")).alias("b")).select("value", "b.kind", "b.score", "b.old")
        found = materialise(best.withColumn("known", (F.col("score") >= confidence).cast("int")), "personal-scores")
        now = found.agg(F.sum("known").alias("known"), F.max(F.col("score") - F.col("old")).alias("rise")).first()
        # New instances and patterns show as a rise; without one the next turn repeats this one.
        if (now.rise or 0.0) <= SETTLED and (now.known or 0) == known:
            break
        known = now.known
        scores = seeds.unionByName(found.drop("old").join(seeds.select("value"), "value", "left_anti"))
    accepted = found.filter("known = 1").select("value", F.col("kind").alias("new_kind"))
    return seen.filter("kind = ''").join(accepted, "value").select("uid", F.col("new_kind").alias("kind"), "start", "end").distinct()


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start."""
    keyed = F.transform(
        spans, lambda s: F.struct(_order(s["kind"]).alias("o"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))
    )
    return F.array_join(
        F.transform(F.sort_array(keyed), lambda s: F.concat(s["k"], F.lit(":"), s["s"].cast("string"), F.lit(":"), s["e"].cast("string"))), ","
    )


def _with_added(scanned: DataFrame, **options) -> DataFrame:
    added = discover(scanned, **options).groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return (
        scanned.withColumn("plain", plain)
        .join(added, "uid", "left")
        .withColumn("all_spans", F.concat("plain", F.coalesce("added", none)))
    )


def find(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts of base spans and the span lists."""
    spans = _with_added(scan(docs), **options)
    count = lambda kind: F.size(F.filter("plain", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(_listed(F.col("plain")), 256).alias("base_sha256"),
        _listed(F.col("all_spans")).alias("spans"),
    )


def _replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; where spans
    overlap, the earlier (then the longer) one names the place of both."""
    kinds = "array<struct<start:int,end:int,kind:string>>"
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind")))
    )

    def step(acc: Column, s: Column) -> Column:
        end = -s["end"]
        one = F.array(F.struct(s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind")))
        last = F.element_at(acc, -1)
        joined = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), last["kind"].alias("kind")))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] > s["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), joined)).otherwise(
            F.concat(acc, one)
        )

    def rebuilt(m: Column) -> Column:
        pieces = F.transform(
            m,
            lambda s, i: F.concat(
                F.substring(text, F.coalesce(F.get(m, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(m, i - 1)["end"], F.lit(0))),
                F.lit("["),
                F.upper(s["kind"]),
                F.lit("]"),
            ),
        )
        rest = F.substring(text, F.get(m, F.size(m) - 1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(pieces, ""), rest)

    merged = F.aggregate(ordered, F.array().cast(kinds), step)
    return F.when(F.size(spans) == 0, text).otherwise(let(merged, rebuilt))


def redact(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, every span in their text replaced by ``[KIND]``."""
    spans = _with_added(scan(docs, keep_rows=True), **options)
    text = _replaced(F.col("row.text"), F.col("all_spans"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("new_text").alias("text"))
        elif c == "n_chars":
            columns.append(F.coalesce(F.length("new_text").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars")).alias("n_chars"))
        else:
            columns.append(F.col("row").getField(c).alias(c))
    return spans.select("row", text.alias("new_text")).select(*columns)
