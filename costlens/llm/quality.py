"""Quality rules by weak supervision.

Each rule looks at one document and votes good (+1), bad (-1) or abstains
(0). No rule decides alone: expectation-maximisation over the counts of vote
patterns estimates, for both classes, how often every rule votes what, and a
document's verdict is the posterior probability of the good class.

Only DataFrame functions run here. Features are computed inside the row (a
document is never split over rows, nothing of its text is shuffled). The
counts of vote patterns are a table of at most 3**len(RULES) rows however
many documents there are; one EM step is one small aggregation over it.

Defined results: a null or empty text has no words and fails the base rules;
a null doc_id is kept as null; repeated rows are judged alike, each on its
own; an empty table gives an empty result (the model then keeps its start
values); columns other than doc_id and text are ignored by ``judge`` and
untouched by ``filter_documents``. Windows are compared by a 64-bit hash of
their words, inside one document only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import let, materialise, text_or_empty, words_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


def _repeated_words(hashes: Column) -> Column:
    """Number of words inside ``WINDOW``-word windows that occur twice or more.

    Sorting (hash, position) puts equal windows side by side, so the work is
    n log n however often a window repeats. The starts of repeated windows,
    in order, cover WINDOW words each less the overlap with the next."""
    windows = F.slice(
        F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)])),
        F.lit(1),
        F.size(hashes) - (WINDOW - 1),
    )

    def marked(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return let(
            pairs,
            lambda s: let(
                F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda e, i: F.coalesce((i > 0) & (F.get(s, i - 1)["h"] == e["h"]), F.lit(False))
                            | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)),
                        ),
                        lambda e: e["p"],
                    )
                ),
                lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                    F.lit(0),
                    lambda acc, x: acc + x,
                ),
            ),
        )

    counted = let(
        windows,
        lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(marked(win)),
    )
    return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(counted)


def features(text: Column) -> Column:
    """One struct of counts for a text; a null text counts as empty."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> list[Column]:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        pair = let(
            hashes,
            lambda h: F.struct(
                _repeated_words(h).alias("repeat"),
                F.size(F.filter(h, lambda x, i: F.coalesce((i > 0) & (F.get(h, i - 1) == x), F.lit(False)))).alias("again"),
            ),
        )
        return [F.size(w).alias("words"), F.length(F.array_join(w, "")).alias("chars"), pair.alias("pair")]

    return F.struct(
        let(words_of(text), lambda w: F.struct(*of_words(w))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}\p{Lu}")).alias("capitals"),
        F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s,.;:'’-]")).alias("marks"),
        F.regexp_count(text, F.lit(r"[.!?…»\"”][\x20\x09\x0B-\x0D]*(?=\n|\z)")).alias("ended"),
    )


#: Base columns of a document, from the feature struct ``f``.
def base_columns(f: Column) -> dict[str, Column]:
    n, repeat = f["w"]["words"].cast("long"), f["w"]["pair"]["repeat"].cast("long")
    return {
        "n_words": n,
        "word_chars": f["w"]["chars"].cast("long"),
        "n_symbols": f["symbols"].cast("long"),
        "n_dup_lines": f["l"]["dup"].cast("long"),
        "n_repeat_words": repeat,
        "base_failed": (n < 20) | (100 * repeat > 30 * n),
    }


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


#: Each rule: counts -> vote. Shares are of words unless named otherwise.
RULES: dict[str, object] = {
    "repeated_windows": lambda f, n: _vote(f["w"]["pair"]["repeat"] > 0.25 * n, f["w"]["pair"]["repeat"] <= 0.1 * n),
    "repeated_neighbours": lambda f, n: _vote(f["w"]["pair"]["again"] > 0.2 * n, f["w"]["pair"]["again"] <= 0.05 * n),
    "repeated_lines": lambda f, n: _vote(f["l"]["dup"] > 0.4 * f["l"]["lines"], (f["l"]["lines"] >= 4) & (f["l"]["dup"] == 0)),
    "symbols": lambda f, n: _vote(f["symbols"] > 0.15 * n, f["symbols"] <= 0.02 * n),
    "marks": lambda f, n: _vote(f["marks"] > 0.08 * f["w"]["chars"], f["marks"] <= 0.03 * f["w"]["chars"]),
    "capitals": lambda f, n: _vote(f["capitals"] > 0.15 * f["w"]["chars"], f["capitals"] <= 0.02 * f["w"]["chars"]),
    "line_ends": lambda f, n: _vote(f["ended"] < 0.1 * f["l"]["lines"], f["ended"] >= 0.8 * f["l"]["lines"]),
    "word_length": lambda f, n: _vote((f["w"]["chars"] > 12 * n) | (f["w"]["chars"] < 2.5 * n), (f["w"]["chars"] >= 3 * n) & (f["w"]["chars"] <= 8 * n)),
    "length": lambda f, n: _vote(n < 10, n >= 60),
}


def votes(f: Column) -> Column:
    n = f["w"]["words"]
    return F.array(*[rule(f, n) for rule in RULES.values()])


@dataclass
class Model:
    """Class share and, per rule, the chance of each vote (-1, 0, 1) in the
    good and in the bad class."""

    good_share: float = 0.8
    good: list[list[float]] = field(default_factory=lambda: [[0.02, 0.18, 0.8] for _ in RULES])
    bad: list[list[float]] = field(default_factory=lambda: [[0.4, 0.2, 0.4] for _ in RULES])
    steps: int = 0

    def log_odds(self, v: Column) -> Column:
        """ln P(good | votes) - ln P(bad | votes)."""
        terms = [F.lit(math.log(self.good_share / (1 - self.good_share)))]
        for j, (g, b) in enumerate(zip(self.good, self.bad)):
            table = F.array(*[F.lit(math.log(x / y)) for x, y in zip(g, b)])
            terms.append(F.get(table, F.get(v, F.lit(j)) + 1))
        return sum(terms[1:], terms[0])

    def posterior(self, v: Column) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(v)))


def fit(votes_table: DataFrame, steps: int = 25, smoothing: float = 0.01, settle: float = 1e-4) -> Model:
    """EM over all documents' votes (column ``votes``).

    ``smoothing`` documents' share is added to every vote of every class (the
    M step's prior), so no chance becomes 0 at any corpus size; EM ends when
    no estimate moves more than ``settle``, after ``steps`` steps at most."""
    patterns = materialise(votes_table.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1), "vote-patterns")
    model = Model()
    for _ in range(steps):
        p = model.posterior(F.col("votes"))
        long = patterns.select("n", p.alias("p"), F.posexplode("votes").alias("rule", "vote"))
        sums = long.groupBy("rule", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("g"), F.sum(F.col("n") * (1 - F.col("p"))).alias("b"))
        rows = {(r["rule"], r["vote"]): (r["g"], r["b"]) for r in sums.collect()}
        if not rows:
            return model
        total_g = sum(rows.get((0, v), (0, 0))[0] for v in (-1, 0, 1))
        total_b = sum(rows.get((0, v), (0, 0))[1] for v in (-1, 0, 1))
        total = total_g + total_b

        def share(j: int, side: int, of: float) -> list[float]:
            return [
                (rows.get((j, v), (0, 0))[side] + smoothing * of / 3 + 1e-9) / (of + smoothing * of + 3e-9) for v in (-1, 0, 1)
            ]

        new = Model(
            min(max(total_g / total, 0.01), 0.99),
            [share(j, 0, total_g) for j in range(len(RULES))],
            [share(j, 1, total_b) for j in range(len(RULES))],
            model.steps + 1,
        )
        moved = max(
            [abs(new.good_share - model.good_share)]
            + [abs(x - y) for a, b in zip(new.good + new.bad, model.good + model.bad) for x, y in zip(a, b)]
        )
        model = new
        if moved < settle:
            break
    return model


def _kept(failed: Column, p: Column, threshold: float) -> Column:
    return F.when(failed, F.lit(False)).otherwise(p >= threshold)


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: base counts, votes, posterior and verdict."""
    f = F.col("f")
    counted = docs.select(F.col("doc_id"), features(text_or_empty()).alias("f")).select(
        "doc_id", *[c.alias(k) for k, c in base_columns(f).items()], votes(f).alias("votes")
    )
    table = materialise(counted, "quality-votes")
    model = fit(table)
    p = model.posterior(F.col("votes"))
    return table.withColumn("posterior", p).withColumn("kept", _kept(F.col("base_failed"), F.col("posterior"), threshold))


def filter_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents kept, whole rows. The verdict is computed in the row
    again from the fitted model, so repeated doc_ids need no join."""
    model = fit(docs.select(features(text_or_empty()).alias("f")).select(votes(F.col("f")).alias("votes")))
    # One lambda variable, not a column: a filter on a column would be pushed
    # below it with a copy of the features for every use.
    kept = let(
        features(text_or_empty()),
        lambda f: _kept(base_columns(f)["base_failed"], model.posterior(votes(f)), threshold),
    )
    return docs.filter(kept)
