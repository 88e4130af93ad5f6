"""Mixing sources to target weights: a token budget goes down a domain-language-source tree.

A node passes its budget to its children by weight, none more than its subtree can give; what a child can't take
goes to its siblings first (water-filling) and reaches the parent's siblings only if all of them are full. A leaf
takes whole epochs, then the token-prefix of one more epoch in a seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import kept_rows, written

LEVELS = ("domain", "lang", "source")
#: A leaf's seeded order is cut into so many ranges; only the range where the budget ends is ordered row by row.
RANGES = 4096
#: Leaves whose supplies the driver may hold; more is an error, never a cut.
MOST_LEAVES = 200_000
#: Target shares of languages, within each domain; others get OTHER.
LANGUAGES, OTHER = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, 0.1


def domain_of(source: str = "source"):
    """Stand-in for a dimension table of sources: sources src0-src9 are d0, src10-src19 d1, and so on; others "?"."""
    number = F.regexp_extract(F.coalesce(F.col(source).cast("string"), F.lit("")), "^src([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), F.floor(number.cast("int") / 10).cast("string"))).otherwise("?")


def fill(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Shares of a budget by (weight, capacity): what a full child leaves goes to the others by weight."""
    given, open_ = [0.0] * len(children), {i for i, (w, c) in enumerate(children) if w > 0 and c > 0}
    rest = budget
    while open_ and rest > 0:
        weight = sum(children[i][0] for i in open_)
        full = [i for i in open_ if rest * children[i][0] / weight >= children[i][1]]
        if not full:
            for i in open_:
                given[i] = rest * children[i][0] / weight
            return given
        for i in full:
            given[i] = children[i][1]
        rest -= sum(children[i][1] for i in full)
        open_ -= set(full)
    return given


def budgets(supplies: Mapping[tuple, int], weight, budget: float, epochs: float) -> dict[tuple, float]:
    """Tokens for each leaf (a path of keys). weight(path) is the weight of a node among its siblings."""
    given: dict[tuple, float] = {}

    def go(path: tuple, leaves: dict[tuple, int], amount: float) -> None:
        if path in leaves:
            given[path] = amount
            return
        groups: dict[tuple, dict[tuple, int]] = {}
        for leaf, n in leaves.items():
            groups.setdefault(leaf[: len(path) + 1], {})[leaf] = n
        keys = sorted(groups)
        shares = fill(amount, [(weight(k), epochs * sum(groups[k].values())) for k in keys])
        for k, share in zip(keys, shares):
            go(k, groups[k], share)

    go((), dict(supplies), budget)
    return given


def _weight(path: tuple) -> float:
    return LANGUAGES.get(path[1], OTHER) if len(path) == 2 else 1.0


def mix(docs: DataFrame, share: float = 0.9, epochs: float = 2.0, seed: int = 17, weight=_weight) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies: how often each row of docs (doc_id, text, lang, source) is taken.

    The budget is `share` of all tokens (words between white space); no leaf gives more than `epochs` times its own.
    Null lang or source is "?". The prefix ends with the last document that fits; ties in the seeded order go by
    doc_id, null first, then by a hash of the text. Documents without a word cost nothing and are taken with the prefix they stand in. Repeated
    rows are rows of their own at the same place of the order. An empty table gives no rows.
    """
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("lang", "source"))
    n = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of().alias("domain"), lang.alias("lang"), source.alias("source"), n.alias("n_tokens"), F.xxhash64("text").alias("tie")), "tokens")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(leaves) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    supplies = {tuple(r[c] for c in LEVELS): r.n for r in leaves}
    given = budgets(supplies, weight, share * sum(supplies.values()), epochs)
    cuts = []
    for leaf, n in supplies.items():
        whole = min(int(given[leaf] // n), int(epochs)) if n else 0
        cuts.append((*leaf, whole, int(given[leaf]) - whole * n))
    table = rows.sparkSession.createDataFrame(cuts, "domain string, lang string, source string, whole long, rest long")
    hashed = rows.join(F.broadcast(table), list(LEVELS)).withColumn("order", F.xxhash64(F.lit(seed), "whole", "doc_id")).withColumn("range", F.shiftrightunsigned("order", 52).cast("int"))
    by = W.partitionBy(*LEVELS).orderBy("range")
    ranges = hashed.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("in_range")).withColumn("before", F.sum("in_range").over(by.rowsBetween(W.unboundedPreceding, -1)))
    ranges = ranges.select(*LEVELS, "range", F.coalesce("before", F.lit(0)).alias("before"), "in_range")
    placed = written(hashed.join(ranges, [*LEVELS, "range"]).withColumn("cut", (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("in_range") > F.col("rest"))), "ranges")
    out = ["doc_id", *LEVELS, "n_tokens"]
    plain = placed.where("not cut").select(*out, (F.col("whole") + (F.col("before") + F.col("in_range") <= F.col("rest")).cast("long")).alias("copies"))
    exact = W.partitionBy(*LEVELS, "range").orderBy("order", "doc_id", "tie").rowsBetween(W.unboundedPreceding, 0)
    border = placed.where("cut").withColumn("upto", F.col("before") + F.sum("n_tokens").over(exact))
    return plain.unionByName(border.select(*out, (F.col("whole") + (F.col("upto") <= F.col("rest")).cast("long")).alias("copies")))


def mixed_documents(docs: DataFrame, share: float = 0.9, seed: int = 17) -> DataFrame:
    """The rows of docs that the mixture takes, once each (one epoch at most), with all their columns."""
    return kept_rows(docs, lambda rows: mix(rows, share, 1.0, seed).where("copies > 0"))
