"""Rows from statistics: flat columns, tables of several texts, parts of documents, windows, highlights, word trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import BLANK_LINE, LINE_BREAK, as_paragraphs, as_sentences, as_words, count_syllables, has_word

MOST_KEYS = 5000


def flatten(stats: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Dictionary statistics (maps) as columns name_key; a value that a row lacks is 0. At most MOST_KEYS columns a map."""
    out = stats
    for c, t in stats.dtypes:
        if t.startswith("map<") and (names is None or c in names):
            keys = [r.k for r in stats.select(F.explode(F.map_keys(c)).alias("k")).distinct().orderBy("k").limit(MOST_KEYS + 1).collect()]
            if len(keys) > MOST_KEYS:
                raise ValueError(f"{c} has more than {MOST_KEYS} keys")
            out = out.withColumns({f"{c}_{k}": F.coalesce(F.col(c)[F.lit(k)], F.lit(0)) for k in keys}).drop(c)
    return out


def stack(tables: list[DataFrame]) -> DataFrame:
    """Tables of several classes of texts as one: the union of their columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def parts(docs: DataFrame, kind: str = "sentences") -> DataFrame:
    """doc_id, part, text: sentences, lines or paragraphs, wordless lines included."""
    source = F.coalesce(F.col("text"), F.lit(""))
    pieces = {"sentences": as_sentences(source), "lines": F.split(source, LINE_BREAK), "paragraphs": as_paragraphs(source)}
    if kind not in pieces:
        raise ValueError("parts must be sentences, lines or paragraphs")
    return docs.select("doc_id", F.posexplode(pieces[kind]).alias("part", "text"))


def by_parts(docs: DataFrame, stats: Callable[..., DataFrame], kind: str = "sentences", **params) -> DataFrame:
    """stats(docs, keep=[doc_id, part]) of every part; parts without a word have null statistics."""
    rows = parts(docs, kind)
    found = stats(rows.where(has_word(F.col("text"))), keep=["doc_id", "part"], **params)
    return rows.select("doc_id", "part").join(found, ["doc_id", "part"], "left")


def split_windows(docs: DataFrame, window: int = 1000, min_words: int | None = None) -> DataFrame:
    """doc_id, window, text: pieces of `window` words with what stands between them; opening marks go to the right side,
    all other marks to the left; a shorter last piece is kept from min_words on."""
    word = r"[\p{L}\p{N}_][\p{L}\p{N}_\p{M}]*"
    unit = rf"(?U)(?:[\p{{Ps}}\p{{Pi}}«“„]*(?={word})){word}(?:(?!\s*[\p{{Ps}}\p{{Pi}}«“„]*{word})[\s\S]|\s+(?=[\p{{Ps}}\p{{Pi}}«“„]*{word}))*+"
    units = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(unit), F.lit(0))
    rows = docs.select("doc_id", units.alias("u")).withColumn("k", F.ceil(F.size("u") / window).cast("int")).where("k > 0")
    cut = rows.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.slice("u", i * window + 1, F.lit(window)))).alias("window", "piece"))
    least = window if min_words is None else min_words
    return cut.where(F.size("piece") >= least).select("doc_id", "window", F.trim(F.array_join("piece", "")).alias("text"))


def spans(docs: DataFrame, pattern: str, flag: Callable[[Column], Column], layer: str) -> DataFrame:
    """doc_id, start, end, layer, note: matches that a predicate takes, as character spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip(F.slice("gap", F.lit(1), F.size("m")).alias("gap"), F.col("m").alias("value"))).alias("i", "x"))
    upto = W.partitionBy("doc_id").orderBy("i")
    end = F.sum(F.length("x.gap") + F.length("x.value")).over(upto.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("doc_id", end.alias("end"), F.col("x.value").alias("note")).where(flag(F.col("note"))).select("doc_id", (F.col("end") - F.length("note")).alias("start"), "end", F.lit(layer).alias("layer"), "note")


def complex_words(docs: DataFrame, least: int = 3, syllables: Callable[[Column], Column] = count_syllables) -> DataFrame:
    from ..functions.text import WORD

    return spans(docs, WORD, lambda w: syllables(w) >= least, "complex_word")


def long_sentences(docs: DataFrame, least: int = 25) -> DataFrame:
    return docs.select("doc_id", F.posexplode(as_sentences(F.col("text"))).alias("sent_id", "sentence")).withColumn("n_words", F.size(as_words(F.col("sentence")))).where(F.col("n_words") >= least)


def elementary_segments(highlights: DataFrame) -> DataFrame:
    """doc_id, start, end, layers: the pieces between neighbouring bounds, with the layers that cover each."""
    bounds = highlights.select("doc_id", F.explode(F.array("start", "end")).alias("start")).distinct()
    pieces = bounds.withColumn("end", F.lead("start").over(W.partitionBy("doc_id").orderBy("start"))).where("end IS NOT NULL")
    h = highlights.select(F.col("doc_id").alias("d"), F.col("start").alias("a"), F.col("end").alias("z"), "layer")
    return pieces.join(h, (F.col("doc_id") == F.col("d")) & (F.col("a") <= F.col("start")) & (F.col("z") >= F.col("end"))).groupBy("doc_id", "start", "end").agg(F.array_sort(F.collect_set("layer")).alias("layers"))


def fingerprint(ws: DataFrame, segment: int = 100, metric: Callable[[DataFrame, list[str]], DataFrame] | None = None, column: str = "ttr") -> DataFrame:
    """doc_id, window, value: a metric over segments that overlap by nine tenths; the last one reaches the end."""
    from .diversity import order_free

    step = max(segment // 10, 1)
    n = F.count(F.lit(1)).over(W.partitionBy("doc_id"))
    last = F.greatest(F.ceil((n - segment) / step), F.lit(0))
    begin = lambda i, n_: F.least(i * step, F.greatest(n_ - segment, F.lit(0)))
    rows = ws.withColumn("n", n).withColumn("last", last)
    ids = F.filter(F.sequence(F.greatest(F.floor((F.col("pos") - segment) / step), F.lit(0)), F.least(F.floor(F.col("pos") / step) + 1, F.col("last"))), lambda i: (begin(i, F.col("n")) <= F.col("pos")) & (F.col("pos") < begin(i, F.col("n")) + segment))
    ids = F.when(F.array_contains(ids, F.col("last")) | (F.col("pos") < F.greatest(F.col("n") - segment, F.lit(0))), ids).otherwise(F.array_append(ids, F.col("last")))
    cut = rows.select("doc_id", "word", F.explode(ids).alias("window"))
    return (metric or order_free)(cut, ["doc_id", "window"]).select("doc_id", "window", F.col(column).alias("value"))


def word_tree(ws: DataFrame, keyword: str, max_n: int = 5, max_per_n: int = 8, forward: bool = True) -> DataFrame:
    """n, ngram, f: the most frequent n-grams that begin (or end) with a keyword, only extensions of kept ones."""
    key, kept, out = keyword.lower(), None, None
    at = W.partitionBy("doc_id").orderBy("pos")
    near = [F.col("word"), *((F.lead if forward else F.lag)("word", i).over(at) for i in range(1, max_n))]
    # the longest runs at the keyword are counted; shorter ones are their beginnings
    hit = (F.col("word") == key) | (F.col("word").startswith(key + "_") if forward else F.col("word").endswith("_" + key))
    runs = ws.select("word", F.filter(F.array(*near), lambda x: x.isNotNull()).alias("run")).where(hit).groupBy("run").agg(F.count(F.lit(1)).alias("c"))
    joined = lambda n: F.array_join(F.slice("run", 1, n) if forward else F.reverse(F.slice("run", 1, n)), "_")
    for n in range(2, max_n + 1):
        rows = runs.where(F.size("run") >= n)
        if kept is not None:
            rows = rows.join(F.broadcast(kept.select(F.col("word").alias("p"))), joined(n - 1) == F.col("p"), "left_semi")
        kept = rows.groupBy(joined(n).alias("word")).agg(F.sum("c").alias("f")).orderBy(F.desc("f"), "word").limit(max_per_n)
        part = kept.select(F.lit(n).alias("n"), F.col("word").alias("ngram"), "f")
        out = part if out is None else out.unionByName(part)
    return out


def moving_average(lengths: DataFrame, window: int = 10) -> DataFrame:
    half = window // 2
    return lengths.withColumn("average", F.avg("n_words").over(W.partitionBy("doc_id").orderBy("sent_id").rowsBetween(-half, window - half - 1)))


def paragraph_starts(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.size(F.filter(F.split(text, BLANK_LINE), has_word)).alias("n_paragraphs"), F.size(F.filter(F.split(text, LINE_BREAK), has_word)).alias("n_lines"))


def to_dataframe(stats: DataFrame, descriptions: dict[str, str] | None = None) -> DataFrame:
    """doc_id, stat, description, value: numbers of each document as rows, in the order of the columns."""
    names = [c for c, t in stats.dtypes if c != "doc_id" and t in ("int", "bigint", "double", "float")]
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("stat"), F.lit((descriptions or {}).get(c, c)).alias("description"), F.col(c).cast("double").alias("value")) for i, c in enumerate(names)))
    return stats.select("doc_id", F.inline(rows))


def print_stats(stats: DataFrame, doc_id, descriptions: dict[str, str] | None = None) -> None:
    """The statistics of one document, a line each."""
    for r in to_dataframe(stats.where(F.col("doc_id") == doc_id), descriptions).orderBy("place").collect():
        print(f"{r.description:<40}{r.value:>14.4f}")
