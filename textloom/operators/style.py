"""Style and search-engine metrics over words (doc_id, pos, word)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .words import frequencies, ngrams, phrase_spans

NAN = float("nan")
TOP_N = 10


def style_stats(ws: DataFrame, stop_words: list[str] | None = None, top_n: int = TOP_N, by: str = "doc_id") -> DataFrame:
    """classic_nausea, academic_nausea, water, spam, zipf_naturalness of each document.

    Nausea counts the top_n significant words (no stop words), ties by first place. Frequencies are counted once.
    """
    stop = F.col("word").isin(*stop_words) if stop_words else F.lit(False)
    freq = ws.groupBy(by, "word").agg(F.count(F.lit(1)).alias("f"), F.min("pos").alias("first")).withColumn("stop", stop)
    w = W.partitionBy(by).orderBy(F.desc("f"), "first")
    ranked = freq.withColumn("r", F.row_number().over(w)).withColumn("own", F.row_number().over(W.partitionBy(by).orderBy("stop", F.desc("f"), "first")))
    n, v, f1 = F.sum("f"), F.count(F.lit(1)), F.max("f")
    g = ranked.groupBy(by).agg(
        n.alias("n"), v.alias("v"), f1.alias("f1"), F.coalesce(F.sum(F.when(~F.col("stop") & (F.col("own") <= top_n), F.col("f"))), F.lit(0)).alias("top"), F.coalesce(F.sum(F.when(F.col("stop"), F.col("f"))), F.lit(0)).alias("water"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= top_n, F.struct("r", "f")))).alias("head"),
    )
    m = F.least(F.lit(top_n).cast("long"), F.col("v"), F.col("f1"))
    span = F.col("f1") * (m - 1)
    off = F.aggregate(F.filter("head", lambda x: (x["r"] >= 2) & (x["r"] <= m)), F.lit(0).cast("long"), lambda a, x: a + F.abs(x["f"] * x["r"] - F.col("f1")))
    zipf = F.when(m < 2, NAN).otherwise(F.greatest(F.lit(0.0), 100 * F.try_divide((span - off).cast("double"), span)))
    return g.select(by, F.sqrt("f1").alias("classic_nausea"), (100 * F.col("top") / F.col("n")).alias("academic_nausea"), (100 * F.col("water") / F.col("n")).alias("water"), (100 * (F.col("n") - F.col("v")) / F.col("n")).alias("spam"), zipf.alias("zipf_naturalness"))


def nausea_words(ws: DataFrame, top_n: int = TOP_N, stop_words: list[str] | None = None, by: str = "doc_id") -> DataFrame:
    rows = ws.where(~F.col("word").isin(*stop_words)) if stop_words else ws
    freq = rows.groupBy(by, "word").agg(F.count(F.lit(1)).alias("f"), F.min("pos").alias("first"))
    return freq.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("f"), "first"))).where(F.col("rank") <= top_n).drop("first")


def keyword_density(ws: DataFrame, keywords: list[str], by: str = "doc_id") -> DataFrame:
    """by, keyword, density: occurrences (overlapping ones count) per 100 words, for every document and keyword."""
    sizes = ws.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    groups: dict[int, list[str]] = {}
    for k in keywords:
        groups.setdefault(len(k.split()), []).append("_".join(k.lower().split()))
    found = None
    for n, keys in groups.items():
        part = ngrams(ws, n, by).where(F.col("word").isin(*keys)).groupBy(by, "word").agg(F.count(F.lit(1)).alias("f"))
        found = part if found is None else found.unionByName(part)
    all_keys = ws.sparkSession.createDataFrame([("_".join(k.lower().split()),) for k in keywords], "word string")
    return sizes.crossJoin(F.broadcast(all_keys)).join(found, [by, "word"], "left").select(by, F.regexp_replace("word", "_", " ").alias("keyword"), (100 * F.coalesce("f", F.lit(0)) / F.col("n")).alias("density"))


def phrase_density(ws: DataFrame, phrases: DataFrame, name: str = "phrases", by: str = "doc_id") -> DataFrame:
    """Longest non-overlapping phrases per 100 words (clichés, compound prepositions, parentheticals)."""
    sizes = ws.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    spans = phrase_spans(ws, phrases, by).groupBy(by).agg(F.count(F.lit(1)).alias("f"))
    return sizes.join(spans, by, "left").select(by, (100 * F.coalesce("f", F.lit(0)) / F.col("n")).alias(name))


def parentheticals(ws: DataFrame, phrases: DataFrame, flag: str | None = None, by: str = "doc_id") -> DataFrame:
    """by, start, end: phrases, and single words with a true `flag` outside them."""
    spans = phrase_spans(ws, phrases, by).select(by, "start", "end")
    if flag is None:
        return spans
    covered = spans.select(by, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    return spans.unionByName(ws.where(F.col(flag)).join(covered, [by, "pos"], "left_anti").select(by, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")))


def verbal_nouns(ws: DataFrame, flag: str = "verbal", by: str = "doc_id") -> DataFrame:
    return ws.groupBy(by).agg((100 * F.coalesce(F.avg(F.when(F.col("upos") == "NOUN", F.col(flag).cast("double"))), F.lit(NAN))).alias("verbal_nouns"))


def top_words(ws: DataFrame, n: int = TOP_N, by: str = "doc_id") -> DataFrame:
    return frequencies(ws, by).withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("f"), "word"))).where(F.col("rank") <= n)


def expand_phrases(phrases: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """variant, phrase: every phrase as it is, and the variants (variant, phrase) of those that are there."""
    own = phrases.select(F.lower("phrase").alias("variant"), F.lower("phrase").alias("phrase")).distinct()
    if variants is None:
        return own
    more = variants.select(F.lower("variant").alias("variant"), F.lower("phrase").alias("phrase")).join(own.select("phrase"), "phrase", "left_semi")
    return own.unionByName(more.select("variant", "phrase")).distinct()


def markers(ws: DataFrame, lists: dict[str, DataFrame], by: str = "doc_id") -> DataFrame:
    """by, metric, found: the phrases of each list (metric -> phrase) in the order of the text, repetitions included."""
    out = None
    for metric, phrases in lists.items():
        found = phrase_spans(ws, phrases, by).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "phrase"))), lambda x: x["phrase"]).alias("found")).select(by, F.lit(metric).alias("metric"), "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("markers need a list of phrases")
    return out
