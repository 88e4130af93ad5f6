"""Stylometry: frequency tables, z-scores, Delta, Zeta, chi-squared, Mendenhall; words as (text, pos, word)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import significant

VARIANTS = ("burrows", "quadratic", "eder", "cosine")


def frequency_table(ws: DataFrame, n_mfw: int = 100, culling: float = 0.0, by: str = "text") -> DataFrame:
    """text, word, rank, rel: relative frequencies of the n_mfw units of highest mean relative frequency over all texts
    (ties alphabetical), zeros included; culling: the least share of texts that have the unit."""
    if not 0 <= culling <= 1 or n_mfw < 1:
        raise ValueError("culling must be from 0 to 1, n_mfw 1 or more")
    counts = ws.groupBy(by, "word").agg(F.count(F.lit(1)).alias("f"))
    sizes = counts.groupBy(by).agg(F.sum("f").alias("n"))
    texts = sizes.agg(F.count(F.lit(1)).alias("k"))
    rel = counts.join(sizes, by).select(by, "word", (F.col("f") / F.col("n")).alias("rel"))
    means = rel.groupBy("word").agg(F.sum("rel").alias("s"), F.count(F.lit(1)).alias("texts")).crossJoin(F.broadcast(texts)).where(F.col("texts") >= culling * F.col("k"))
    top = means.select("word", significant(F.col("s") / F.col("k")).alias("m")).orderBy(F.desc("m"), "word").limit(n_mfw)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("m"), "word"))).select("word", "rank")  # n_mfw rows
    grid = sizes.select(by).crossJoin(F.broadcast(ranked))
    return grid.join(rel, [by, "word"], "left").select(by, "word", "rank", F.coalesce("rel", F.lit(0.0)).alias("rel"))


def z_scores(table: DataFrame, by: str = "text", stats: DataFrame | None = None) -> DataFrame:
    """Adds z over the texts (sample deviation; 0 for a constant unit); stats (word, mean, std) from elsewhere if given."""
    stats = stats if stats is not None else table.groupBy("word").agg(F.avg("rel").alias("mean"), F.stddev_samp("rel").alias("std"))
    return table.join(F.broadcast(stats), "word").withColumn("z", F.when(F.col("std") > 0, (F.col("rel") - F.col("mean")) / F.col("std")).otherwise(0.0)).drop("mean", "std")


def _distance(variant: str, n: Column) -> Column:
    gap = F.col("a") - F.col("b")
    return {
        "burrows": F.sum(F.abs(gap)) / n, "quadratic": F.sqrt(F.sum(gap * gap)) / n, "eder": F.sum(F.abs(gap) * (F.col("m") - F.col("rank") + 2)) / n,
        "cosine": 1 - F.coalesce(F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))), F.lit(1.0)),
    }[variant]


def _pairs(left: DataFrame, right: DataFrame, variant: str, by: str, above: bool) -> DataFrame:
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {', '.join(VARIANTS)}")
    a = left.select(F.col(by).alias("text_a"), "word", "rank", F.col("z").alias("a"))
    b = right.select(F.col(by).alias("text_b"), "word", F.col("z").alias("b"))
    rows = a.join(b, "word").where("text_a < text_b" if above else "true").crossJoin(F.broadcast(left.agg(F.max("rank").alias("m"))))
    return rows.groupBy("text_a", "text_b").agg(_distance(variant, F.max("m")).alias("distance"))


def delta(ws: DataFrame, n_mfw: int = 100, variant: str = "burrows", culling: float = 0.0, by: str = "text") -> DataFrame:
    """text_a, text_b, distance of every pair of texts; texts and units are few, so the pairs are of small vectors."""
    z = z_scores(frequency_table(ws, n_mfw, culling, by), by)
    return _pairs(z, z, variant, by, True)


def delta_profiles(reference: DataFrame, samples: DataFrame, n_mfw: int = 100, variant: str = "burrows", culling: float = 0.0, by: str = "text") -> DataFrame:
    """Distances of samples (text_a) to reference texts (text_b), scaled by the reference."""
    table = frequency_table(reference, n_mfw, culling, by)
    stats = table.groupBy("word").agg(F.avg("rel").alias("mean"), F.stddev_samp("rel").alias("std"))
    units = table.select("word", "rank").distinct()
    sizes = samples.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    counts = samples.join(F.broadcast(units), "word").groupBy(by, "word").agg(F.count(F.lit(1)).alias("f"))
    own = sizes.crossJoin(F.broadcast(units)).join(counts, [by, "word"], "left").select(by, "word", "rank", (F.coalesce("f", F.lit(0)) / F.col("n")).alias("rel"))
    return _pairs(z_scores(own, by, stats), z_scores(table, by, stats), variant, by, False)


def rolling_windows(ws: DataFrame, window: int, step: int, by: str = "text") -> DataFrame:
    """text, window, word: each word once for every complete window that holds it."""
    n = F.count(F.lit(1)).over(W.partitionBy(by))
    low, high = F.greatest(F.ceil((F.col("pos") - window + 1) / step), F.lit(0)), F.least(F.floor(F.col("pos") / step), F.floor((n - window) / step))
    rows = ws.select(by, "word", low.alias("low"), high.alias("high")).where("low <= high")
    return rows.select(by, F.explode(F.sequence("low", "high")).alias("window"), "word")


def rolling_delta(reference: DataFrame, text: DataFrame, window: int = 5000, step: int = 1000, n_mfw: int = 100, variant: str = "burrows", by: str = "text") -> DataFrame:
    """start, text_b, distance: windows of a text against the centroids of each reference text's windows."""
    as_text = lambda w: w.select(F.concat_ws("\u0001", F.col(by), F.col("window").cast("string")).alias(by), "word")
    table = frequency_table(as_text(rolling_windows(reference, window, step, by)), n_mfw, 0.0, by)
    stats = table.groupBy("word").agg(F.avg("rel").alias("mean"), F.stddev_samp("rel").alias("std"))
    centroids = z_scores(table, by, stats).withColumn(by, F.split(by, "\u0001")[0]).groupBy(by, "word", "rank").agg(F.avg("z").alias("z"))
    units = table.select("word", "rank").distinct()
    windows = rolling_windows(text, window, step, by).groupBy("window", "word").agg(F.count(F.lit(1)).alias("f"))
    own = windows.select("window").distinct().crossJoin(F.broadcast(units)).join(windows, ["window", "word"], "left").select(F.col("window").cast("string").alias(by), "word", "rank", (F.coalesce("f", F.lit(0)) / window).alias("rel"))
    return _pairs(z_scores(own, by, stats), centroids, variant, by, False).select((F.col("text_a").cast("long") * step + window // 2).alias("middle"), "text_b", "distance")


def segments(ws: DataFrame, size: int = 2000, by: str = "text") -> DataFrame:
    """Adds segment: max(1, round half up of n / size) nearly equal parts of each text, the first ones longer."""
    n = F.count(F.lit(1)).over(W.partitionBy(by))
    rows = ws.withColumn("_n", n).withColumn("_k", F.greatest(F.floor(F.col("_n") / size + 0.5), F.lit(1)))
    q, r = F.floor(F.col("_n") / F.col("_k")), F.col("_n") % F.col("_k")
    at = F.col("pos")
    return rows.withColumn("segment", F.when(at < r * (q + 1), F.floor(at / (q + 1))).otherwise(r + F.floor((at - r * (q + 1)) / q))).drop("_n", "_k")


def zeta(target: DataFrame, comparison: DataFrame, size: int = 2000, top_n: int | None = None, by: str = "text") -> DataFrame:
    """word, share_target, share_comparison, zeta, log_zeta: shares of the segments that have the word."""
    def shares(ws: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        cut = segments(ws, size, by).select(by, "segment", "word").distinct()
        k = cut.select(by, "segment").distinct().agg(F.count(F.lit(1)).alias(f"k_{name}"))
        return cut.groupBy("word").agg(F.count(F.lit(1)).alias(f"n_{name}")), k

    (a, ka), (b, kb) = shares(target, "a"), shares(comparison, "b")
    rows = a.join(b, "word", "full").crossJoin(F.broadcast(ka.crossJoin(kb)))
    na, nb = (F.coalesce(f"n_{x}", F.lit(0)) for x in "ab")
    pa, pb = na / F.col("k_a"), nb / F.col("k_b")
    log = F.log2(F.when(na > 0, pa).otherwise(0.5 / F.col("k_a")) / F.when(nb > 0, pb).otherwise(0.5 / F.col("k_b")))
    out = rows.select("word", pa.alias("share_target"), pb.alias("share_comparison"), (pa - pb).alias("zeta"), log.alias("log_zeta"))
    return out.orderBy(significant(F.col("zeta")).desc(), "word").limit(top_n) if top_n else out


def zeta_segments(ws: DataFrame, preferred: list[str], avoided: list[str], size: int = 2000, by: str = "text") -> DataFrame:
    """text, segment, preferred, avoided: shares of either list's markers that the segment has."""
    cut = segments(ws, size, by).select(by, "segment", "word").distinct()
    share = lambda marks, name: (F.count_if(F.col("word").isin(*marks)) / len(marks)).alias(name)
    return cut.groupBy(by, "segment").agg(share(preferred, "preferred"), share(avoided, "avoided"))


def kilgarriff_chi2(words_a: DataFrame, words_b: DataFrame, n_mfw: int = 500) -> DataFrame:
    """One row: chi2 over the n_mfw most frequent words of both corpora together."""
    count = lambda ws, f: ws.groupBy("word").agg(F.count(F.lit(1)).cast("double").alias(f))
    a, b = count(words_a, "a"), count(words_b, "b")
    sizes = a.agg(F.sum("a").alias("c")).crossJoin(b.agg(F.sum("b").alias("d")))
    both = a.join(b, "word", "full").select("word", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    top = both.orderBy((F.col("a") + F.col("b")).desc(), "word").limit(n_mfw).crossJoin(F.broadcast(sizes))
    t, n = F.col("a") + F.col("b"), F.col("c") + F.col("d")
    part = lambda o, size: (o - t * size / n) * (o - t * size / n) / (t * size / n)
    return top.agg(F.sum(part(F.col("a"), F.col("c")) + part(F.col("b"), F.col("d"))).alias("chi2"))


def mendenhall_curve(ws: DataFrame, by: str | None = None) -> DataFrame:
    """(by,) length, share: words by their number of characters."""
    keys = [by] if by else []
    g = ws.groupBy(*keys, F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, "length", (F.col("n") / F.sum("n").over(W.partitionBy(*keys))).alias("share"))


def mendenhall_distance(words_a: DataFrame, words_b: DataFrame) -> DataFrame:
    """One row: Jensen-Shannon distance of the two curves, base 2."""
    a, b = (mendenhall_curve(ws).withColumnRenamed("share", s) for ws, s in ((words_a, "p"), (words_b, "q")))
    both = a.join(b, "length", "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return both.agg(F.sqrt(F.greatest(F.sum(part("p") + part("q")) / 2, F.lit(0.0))).alias("distance"))
