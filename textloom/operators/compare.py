"""Comparing two corpora by features: values(feature, corpus, text, value), corpus being one of two labels."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType

from ..functions.text import as_sentences, as_words, significant

NAN = float("nan")


def effect_sizes(values: DataFrame, a: str = "A", b: str = "B", by: str = "feature") -> DataFrame:
    """Counts, means, medians, Cohen's d (pooled, sample variance), Cliff's delta by mid-ranks, Mann-Whitney U and its
    p-value by the normal approximation with corrections for ties and continuity. nan and infinite values are left out."""
    rows = values.where(~F.isnan("value") & (F.abs("value") != float("inf")) & F.col("value").isNotNull())
    w = W.partitionBy(by)
    ties = F.count(F.lit(1)).over(W.partitionBy(by, "value"))
    ranked = rows.withColumn("ties", ties).withColumn("mid", F.rank().over(w.orderBy("value")) + (F.col("ties") - 1) / 2)
    x, y = F.col("corpus") == a, F.col("corpus") == b
    v = F.col("value")
    g = ranked.groupBy(by).agg(
        F.count_if(x).alias("n_a"), F.count_if(y).alias("n_b"), F.avg(F.when(x, v)).alias("mean_a"), F.avg(F.when(y, v)).alias("mean_b"), F.expr(f"percentile(CASE WHEN corpus = '{a}' THEN value END, 0.5)").alias("median_a"), F.expr(f"percentile(CASE WHEN corpus = '{b}' THEN value END, 0.5)").alias("median_b"),
        F.var_samp(F.when(x, v)).alias("va"), F.var_samp(F.when(y, v)).alias("vb"), F.sum(F.when(x, F.col("mid"))).alias("ra"), F.sum(F.col("ties") * F.col("ties") - 1.0).alias("t"),
    )
    n, m = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    enough = (n >= 2) & (m >= 2)
    u = F.col("ra") - n * (n + 1) / 2
    pooled = F.try_divide((n - 1) * F.col("va") + (m - 1) * F.col("vb"), n + m - 2)
    d = F.when(enough & (pooled > 0), F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(pooled))).otherwise(NAN)
    total = n + m
    sd = F.sqrt(F.try_divide(n * m, F.lit(12.0)) * ((total + 1) - F.try_divide(F.col("t"), total * (total - 1))))
    z = F.when(enough & (sd > 0), F.try_divide(F.greatest(F.abs(u - n * m / 2) - 0.5, F.lit(0.0)), sd)).otherwise(NAN)
    return g.select(by, "n_a", "n_b", "mean_a", "mean_b", "median_a", "median_b", d.alias("cohen_d"), F.when(enough, 2 * F.try_divide(u, n * m) - 1).otherwise(NAN).alias("cliff_delta"), u.alias("u"), z.alias("z"), F.coalesce(F.col("t") > 0, F.lit(False)).alias("tied"))


@F.pandas_udf(DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else NAN)


EXACT_MOST = 50


@F.pandas_udf(DoubleType())
def small_sample_p(u: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([exact_p(*r) for r in zip(u, n, m)], dtype=float)


def exact_p(u: float, n: int, m: int) -> float:
    """Two-sided exact p of U without ties, by counting orders."""
    counts = np.ones(1)
    for i in range(1, min(n, m) + 1):  # Gaussian binomial, factor by factor
        up = np.zeros(len(counts) + max(n, m) + i)
        up[: len(counts)] += counts
        up[max(n, m) + i :] -= counts[: len(up) - max(n, m) - i]
        out = up.copy()
        for k in range(i, len(out)):
            out[k] += out[k - i]
        counts = out[: i * max(n, m) + 1]
    low = int(math.floor(min(u, n * m - u)))
    return float(min(1.0, 2 * counts[: low + 1].sum() / counts.sum()))


def holm(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """Adds p_holm: step-down over the defined p-values, running maximum, at most 1."""
    ok = tests.where(~F.isnan(p))
    w = W.orderBy(p)  # a row a feature
    m = F.count(F.lit(1)).over(W.partitionBy())
    ranked = ok.withColumn("_x", F.col(p) * (m - F.row_number().over(w) + 1))
    done = ranked.withColumn("p_holm", F.least(F.lit(1.0), F.max("_x").over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("_x")
    return done.unionByName(tests.where(F.isnan(p)).withColumn("p_holm", F.lit(NAN)))


def bootstrap_median_diff(values: DataFrame, a: str = "A", b: str = "B", n_bootstrap: int = 1000, seed: int = 0, confidence: float = 0.95, by_text: bool = False, by: str = "feature") -> DataFrame:
    """feature, low, high: percentile interval of the difference of medians, over values or over whole texts. A
    feature's generator is seeded by (seed, crc32 of its name); values are drawn by their rank, so the order of the rows
    doesn't show. One sample is held at a time: 8 bytes a value, however many samples."""
    needed = values.select(by, F.col("corpus").cast("string").alias("corpus"), F.col("value").cast("double").alias("value"), *(["text"] if by_text else []))

    def median_of(rng, ordered: np.ndarray) -> float:
        n = len(ordered)
        low, high = (n - 1) // 2, n // 2
        picked = np.partition(rng.integers(0, n, n), (low, high))
        return (ordered[picked[low]] + ordered[picked[high]]) / 2

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode())])
        pdf = pdf[np.isfinite(pdf.value)]
        sides = []
        for label in (a, b):
            own = pdf[pdf.corpus == label]
            units = [g.value.to_numpy() for _, g in own.groupby("text")] if by_text else np.sort(own.value.to_numpy())
            if len(units) < 2:
                return pd.DataFrame([[key[0], NAN, NAN]], columns=[by, "low", "high"])
            sides.append(np.array([np.median(np.concatenate([units[i] for i in rng.integers(0, len(units), len(units))])) if by_text else median_of(rng, units) for _ in range(n_bootstrap)]))
        low, high = np.quantile(sides[0] - sides[1], [(1 - confidence) / 2, (1 + confidence) / 2])
        return pd.DataFrame([[key[0], low, high]], columns=[by, "low", "high"])

    return needed.groupBy(by).applyInPandas(run, f"{by} string, low double, high double")


def compare_features(values: DataFrame, labels: tuple[str, str] = ("A", "B"), n_bootstrap: int = 1000, seed: int = 0) -> DataFrame:
    """Effect sizes, p-values with Holm's correction and bootstrap intervals, by falling |Cliff's delta|."""
    if len(set(labels)) != 2:
        raise ValueError("labels must be two different names")
    e = effect_sizes(values, *labels)
    # exact where there are no ties and both samples are small; the rest by the normal approximation
    small = ~F.col("tied") & (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (F.greatest("n_a", "n_b") <= EXACT_MOST)
    size = lambda c: F.when(small, F.col(c)).otherwise(F.lit(2)).cast("int")
    exact = small_sample_p(F.when(small, F.col("u")).otherwise(F.lit(2.0)), size("n_a"), size("n_b"))
    e = holm(e.withColumn("p_value", F.when(small, exact).otherwise(two_sided("z")))).drop("tied")
    out = e.join(bootstrap_median_diff(values, *labels, n_bootstrap=n_bootstrap, seed=seed), "feature", "left")
    return out.orderBy(F.isnan("cliff_delta"), significant(F.abs("cliff_delta")).desc(), "feature")


def unpivot(stats: DataFrame, corpus: str, features: list[str], text: str = "doc_id") -> DataFrame:
    """Statistics as values(feature, corpus, text, value)."""
    return stats.select(F.col(corpus).cast("string").alias("corpus"), F.col(text).cast("string").alias("text"), F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))))


def sentence_lengths(docs: DataFrame) -> DataFrame:
    lengths = F.filter(F.transform(as_sentences(F.col("text")), lambda s: F.size(as_words(s))), lambda n: n > 0)
    return docs.select("doc_id", F.posexplode(lengths).alias("sent_id", "n_words"))


def sentence_rhythm(lengths: DataFrame) -> DataFrame:
    """mean, std, cv, autocorr: sentence lengths and their correlation with the next one (about the text's mean)."""
    x = F.col("n_words") - F.avg("n_words").over(W.partitionBy("doc_id"))
    rows = lengths.withColumn("x", x).withColumn("y", F.lag("x").over(W.partitionBy("doc_id").orderBy("sent_id")))
    g = rows.groupBy("doc_id").agg(F.avg("n_words").alias("mean"), F.coalesce(F.stddev_samp("n_words"), F.lit(NAN)).alias("std"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    return g.select("doc_id", "mean", "std", (F.col("std") / F.col("mean")).alias("cv"), F.when(F.col("xx") > 0, F.coalesce(F.try_divide("xy", "xx"), F.lit(NAN))).otherwise(NAN).alias("autocorr"))
