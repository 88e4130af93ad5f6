"""Phonetics over distinct words, weighted by their frequency; classes of sounds are strings of letters."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import ratio

NAN = float("nan")
VOWELS, SONORANTS, VOICED, VOICELESS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüœ", "lmnrwjñ", "bdgvz", "pfktscqhxçß"


def cv_pattern(word: Column, vowels: str = VOWELS, consonants: str = SONORANTS + VOICED + VOICELESS) -> Column:
    """V and C for the sounds of a word, others left out."""
    return F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(word, f"[{vowels}]", "\u0001"), f"[{consonants}]", "\u0002"), "[^\u0001\u0002]", ""), "\u0001\u0002", "VC")


def consonant_clusters(word: Column, consonants: str = SONORANTS + VOICED + VOICELESS) -> Column:
    return F.transform(F.regexp_extract_all(word, F.lit(f"[{consonants}]+"), F.lit(0)), lambda c: F.length(c))


def count_hiatus(word: Column, vowels: str = VOWELS) -> Column:
    """Runs of two or more vowels."""
    return F.regexp_count(word, F.lit(f"[{vowels}]{{2,}}"))


def phon_stats(ws: DataFrame, vowels: str = VOWELS, sonorants: str = SONORANTS, voiced: str = VOICED, voiceless: str = VOICELESS, by: str = "doc_id", transcribe: Callable[[Column], Column] | None = None, skipped: str = "") -> DataFrame:
    """transcribe: a language's hook, an expression of a word whose letters are its sounds; skipped: signs that are no
    sounds and don't part a cluster. Words are their letters by default."""
    consonants = sonorants + voiced + voiceless
    freq = ws.groupBy(by, "word").agg(F.count(F.lit(1)).alias("f"))
    if transcribe is not None:
        freq = freq.withColumn("word", transcribe(F.col("word")))
    if skipped:
        freq = freq.withColumn("word", F.regexp_replace("word", f"[{skipped}]", ""))
    count = lambda chars: F.regexp_count("word", F.lit(f"[{chars}]")) * F.col("f")
    clusters = consonant_clusters(F.col("word"), consonants)
    pattern = cv_pattern(F.col("word"), vowels, consonants)
    rows = freq.select(by, "f", pattern.alias("cv"), count(vowels).alias("v"), count(sonorants).alias("s"), count(voiced).alias("d"), count(voiceless).alias("t"), (F.size(clusters) * F.col("f")).alias("k"), (F.size(F.filter(clusters, lambda x: x >= 3)) * F.col("f")).alias("heavy"), (count_hiatus(F.col("word"), vowels) * F.col("f")).alias("h"))
    per = rows.groupBy(by, "cv").agg(*(F.sum(c).alias(c) for c in ("f", "v", "s", "d", "t", "k", "heavy", "h")))
    g = per.groupBy(by).agg(*(F.sum(c).alias(c) for c in ("f", "v", "s", "d", "t", "k", "heavy", "h")), F.sum(F.col("f") * F.log2("f")).alias("fl"))
    v, s, d, t = (F.col(c) for c in "vsdt")
    all_ = v + s + d + t
    r = lambda a, b: ratio(a, b, None)
    return g.select(by, r(v, all_).alias("p_vowels"), r(s, all_).alias("p_sonorants"), r(d, all_).alias("p_voiced"), r(t, all_).alias("p_voiceless"), r(s + d + t, v).alias("consonant_vowel_ratio"), r(F.col("heavy"), F.col("k")).alias("p_heavy_clusters"), r(F.col("h"), F.col("f")).alias("p_hiatus"), (F.log2("f") - F.col("fl") / F.col("f")).alias("cv_entropy"), r(t, v + s).alias("hardness"))


def repetition_index(ws: DataFrame, sounds: str, window: int = 3, by: str = "doc_id") -> DataFrame:
    """Windows of words in which two or more have a sound, over what the sound's number of words makes likely."""
    n = F.count(F.lit(1)).over(W.partitionBy(by))
    sized = ws.select(by, "pos", "word", n.alias("n"))  # before the explode, which would change the count
    has = sized.select(by, "pos", "n", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(f"[{sounds}]"), F.lit(0)))).alias("sound"))
    # place by place only where a sound occurs; the windows with two or more are unions of short intervals
    w = W.partitionBy(by, "sound").orderBy("pos")
    pairs = has.select(by, "sound", "n", "pos", F.lead("pos").over(w).alias("next"), F.lag("pos").over(w).alias("prev"))
    low = lambda a, b: F.greatest(b - window + 1, F.lit(0))
    reach = F.least(F.col("pos"), F.col("n") - window)
    before = F.when(F.col("prev").isNotNull(), F.greatest(F.least(F.col("prev"), F.col("n") - window), low(None, F.col("pos")) - 1)).otherwise(low(None, F.col("next")) - 1)
    begin = F.greatest(low(None, F.col("next")), before + 1)
    hits = pairs.withColumn("hit", F.when(F.col("next").isNotNull(), F.greatest(reach - begin + 1, F.lit(0))).otherwise(0))
    counts = hits.groupBy(by, "sound").agg(F.sum("hit").alias("seen"), F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    x, c = F.col("n").cast("double"), F.col("c").cast("double")
    def choose(m: Column, k: int, times: Column = F.lit(1.0)) -> Column:
        # one division of whole numbers, so that a sound that can't recur has an expectation of exactly 0
        for i in range(k):
            times = times * F.greatest(m - i, F.lit(0.0))
        return times / math.factorial(k)
    p = 1 - F.try_divide(choose(x - c, window) + choose(x - c, window - 1, c), choose(x, window))
    # summed in the order of the sounds, whatever order the rows came in
    expected = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("sound", ((F.col("n") - window + 1) * p).alias("e")))), lambda s: s["e"]), F.lit(0.0), lambda a, e: a + F.coalesce(e, F.lit(0.0)))
    g = counts.groupBy(by).agg(F.sum("seen").alias("seen"), expected.alias("expected"))
    return g.select(by, ratio(F.col("seen"), F.when(F.col("expected") > 0, F.col("expected")), None).alias("repetition_index"))


def syllable_stats(syllables: DataFrame, vowels: str = VOWELS, by: str = "doc_id") -> DataFrame:
    """by, syllable (given by a language's hook) -> p_open_syllables, mean_syllable_len."""
    rows = syllables.where(F.col("syllable") != "")
    return rows.groupBy(by).agg(F.avg(F.col("syllable").rlike(f"[{vowels}]$").cast("double")).alias("p_open_syllables"), F.avg(F.length("syllable").cast("double")).alias("mean_syllable_len"))
