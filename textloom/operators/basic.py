"""Basic statistics and readability: row-wise expressions over a document's arrays; no shuffle at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, as_words, by_scale, count_letters, count_sentences, count_syllables, entropy_of, half_up, is_number, punctuation_counts, ratio

SHARES = {"p_unique_words": "n_words", "p_long_words": "n_words", "p_complex_words": "n_words", "p_simple_words": "n_words", "p_monosyllable_words": "n_words", "p_polysyllable_words": "n_words", "p_letters": "n_chars", "p_spaces": "n_chars", "p_punctuations": "n_chars"}


def _histogram(values: Column) -> Column:
    """Map of value -> count."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(v, F.size(F.filter(values, lambda x: x == v)))))


def basic_stats(docs: DataFrame, *, filter_numbers: bool = False, long_word: int = 7, complex_word: int = 3, syllables: Callable[[Column], Column] = count_syllables, normalize: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row a document: counts of sentences, words, letters, syllables and marks, histograms and their entropies.

    syllables: the language's hook, an expression of a word. A text without words has zero counts and nan entropies.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(*(keep or ["doc_id"]), text.alias("text")).withColumn("_all", as_words(F.col("text")))
    df = df.withColumn("_w", F.filter("_all", lambda w: ~is_number(w)) if filter_numbers else F.col("_all"))
    df = df.withColumn("_l", F.transform("_w", lambda w: count_letters(w))).withColumn("_s", F.transform("_w", lambda w: syllables(w)))
    marks = punctuation_counts(F.col("text"))
    df = df.withColumn("c_punctuations", F.map_filter(F.create_map(*[x for k, c in marks.items() for x in (F.lit(k), c)]), lambda k, v: v > 0))
    n = lambda col, test: F.size(F.filter(col, test))
    df = df.withColumn("c_letters", _histogram(F.col("_l"))).withColumn("c_syllables", _histogram(F.col("_s")))
    df = df.select(
        *(keep or ["doc_id"]), "c_letters", "c_syllables", "c_punctuations",
        count_sentences(F.col("text")).alias("n_sents"), F.size("_w").alias("n_words"), (F.size("_all") - F.size("_w")).alias("n_numbers"),
        F.size(F.array_distinct(F.transform("_w", F.lower))).alias("n_unique_words"),
        n("_l", lambda x: x >= long_word).alias("n_long_words"), n("_s", lambda x: x >= complex_word).alias("n_complex_words"),
        n("_s", lambda x: (x > 0) & (x < complex_word)).alias("n_simple_words"), n("_s", lambda x: x == 1).alias("n_monosyllable_words"), n("_s", lambda x: x > 1).alias("n_polysyllable_words"),
        n("_s", lambda x: x <= 1).alias("n_short_words"), n("_s", lambda x: x >= 1).alias("n_syllabic_words"), n("_l", lambda x: (x >= 1) & (x <= 3)).alias("n_mini_words"),
        F.length(F.regexp_replace("text", LINE_BREAK, "")).alias("n_chars"), F.length(F.regexp_replace("text", r"[^\p{L}]", "")).alias("n_letters"), F.regexp_count("text", F.lit(r"[\p{Zs}\t]")).alias("n_spaces"),
        F.aggregate("_s", F.lit(0), lambda a, x: a + x).alias("n_syllables"), F.aggregate("_l", F.lit(0), lambda a, x: a + x).alias("n_word_letters"),
        F.filter("_l", lambda x: x > 0).alias("_long"),
    )
    size = F.size("_long")
    mean = F.aggregate("_long", F.lit(0).cast("double"), lambda a, x: a + x) / F.nullif(size, F.lit(0))
    df = df.withColumn("_mean", mean)
    variance = F.try_divide(F.aggregate("_long", F.lit(0).cast("double"), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))), (size - 1).cast("double"))
    df = df.withColumn("mu_index", F.when((size >= 2) & (variance > 0), 100 * F.col("_mean") / variance).otherwise(float("nan")))
    df = df.withColumn("n_punctuations", F.aggregate(F.map_values("c_punctuations"), F.lit(0), lambda a, x: a + x))
    df = df.withColumn("letters_entropy", entropy_of(F.map_values("c_letters"))).withColumn("syllables_entropy", entropy_of(F.map_values("c_syllables"))).drop("_long", "_mean")
    if normalize:
        for share, base in SHARES.items():
            df = df.withColumn(share, ratio(F.col("n" + share[1:]), F.col(base)))
    return df


def _d(a, b) -> Column:
    return ratio(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b, None)


GRADE_BANDS = [(90, 5), (80, 6), (70, 7), (60, 8.5), (50, 11), (30, 14)]
EASE_SCALE = [(90.0, "very easy"), (80.0, "easy"), (70.0, "fairly easy"), (60.0, "standard"), (50.0, "fairly difficult"), (30.0, "difficult"), (0.0, "very difficult")]


def flesch_reading_easy(a: float = 1.015, b: float = 84.6, c: float = 206.835) -> Column:
    return c - a * _d("n_words", "n_sents") - b * _d("n_syllables", "n_words")


def ease_to_grade(ease: Column, bands: list[tuple[float, float]] = GRADE_BANDS, below: float = 13) -> Column:
    out = F.when(F.isnan(ease), float("nan"))
    for bound, grade in bands:
        out = out.when(ease >= bound, float(grade))
    return out.otherwise(float(below))


def median_of(values: list[Column]) -> Column:
    ordered, n = F.array_sort(F.array(*values)), len(values)
    return F.get(ordered, F.lit(n // 2)) if n % 2 else (F.get(ordered, F.lit(n // 2 - 1)) + F.get(ordered, F.lit(n // 2))) / 2


#: Coefficients of the formulas that adaptations to a language change, in the order they stand in.
COEFFICIENTS = {"flesch_reading_easy": (1.015, 84.6, 206.835), "flesch_kincaid_grade": (0.39, 11.8, 15.59), "coleman_liau_index": (5.88, 29.6, 15.8), "automated_readability_index": (4.71, 0.5, 21.43), "smog_index": (1.043, 30.0, 3.1291), "gunning_fog_index": (0.4,)}


def readability(stats: DataFrame, wpm: float = 238.0, preset: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """Adds the readability formulas to basic statistics. Zero denominators give nan.

    preset: other COEFFICIENTS of some formulas, as an adaptation to a language has them.
    """
    unknown = set(preset or {}) - set(COEFFICIENTS)
    if unknown or any(len(v) != len(COEFFICIENTS[k]) for k, v in (preset or {}).items()):
        raise ValueError(f"a preset has coefficients of {', '.join(COEFFICIENTS)}, as many as the formula has")
    c = COEFFICIENTS | (preset or {})
    kincaid, coleman, automated, smog, fog = (c[k] for k in ("flesch_kincaid_grade", "coleman_liau_index", "automated_readability_index", "smog_index", "gunning_fog_index"))
    per_word = lambda c: 100 * _d(c, "n_words")
    w_s, types = _d("n_words", "n_sents"), F.col("n_unique_words")
    df = stats.withColumns({
        "flesch_reading_easy": flesch_reading_easy(*c["flesch_reading_easy"]), "flesch_kincaid_grade": kincaid[0] * w_s + kincaid[1] * _d("n_syllables", "n_words") - kincaid[2],
        "coleman_liau_index": coleman[0] * _d("n_word_letters", "n_words") - coleman[1] * _d("n_sents", "n_words") - coleman[2], "automated_readability_index": automated[0] * _d("n_word_letters", "n_words") + automated[1] * w_s - automated[2],
        "smog_index": smog[0] * F.sqrt(smog[1] * _d("n_complex_words", "n_sents")) + smog[2], "gunning_fog_index": fog[0] * (w_s + per_word("n_complex_words")),
        "lix": w_s + per_word("n_long_words"), "rix": _d("n_long_words", "n_sents"), "reading_time": (F.col("n_words") + F.col("n_numbers")) / wpm,
        "forcast": _d(20 * F.col("n_words") - 15 * F.col("n_short_words"), "n_words"),
        "powers_sumner_kearl": 0.0778 * w_s + 4.55 * _d("n_syllables", "n_words") - 2.2029, "eflaw": _d(F.col("n_words") + F.col("n_mini_words"), "n_sents"),
        "dickes_steiwer": 235.95993 - 73.021 * F.log(_d("n_word_letters", "n_words") + 1) - 12.56438 * F.log(w_s + 1) - 50.03293 * _d(types, "n_words"),
        "gulpease": _d(89 * F.col("n_words") + 300 * F.col("n_sents") - 10 * F.col("n_word_letters"), "n_words"), "fucks": _d("n_syllables", "n_sents"), "strain_index": 0.3 * _d("n_syllables", "n_sents"),
        "elf": _d(F.col("n_syllables") - F.col("n_syllabic_words"), "n_sents"), "wheeler_smith": 10 * _d("n_polysyllable_words", "n_sents"),
    })
    r = _d(F.col("n_words") - F.col("n_complex_words") + 3 * F.col("n_complex_words"), "n_sents")
    ms, sl, iw, es = per_word("n_complex_words"), w_s, per_word("n_long_words"), per_word("n_monosyllable_words")
    df = df.withColumns({
        "linsear_write": F.when(r > 20, r / 2).otherwise((r - 2) / 2),
        "wiener_1": 0.1935 * ms + 0.1672 * sl + 0.1297 * iw - 0.0327 * es - 0.875, "wiener_2": 0.2007 * ms + 0.1682 * sl + 0.1373 * iw - 2.779,
        "wiener_3": 0.2963 * ms + 0.1905 * sl - 1.1144, "wiener_4": 0.2744 * ms + 0.2656 * sl - 1.693,
    })
    grades = [half_up(F.col(c)).cast("double") for c in ("flesch_kincaid_grade", "coleman_liau_index", "automated_readability_index", "smog_index", "gunning_fog_index")]
    return df.withColumn("consensus_grade", F.when(F.col("n_words") > 0, median_of([*grades, ease_to_grade(F.col("flesch_reading_easy"))])).otherwise(float("nan")))


def reading_time_by_norm(stats: DataFrame, speeds: tuple[float, ...] = (183.0, 238.0)) -> DataFrame:
    return stats.withColumn("reading_times", F.array(*((F.col("n_words") + F.col("n_numbers")) / s for s in speeds)))


def describe(stats: DataFrame, stat: str = "flesch_reading_easy", scale: list[tuple[float, str]] = EASE_SCALE) -> DataFrame:
    """Adds the band of a statistic."""
    return stats.withColumn(f"{stat}_level", by_scale(F.col(stat), scale))


def grade_to_age(grade: Column, above: str = "postgraduate") -> Column:
    """School stage and age of a grade, half up."""
    g = half_up(grade).cast("int")
    stage = F.when(g <= 0, "preschool").when(g <= 5, "elementary school").when(g <= 8, "middle school").when(g <= 12, "high school").when(g <= 16, "college").otherwise(above)
    return F.struct(stage.alias("stage"), (g + 5).alias("age_from"), (g + 6).alias("age_to"))
