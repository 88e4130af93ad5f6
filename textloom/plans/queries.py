"""The engine's queries over the driver's tables, and their SQL in DuckDB.

Doubles are rounded to six places on both sides, so that the order of a sum doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basic, corpus, diversity, stylometry
from ..operators.words import char_ngram_counts, frequencies, most_common, ngrams, sentences, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORDS = r"""w AS (
    SELECT doc_id, source, lang, pos, lower(form) AS word, form FROM (
        SELECT doc_id, source, lang, unnest(ws) AS form, generate_subscripts(ws, 1) - 1 AS pos FROM (
            SELECT doc_id, source, lang, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_\p{M}\x{AD}\x{200C}\x{200D}]*'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS ws FROM documents)))"""
FREQ = WORDS + ", q AS (SELECT doc_id, word, count(*) AS f FROM w GROUP BY ALL)"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded as the SQL's round does: the scaled double half away from zero (Spark's own round takes the decimal digits)."""
    return df.select(*((F.round(F.col(c) * 10.0**places, 0) / 10.0**places).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """documents; a table of fewer splits than cores (one small file) is spread, so that row-wise work isn't one task.
    At scale the scan has more splits than cores, and nothing is shuffled."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = sum(_sizes(spark, f"{sf}/documents.parquet"))
    return df.repartition(cores) if size < cores << 22 else df


def _sizes(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    while found.hasNext():
        yield found.next().getLen()


def tagged(spark: SparkSession, sf: str, column: str) -> DataFrame:
    """Words with a column of their document, without a shuffle."""
    from ..functions.text import as_words

    return docs(spark, sf).select("doc_id", column, F.posexplode(F.transform(as_words(F.col("text")), F.lower)).alias("pos", "word"))


COUNTS = r"""c AS (
    SELECT doc_id, text, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_\p{M}\x{AD}\x{200C}\x{200D}]*'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS ws FROM documents),
d AS (SELECT *, list_transform(ws, lambda x: length(regexp_replace(x, '[^\p{L}]', '', 'g'))) AS ls, list_transform(ws, lambda x: len(regexp_extract_all(lower(x), '[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüœ]+'))) AS ss FROM c),
s AS (SELECT doc_id,
    len(list_filter(string_split(regexp_replace(text, '([.!?…]["''»”’)\]]*)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) AS n_sents,
    len(ws) AS n_words, 0::BIGINT AS n_numbers, len(list_distinct(list_transform(ws, lambda x: lower(x)))) AS n_unique_words,
    len(list_filter(ls, lambda x: x >= 7)) AS n_long_words, len(list_filter(ss, lambda x: x >= 3)) AS n_complex_words, len(list_filter(ss, lambda x: x > 0 AND x < 3)) AS n_simple_words,
    len(list_filter(ss, lambda x: x = 1)) AS n_monosyllable_words, len(list_filter(ss, lambda x: x > 1)) AS n_polysyllable_words, len(list_filter(ss, lambda x: x <= 1)) AS n_short_words,
    len(list_filter(ss, lambda x: x >= 1)) AS n_syllabic_words, len(list_filter(ls, lambda x: x >= 1 AND x <= 3)) AS n_mini_words,
    length(regexp_replace(text, '\r\n|\r|\n', '', 'g')) AS n_chars, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters, len(regexp_extract_all(text, '[\p{Zs}\t]')) AS n_spaces,
    coalesce(list_sum(ss), 0)::BIGINT AS n_syllables, coalesce(list_sum(ls), 0)::BIGINT AS n_word_letters, list_filter(ls, lambda x: x > 0) AS lw,
    list_entropy(ls) AS letters_entropy, list_entropy(ss) AS syllables_entropy FROM d)"""
COUNT_COLUMNS = "n_sents, n_words, n_numbers, n_unique_words, n_long_words, n_complex_words, n_simple_words, n_monosyllable_words, n_polysyllable_words, n_chars, n_letters, n_spaces, n_syllables, n_word_letters"


@query(f"WITH {COUNTS} SELECT doc_id, {COUNT_COLUMNS}, round(letters_entropy, 6) AS letters_entropy, round(syllables_entropy, 6) AS syllables_entropy FROM s")
def basic_stats(spark, sf):
    return rounded(basic.basic_stats(docs(spark, sf)).select("doc_id", *COUNT_COLUMNS.split(", "), "letters_entropy", "syllables_entropy"))


@query(f"""WITH {COUNTS} SELECT doc_id, round(n_unique_words / n_words, 6) AS p_unique_words, round(n_long_words / n_words, 6) AS p_long_words, round(n_complex_words / n_words, 6) AS p_complex_words,
    round(n_monosyllable_words / n_words, 6) AS p_monosyllable_words, round(n_letters / n_chars, 6) AS p_letters, round(n_spaces / n_chars, 6) AS p_spaces FROM s""")
def basic_shares(spark, sf):
    return rounded(basic.basic_stats(docs(spark, sf), normalize=True).select("doc_id", "p_unique_words", "p_long_words", "p_complex_words", "p_monosyllable_words", "p_letters", "p_spaces"))


READ = {
    "flesch_reading_easy": "206.835 - 1.015 * (W / S) - 84.6 * (Y / W)", "flesch_kincaid_grade": "0.39 * (W / S) + 11.8 * (Y / W) - 15.59", "coleman_liau_index": "5.88 * (L / W) - 29.6 * (S / W) - 15.8",
    "automated_readability_index": "4.71 * (L / W) + 0.5 * (W / S) - 21.43", "smog_index": "1.043 * sqrt(30 * (C / S)) + 3.1291", "gunning_fog_index": "0.4 * ((W / S) + 100 * (C / W))", "lix": "(W / S) + 100 * (G / W)", "rix": "(G / S)",
    "reading_time": "W / 238", "forcast": "(20 * W - 15 * n_short_words) / W", "powers_sumner_kearl": "0.0778 * (W / S) + 4.55 * (Y / W) - 2.2029", "eflaw": "(W + n_mini_words) / S",
    "dickes_steiwer": "235.95993 - 73.021 * ln((L / W) + 1) - 12.56438 * ln((W / S) + 1) - 50.03293 * (n_unique_words / W)", "gulpease": "(89 * W + 300 * S - 10 * L) / W", "fucks": "(Y / S)", "strain_index": "0.3 * (Y / S)",
    "elf": "(Y - n_syllabic_words) / S", "wheeler_smith": "10 * (n_polysyllable_words / S)", "linsear_write": "CASE WHEN (W + 2 * C) / S > 20 THEN (W + 2 * C) / S / 2 ELSE ((W + 2 * C) / S - 2) / 2 END",
    "wiener_1": "0.1935 * (100 * (C / W)) + 0.1672 * (W / S) + 0.1297 * (100 * (G / W)) - 0.0327 * (100 * (n_monosyllable_words / W)) - 0.875", "wiener_2": "0.2007 * (100 * (C / W)) + 0.1682 * (W / S) + 0.1373 * (100 * (G / W)) - 2.779",
    "wiener_3": "0.2963 * (100 * (C / W)) + 0.1905 * (W / S) - 1.1144", "wiener_4": "0.2744 * (100 * (C / W)) + 0.2656 * (W / S) - 1.693",
    "mu_index": "CASE WHEN len(lw) >= 2 AND list_var_samp(lw) > 0 THEN 100 * list_avg(lw) / list_var_samp(lw) ELSE 'nan'::DOUBLE END",
}


@query(f"""WITH {COUNTS}, r AS (SELECT doc_id, {", ".join(f"{v} AS {k}" for k, v in READ.items())} FROM (SELECT *, n_words::DOUBLE AS W, n_sents::DOUBLE AS S, n_syllables::DOUBLE AS Y, n_word_letters::DOUBLE AS L, n_complex_words::DOUBLE AS C, n_long_words::DOUBLE AS G FROM s))
    SELECT doc_id, {", ".join(f"round({k}, 9) AS {k}" for k in READ)} FROM r""")
def readability(spark, sf):
    return rounded(basic.readability(basic.basic_stats(docs(spark, sf))).select("doc_id", *READ), 9)


@query(f"""WITH {COUNTS}, r AS (SELECT doc_id, {", ".join(f"{READ[k]} AS {k}" for k in list(READ)[:6])} FROM (SELECT *, n_words::DOUBLE AS W, n_sents::DOUBLE AS S, n_syllables::DOUBLE AS Y, n_word_letters::DOUBLE AS L, n_complex_words::DOUBLE AS C FROM s)),
    g AS (SELECT *, list_sort([floor(flesch_kincaid_grade + 0.5), floor(coleman_liau_index + 0.5), floor(automated_readability_index + 0.5), floor(smog_index + 0.5), floor(gunning_fog_index + 0.5),
        CASE WHEN flesch_reading_easy >= 90 THEN 5 WHEN flesch_reading_easy >= 80 THEN 6 WHEN flesch_reading_easy >= 70 THEN 7 WHEN flesch_reading_easy >= 60 THEN 8.5 WHEN flesch_reading_easy >= 50 THEN 11 WHEN flesch_reading_easy >= 30 THEN 14 ELSE 13 END::DOUBLE]) AS gs FROM r)
    SELECT doc_id, (gs[3] + gs[4]) / 2 AS consensus_grade, CASE WHEN flesch_reading_easy >= 90 THEN 'very easy' WHEN flesch_reading_easy >= 80 THEN 'easy' WHEN flesch_reading_easy >= 70 THEN 'fairly easy' WHEN flesch_reading_easy >= 60 THEN 'standard'
        WHEN flesch_reading_easy >= 50 THEN 'fairly difficult' WHEN flesch_reading_easy >= 30 THEN 'difficult' ELSE 'very difficult' END AS flesch_reading_easy_level FROM g""")
def readability_levels(spark, sf):
    r = basic.describe(basic.readability(basic.basic_stats(docs(spark, sf))))
    return r.select("doc_id", "consensus_grade", "flesch_reading_easy_level")


@query(f"WITH {WORDS} SELECT word, count(*) AS freq FROM w GROUP BY word ORDER BY freq DESC, min((doc_id, pos)) LIMIT 50")
def most_common_words(spark, sf):
    return most_common(words(docs(spark, sf), shuffle=False), 50)


@query(f"WITH {WORDS} SELECT word, count(*) AS f FROM (SELECT concat_ws('_', word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos)) AS word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM w) WHERE n IS NOT NULL GROUP BY word")
def word_bigrams(spark, sf):
    return frequencies(ngrams(words(docs(spark, sf)), 2), [])


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(trim(text), '\s+', ' ', 'g'), '\p{Cf}', '', 'g') AS s FROM documents)
    SELECT ngram, count(*) AS f FROM (SELECT substr(s, i, 3) AS ngram FROM (SELECT s, unnest(range(1, length(s) - 1)) AS i FROM t WHERE length(s) >= 3)) GROUP BY ngram""")
def char_trigrams(spark, sf):
    return char_ngram_counts(docs(spark, sf), 3)


@query(r"""WITH t AS (SELECT doc_id, generate_subscripts(ps, 1) AS para, unnest(ps) AS p FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)'), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM documents)),
    x AS (SELECT doc_id, para, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM (SELECT doc_id, para, string_split(regexp_replace(p, '([.!?…]["''»”’)\]]*)(\s+)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM t)),
    g AS (SELECT doc_id, para, i, s, greatest(sum(regexp_matches(s, '[\p{L}\p{N}]')::INT) OVER (PARTITION BY doc_id, para ORDER BY i), 1) AS k FROM x),
    j AS (SELECT doc_id, para, k, string_agg(s, '' ORDER BY i) AS sentence FROM g GROUP BY ALL)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para, k) - 1 AS sent_id, length(regexp_replace(sentence, '^\s+|\s+$', '', 'g')) AS n_chars FROM j""")
def sentence_table(spark, sf):
    s = sentences(docs(spark, sf))
    return s.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.length(F.regexp_replace("sentence", r"^\s+|\s+$", "")).cast("long").alias("n_chars"))


@query(f"WITH {FREQ} SELECT doc_id, f, count(*) AS n FROM q GROUP BY ALL")
def frequency_spectrum(spark, sf):
    return diversity.spectrum(words(docs(spark, sf)))


DIVERSITY = {
    "ttr": "V / N", "rttr": "V / sqrt(N)", "cttr": "V / sqrt(2 * N)", "httr": "CASE WHEN N > 1 THEN ln(V) / ln(N) ELSE 0 END", "mttr": "CASE WHEN N > 1 THEN (log10(N) - log10(V)) / (log10(N) * log10(N)) ELSE 0 END",
    "simpson_index": "CASE WHEN N > 1 THEN (S2 - N) / (N * (N - 1)) ELSE 'nan'::DOUBLE END", "gini_simpson_index": "CASE WHEN N > 1 THEN 1 - (S2 - N) / (N * (N - 1)) ELSE 'nan'::DOUBLE END",
    "yule_k": "CASE WHEN N > 1 THEN 1e4 * (S2 - N) / (N * N) ELSE 'nan'::DOUBLE END", "herdan_vm": "CASE WHEN N > 1 THEN sqrt(greatest(S2 / (N * N) - 1 / V, 0)) ELSE 'nan'::DOUBLE END", "sichel_s": "V2 / V", "brunet_w": "N ** (V ** -0.172)",
    "baayen_p": "V1 / N", "hapax_ratio": "V1 / V", "alpha2": "CASE WHEN V1 > 0 THEN 1 - 2 * V2 / V1 ELSE 'nan'::DOUBLE END", "entropy": "log2(N) - IL / N", "evenness": "CASE WHEN V > 1 THEN (log2(N) - IL / N) / log2(V) ELSE 'nan'::DOUBLE END", "perplexity": "2 ** (log2(N) - IL / N)",
    "inverse_simpson_index": "CASE WHEN N <= 1 THEN 'nan'::DOUBLE WHEN S2 = N THEN 'inf'::DOUBLE ELSE N * (N - 1) / (S2 - N) END", "dttr": "CASE WHEN V = N THEN 'inf'::DOUBLE ELSE log10(N) * log10(N) / (log10(N) - log10(V)) END",
    "honore_r": "CASE WHEN N < 2 THEN 'nan'::DOUBLE WHEN V1 = V THEN 'inf'::DOUBLE ELSE 100 * ln(N) / (1 - V1 / V) END", "yule_i": "CASE WHEN N < 2 THEN 'nan'::DOUBLE WHEN S2 = V THEN 'inf'::DOUBLE ELSE V * V / (S2 - V) END",
    "michea_m": "CASE WHEN V2 = 0 THEN 'inf'::DOUBLE ELSE V / V2 END", "dugast_k": "CASE WHEN log10(N) > 1 THEN log10(V) / log10(log10(N)) ELSE 'nan'::DOUBLE END",
}


@query(f"""WITH {FREQ}, d AS (SELECT doc_id, sum(f)::DOUBLE AS N, count(*)::DOUBLE AS V, sum(f * f)::DOUBLE AS S2, count(*) FILTER (f = 1)::DOUBLE AS V1, count(*) FILTER (f = 2)::DOUBLE AS V2, sum(f * log2(f)) AS IL FROM q GROUP BY doc_id)
    SELECT doc_id, N::BIGINT AS n_words, V::BIGINT AS n_types, {", ".join(f"round({v}, 6) AS {k}" for k, v in DIVERSITY.items())} FROM d""")
def lexical_diversity(spark, sf):
    return rounded(diversity.order_free(words(docs(spark, sf))).select("doc_id", "n_words", "n_types", *DIVERSITY))


@query(f"""WITH {FREQ}, n AS (SELECT doc_id, f, sum(f) OVER (PARTITION BY doc_id)::DOUBLE AS N FROM q),
    g AS (SELECT doc_id, any_value(N) AS N, sum((1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(42), lambda k: greatest(N - f - k, 0) / greatest(N - k, 1))), lambda a, b: a * b)) / 42) AS h FROM n GROUP BY doc_id)
    SELECT doc_id, CASE WHEN N >= 50 THEN round(h, 6) ELSE 'nan'::DOUBLE END AS hdd FROM g""")
def hdd(spark, sf):
    return rounded(diversity.order_free(words(docs(spark, sf))).select("doc_id", "hdd"))


PREVIOUS = "p AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY doc_id, word ORDER BY pos), -1) AS prev, count(*) OVER (PARTITION BY doc_id) AS n FROM w)"


@query(f"""WITH {WORDS}, {PREVIOUS} SELECT doc_id, round(CASE WHEN max(n) <= 50 THEN count(*) FILTER (prev < 0) / max(n)
    ELSE sum(greatest(0, least(pos, n - 50) - greatest(prev + 1, pos - 49, 0) + 1)) / (50 * (max(n) - 49)) END, 6) AS mattr FROM p GROUP BY doc_id""")
def mattr(spark, sf):
    return rounded(diversity.mattr(words(docs(spark, sf))))


@query(f"""WITH {WORDS}, s AS (SELECT doc_id, pos // 50 AS seg, count(*) AS n, count(DISTINCT word) AS t FROM w GROUP BY ALL), d AS (SELECT doc_id, count(*) AS n, count(DISTINCT word) AS v FROM w GROUP BY ALL)
    SELECT doc_id, round(CASE WHEN d.n <= 50 THEN v / d.n ELSE m END, 6) AS msttr FROM d LEFT JOIN (SELECT doc_id, avg(t / n) AS m FROM s WHERE n = 50 GROUP BY doc_id) USING (doc_id)""")
def msttr(spark, sf):
    return rounded(diversity.msttr(words(docs(spark, sf))))


def _fold(order: str) -> str:
    n = "len(ps)"
    return f"""list_reduce(list_prepend({{'p': -1, 'f': 0.0::DOUBLE, 'b': 0, 't': 0}}, list_transform({order}, lambda x: {{'p': x.pos, 'f': 0.0::DOUBLE, 'b': x.a, 't': 0}})),
        lambda s, x: CASE WHEN x.p - s.b + 1 >= 10 AND (s.t + (x.b < s.b)::INT) / (x.p - s.b + 1) <= 0.72 THEN {{'p': x.p, 'f': s.f + 1, 'b': x.p + 1, 't': 0}} ELSE {{'p': x.p, 'f': s.f, 'b': s.b, 't': s.t + (x.b < s.b)::INT}} END)""".replace("{n}", n)


@query(f"""WITH {WORDS}, p AS (SELECT doc_id, pos::INT AS pos, coalesce(lag(pos) OVER x, -1)::INT AS prev, (count(*) OVER (PARTITION BY doc_id) - 1 - pos)::INT AS back, (count(*) OVER (PARTITION BY doc_id) - 1 - coalesce(lead(pos) OVER x, count(*) OVER (PARTITION BY doc_id)))::INT AS bprev FROM w WINDOW x AS (PARTITION BY doc_id, word ORDER BY pos)),
    g AS (SELECT doc_id, count(*) AS n, list({{'pos': pos, 'a': prev}} ORDER BY pos) AS ps, list({{'pos': back, 'a': bprev}} ORDER BY back) AS bs FROM p GROUP BY doc_id),
    r AS (SELECT doc_id, n, {_fold('ps')} AS x, {_fold('bs')} AS y FROM g),
    z AS (SELECT doc_id, n, x.f + CASE WHEN n > x.b THEN least(1.0, (1 - x.t / (n - x.b)) / (1 - 0.72)) ELSE 0 END AS a, y.f + CASE WHEN n > y.b THEN least(1.0, (1 - y.t / (n - y.b)) / (1 - 0.72)) ELSE 0 END AS b FROM r)
    SELECT doc_id, round(((CASE WHEN a > 0 THEN n / a ELSE 'inf'::DOUBLE END) + (CASE WHEN b > 0 THEN n / b ELSE 'inf'::DOUBLE END)) / 2, 5) AS mtld FROM z""")
def mtld(spark, sf):
    return rounded(diversity.mtld(words(docs(spark, sf))), 5)


@query(f"""WITH {WORDS}, g AS (SELECT doc_id, pos + 1 AS n, sum((rn = 1)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) AS rn FROM w))
    SELECT doc_id, round(coalesce(regr_slope(ln(v), ln(n)), 'nan'), 5) AS heaps_beta FROM g GROUP BY doc_id""")
def heaps_beta(spark, sf):
    return rounded(diversity.heaps(words(docs(spark, sf))).select("doc_id", "heaps_beta"), 5)


@query(f"""WITH {FREQ}, r AS (SELECT doc_id, f, row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, word) AS k FROM q) SELECT doc_id, round(coalesce(-regr_slope(ln(f), ln(k)), 'nan'), 5) AS zipf_alpha FROM r GROUP BY doc_id""")
def zipf_alpha(spark, sf):
    return rounded(diversity.zipf_alpha(words(docs(spark, sf))), 5)


@query(f"""WITH {WORDS}, a AS (SELECT doc_id, word, coalesce(lead(pos) OVER x, first_value(pos) OVER x + count(*) OVER (PARTITION BY doc_id)) - pos AS gap FROM w WINDOW x AS (PARTITION BY doc_id, word ORDER BY pos)),
    b AS (SELECT doc_id, word, count(*) AS f, stddev_pop(gap) / avg(gap) AS r FROM a GROUP BY ALL HAVING count(*) >= 5),
    c AS (SELECT doc_id, avg((sqrt(f + 1) * r - sqrt(f - 1)) / ((sqrt(f + 1) - 2) * r + sqrt(f - 1))) AS x FROM b GROUP BY doc_id)
    SELECT doc_id, round(coalesce(x, 'nan'), 6) AS burstiness FROM (SELECT DISTINCT doc_id FROM w) LEFT JOIN c USING (doc_id)""")
def burstiness(spark, sf):
    return rounded(diversity.burstiness(words(docs(spark, sf))))


@query()
def sequential_diversity(spark, sf):
    return rounded(diversity.sequential(words(docs(spark, sf)), step=10))


@query(f"""WITH {WORDS}, r AS (SELECT doc_id, pos // 100 AS seg, count(*) AS n, count(DISTINCT word) AS t FROM w GROUP BY ALL), s AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS m FROM r)
    SELECT doc_id, count(*) AS n_windows, round(avg(t / n), 6) AS mean, round(coalesce(stddev_samp(t / n), 'nan'), 6) AS std FROM s WHERE n = 100 OR m < 100 GROUP BY doc_id""")
def windowed_ttr(spark, sf):
    return rounded(diversity.windowed(words(docs(spark, sf)), "ttr", 100).select("doc_id", "n_windows", "mean", "std"))


AB = f"""{WORDS}, a AS (SELECT word, count(*)::DOUBLE AS a FROM w WHERE lang = 'en' GROUP BY word), b AS (SELECT word, count(*)::DOUBLE AS b FROM w WHERE lang = 'fr' GROUP BY word),
    x AS (SELECT word, coalesce(a, 0) AS a, coalesce(b, 0) AS b, (SELECT sum(a) FROM a) AS c, (SELECT sum(b) FROM b) AS d FROM a FULL JOIN b USING (word)), y AS (SELECT *, c * (a + b) / (c + d) AS e, d * (a + b) / (c + d) AS g FROM x WHERE a / c > b / d)"""
KEY_SQL = {
    "log_likelihood": "2 * ((CASE WHEN a > 0 THEN a * ln(a / e) ELSE 0 END) + (CASE WHEN b > 0 THEN b * ln(b / g) ELSE 0 END))",
    "chi2": "coalesce((c + d) * greatest(abs(a * (d - b) - b * (c - a)) - (c + d) / 2, 0) ** 2 / (c * d * (a + b) * (c - a + d - b)), 0)",
    "diff": "100 * ((CASE a WHEN 0 THEN 0.5 ELSE a END) / c - (CASE b WHEN 0 THEN 0.5 ELSE b END) / d) / ((CASE b WHEN 0 THEN 0.5 ELSE b END) / d)",
    "log_ratio": "log2(((CASE a WHEN 0 THEN 0.5 ELSE a END) / c) / ((CASE b WHEN 0 THEN 0.5 ELSE b END) / d))",
    "odds_ratio": "CASE WHEN b * (c - a) > 0 THEN a * (d - b) / (b * (c - a)) WHEN a * (d - b) > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END",
}
KEY_SQL["bic"] = f"{KEY_SQL['log_likelihood']} - ln(c + d)"
KEY_SQL["ell"] = f"CASE WHEN least(c, d) * (a + b) / (c + d) > 1 THEN ({KEY_SQL['log_likelihood']}) / ((c + d) * ln(least(c, d) * (a + b) / (c + d))) ELSE 'nan'::DOUBLE END"


def _two(spark, sf):
    w = tagged(spark, sf, "lang")
    return w.where("lang = 'en'"), w.where("lang = 'fr'")


def _keyness(measure: str):
    def run(spark, sf):
        a, b = _two(spark, sf)
        return rounded(corpus.keyness(a, b, measure, min_freq=2).select("word", "freq_target", "freq_reference", "score"), 4)

    run.__name__ = f"keyness_{measure}"
    return query(f"WITH {AB} SELECT word, a::BIGINT AS freq_target, b::BIGINT AS freq_reference, round({KEY_SQL[measure]}, 4) AS score FROM y WHERE a >= 2")(run)


for _m in corpus.KEYNESS:
    _keyness(_m)

PAIRS = f"""{WORDS}, f AS (SELECT word, count(*) AS n FROM w GROUP BY word), t AS (SELECT count(*)::DOUBLE AS n FROM w),
    g AS (SELECT word, lead(word) OVER o AS r1, lead(word, 2) OVER o AS r2, lead(word, 3) OVER o AS r3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    c AS (SELECT "left", "right", count(*) AS freq FROM (SELECT word AS "left", r1 AS "right" FROM g UNION ALL SELECT word, r2 FROM g UNION ALL SELECT word, r3 FROM g) WHERE "right" IS NOT NULL GROUP BY ALL HAVING count(*) >= 8),
    x AS (SELECT "left", "right", freq, freq / 3 AS ab, l.n::DOUBLE AS a, r.n::DOUBLE AS b, t.n AS n FROM c JOIN f l ON l.word = "left" JOIN f r ON r.word = "right", t)"""
COLL_SQL = {"mi": "log2(ab * n / (a * b))", "mi3": "log2(ab * ab * ab * n / (a * b))", "t_score": "(ab - a * b / n) / sqrt(ab)", "dice": "2 * ab / (a + b)", "logdice": "14 + log2(2 * ab / (a + b))", "npmi": "log2(ab * n / (a * b)) / -log2(ab / n)",
    "log_likelihood": "CASE WHEN ab > least(a, b) OR n - a - b + ab < 0 THEN 'nan' ELSE 2 * (" + " + ".join(f"CASE WHEN {o} > 0 AND {e} > 0 THEN {o} * ln({o} / ({e})) ELSE 0 END" for o, e in (("ab", "a * b / n"), ("(a - ab)", "a * (n - b) / n"), ("(b - ab)", "(n - a) * b / n"), ("(n - a - b + ab)", "(n - a) * (n - b) / n"))) + ") END", "min_sensitivity": "least(ab / a, ab / b)"}


def _collocations(measure: str):
    def run(spark, sf):
        return rounded(corpus.collocations(words(docs(spark, sf)), 3, measure, 8).select("left", "right", "freq", "score"), 5)

    run.__name__ = f"collocations_{measure}"
    return query(f'WITH {PAIRS} SELECT "left", "right", freq, round({COLL_SQL[measure]}, 5) AS score FROM x' if measure in COLL_SQL else None)(run)


for _m in corpus.COLLOCATIONS:
    _collocations(_m)


@query(f"""WITH {WORDS}, z AS (SELECT source AS part, count(*)::DOUBLE AS size FROM w GROUP BY ALL), k AS (SELECT sum(size) AS n, count(*)::DOUBLE AS k, min(size) / sum(size) AS ms FROM z),
    c AS (SELECT word, source AS part, count(*)::DOUBLE AS f FROM w GROUP BY ALL), x AS (SELECT *, sum(f) OVER (PARTITION BY word) AS t, size / n AS s, f / size AS r FROM c JOIN z USING (part), k),
    g AS (SELECT word, max(t) AS t, count(*) AS range, 0.5 * (1 + sum(abs(f / t - s) - s)) AS dp, sum(r) AS r1, sum(r * r) AS r2, sum(r * log2(r)) AS rl, sum(sqrt(s * f)) AS q, sum(f / t * log2(f / t / s)) AS kl, max(k) AS k, max(ms) AS ms FROM x GROUP BY word HAVING max(t) >= 5)
    SELECT word, t::BIGINT AS freq, range, round(dp, 5) AS dp, round(dp / (1 - ms), 5) AS dp_norm, round(greatest(0, 1 - sqrt(greatest(r2 / k - (r1 / k) ** 2, 0)) / (r1 / k) / sqrt(k - 1)), 5) AS juilland_d,
        round((log2(r1) - rl / r1) / log2(k), 5) AS carroll_d2, round(q * q / t, 5) AS rosengren_s, round(kl, 5) AS kl_divergence FROM g""")
def dispersion(spark, sf):
    return rounded(corpus.dispersion_by(tagged(spark, sf, "source"), "source", 5), 5)


@query(f"""WITH {WORDS} SELECT doc_id, pos AS start, coalesce(l, '') AS "left", word AS match, coalesce(r, '') AS "right" FROM (SELECT doc_id, pos, word,
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS r FROM w) WHERE word = 'that'""")
def kwic(spark, sf):
    return rounded(corpus.kwic(words(docs(spark, sf)), "that", 3))


TABLE = f"""{WORDS}, c AS (SELECT source AS text, word, count(*)::DOUBLE AS f FROM w GROUP BY ALL), n AS (SELECT text, sum(f) AS n FROM c GROUP BY text), m AS (SELECT word, printf('%.11e', sum(f / n) / (SELECT count(*) FROM n))::DOUBLE AS m FROM c JOIN n USING (text) GROUP BY word),
    u AS (SELECT word, row_number() OVER (ORDER BY m DESC, word) AS rank FROM m QUALIFY rank <= 50), t AS (SELECT n.text, u.word, rank, coalesce(f / n, 0) AS rel FROM n CROSS JOIN u LEFT JOIN c ON c.text = n.text AND c.word = u.word),
    z AS (SELECT text, word, rank, CASE WHEN stddev_samp(rel) OVER x > 0 THEN (rel - avg(rel) OVER x) / stddev_samp(rel) OVER x ELSE 0 END AS z FROM t WINDOW x AS (PARTITION BY word))"""
DELTA_SQL = {"burrows": "sum(abs(a.z - b.z)) / 50", "quadratic": "sqrt(sum((a.z - b.z) ** 2)) / 50", "eder": "sum(abs(a.z - b.z) * (52 - a.rank)) / 50", "cosine": "1 - sum(a.z * b.z) / sqrt(sum(a.z * a.z) * sum(b.z * b.z))"}


def _by_source(spark, sf):
    return tagged(spark, sf, "source").withColumnRenamed("source", "text")


@query(f"WITH {TABLE} SELECT text, word, rank, round(rel, 8) AS rel FROM t")
def frequency_table(spark, sf):
    return rounded(stylometry.frequency_table(_by_source(spark, sf), 50), 8)


def _delta(variant: str):
    def run(spark, sf):
        return rounded(stylometry.delta(_by_source(spark, sf), 50, variant))

    run.__name__ = f"delta_{variant}"
    return query(f"WITH {TABLE} SELECT a.text AS text_a, b.text AS text_b, round({DELTA_SQL[variant]}, 6) AS distance FROM z a JOIN z b ON a.word = b.word AND a.text < b.text GROUP BY ALL")(run)


for _m in stylometry.VARIANTS:
    _delta(_m)


def _documents_as_texts(spark, sf, lang):
    return tagged(spark, sf, "lang").where(F.col("lang") == lang).withColumnRenamed("doc_id", "text")


@query(f"""WITH {WORDS}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, greatest(floor(count(*) OVER (PARTITION BY doc_id) / 200 + 0.5), 1)::BIGINT AS k FROM w WHERE lang IN ('en', 'fr')),
    s AS (SELECT DISTINCT doc_id, lang, word, CASE WHEN pos < (n % k) * (n // k + 1) THEN pos // (n // k + 1) ELSE n % k + (pos - (n % k) * (n // k + 1)) // (n // k) END AS seg FROM n), k AS (SELECT count(*) FILTER (lang = 'en') AS ka, count(*) FILTER (lang = 'fr') AS kb FROM (SELECT DISTINCT doc_id, lang, seg FROM s)),
    g AS (SELECT word, count(*) FILTER (lang = 'en') AS na, count(*) FILTER (lang = 'fr') AS nb FROM s GROUP BY word)
    SELECT word, round(na / ka, 6) AS share_target, round(nb / kb, 6) AS share_comparison, round(na / ka - nb / kb, 6) AS zeta, round(log2((CASE na WHEN 0 THEN 0.5 ELSE na END / ka) / (CASE nb WHEN 0 THEN 0.5 ELSE nb END / kb)), 6) AS log_zeta FROM g, k""")
def zeta(spark, sf):
    return rounded(stylometry.zeta(_documents_as_texts(spark, sf, "en"), _documents_as_texts(spark, sf, "fr"), 200))


@query(f"""WITH {WORDS}, x AS (SELECT word, count(*) FILTER (lang = 'en')::DOUBLE AS a, count(*) FILTER (lang = 'fr')::DOUBLE AS b FROM w GROUP BY word), n AS (SELECT sum(a) AS c, sum(b) AS d FROM x), t AS (SELECT * FROM x, n ORDER BY a + b DESC, word LIMIT 500)
    SELECT round(sum((a - (a + b) * c / (c + d)) ** 2 / ((a + b) * c / (c + d)) + (b - (a + b) * d / (c + d)) ** 2 / ((a + b) * d / (c + d))), 3) AS chi2 FROM t""")
def kilgarriff_chi2(spark, sf):
    return rounded(stylometry.kilgarriff_chi2(*_two(spark, sf)), 3)


@query(f"WITH {WORDS} SELECT source, length(word) AS length, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 8) AS share FROM w GROUP BY source, length(word)")
def mendenhall_curve(spark, sf):
    return rounded(stylometry.mendenhall_curve(tagged(spark, sf, "source"), "source"), 8)


@query(f"""WITH {WORDS}, c AS (SELECT length(word) AS l, count(*) FILTER (lang = 'en') / (SELECT count(*) FROM w WHERE lang = 'en') AS p, count(*) FILTER (lang = 'fr') / (SELECT count(*) FROM w WHERE lang = 'fr') AS q FROM w WHERE lang IN ('en', 'fr') GROUP BY l)
    SELECT round(sqrt(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2), 6) AS distance FROM c""")
def mendenhall_distance(spark, sf):
    return rounded(stylometry.mendenhall_distance(*_two(spark, sf)))


from ..operators import cohesion, lexical, phonetics, style  # noqa: E402

STOP = ["the", "of", "and", "to", "in", "is", "was", "for", "that", "by", "with", "on", "as", "at", "from", "this", "are", "he", "a", "be", "it", "de", "la", "le", "les", "et", "des", "en", "du", "un", "une", "der", "die", "das", "und", "el", "los", "que", "y", "er", "th", "st", "ou", "an", "re"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


@query(f"""WITH {WORDS}, q AS (SELECT doc_id, word, count(*) AS f, min(pos) AS first, word IN ({STOP_SQL}) AS stop FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, first) AS r, row_number() OVER (PARTITION BY doc_id ORDER BY stop, f DESC, first) AS own, count(*) OVER (PARTITION BY doc_id) AS v, max(f) OVER (PARTITION BY doc_id) AS f1 FROM q),
    g AS (SELECT doc_id, sum(f)::DOUBLE AS n, any_value(v) AS v, any_value(f1) AS f1, coalesce(sum(f) FILTER (NOT stop AND own <= 10), 0) AS top, coalesce(sum(f) FILTER (stop), 0) AS water, least(10, any_value(v), any_value(f1)) AS m, coalesce(sum(abs(f * r - f1)) FILTER (r >= 2 AND r <= least(10, v, f1)), 0) AS off FROM r GROUP BY doc_id)
    SELECT doc_id, round(sqrt(f1), 6) AS classic_nausea, round(100 * top / n, 6) AS academic_nausea, round(100 * water / n, 6) AS water, round(100 * (n - v) / n, 6) AS spam, CASE WHEN m < 2 THEN 'nan'::DOUBLE ELSE round(greatest(0, 100 * (f1 * (m - 1) - off) / (f1 * (m - 1))), 6) END AS zipf_naturalness FROM g""")
def style_stats(spark, sf):
    return rounded(style.style_stats(words(docs(spark, sf)), STOP))


@query(f"""WITH {WORDS}, n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), g AS (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM w)
    SELECT n.doc_id, k.keyword, round(100 * coalesce((SELECT count(*) FROM g WHERE g.doc_id = n.doc_id AND (k.keyword = g.word OR k.keyword = concat(g.word, ' ', g.nx))), 0) / n.n, 6) AS density FROM n CROSS JOIN (VALUES ('that'), ('of the')) k(keyword)""")
def keyword_density(spark, sf):
    return rounded(style.keyword_density(words(docs(spark, sf)), ["that", "of the"]))


@query(f"""WITH {WORDS}, g AS (SELECT doc_id, pos, CASE WHEN word = 'of' AND lead(word) OVER x = 'the' AND lead(word, 2) OVER x = 'and' THEN 3 WHEN word = 'of' AND lead(word) OVER x = 'the' THEN 2 WHEN word = 'and' AND lead(word) OVER x = 'the' THEN 2 END AS len FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY pos)),
    h AS (SELECT *, pos >= coalesce(lag(pos + len) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS ok FROM g WHERE len IS NOT NULL)
    SELECT doc_id, round(100 * coalesce(c, 0) / n, 6) AS phrases FROM (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) FILTER (ok) AS c FROM h GROUP BY doc_id) USING (doc_id)""")
def phrase_density(spark, sf):
    phrases = spark.createDataFrame([("of the",), ("of the and",), ("and the",)], "phrase string")
    return rounded(style.phrase_density(words(docs(spark, sf)), phrases))


_V, _S, _D, _T = phonetics.VOWELS, phonetics.SONORANTS, phonetics.VOICED, phonetics.VOICELESS


def _n(chars: str, at_least: int = 1) -> str:
    return f"len(regexp_extract_all(word, '[{chars}]{{{at_least},}}'))" if at_least > 1 else f"len(regexp_extract_all(word, '[{chars}]'))"


@query(f"""WITH {WORDS}, x AS (SELECT doc_id, {_n(_V)} AS v, {_n(_S)} AS s, {_n(_D)} AS d, {_n(_T)} AS t, len(regexp_extract_all(word, '[{_S}{_D}{_T}]+')) AS k, len(regexp_extract_all(word, '[{_S}{_D}{_T}]{{3,}}')) AS heavy, {_n(_V, 2)} AS h,
        regexp_replace(regexp_replace(regexp_replace(word, '[{_V}]', chr(1), 'g'), '[{_S}{_D}{_T}]', chr(2), 'g'), '[^\\x01\\x02]', '', 'g') AS cv FROM w),
    c AS (SELECT doc_id, cv, count(*)::DOUBLE AS f, sum(v) AS v, sum(s) AS s, sum(d) AS d, sum(t) AS t, sum(k) AS k, sum(heavy) AS heavy, sum(h) AS h FROM x GROUP BY ALL),
    g AS (SELECT doc_id, sum(f) AS f, sum(v) AS v, sum(s) AS s, sum(d) AS d, sum(t) AS t, sum(k) AS k, sum(heavy) AS heavy, sum(h) AS h, sum(f * log2(f)) AS fl, sum(v + s + d + t) AS a FROM c GROUP BY doc_id)
    SELECT doc_id, round(v / a, 6) AS p_vowels, round(s / a, 6) AS p_sonorants, round(d / a, 6) AS p_voiced, round(t / a, 6) AS p_voiceless, round(CASE WHEN v > 0 THEN (s + d + t) / v ELSE 'nan' END, 6) AS consonant_vowel_ratio, round(heavy / k, 6) AS p_heavy_clusters, round(h / f, 6) AS p_hiatus, round(log2(f) - fl / f, 6) AS cv_entropy, round(t / (v + s), 6) AS hardness FROM g""")
def phonetics_stats(spark, sf):
    return rounded(phonetics.phon_stats(words(docs(spark, sf))))


def _repetition_sql(sounds: str) -> str:
    return f"""WITH {WORDS}, n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), h AS (SELECT doc_id, pos, unnest(list_distinct(regexp_extract_all(word, '[{sounds}]'))) AS sound FROM w),
    s AS (SELECT doc_id, sound, unnest(range(greatest(pos - 2, 0), least(pos, n - 3) + 1)) AS st FROM h JOIN n USING (doc_id)), o AS (SELECT doc_id, sound, count(*) AS seen FROM (SELECT doc_id, sound, st FROM s GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
    c AS (SELECT doc_id, sound, count(*)::DOUBLE AS c, any_value(n)::DOUBLE AS n FROM h JOIN n USING (doc_id) GROUP BY ALL),
    e AS (SELECT doc_id, coalesce(seen, 0) AS seen, CASE WHEN n >= 3 THEN (n - 2) * (1 - (greatest(n - c, 0) * greatest(n - c - 1, 0) * greatest(n - c - 2, 0) / 6 + c * greatest(n - c, 0) * greatest(n - c - 1, 0) / 2) / (n * (n - 1) * (n - 2) / 6)) END AS expected FROM c LEFT JOIN o USING (doc_id, sound))
    SELECT doc_id, round(coalesce(CASE WHEN sum(expected) > 0 THEN sum(seen) / sum(expected) END, 'nan'), 5) AS repetition_index FROM e GROUP BY doc_id"""


@query(_repetition_sql(_S + _D + _T))
def alliteration(spark, sf):
    return rounded(phonetics.repetition_index(words(docs(spark, sf)), _S + _D + _T), 5)


@query(_repetition_sql(_V))
def assonance(spark, sf):
    return rounded(phonetics.repetition_index(words(docs(spark, sf)), _V), 5)


SETS = rf"""p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?…]["''»”’)\]]*)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) AS ss FROM documents),
    s AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS sent_id, unnest(ss) AS sentence FROM p),
    t AS (SELECT doc_id, sent_id, list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(sentence, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_\p{{M}}\x{{AD}}\x{{200C}}\x{{200D}}]*'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')), lambda x: lower(x)), lambda x: x NOT IN ({STOP_SQL}))) AS items FROM s)"""


@query(f"""WITH {SETS}, l AS (SELECT *, lag(items) OVER (PARTITION BY doc_id ORDER BY sent_id) AS b FROM t), a AS (SELECT doc_id, count(*) AS n, avg(list_has_any(items, b)::INT) FILTER (b IS NOT NULL) AS x, avg(CASE WHEN len(items) + len(b) > 0 THEN 2 * len(list_intersect(items, b)) / (len(items) + len(b)) ELSE 0 END) FILTER (b IS NOT NULL) AS y FROM l GROUP BY doc_id),
    f AS (SELECT doc_id, sent_id, len(items) AS k, unnest(items) AS item FROM t), j AS (SELECT a.doc_id, a.sent_id AS i, b.sent_id AS j, count(*) AS m, max(a.k + b.k) AS k FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.item = b.item AND a.sent_id < b.sent_id GROUP BY ALL), g AS (SELECT doc_id, count(*) AS c, sum(2 * m / k) AS d FROM j GROUP BY doc_id)
    SELECT doc_id, n AS n_sents, round(coalesce(x, 'nan'), 6) AS overlap_adjacent, round(CASE WHEN n >= 2 THEN coalesce(c, 0) / (n * (n - 1) / 2) ELSE 'nan' END, 6) AS overlap_all, round(coalesce(y, 'nan'), 6) AS overlap_prop_adjacent, round(CASE WHEN n >= 2 THEN coalesce(d, 0) / (n * (n - 1) / 2) ELSE 'nan' END, 6) AS overlap_prop_all FROM a LEFT JOIN g USING (doc_id)""")
def cohesion_overlaps(spark, sf):
    return rounded(cohesion.overlaps(cohesion.sentence_sets(docs(spark, sf), STOP)))


@query(f"""WITH {SETS}, l AS (SELECT doc_id, items, lead(items) OVER x AS a, lead(items, 2) OVER x AS b FROM t WINDOW x AS (PARTITION BY doc_id ORDER BY sent_id)), g AS (SELECT doc_id, sum(len(list_intersect(items, list_concat(a, b)))) AS x, sum(len(items)) AS y FROM l WHERE b IS NOT NULL GROUP BY doc_id)
    SELECT doc_id, round(CASE WHEN y > 0 THEN x / y ELSE 'nan' END, 6) AS overlap_2_sent FROM (SELECT DISTINCT doc_id FROM t) LEFT JOIN g USING (doc_id)""")
def cohesion_forward(spark, sf):
    return rounded(cohesion.forward_overlap(cohesion.sentence_sets(docs(spark, sf), STOP), 2, "overlap_2_sent"))


@query(f"WITH {WORDS} SELECT doc_id, round(avg((rn > 1)::INT), 6) AS p_given FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) AS rn FROM w) GROUP BY doc_id")
def cohesion_given(spark, sf):
    return rounded(cohesion.p_given(words(docs(spark, sf))))


@query(f"""WITH {WORDS}, t AS (SELECT count(*)::DOUBLE AS n FROM w), a AS (SELECT word, count(*) AS f, count(DISTINCT source) AS range FROM w GROUP BY word), b AS (SELECT word, f * 1e6 / n AS ipm, range, row_number() OVER (ORDER BY f DESC, word) AS rank FROM a, t QUALIFY f >= 5),
    q AS (SELECT doc_id, word, count(*) AS f FROM w GROUP BY ALL), x AS (SELECT * FROM (SELECT doc_id, word, f FROM q) LEFT JOIN b USING (word)), n AS (SELECT doc_id, sum(f)::DOUBLE AS n FROM q GROUP BY doc_id)
    SELECT doc_id, any_value(n)::BIGINT AS n_words, round(coalesce(sum(f) FILTER (ipm IS NOT NULL), 0) / any_value(n), 6) AS coverage, round(coalesce(sum(f * ipm) / sum(f) FILTER (ipm IS NOT NULL), 'nan'), 5) AS mean_ipm, round(coalesce(sum(f * log10(ipm)) / sum(f) FILTER (ipm IS NOT NULL), 'nan'), 6) AS mean_log_ipm,
        round(coalesce(sum(f * range) / sum(f) FILTER (ipm IS NOT NULL), 'nan'), 6) AS mean_range, round(sum(f * -log2(greatest(coalesce(ipm, 0), 0.5) / 1e6)) / any_value(n), 6) AS surprisal, round(coalesce(sum(f) FILTER (rank <= 1000), 0) / any_value(n), 6) AS p_top1000, round(coalesce(sum(f) FILTER (rank <= 5000), 0) / any_value(n), 6) AS p_top5000
    FROM x JOIN n USING (doc_id) GROUP BY doc_id""")
def lexical_stats(spark, sf):
    w = tagged(spark, sf, "source")
    d = lexical.dictionary_of(w).where(F.col("ipm") * w.count() / 1e6 >= 4.5)
    out = lexical.lexical_stats(words(docs(spark, sf)), d)
    out = out.select("doc_id", "n_words", "coverage", F.round("mean_ipm", 5).alias("mean_ipm"), "mean_log_ipm", "mean_range", "surprisal", "p_top1000", "p_top5000")
    return rounded(out)


from ..operators import assembly, compare  # noqa: E402


@query(rf"""WITH {SETS}, l AS (SELECT doc_id, sent_id, len(list_filter(regexp_extract_all(sentence, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_\p{{M}}]*'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]'))) AS n FROM s), x AS (SELECT doc_id, sent_id, n, n - avg(n) OVER (PARTITION BY doc_id) AS x FROM l), y AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY sent_id) AS y FROM x)
    SELECT doc_id, round(avg(n), 6) AS mean, round(coalesce(stddev_samp(n), 'nan'), 6) AS std, round(coalesce(stddev_samp(n) / avg(n), 'nan'), 6) AS cv, round(CASE WHEN sum(x * x) > 1e-12 THEN coalesce(sum(x * y) / sum(x * x), 'nan') ELSE 'nan' END, 6) AS autocorr FROM y GROUP BY doc_id""")
def sentence_rhythm(spark, sf):
    return rounded(compare.sentence_rhythm(compare.sentence_lengths(docs(spark, sf))))


def _features(spark, sf):
    w = tagged(spark, sf, "lang").where("lang IN ('en', 'fr')")
    lengths = w.groupBy("doc_id", "lang").agg(F.count(F.lit(1)).cast("double").alias("n_words"), F.avg(F.length("word")).alias("word_len"), F.countDistinct("word").cast("double").alias("n_types"))
    return compare.unpivot(lengths, "lang", ["n_words", "word_len", "n_types"])


@query(f"""WITH {WORDS}, d AS (SELECT doc_id, lang, count(*)::DOUBLE AS n_words, avg(length(word)) AS word_len, count(DISTINCT word)::DOUBLE AS n_types FROM w WHERE lang IN ('en', 'fr') GROUP BY ALL), v AS (UNPIVOT d ON n_words, word_len, n_types INTO NAME feature VALUE value),
    m AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS mid FROM v),
    g AS (SELECT feature, count(*) FILTER (lang = 'en')::DOUBLE AS n, count(*) FILTER (lang = 'fr')::DOUBLE AS m, avg(value) FILTER (lang = 'en') AS ma, avg(value) FILTER (lang = 'fr') AS mb, median(value) FILTER (lang = 'en') AS da, median(value) FILTER (lang = 'fr') AS db, var_samp(value) FILTER (lang = 'en') AS va, var_samp(value) FILTER (lang = 'fr') AS vb, sum(mid) FILTER (lang = 'en') AS ra FROM m GROUP BY feature)
    SELECT feature, n::BIGINT AS n_a, m::BIGINT AS n_b, round(ma, 5) AS mean_a, round(mb, 5) AS mean_b, round(da, 5) AS median_a, round(db, 5) AS median_b, round((ma - mb) / sqrt(((n - 1) * va + (m - 1) * vb) / (n + m - 2)), 5) AS cohen_d, round(2 * (ra - n * (n + 1) / 2) / (n * m) - 1, 5) AS cliff_delta FROM g""")
def corpus_comparison(spark, sf):
    e = compare.effect_sizes(_features(spark, sf), "en", "fr")
    return rounded(e.select("feature", "n_a", "n_b", "mean_a", "mean_b", "median_a", "median_b", "cohen_d", "cliff_delta"), 5)


@query()
def corpus_comparison_bootstrap(spark, sf):
    return rounded(compare.compare_features(_features(spark, sf), ("en", "fr"), 200))


@query(f"WITH {WORDS} SELECT doc_id, pos AS n, 0::BIGINT AS v FROM w WHERE false UNION ALL SELECT doc_id, pos + 1, (sum((rn = 1)::INT) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY pos) AS rn FROM w)")
def vocabulary_growth(spark, sf):
    return rounded(diversity.growth(words(docs(spark, sf))))


@query(r"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS part FROM documents)
    SELECT doc_id, part, CASE WHEN regexp_matches(line, '[\p{L}\p{N}]') THEN len(list_filter(regexp_extract_all(line, '[\p{L}\p{N}_][\p{L}\p{N}_\p{M}]*'), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) END AS n_words FROM x""")
def stats_by_lines(spark, sf):
    return rounded(assembly.by_parts(docs(spark, sf), basic.basic_stats, "lines").select("doc_id", "part", "n_words"))


@query(f"""WITH {WORDS}, b AS (SELECT 2 AS n, word || '_' || lead(word) OVER x AS ngram FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY pos)), c AS (SELECT n, ngram, count(*) AS f FROM b WHERE ngram LIKE 'that\\_%' ESCAPE '\\' GROUP BY ALL ORDER BY f DESC, ngram LIMIT 8),
    d AS (SELECT 3 AS n, word || '_' || lead(word) OVER x || '_' || lead(word, 2) OVER x AS ngram, word || '_' || lead(word) OVER x AS p FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY pos)), e AS (SELECT n, ngram, count(*) AS f FROM d WHERE p IN (SELECT ngram FROM c) AND ngram IS NOT NULL GROUP BY ALL ORDER BY f DESC, ngram LIMIT 8)
    SELECT n::BIGINT AS n, ngram, f FROM c UNION ALL SELECT n::BIGINT, ngram, f FROM e""")
def word_tree(spark, sf):
    return rounded(assembly.word_tree(words(docs(spark, sf)), "that", 3))


from ..operators import spans as places  # noqa: E402

SPANS = r"""x AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_\p{M}\x{AD}\x{200C}\x{200D}]*') AS m, string_split_regex(text, '[\p{L}\p{N}_][\p{L}\p{N}_\p{M}\x{AD}\x{200C}\x{200D}]*') AS g FROM documents),
    y AS (SELECT doc_id, text, generate_subscripts(m, 1) AS i, unnest(m) AS word, unnest(g[1:len(m)]) AS gap FROM x), z AS (SELECT doc_id, text, word, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS "end" FROM y),
    w AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY "end") - 1 AS pos, "end" - length(word) AS start, "end", word FROM z WHERE regexp_matches(word, '[\p{L}\p{N}]')),
    h AS (SELECT doc_id, pos, substr(text, b + 1, start - b) AS gap FROM (SELECT *, lag("end") OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM w) WHERE b IS NOT NULL)"""


@query(f'WITH {SPANS} SELECT doc_id, pos, start, "end", word FROM w')
def token_spans(spark, sf):
    return rounded(places.token_spans(docs(spark, sf)))


@query(f"WITH {SPANS}" + r" SELECT doc_id, pos FROM h WHERE gap <> '-' AND regexp_matches(regexp_replace(gap, '[\p{Pi}\p{Pf}\"''„‚]', '', 'g'), '[\p{P}\p{S}\p{M}]')")
def word_marks(spark, sf):
    return rounded(places.marks(docs(spark, sf)))


@query(f"WITH {SPANS}" + r" SELECT doc_id, pos FROM h WHERE regexp_matches(gap, '\r\n|\r|\n')")
def paragraph_words(spark, sf):
    return rounded(places.paragraph_words(docs(spark, sf)))


@query(f'WITH {SPANS} SELECT doc_id, start // 100 * 100 AS start, start // 100 * 100 + 100 AS "end", count(*) AS n_words FROM w GROUP BY ALL')
def words_by_spans(spark, sf):
    d = docs(spark, sf)
    cut = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 100).cast("int"))).alias("i")).select("doc_id", (F.col("i") * 100).alias("start"), (F.col("i") * 100 + 100).alias("end"))
    return rounded(places.words_by_spans(places.token_spans(d), cut))


@query(f"WITH {WORDS}, a AS (SELECT doc_id, word, n, CASE n WHEN 1 THEN word WHEN 2 THEN word || '_' || x ELSE word || '_' || x || '_' || y END AS g FROM (SELECT doc_id, word, lead(word) OVER o AS x, lead(word, 2) OVER o AS y FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), (VALUES (1), (2), (3)) t(n)) SELECT n::BIGINT AS n, g AS word, count(*) AS freq FROM a WHERE g IS NOT NULL GROUP BY ALL HAVING count(*) >= 5")
def ngram_range(spark, sf):
    from ..operators.words import ngram_range as grams

    return rounded(grams(words(docs(spark, sf)), 1, 3).groupBy("n", "word").agg(F.count(F.lit(1)).alias("freq")).where("freq >= 5"))


@query(f"WITH {COUNTS} SELECT doc_id, round(208.0 - 1.3 * (n_words / n_sents) - 60.1 * (n_syllables / n_words), 6) AS flesch_reading_easy, round(0.5 * (n_words / n_sents + 100 * (n_complex_words / n_words)), 6) AS gunning_fog_index FROM s")
def readability_preset(spark, sf):
    r = basic.readability(basic.basic_stats(docs(spark, sf)), preset={"flesch_reading_easy": (1.3, 60.1, 208.0), "gunning_fog_index": (0.5,)})
    return rounded(r.select("doc_id", "flesch_reading_easy", "gunning_fog_index"))


@query(f"""WITH {WORDS}, g AS (SELECT doc_id, pos, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM w), h AS (SELECT doc_id, pos, CASE WHEN word = 'of' AND nx = 'the' THEN 'of the' WHEN word = 'of' THEN 'of' END AS p FROM g)
    SELECT doc_id, 'prepositions' AS metric, string_agg(p, ' ' ORDER BY pos) AS found FROM h WHERE p IS NOT NULL GROUP BY doc_id""")
def style_markers(spark, sf):
    lists = {"prepositions": spark.createDataFrame([("of the",), ("of",)], "phrase string")}
    return style.markers(words(docs(spark, sf)), lists).select("doc_id", "metric", F.array_join("found", " ").alias("found"))
