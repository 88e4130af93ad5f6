"""The words table, which nearly every operator starts from."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import WORD, as_sentences, as_words, is_number


#: Bytes of input (as stored) that one partition of documents takes: its words are some sixty times as large in memory.
PART_BYTES = 4 << 20


def partitions(docs: DataFrame) -> int | None:
    """Into how many partitions texts go, so that a task's memory doesn't grow with the table; None where the size isn't known."""
    if docs.isStreaming:
        return None
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(-(-size // PART_BYTES), docs.sparkSession.sparkContext.defaultParallelism) if size < 1 << 60 else None


def by_document(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts partitioned by document: the one shuffle, of raw texts; groups and windows by document need no other."""
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    n = partitions(docs)
    return rows.repartition(n, key) if n else rows.repartition(key)


def words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", pattern: str = WORD, lower: bool = True, filter_numbers: bool = False, stop_words: list[str] | None = None, lemmas: DataFrame | None = None, min_len: int = 0, max_len: int = 0, shuffle: bool = True) -> DataFrame:
    """key, pos, word: numbers out, lemma (dictionary lemmas: word, lemma), lower case, stop words out, lengths, and pos
    counts what is left. shuffle=False leaves texts where they lie, for corpus-wide counts."""
    rows = by_document(docs, key, text) if shuffle else docs.select(key, F.col(text).cast("string").alias("text"))
    ws = as_words(F.col("text"), pattern)
    if filter_numbers:
        ws = F.filter(ws, lambda w: ~is_number(w))
    if lemmas is None:
        if lower:
            ws = F.transform(ws, F.lower)
        if stop_words:
            ws = F.filter(ws, lambda w: ~F.lower(w).isin(*stop_words))
        if min_len:
            ws = F.filter(ws, lambda w: F.length(w) >= min_len)
        if max_len:
            ws = F.filter(ws, lambda w: F.length(w) <= max_len)
        return rows.select(key, F.posexplode(ws).alias("pos", "word"))
    found = rows.select(key, F.posexplode(ws).alias("pos", "word")).join(lemmas.select("word", "lemma"), "word", "left").withColumn("word", F.coalesce("lemma", "word")).drop("lemma")
    if lower:
        found = found.withColumn("word", F.lower("word"))
    if stop_words:
        found = found.where(~F.lower("word").isin(*stop_words))
    if min_len:
        found = found.where(F.length("word") >= min_len)
    if max_len:
        found = found.where(F.length("word") <= max_len)
    return found.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy("pos")) - 1).select(key, "pos", "word")


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", min_len: int = 0, max_len: int = 0) -> DataFrame:
    """key, sent_id, sentence; paragraphs without a word are sentences."""
    ss = as_sentences(F.col(text), wordless=True)
    if min_len or max_len:
        ss = F.filter(ss, lambda s: (F.length(s) >= min_len) & (F.length(s) <= (max_len or 2**31 - 1)))
    return docs.select(key, F.posexplode(ss).alias("sent_id", "sentence"))


def ngram_range(ws: DataFrame, least: int, most: int, key: str = "doc_id", unit: str = "word") -> DataFrame:
    """key, pos, n, word: n-grams of all lengths from least to most."""
    out = None
    for n in range(least, most + 1):
        part = ngrams(ws, n, key, unit).withColumn("n", F.lit(n))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("most must not be below least")
    return out


def ngrams(ws: DataFrame, n: int, key: str = "doc_id", unit: str = "word") -> DataFrame:
    """key, pos, word: runs of n words of one document, joined by _."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    if n == 1:
        return ws.select(key, "pos", F.col(unit).alias("word"))
    w = W.partitionBy(key).orderBy("pos")
    parts = [F.col(unit), *(F.lead(unit, i).over(w) for i in range(1, n))]
    return ws.select(key, "pos", F.when(parts[-1].isNotNull(), F.concat_ws("_", *parts)).alias("word")).where("word IS NOT NULL")


def _plain_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "), r"\p{Cf}", "")


def char_ngrams(docs: DataFrame, n: int, within_words: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ngram: character n-grams over the text (runs of white space as one space, format characters out) or its words."""
    source = _plain_text(F.col(text))
    rows = docs.select(key, F.explode(as_words(F.col(text))).alias("s")) if within_words else docs.select(key, source.alias("s"))
    grams = F.when(F.length("s") >= n, F.transform(F.sequence(F.lit(1), F.length("s") - n + 1), lambda i: F.substring(F.col("s"), i, F.lit(n))))
    return rows.select(key, F.explode(grams).alias("ngram"))


def char_ngram_counts(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text", most: int = 1_000_000) -> DataFrame:
    """ngram, f over all texts: what counting char_ngrams gives, without a row a character. A task holds `most` different
    n-grams and 4 million characters at most at once (a longer text alone)."""
    rows = docs.select(_plain_text(F.col(text)).alias("s"))

    def counted(values: pa.Array) -> dict[str, int]:
        codes = np.frombuffer("".join(values.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(values)), pc.utf8_length(values).to_numpy(zero_copy_only=False))
        if len(codes) < n:
            return {}
        letters, at = np.flatnonzero(np.bincount(codes, minlength=1)), None
        place = np.zeros(int(codes.max()) + 1, np.int64)
        place[letters] = np.arange(len(letters))
        if len(letters) ** n >= 1 << 62:  # too many letters for one number
            return Counter("".join(map(chr, codes[i : i + n])) for i in np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :]))
        codes, base = place[codes], len(letters)
        at = sum(codes[i : len(codes) - n + 1 + i] * base ** (n - 1 - i) for i in range(n))[of[: len(of) - n + 1] == of[n - 1 :]]
        if base**n <= 1 << 24:
            f = np.bincount(at)
            found = np.flatnonzero(f)
            f = f[found]
        else:
            found, f = np.unique(at, return_counts=True)
        grams = zip(*(map(chr, letters[found // base ** (n - 1 - i) % base]) for i in range(n)))
        return dict(zip(map("".join, grams), f.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        given = lambda: pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["ngram", "f"])
        for batch in batches:
            values = batch.column(0)
            sizes = pc.binary_length(values).to_numpy(zero_copy_only=False).cumsum()
            at = 0
            while at < len(values):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (4 << 20), "right")))
                held.update(counted(values.slice(at, end - at)))
                at = end
                if len(held) > most:
                    yield given()
                    held.clear()
        if held:
            yield given()

    return rows.mapInArrow(run, "ngram string, f long").groupBy("ngram").agg(F.sum("f").alias("f"))


def most_common(ws: DataFrame, n: int = 10, by: list[str] | None = None, unit: str = "word", place: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """The n most frequent units (of each group), ties by first occurrence: the least `place`."""
    by = by or []
    counts = ws.groupBy(*by, unit).agg(F.count(F.lit(1)).alias("freq"), F.min(F.struct(*place)).alias("_first"))
    if not by:
        return counts.orderBy(F.desc("freq"), "_first").limit(n).drop("_first")
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("freq"), "_first"))).where(F.col("rank") <= n).drop("_first")


def frequencies(ws: DataFrame, by: list[str] | str = "doc_id", unit: str = "word") -> DataFrame:
    by = [by] if isinstance(by, str) else by
    return ws.groupBy(*by, unit).agg(F.count(F.lit(1)).alias("f"))


def phrase_spans(ws: DataFrame, phrases: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end, phrase: leftmost-longest, non-overlapping occurrences of phrases (phrase: words with spaces).

    Candidates by joins on runs of words of each length that occurs; the greedy choice then walks a document's few
    candidates in order.
    """
    lengths = [r.n for r in phrases.select(F.size(F.split("phrase", " ")).alias("n")).distinct().orderBy("n").collect()]
    wanted = phrases.select(F.lower("phrase").alias("phrase")).distinct().withColumn("_key", F.regexp_replace("phrase", " ", "_"))
    found = ws.where("false").select(key, F.col("pos").alias("start"), F.col("pos").alias("end"), F.lit("").alias("phrase"))
    for n in lengths:
        part = ngrams(ws, n, key).join(wanted, F.col("word") == F.col("_key")).select(key, F.col("pos").alias("start"), (F.col("pos") + n).alias("end"), "phrase")
        found = found.unionByName(part)
    spans = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("minus_end"), "phrase")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,phrase:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        took = F.struct((-x["minus_end"]).alias("at"), F.array_append(acc["out"], F.struct(x["start"].alias("start"), (-x["minus_end"]).alias("end"), x["phrase"].alias("phrase"))).alias("out"))
        return F.when(x["start"] >= acc["at"], took).otherwise(acc)

    return found.groupBy(key).agg(spans.alias("c")).select(key, F.inline(F.aggregate("c", start, step, lambda acc: acc["out"])))
