"""Places in texts: character spans of words, marks and line breaks between words, parts of documents, highlights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import BLANK_LINE, LINE_BREAK, WORD, has_word
from .words import phrase_spans

#: Quotes and apostrophes, which are no marks between words; nor are invisible characters, or a single joining hyphen.
QUOTES = r"[\p{Pi}\p{Pf}\"'„‚]"


#: Words that a task places at once (a longer text alone).
AT_ONCE = 200_000


def _places(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, pos, start, end, word, gap of every word, text by text: no shuffle, no sort."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as matches, what stands before each, and which are words -> words with their spans and the text since the
        word before (null for the first)."""
        for whole in batches:
            sizes = pc.list_value_length(whole.column(1)).to_numpy(zero_copy_only=False).cumsum()
            first = 0
            while first < len(whole):
                last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + AT_ONCE, "right")))
                batch = whole.slice(first, last - first)
                first = last
                words, gaps = (pc.list_flatten(batch.column(i)) for i in (1, 2))
                kept = pc.list_flatten(batch.column(3)).to_numpy(zero_copy_only=False).astype(bool)
                of = pc.list_parent_indices(batch.column(1)).to_numpy(zero_copy_only=False)
                length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(length + pc.utf8_length(gaps).to_numpy(zero_copy_only=False))
                begins = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
                per = np.diff(np.append(begins, len(of)))
                ends = ends - np.repeat(np.append(0, ends)[begins], per)
                rank = np.cumsum(kept)
                pos = rank - 1 - np.repeat(np.append(0, rank)[begins], per)
                at = np.flatnonzero(kept)
                before = np.append(-1, at[:-1]) if len(at) else at
                gap = gaps.take(pa.array(at))
                far = np.flatnonzero((before < at - 1) & (pos[at] > 0))
                if len(far):  # matches that are no words stand between
                    texts = gap.to_pylist()
                    for k in far.tolist():
                        texts[k] = "".join(x.as_py() for i in range(before[k] + 1, at[k]) for x in (gaps[i], words[i])) + texts[k]
                    gap = pa.array(texts, pa.string())
                gap = pc.if_else(pa.array(pos[at] > 0), gap, pa.scalar(None, gap.type))
                yield pa.record_batch([batch.column(0).take(pa.array(of[at])), pa.array(pos[at], pa.int32()), pa.array(ends[at] - length[at]), pa.array(ends[at]), words.take(pa.array(at)), gap], names=["doc_id", "pos", "start", "end", "word", "gap"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    rows = rows.select("doc_id", "m", F.slice("g", F.lit(1), F.size("m")).alias("g"), F.transform("m", has_word).alias("kept"))
    return rows.mapInArrow(placed, f"doc_id {dict(docs.dtypes)['doc_id']}, pos int, start long, end long, word string, gap string")


def token_spans(docs: DataFrame, pattern: str = WORD) -> DataFrame:
    """doc_id, pos, start, end, word: character spans (end exclusive) of the words of each document."""
    return _places(docs, pattern).drop("gap")


def gaps(docs: DataFrame, pattern: str = WORD) -> DataFrame:
    """doc_id, pos, gap: the text between each word and the one before it; the first word of a text has none."""
    return _places(docs, pattern).where("gap IS NOT NULL").select("doc_id", "pos", "gap")


def is_mark_gap(gap: Column) -> Column:
    return (gap != "-") & F.regexp_replace(gap, QUOTES, "").rlike(r"[\p{P}\p{S}\p{M}]")


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, pos of the words that a punctuation mark stands before."""
    return gaps(docs).where(is_mark_gap(F.col("gap"))).select("doc_id", "pos")


def paragraph_words(docs: DataFrame, blank_lines: bool = False) -> DataFrame:
    """doc_id, pos of the words that a line break (blank_lines: a blank line) separates from the word before."""
    return gaps(docs).where(F.col("gap").rlike(BLANK_LINE if blank_lines else LINE_BREAK)).select("doc_id", "pos")


def words_by_spans(words: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, start, end, n_words of every span (doc_id, start, end; not overlapping) that has a word (doc_id, start).

    A word belongs to the span of its first character: the last one that begins at it or before, found by one sort.
    """
    rows = spans.select("doc_id", F.col("start").cast("long").alias("at"), F.lit(0).alias("is_word"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias("s"))
    rows = rows.unionByName(words.select("doc_id", F.col("start").cast("long").alias("at"), F.lit(1).alias("is_word"), F.lit(None).cast("struct<start:long,end:long>").alias("s")))
    last = F.last("s", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("at", "is_word").rowsBetween(W.unboundedPreceding, 0))
    own = rows.withColumn("s", last).where((F.col("is_word") == 1) & (F.col("at") < F.col("s.end")))
    return own.groupBy("doc_id", "s.start", "s.end").agg(F.count(F.lit(1)).alias("n_words"))


def document_part(words: DataFrame, first: int, last: int) -> DataFrame:
    """The words from first to before last of each document, counted from 0 again."""
    return words.where((F.col("pos") >= first) & (F.col("pos") < last)).withColumn("pos", F.col("pos") - first)


def word_at(words: DataFrame, offset: int) -> DataFrame:
    """The word of each document (token_spans) that holds a character."""
    return words.where((F.col("start") <= offset) & (F.col("end") > offset))


def sentence_starts(words: DataFrame) -> DataFrame:
    """doc_id, sent_id, pos of the first word of each sentence, from words(doc_id, sent_id, pos)."""
    return words.groupBy("doc_id", "sent_id").agg(F.min("pos").alias("pos"))


def phrase_highlights(docs: DataFrame, phrases: DataFrame, layer: str = "phrase") -> DataFrame:
    """doc_id, start, end, layer, note: longest phrases (phrase: words with spaces) as character spans."""
    words = token_spans(docs)
    found = phrase_spans(words.select("doc_id", "pos", F.lower("word").alias("word")), phrases)
    first = words.select("doc_id", F.col("pos").alias("_first"), F.col("start").alias("_start"))
    last = words.select("doc_id", (F.col("pos") + 1).alias("_last"), F.col("end").alias("_end"))
    hits = found.select("doc_id", F.col("start").alias("_first"), F.col("end").alias("_last"), F.col("phrase").alias("note"))
    return hits.join(first, ["doc_id", "_first"]).join(last, ["doc_id", "_last"]).select("doc_id", F.col("_start").alias("start"), F.col("_end").alias("end"), F.lit(layer).alias("layer"), "note")


def connector_highlights(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Connectors (phrase, cls, kind) as character spans, with their class as layer."""
    hits = phrase_highlights(docs, dictionary.select("phrase"))
    classes = dictionary.select(F.lower("phrase").alias("note"), F.col("cls").alias("_cls")).distinct()
    return hits.join(classes, "note").select("doc_id", "start", "end", F.col("_cls").alias("layer"), "note")


def zipf_theory(size: float, num_ranks: int, alpha: float = 1.0) -> list[tuple[int, float]]:
    """Rank and frequency of the theoretical law size / rank ** alpha."""
    if isinstance(num_ranks, bool) or not isinstance(num_ranks, int) or num_ranks < 1 or size <= 0 or alpha <= 0:
        raise ValueError("size and alpha must be above zero, num_ranks an integer of 1 or more")
    return [(r, size * r**-alpha) for r in range(1, num_ranks + 1)]
