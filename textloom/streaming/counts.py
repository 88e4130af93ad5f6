"""Texts as a stream: row-wise statistics, and word counts by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_words
from ..operators import basic


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_statistics(docs: DataFrame) -> DataFrame:
    """Basic statistics and readability have no state: each document that arrives gives its row."""
    return basic.readability(basic.basic_stats(docs))


def word_counts(docs: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, word, f: state is kept until the watermark passes a window."""
    rows = docs.withWatermark(time, late).select(time, F.explode(F.transform(as_words(F.col("text")), lambda w: F.lower(w))).alias("word"))
    return rows.groupBy(F.window(time, window).alias("window"), "word").agg(F.count(F.lit(1)).alias("f"))


def running_vocabulary(docs: DataFrame, key: str = "source") -> DataFrame:
    """source, n_words, n_types (HyperLogLog, an approximation): state is one sketch a key, however long the stream."""
    rows = docs.select(key, F.explode(F.transform(as_words(F.col("text")), lambda w: F.lower(w))).alias("word"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_words"), F.approx_count_distinct("word", 0.02).alias("n_types"))
