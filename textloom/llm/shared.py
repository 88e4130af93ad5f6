"""What the training-data operators share: the cluster's shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: a space and \x09-\x0D. bytes.split() takes the same.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (URI) below spark.checkpoint.dir, which all executors share.

    Only where the session has no such setting and runs on one machine (tests) a temporary folder is made and set; on a
    cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Removes an execution's shuffle files when it ends, not when the driver happens to collect its plan as garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, forget: bool = False) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage and survives lost executors.

    forget: what was shuffled for it is removed from disk.
    """
    path = shared_folder(df.sparkSession, name)
    before = df.sparkSession.conf.get(CLEANUP)
    try:
        df.sparkSession.conf.set(CLEANUP, str(forget or before == "true").lower())
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(uri: str):
    """pyarrow's file system and path of a URI, made if it isn't there yet."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))
    system.create_dir(path, recursive=True)
    return system, path


def commit_file(uri: str, name: str, data: list) -> str:
    """Write a file whole or not at all: tasks that run twice (retries, speculation) leave one good copy."""
    system, path = opened(uri)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        for x in data:
            f.write(x)
    system.move(part, f"{path}/{name}")
    return f"{path}/{name}"


def texts(column: pa.Array) -> pa.Array:
    """Strings with null as the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def lowered(column: pa.Array) -> pa.Array:
    """A-Z alone in lower case; every other character stays."""
    return pc.ascii_lower(texts(column))


def raw(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and the bytes of a large_string array without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return offsets, memoryview(data if data is not None else b"")


def words_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Document index of each word, and the words, of a large_string array without nulls."""
    parts = pc.ascii_split_whitespace(column)
    flat, of = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    there = pc.not_equal(pc.binary_length(flat), 0)
    return of[there.to_numpy(zero_copy_only=False)], flat.filter(there)


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = 6 << 20):
    """The batch in slices of at most `limit` bytes of text (a longer text is a slice of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(batch):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Gives memory that this worker has freed back to the system, where the C library can: workers of earlier stages
    stay, and an executor's memory counts them all."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by index, as doubles."""
    return np.bincount(of, values, n)


#: A class of more than this share of all rows is hot; there can't be more hot classes than 1 / HOT_SHARE.
HOT_SHARE = 1 / 1000


def with_classes(rows: DataFrame, classes: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of classes (one row a key, `size` of its rows); every key of rows has a class.

    The hot classes, a thousand at most, are broadcast; their rows keep no key, so that the shuffled join spreads them.
    """
    total = classes.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n
    columns = [c for c in classes.columns if c != key]
    renamed = lambda df, mark: df.select(F.col(key).alias(f"{mark}{key}"), *(F.col(c).alias(f"{mark}{c}") for c in columns))
    hot = renamed(classes.where(F.col(size) > HOT_SHARE * total), "_hot_")
    cold = renamed(classes.where(F.col(size) <= HOT_SHARE * total), "_cold_")
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col(f"_hot_{key}"), "left")
    marked = marked.withColumn("_of", F.when(F.col(f"_hot_{key}").isNull(), F.col(key))).withColumn("_salt", F.when(F.col("_of").isNull(), F.pmod(F.xxhash64("doc_id"), F.lit(4096)).cast("int")).otherwise(-1))
    both = marked.join(cold.withColumn("_none", F.lit(-1)), (F.col("_of") == F.col(f"_cold_{key}")) & (F.col("_salt") == F.col("_none")), "left")
    return both.select(*rows.columns, *(F.when(F.col("_of").isNull(), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in columns))


def kept_rows(docs: DataFrame, decide, above: bool = False) -> DataFrame:
    """Rows of docs whose doc_id is in decide(docs) (doc_id). Rows of one doc_id are one document.

    A row without doc_id is decided by its text: decide() sees a number made of the text's hash, below all doc_ids
    (above: above them), which isn't in what is returned.
    """
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + mark if above else F.lit(-(1 << 62)) - mark)
    rows = docs.withColumn("_own_id", own)
    keys = decide(docs.withColumn("doc_id", own)).select(F.col("doc_id").alias("_kept_id"))
    return rows.join(keys, F.col("_own_id") == F.col("_kept_id"), "left_semi").drop("_own_id")
