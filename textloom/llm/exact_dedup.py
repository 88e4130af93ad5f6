"""Exact deduplication by a cuckoo-filter index over text digests.

A digest that the filter doesn't know is new, and no content is looked at. A hit is verified against the content kept in
the digest's bucket, so a false positive of the filter never drops a text. Overflow doubles the filter and its buckets,
refilled from the stored keys. Live digests are deleted again, which a Bloom filter can't do: texts go through by
ranges of digests, and what a range leaves in the index is given out and deleted before the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, lowered, raw, with_classes, written

SLOTS, KICKS = 4, 200


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; partial-key cuckoo hashing over SHA-256 digests."""

    def __init__(self, buckets: int = 1024):
        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.mask, self.rows = buckets - 1, [[] for _ in range(buckets)]

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, first ^ (mark * 0x5BD1E995 & self.mask)

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return mark in self.rows[a] or mark in self.rows[b]

    def add(self, digest: bytes) -> bool:
        """False: no place was found, and one fingerprint is homeless; the filter must be rebuilt larger."""
        mark, a, b = self.places(digest)
        for at in (a, b):
            if len(self.rows[at]) < SLOTS:
                self.rows[at].append(mark)
                return True
        at = b
        for kick in range(KICKS):
            row = self.rows[at]
            row[kick % SLOTS], mark = mark, row[kick % SLOTS]
            at ^= mark * 0x5BD1E995 & self.mask
            if len(self.rows[at]) < SLOTS:
                self.rows[at].append(mark)
                return True
        return False

    def remove(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        for at in (a, b):
            if mark in self.rows[at]:
                self.rows[at].remove(mark)
                return True
        return False


class CuckooIndex:
    """A filter, and stored entries [digest, content, ...] in buckets by a digest's first place."""

    def __init__(self, buckets: int = 1024):
        self.filter, self.store = CuckooFilter(buckets), [[] for _ in range(buckets)]

    def _bucket(self, digest: bytes) -> list[list]:
        return self.store[int.from_bytes(digest[2:10], "little") & self.filter.mask]

    def find(self, digest: bytes, content: bytes | None = None) -> list | None:
        """The entry of a digest, or None. Its content must be the given one."""
        if digest not in self.filter:
            return None
        for entry in self._bucket(digest):
            if entry[0] == digest:
                if content is not None and entry[1] != content:
                    raise ValueError("two different texts have one SHA-256 digest")
                return entry
        return None

    def insert(self, entry: list) -> None:
        """A new entry; its digest must not be live."""
        self._bucket(entry[0]).append(entry)
        if not self.filter.add(entry[0]):
            self.resize()

    def delete(self, digest: bytes) -> bool:
        """Only live digests are deleted: removing an absent one could take another's fingerprint."""
        bucket = self._bucket(digest)
        for i, entry in enumerate(bucket):
            if entry[0] == digest:
                del bucket[i]
                return self.filter.remove(digest)
        return False

    def entries(self) -> Iterator[list]:
        for bucket in self.store:
            yield from bucket

    def resize(self) -> None:
        live, buckets = list(self.entries()), 2 * len(self.store)
        while True:
            self.filter, self.store = CuckooFilter(buckets), [[] for _ in range(buckets)]
            for entry in live:
                self._bucket(entry[0]).append(entry)
            if all(self.filter.add(entry[0]) for entry in live):
                return
            buckets *= 2


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None or (b is not None and b > a) else a


def _combiner(content_mb: int):
    """Texts of one input split -> one row per different text: digest, content, largest doc_id, number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = CuckooIndex(), 0

        def flush() -> pa.RecordBatch:
            rows = list(index.entries())
            return pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["digest", "content", "keep_id", "n"])

        for batch in batches:
            ends, data = raw(lowered(batch.column(1)))
            for k, doc in enumerate(batch.column(0).to_pylist()):
                text = bytes(data[ends[k] : ends[k + 1]])
                digest = hashlib.sha256(text).digest()
                entry = index.find(digest, text)
                if entry is None:
                    index.insert([digest, text, doc, 1])
                    held += len(text)
                else:
                    entry[2], entry[3] = _larger(entry[2], doc), entry[3] + 1
            if held > content_mb << 20:
                yield flush()
                index, held = CuckooIndex(), 0
        yield flush()

    return run


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range of digests -> one row per different text; a range at a time is live in the index."""
    index, live, now, out = CuckooIndex(), [], None, []

    def ended() -> None:
        for entry in live:
            out.append([entry[0], entry[2], entry[3]])
            index.delete(entry[0])
        live.clear()

    for batch in batches:
        for bucket, digest, content, doc, n in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                ended()
                now = bucket
            entry = index.find(digest, content)
            if entry is None:
                entry = [digest, content, doc, n]
                index.insert(entry)
                live.append(entry)
            else:
                entry[2], entry[3] = _larger(entry[2], doc), entry[3] + n
        yield _rows(out)
        out.clear()
    ended()
    yield _rows(out)


def _rows(rows: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["digest", "keep_id", "group_size"])


#: Digests are cut into 2 ** RANGE_BITS ranges; a range's different contents are held by one task at a time.
RANGE_BITS = 20


def _range(bits: int):
    return F.shiftright(F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int"), 24 - bits)


def text_classes(docs: DataFrame, content_mb: int = 48, bits: int = RANGE_BITS) -> DataFrame:
    """One row per different text: digest, keep_id, group_size.

    Each input split is combined first (a text held by a third of all rows leaves a split once), so what is
    shuffled is at most one content per split and text. bits: 20 (of 24 at most) hold a range at some 100 MB of content
    for 100 TB of different texts.
    """
    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(_combiner(content_mb), "digest binary, content binary, keep_id long, n long")
        .select(_range(bits).alias("range"), "digest", "content", "keep_id", "n")
        .repartition("range")
        .sortWithinPartitions("range")
        .mapInArrow(_merger, "digest binary, keep_id long, group_size long")
    )


def _digest():
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), 256))


def exact_dedup(docs: DataFrame, content_mb: int = 48) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text; other columns are ignored).

    Texts are equal when identical after lower-casing A-Z; a null text is the empty text. The row with the largest
    doc_id stays; a null doc_id is below all others (keep_id is null where a group has no other). Repeated rows of
    one doc_id count each in group_size and share their flags. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"))
    classes = written(text_classes(docs, content_mb), "texts")
    return with_classes(rows, classes, "digest", "group_size").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def update_index(keys: DataFrame, members: DataFrame, inserts: DataFrame, deletes: DataFrame, bits: int = 6) -> tuple[DataFrame, DataFrame]:
    """The index after deleting the documents of `deletes` (doc_id) and then adding `inserts` (doc_id, text).

    keys: digest, content, n (live documents of the text); members: doc_id, digest. A text stays live until its last
    document is deleted. A deleted doc_id takes all its rows; a null doc_id is never deleted, and unknown ones change
    nothing. bits: 2 ** bits ranges of digests, each a group of one task; scale them with the keys (some 100 MB a group).
    Changes are summed by digest before they are grouped, so a hot text is one row.
    """
    new = inserts.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_combiner(48), "digest binary, content binary, keep_id long, n long")
    gone = deletes.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    dead = members.join(gone, "doc_id", "left_semi").select("digest", F.lit(None).cast("binary").alias("content"), F.lit(0).cast("long").alias("more"), F.lit(1).cast("long").alias("less"))
    both = dead.unionByName(new.select("digest", "content", F.col("n").alias("more"), F.lit(0).cast("long").alias("less")))
    changes = both.groupBy("digest").agg(F.max("content").alias("content"), F.sum("more").alias("more"), F.sum("less").alias("less"))

    def apply(live: pd.DataFrame, changed: pd.DataFrame) -> pd.DataFrame:
        index = CuckooIndex()
        for digest, content, n in zip(live.digest, live.content, live.n):
            index.insert([bytes(digest), bytes(content), n])
        for digest, content, more, less in zip(map(bytes, changed.digest), changed.content, changed.more, changed.less):
            entry = index.find(digest, None if content is None else bytes(content))
            if entry is None:
                index.insert([digest, bytes(content), more])
                continue
            entry[2] += more - less
            if entry[2] <= 0:
                index.delete(digest)
        rows = list(index.entries())
        return pd.DataFrame({"digest": [r[0] for r in rows], "content": [r[1] for r in rows], "n": pd.Series([r[2] for r in rows], dtype="int64")})

    own = [F.col(c).alias(c) for c in ("digest", "content", "n")]  # new names, as both sides may come from keys
    live, changed = keys.select(_range(bits).alias("range"), *own), changes.select(_range(bits).alias("range"), "*")
    kept = live.groupBy("range").cogroup(changed.groupBy("range")).applyInPandas(apply, "digest binary, content binary, n long")
    added = inserts.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"))
    return kept, members.join(gone, "doc_id", "left_anti").select("doc_id", "digest").unionByName(added)


def empty_index(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], "digest binary, content binary, n long"), spark.createDataFrame([], "doc_id long, digest binary")
