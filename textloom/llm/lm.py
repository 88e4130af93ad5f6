"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped.

Tokens are words in lower case (A-Z), and one end after each text; a text begins in the context of an end. A word is
its 64-bit hash. The model is a folder of .npy files: for each bucket of pairs the sorted hashes of (previous, word)
and their counts; for each bucket of words the sorted hashes with count, number of different words before and after,
and how many followers came once, twice and more. Workers map the files (the page cache is shared, nothing is copied)
and search a batch's different pairs in order.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import commit_file, lowered, opened, shared_folder, slices, words_of, written

#: The hash of the end; no word has it, as words are hashed with another seed's bits set.
END = np.uint64(1)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD))
WORD_COLUMNS = ("hash", "count", "before", "once", "twice", "more")


def learned_from(doc_id: str = "doc_id"):
    return ~F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair of word hashes."""
    x = a * MIX[0] + (b ^ (b >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * MIX[1]
    return x ^ (x >> np.uint64(29))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens of each text (null: the end alone), and the hashes of all tokens in order."""
    text = lowered(column)
    of, words = words_of(text)
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) | 2 for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    hashes = known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    counts = np.bincount(of, minlength=len(text)).astype(np.int64)
    return counts + 1, np.insert(hashes, np.cumsum(counts), END)


def pairs_of(counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Previous token and token; before the first of a text is an end, as after the last of the text before it."""
    return (np.append(END, hashes[:-1]) if len(hashes) else hashes), hashes


def summed(before: np.ndarray, word: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs as one, with the sum of their times, in order."""
    order = np.lexsort((word, before))
    before, word, times = before[order], word[order], times[order]
    new = np.append(True, (before[1:] != before[:-1]) | (word[1:] != word[:-1])) if len(before) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return before[at], word[at], np.add.reduceat(times, at) if len(at) else times


def bucket_of(before: np.ndarray, word: np.ndarray, buckets: int, spread: int) -> np.ndarray:
    """A word's followers lie in `spread` buckets, so a word of a large share of all pairs doesn't fill one."""
    return ((before >> np.uint64(20)) + (word >> np.uint64(40)) % np.uint64(spread) * np.uint64(0x9E3779B1)) % np.uint64(buckets)


def _packed(before, word, times) -> bytes:
    """Sorted pairs, packed: runs of equal first words, differences of the second within a run."""
    new = np.append(True, before[1:] != before[:-1])
    at = np.flatnonzero(new)
    step = np.where(new, word, word - np.append(np.uint64(0), word[:-1]))
    parts = [before[at], np.diff(np.append(at, len(before))).astype(np.uint32), step, times.astype(np.uint32)]
    out = io.BytesIO()
    np.save(out, np.array([len(at), len(before)]))
    for p in parts:
        out.write(np.ascontiguousarray(p.view(np.uint8).reshape(-1, p.itemsize).T).tobytes())  # byte planes
    return zstandard.ZstdCompressor(1).compress(out.getvalue())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = io.BytesIO(zstandard.ZstdDecompressor().decompress(data))
    runs, n = np.load(f).tolist()
    first, lengths, step, times = (np.ascontiguousarray(np.frombuffer(f.read(k * size), np.uint8).reshape(size, k).T).view(kind).ravel() for k, size, kind in ((runs, 8, np.uint64), (runs, 4, np.uint32), (n, 8, np.uint64), (n, 4, np.uint32)))
    sums = np.cumsum(step, dtype=np.uint64)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    word = sums - np.repeat(sums[starts] - step[starts], lengths)
    return np.repeat(first, lengths), word, times.astype(np.int64)


def _counting(buckets: int, spread: int, most: int = 3_000_000):
    """Texts -> rows (bucket, packed pairs and counts), combined over `most` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            before, word, times = summed(*(np.concatenate(c) for c in zip(*held)))
            of = bucket_of(before, word, buckets, spread)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(buckets + 1))
            there = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            data = [_packed(before[order[cuts[b] : cuts[b + 1]]], word[order[cuts[b] : cuts[b + 1]]], times[order[cuts[b] : cuts[b + 1]]]) for b in there]
            return pa.record_batch([pa.array(there, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "pairs"])

        for whole in batches:
            for batch in slices(whole, 0):
                counts, hashes = tokens_of(batch.column(0))
                before, word = pairs_of(counts, hashes)
                held.append(summed(before, word, np.ones(len(word), np.int64)))
                n += len(word)
                if n > most:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


def _npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def _merging(folder: str):
    """Whole buckets -> a file of sorted pair hashes and counts each; rows of what the words' table needs.

    kind 0: a word with its followers (count, once, twice, more); kind 1: a word with its number of predecessors;
    kind 2: how many pairs came `hash` times (1 to 4); kind 3: bucket `hash` has files of so many pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple] = {}
        for batch in batches:
            parts: dict[int, list] = {}
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.setdefault(b, []).append(_unpacked(data))
            for b, rows in parts.items():
                if b in by:
                    rows.append(by[b])
                by[b] = summed(*(np.concatenate(c) for c in zip(*rows)))
        for b, (before, word, times) in by.items():
            at = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
            of = np.cumsum(np.append(True, before[1:] != before[:-1])) - 1
            pair = mixed(before, word)
            order = np.argsort(pair)
            commit_file(folder, f"pairs-{b:06d}.npy", [_npy(pair[order])])
            commit_file(folder, f"times-{b:06d}.npy", [_npy(times[order].astype(np.min_scalar_type(int(times.max()))))])
            n = len(at)
            follow = [np.add.reduceat(times, at), *(np.bincount(of[m], minlength=n) for m in (times == 1, times == 2, times > 2))]
            words, preceded = np.unique(word, return_counts=True)
            kinds = [np.bincount(np.minimum(times, 5).astype(np.int64), minlength=6)[k] for k in range(1, 5)]
            zero = np.zeros
            yield pa.record_batch([
                pa.array(np.concatenate([before[at].view(np.int64), words.view(np.int64), np.arange(1, 5), [b]])), pa.array(np.repeat([0, 1, 2, 3], [n, len(words), 4, 1])),
                pa.array(np.concatenate([follow[0], zero(len(words), np.int64), kinds, [len(pair)]]).astype(np.int64)), pa.array(np.concatenate([zero(n, np.int64), preceded, zero(5, np.int64)])),
                *(pa.array(np.concatenate([f, zero(len(words) + 5, np.int64)]).astype(np.int64)) for f in follow[1:]),
            ], names=["hash", "kind", "count", "before", "once", "twice", "more"])

    return run


def _storing(folder: str):
    """The words of a partition, sorted by hash as unsigned, as one file; a row of sums for the discounts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
        table = np.concatenate(tables) if tables else np.zeros((0, 6), np.int64)
        key = table[:, 0].view(np.uint64) if len(table) else np.zeros(0, np.uint64)
        key = np.ascontiguousarray(key)
        order = np.argsort(key)
        part = TaskContext.get().partitionId()
        commit_file(folder, f"words-{part:06d}.npy", [_npy(key[order])])
        commit_file(folder, f"stats-{part:06d}.npy", [_npy(np.ascontiguousarray(table[order, 1:]))])
        before = table[:, 2]
        sums = [len(table), table[:, 1].sum(), before.sum(), *(np.count_nonzero(before == k) for k in range(1, 5))]
        yield pa.record_batch([pa.array([int(s)]) for s in sums], names=[f"s{i}" for i in range(7)])

    return run


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from how many n-grams came 1 to 4 times; absolute discounts where a number is missing."""
    if min(n[:3]) == 0:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return [min(max(d, 0.01), 0.99 * k) for k, d in zip((1, 2, 3), found)]


class Model:
    """The arrays of a folder. sizes: pairs of each bucket that has any; a file that should be there and isn't, or that
    has another length, is an error.

    Files of a file system that the machine mounts are memory-mapped; of another one (HDFS, S3) the arrays in use are
    read, and the last KEPT of them stay.
    """

    KEPT = 8

    def __init__(self, folder: str, buckets: int, spread: int, word_files: int, sums: dict, sizes: dict[int, int]):
        from pyarrow import fs

        self.system, self.path = opened(folder)
        self.mapped = isinstance(self.system, fs.LocalFileSystem)
        self.buckets, self.spread, self.word_files, self.sums, self.sizes, self.maps = buckets, spread, word_files, sums, sizes, {}

    def get(self, name: str, at: int) -> np.ndarray | None:
        if name in ("pairs", "times") and at not in self.sizes:
            return None
        file = f"{name}-{at:06d}"
        if file not in self.maps:
            if self.mapped:
                found = np.load(f"{self.path}/{file}.npy", mmap_mode="r")
            else:
                with self.system.open_input_file(f"{self.path}/{file}.npy") as f:
                    found = np.load(io.BytesIO(f.readall()))
                while len(self.maps) >= self.KEPT:
                    self.maps.pop(next(iter(self.maps)))
            if name in ("pairs", "times") and len(found) != self.sizes[at]:
                raise ValueError(f"{self.path}/{file}.npy has {len(found)} rows instead of {self.sizes[at]}")
            self.maps[file] = found
        return self.maps[file]

    def _search(self, keys: np.ndarray, of: np.ndarray, names: tuple[str, str], width: int) -> np.ndarray:
        """Values of the keys (zeros where there is none); of: the bucket of each key."""
        shape = (len(keys), width) if width > 1 else len(keys)
        out = np.zeros(shape, np.int64)
        order = np.lexsort((keys, of))
        keys, of = keys[order], of[order]
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
        for a, z in zip(cuts, [*cuts[1:], len(of)]):
            stored = self.get(names[0], int(of[a]))
            if stored is None or not len(stored):
                continue
            at = np.minimum(np.searchsorted(stored, keys[a:z]), len(stored) - 1)
            hit = np.flatnonzero(stored[at] == keys[a:z])
            out[order[a + hit]] = self.get(names[1], int(of[a]))[at[hit]]
        return out

    def scores(self, counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each text."""
        s = self.sums
        before, word = pairs_of(counts, hashes)
        words, at = np.unique(np.append(END, hashes), return_inverse=True)
        of_end, at = at[0], at[1:]
        at_before = np.append(of_end, at[:-1])
        stats = self._search(words, words % np.uint64(self.word_files) if self.word_files else words, ("words", "stats"), 5)
        n, v, types = s["tokens"], s["vocabulary"], s["types"]
        d1, d2 = s["unigram"], s["bigram"]
        kept = lambda c, d: np.maximum(c - np.where(c > 2, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0.0))), 0)
        left = (d1[0] * s["types_by"][0] + d1[1] * s["types_by"][1] + d1[2] * s["types_by"][2]) / max(types, 1)
        low = kept(stats[:, 1].astype(float), d1) / max(types, 1) + (left if types else 1.0) / (v + 1)
        pair = mixed(before, word)
        pairs, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
        times = self._search(pairs, bucket_of(before[first], word[first], self.buckets, self.spread), ("pairs", "times"), 1)[inverse].astype(float)
        follow = stats[at_before]
        total = np.maximum(follow[:, 0], 1)
        back = np.where(follow[:, 0] > 0, (d2[0] * follow[:, 2] + d2[1] * follow[:, 3] + d2[2] * follow[:, 4]) / total, 1.0)
        p = np.where(follow[:, 0] > 0, kept(times, d2) / total, 0) + back * low[at]
        c = stats[at, 0]
        ends = np.cumsum(counts)
        starts = ends - counts
        return np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(np.log10((c + 1) / (n + v + 1)), starts), np.add.reduceat(np.log10(p), starts)


def train(docs: DataFrame, folder: str) -> dict:
    """Count the pairs of docs (text) into the files of folder; returns what a Model of it needs.

    What reaches the driver are sums: four numbers a kind, and one row for each bucket and file of words.
    """
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = max(buckets // 32, 1)
    packed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counting(buckets, spread), "bucket long, pairs binary")
    opened(folder)
    parts = packed.repartition(buckets, "bucket").mapInArrow(_merging(folder), "hash long, kind long, count long, before long, once long, twice long, more long")
    parts = written(parts, "followers")
    got = parts.where("kind > 1").groupBy("kind", "hash").agg(F.sum("count").alias("n")).collect()  # 4 rows, and one a bucket
    kinds, sizes = ({r.hash: r.n for r in got if r.kind == k} for k in (2, 3))
    words = parts.where("kind < 2").groupBy("hash").agg(*(F.sum(c).alias(c) for c in WORD_COLUMNS[1:]))
    # the file of a word is its unsigned hash modulo the number of files
    low = F.pmod(F.col("hash"), F.lit(buckets))
    wrapped = F.when(F.col("hash") < 0, F.pmod(low + F.lit((1 << 64) % buckets), F.lit(buckets))).otherwise(low).cast("int")
    stored = written(words.withColumn("file", wrapped).repartitionById(buckets, F.col("file")).select(*WORD_COLUMNS).mapInArrow(_storing(folder), ", ".join(f"s{i} long" for i in range(7))), "words")
    s = stored.agg(*(F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"s{i}") for i in range(7))).first()
    by = [s.s3, s.s4, max(s.s0 - s.s3 - s.s4, 0)]
    sums = {"tokens": s.s1, "vocabulary": s.s0, "types": s.s2, "types_by": by, "unigram": discounts([s.s3, s.s4, s.s5, s.s6]), "bigram": discounts([kinds.get(k, 0) for k in range(1, 5)])}
    return {"folder": folder, "buckets": buckets, "spread": spread, "word_files": buckets, "sums": sums, "sizes": sizes}


_models: dict[str, Model] = {}


def _scoring(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model["folder"] not in _models:
            _models.clear()
            _models[model["folder"]] = Model(**model)
        for whole in batches:
            for batch in slices(whole, 2):
                counts, hashes = tokens_of(batch.column(2))
                known, base, score = _models[model["folder"]].scores(counts, hashes)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts), pa.array(known), pa.array(np.full(len(counts), model["sums"]["tokens"])), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Learned from the rows that aren't held out (crc32 of the doc_id as text, modulo 7, is 2; null doc_ids aren't).
    Null texts are empty: the end alone. score is the log10 probability of the whole text; unknown words share what
    the unigram discount leaves with all words, evenly. Repeated rows count and score as rows. No rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~learned_from()).alias("held_out"), F.col("text").cast("string").alias("text"))
    folder = shared_folder(docs.sparkSession, "lm")
    model = train(rows.where("not held_out"), folder)
    return rows.mapInArrow(_scoring(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
