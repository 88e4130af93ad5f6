"""SimHash near-duplicates, compared bit-sliced.

Fingerprints that differ in at most r of 64 bits agree on at least k of k + r blocks of bits (pigeonhole), so
rows are sorted by each choice of k blocks and compared only within a run of equal blocks. Runs are compared
bit-sliced: 64 planes hold the fingerprints vertically, the distances of all lanes to the lane d places on are
counted together by carry-save adders, and a block is abandoned once all its lanes exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import lowered, raw, with_classes, written

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of a normalised text (bytes): a bit is 1 if set in over half of the shingles' XXH64."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - width].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter([digest(joined[a:z], seed) for a, z in zip(starts, ends[width - 1 :].tolist())], np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, data = raw(lowered(batch.column(1)))
            marks = np.fromiter((fingerprint(bytes(data[a:z]), width) for a, z in zip(ends[:-1], ends[1:])), np.uint64, len(batch))
            yield pa.record_batch([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    return run


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 planes of packed lanes: bit b of fingerprint i is bit i % 64 of plane b's word i // 64."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.unpackbits(np.pad(fps, (0, lanes - len(fps))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _moved(words: np.ndarray, by: int) -> np.ndarray:
    """Lanes moved down by `by` places: lane i gets lane i + by; zeros enter."""
    whole, bit = divmod(by, 64)
    out = np.zeros_like(words)
    out[: len(words) - whole] = words[whole:]
    if bit:
        up = np.zeros_like(out)
        up[:-1] = out[1:]
        out = (out >> np.uint64(bit)) | (up << np.uint64(64 - bit))
    return out


def within(planes: np.ndarray, by: int, radius: int, alive: np.ndarray) -> np.ndarray:
    """Of the lanes in `alive`, those at most radius (below 8) from the lane `by` places on."""
    rows = np.flatnonzero(alive)
    if not len(rows):
        return alive
    whole, bit = divmod(by, 64)
    n = planes.shape[1]
    low, high = np.minimum(rows + whole, n - 1), rows + whole + 1
    inside = high < n
    high = np.minimum(high, n - 1)
    live, ones, twos, fours, over = alive[rows], *(np.zeros(len(rows), np.uint64) for _ in range(4))

    def differing(b: int) -> np.ndarray:
        p = planes[b]
        other = p[low]
        if bit:
            other = (other >> np.uint64(bit)) | np.where(inside, p[high] << np.uint64(64 - bit), np.uint64(0))
        return p[rows] ^ other

    for b in range(0, 64, 2):
        x, y = differing(b), differing(b + 1)
        mixed = ones ^ x
        carry = (ones & x) | (mixed & y)  # a full adder over three words
        ones = mixed ^ y
        more = twos & carry
        twos ^= carry
        over |= fours & more
        fours ^= more
        if b % 8 == 6:
            live = live & ~_beyond(ones, twos, fours, over, radius)
            keep = live != 0
            if not keep.all():
                rows, low, high, inside, live, ones, twos, fours, over = (a[keep] for a in (rows, low, high, inside, live, ones, twos, fours, over))
                if not len(rows):
                    break
    out = np.zeros_like(alive)
    out[rows] = live
    return out


def _beyond(ones, twos, fours, over, radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius: compare the three counter planes with its bits from the top."""
    more, same = over, ~over
    for plane, bit in ((fours, radius >> 2 & 1), (twos, radius >> 1 & 1), (ones, radius & 1)):
        if bit:
            same = same & plane
        else:
            more = more | (same & plane)
            same = same & ~plane
    return more


def link_runs(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within runs of equal keys (rows sorted by key)."""
    planes, n = planes_of(fps), len(fps)
    change = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if n else np.zeros(0, np.int64)
    left = np.zeros(n, np.int64)  # rows of the same run behind each row
    if n:
        left = change[np.searchsorted(change, np.arange(n))] - np.arange(n)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    us, vs = [], []
    lanes = planes.shape[1] * 64
    for by in range(1, int(left.max(initial=0)) + 1):
        alive = np.packbits(np.pad(left >= by, (0, lanes - n)), bitorder="little").view(np.uint64)
        hit = within(planes, by, radius, alive)
        for i in np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little")[:n]).tolist():
            a, b = root(i), root(i + by)
            if a != b:
                parent[max(a, b)] = min(a, b)
                us.append(i)
                vs.append(i + by)
    return np.array(us, np.int64), np.array(vs, np.int64)


def _linker(radius: int, rows_at_once: int = 1 << 16):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(keys, fps):
            u, v = link_runs(keys, fps.view(np.uint64), radius)
            return pa.record_batch([pa.array(fps[u]), pa.array(fps[v])], names=["u", "v"])

        for batch in batches:
            keys = np.append(keys, batch.column(0).to_numpy(zero_copy_only=False))
            fps = np.append(fps, batch.column(1).to_numpy(zero_copy_only=False))
            if len(keys) >= rows_at_once and keys[0] != keys[-1]:
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
                yield links(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        yield links(keys, fps)

    return run


def _blocks(n: int, radius: int) -> tuple[int, list[int]]:
    """Number of agreeing blocks and the masks of each choice of them, so that a run has some 64 rows at random."""
    for k in range(1, 5):
        m = k + radius
        if n / 2 ** (64 * k // m) <= 64 or k == 4:
            edges = [64 * i // m for i in range(m + 1)]
            parts = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(m)]
            return k, [sum(parts[i] for i in c) for c in combinations(range(m), k)]
    raise AssertionError


def links_between(marks: DataFrame, radius: int = 4, chunk: int = 16384) -> DataFrame:
    """u, v: links that connect all different fingerprints of marks (fp long) within the radius.

    A run of more than `chunk` rows is split into chunks, and each pair of chunks is a run of its own; so no task
    holds more than two chunks of a run, and no link is lost.
    """
    if not 0 <= radius <= 7:
        raise ValueError("radius must be from 0 to 7")
    _, masks = _blocks(marks.count(), radius)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    table = F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("t", "mask")
    rows = marks.select("fp", table).select("fp", F.xxhash64(F.col("t"), F.col("fp").bitwiseAND(F.col("mask"))).alias("run"))
    hot = rows.groupBy("run").count().where(F.col("count") > chunk).select("run", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.xxhash64(F.col("run"), F.least(own, x), F.greatest(own, x)))
    split = rows.join(hot, "run", "left").select("fp", F.explode(F.when(F.col("chunks").isNull(), F.array("run")).otherwise(pairs)).alias("run"))
    return split.repartition("run").sortWithinPartitions("run", "fp").select("run", "fp").mapInArrow(_linker(radius), "u long, v long")


def simhash_dedup(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id, text; others are ignored).

    Null text: no words. No words: fingerprint zero, linked like any other. component_id is the smallest doc_id
    reachable over links of at most `radius` differing bits, the row itself included; null doc_ids don't count
    (a component of nothing else has null). Repeated rows each give a row. An empty table gives no rows.
    """
    rows = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints(width), "doc_id long, fp long"), "fingerprints")
    marks = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "marks")
    parts = components(links_between(marks.select("fp"), radius))
    named = marks.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("part"))
    least = named.groupBy("part").agg(F.min("first").alias("component_id"))
    of = written(named.join(least, "part").select("fp", "component_id", "n"), "classes")
    return with_classes(rows, of, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
