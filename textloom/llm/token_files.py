"""Token ids in files of bit or byte planes.

A file holds blocks of a fixed number of ids (the last is shorter). A block is transposed into 4 byte planes or 32 bit
planes (plane p has byte or bit p of every id), each compressed by zstandard: the upper planes of small ids shrink to
nothing. After the blocks come the documents (doc_id and number of ids, as an Arrow stream), the chunk index (offset,
number of ids and plane sizes of every block), and a fixed footer. Files are written under a temporary name and moved,
so a task that runs again leaves one whole file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import opened, shared_folder, slices, written
from .units import units_of

MAGIC, FOOTER = b"TLIDS001", struct.Struct("<8sBIQQQQ")
BLOCK = 1 << 16
PLANES = {"byte": 4, "bit": 32}
#: A file is closed, and the next of its shard begun, beyond so many ids or documents.
MOST_IDS, MOST_DOCS = 1 << 26, 1 << 22


def planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of uint32 ids."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [rows[:, p].tobytes() for p in range(4)]
    return [x.tobytes() for x in np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")]


def joined(parts: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids that planes() was given."""
    rows = np.stack([np.frombuffer(p, np.uint8) for p in parts], 1 if kind == "byte" else 0)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").ravel()


class Writer:
    """Streams ids and documents to one file; holds one block at a time besides the index and the documents' sizes."""

    def __init__(self, folder: str, name: str, kind: str = "byte", block: int = BLOCK, level: int = 3):
        self.system, path = opened(folder)
        self.final, self.part = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}"
        self.out, self.kind, self.block, self.pack = self.system.open_output_stream(self.part), kind, block, zstandard.ZstdCompressor(level)
        self.at, self.index, self.rest, self.docs, self.counts, self.n_docs, self.total = 0, [], np.zeros(0, np.uint32), [], [], 0, 0

    @property
    def full(self) -> bool:
        return self.total >= MOST_IDS or self.n_docs >= MOST_DOCS

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids.cast(pa.int64()))
        self.counts.append(pa.array(counts, pa.int64()))
        self.n_docs += len(doc_ids)
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) - len(ids) % self.block
        for a in range(0, whole, self.block):
            self._block(ids[a : a + self.block])
        self.rest = ids[whole:]

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        parts = [self.pack.compress(p) for p in planes(ids, self.kind)]
        self.index.append([self.at, len(ids), *map(len, parts)])
        for p in parts:
            self._write(p)

    def close(self) -> str:
        if len(self.rest):
            self._block(self.rest)
        docs_at = self.at
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": pa.chunked_array(self.docs, pa.int64()), "n": pa.chunked_array(self.counts, pa.int64())})
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table, max_chunksize=1 << 16)
        self._write(sink.getvalue().to_pybytes())
        index_at = self.at
        self._write(np.array(self.index, "<i8").tobytes())
        self._write(FOOTER.pack(MAGIC, PLANES[self.kind], self.block, docs_at, index_at, len(self.index), self.total))
        self.out.close()
        self.system.move(self.part, self.final)
        return self.final


class Reader:
    """Reads a file of Writer: any block by the chunk index, or documents in order, block by block."""

    def __init__(self, folder: str, name: str):
        system, path = opened(folder)
        self.f = system.open_input_file(f"{path}/{name}")
        size = self.f.size()
        magic, n_planes, self.block, docs_at, index_at, n, self.total = FOOTER.unpack(self.f.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path}/{name} is no file of token ids")
        self.kind = "byte" if n_planes == 4 else "bit"
        self.index = np.frombuffer(self.f.read_at(size - FOOTER.size - index_at, index_at), "<i8").reshape(n, 2 + n_planes)
        self.docs_data, self.unpack = self.f.read_at(index_at - docs_at, docs_at), zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        """The ids of block k."""
        at, n, *sizes = self.index[k].tolist()
        data, cut = self.f.read_at(sum(sizes), at), np.cumsum([0, *sizes])
        most = n if self.kind == "byte" else -(-n // 8)
        return joined([self.unpack.decompress(data[a:z], max_output_size=most) for a, z in zip(cut, cut[1:])], n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, start in this file, number of ids, crc32 of the ids, in file order."""
        start, k, held, at = 0, 0, np.zeros(0, np.uint32), 0
        for batch in pa.ipc.open_stream(self.docs_data):
            for doc, n in zip(*(c.to_pylist() for c in batch.columns)):
                crc, need = 0, n
                while need:
                    if at == len(held):
                        held, at, k = self.ids(k), 0, k + 1
                    take = min(need, len(held) - at)
                    crc, at, need = zlib.crc32(held[at : at + take].tobytes(), crc), at + take, need - take
                yield doc, start, n, crc
                start += n


#: Marks that end a word without being part of a match with letters; no apostrophe, as contractions have one.
MARKS = ".,;:!?*%&$#|)"
NEW_LINE = "\n"


class UnitEncoder:
    """Units -> their ids, by the tokenizers library.

    A word, the marks after it and a new line before it are separate matches of the pattern, so stems are encoded once
    for all their marks. Plain pieces go in lines of many, since a call for each costs more than its ids; a new line
    between two is a match, and an id, of its own. What is known of pieces stays, up to `most` of them.
    """

    def __init__(self, path: str, most: int = 650_000, at_once: int = 60_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        line = self.tokenizer.encode(NEW_LINE, add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.most, self.at_once = most, at_once
        self._forget()

    def _forget(self) -> None:
        #: piece -> place in starts and sizes; ids are in blocks that are joined when they are read.
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __call__(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all units in order, and how many each has."""
        if len(self.known) > self.most:
            self._forget()
        n = len(units)
        headed = pc.match_substring_regex(units, r"^\n[\p{L}\p{N}]") if self.line is not None else pa.array(np.zeros(n, bool))
        body = pc.if_else(headed, pc.utf8_slice_codeunits(units, 1), units)
        stem = pc.utf8_rtrim(body, characters=MARKS)
        parted = pc.and_(pc.less(pc.binary_length(stem), pc.binary_length(body)), pc.match_substring_regex(stem, r"^[ \p{L}]\p{L}+$"))
        main = pc.if_else(parted, stem, body)
        tails = pc.replace_substring_regex(body.filter(parted), r"^[ \p{L}]\p{L}+", "")
        pieces = pa.concat_arrays([pa.array([NEW_LINE], main.type), main, tails.cast(main.type)]).dictionary_encode()
        codes = self._codes(pieces.dictionary.to_pylist())[pieces.indices.to_numpy(zero_copy_only=False)]
        # a unit's pieces in order: the new line, the stem, the marks
        with_tail, with_head = parted.to_numpy(zero_copy_only=False), headed.to_numpy(zero_copy_only=False)
        own = np.zeros((n, 3), np.int64)
        own[:, 0], own[:, 1] = codes[0], codes[1 : n + 1]
        own[with_tail, 2] = codes[n + 1 :]
        there = np.column_stack([with_head, np.ones(n, bool), with_tail])
        sizes = np.where(there, self.sizes[own], 0)
        flat = own[there]
        return gathered(self.ids, np.cumsum(self.sizes) - self.sizes, self.sizes, flat), sizes.sum(1)

    def _codes(self, pieces: list[str]) -> np.ndarray:
        found = list(map(self.known.get, pieces))
        missing = [i for i, c in enumerate(found) if c is None]
        for at in range(0, len(missing), self.at_once):
            part = [pieces[i] for i in missing[at : at + self.at_once]]
            order, ids, sizes = self._encoded(part)
            first = len(self.sizes)
            self.ids, self.sizes = np.concatenate([self.ids, *ids]), np.concatenate([self.sizes, *sizes])
            self.known.update(zip((part[k] for k in order), range(first, first + len(order))))
        for i in missing:
            found[i] = self.known[pieces[i]]
        return np.array(found, np.int64)

    def _encoded(self, pieces: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Which pieces come in which order, their ids in blocks, and their numbers of ids in blocks."""
        # a word, or other printable characters without white space but a space at its start
        plain = lambda u: u.isalnum() or u[1:].isalnum() and u[0] == " " or u.isprintable() and " " not in u[1:] and u[:2].strip()
        lines = [i for i, u in enumerate(pieces) if u and self.line is not None and plain(u)]
        groups = [lines[at : at + 50] for at in range(0, len(lines), 50)]
        order, ids, sizes, single = [], [], [], np.ones(len(pieces), bool)
        for own, e in zip(groups, self.tokenizer.encode_batch_fast([NEW_LINE.join([pieces[i] for i in own]) for own in groups], add_special_tokens=False)):
            found = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(found == self.line)
            if len(cuts) == len(own) - 1:
                order += own
                ids.append(found[found != self.line])
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(found)]])) - 1)
        single[order] = False
        rest = np.flatnonzero(single).tolist()
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            order.append(i)
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(e.ids)], np.int64))
        return order, ids, sizes


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of the codes, one after another; code c has sizes[c] ids from starts[c] on."""
    own = sizes[codes]
    ends = np.cumsum(own)
    return ids[np.repeat(starts[codes] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]


_workers: dict[str, UnitEncoder] = {}


def _writing(path: str, folder: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = UnitEncoder(path)
        known, shard, out, part = _workers[path], TaskContext.get().partitionId(), None, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.record_batch([pa.array([shard]), pa.array([out.final.rsplit("/", 1)[-1]]), pa.array([out.n_docs]), pa.array([out.total])], names=["shard", "name", "n_docs", "n_ids"])

        for whole in batches:
            for batch in slices(whole, limit=12 << 20):
                if out is not None and out.full:
                    yield closed()
                    out, part = None, part + 1
                out = out or Writer(folder, f"shard-{shard:06d}-{part:05d}.ids", kind)
                counts, codes, strings = units_of(batch.column(1))
                values, sizes = known(strings)
                values, sizes = np.append(values, np.uint32(end_id)), np.append(sizes, 1)
                ends = np.cumsum(counts)
                codes = np.insert(codes, ends, len(sizes) - 1)  # the end id after each document
                ids = gathered(values, np.cumsum(sizes) - sizes, sizes, codes)
                total = np.append(0, np.cumsum(sizes[codes]))
                ends = ends + np.arange(1, len(ends) + 1)
                out.add(batch.column(0), np.diff(total[np.append(0, ends)]), ids)
        if out is not None:
            yield closed()

    return run


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, kind: str = "byte", shards: int | None = None) -> DataFrame:
    """Encode the texts of docs (doc_id, text) and write them to files in folder, in ascending doc_id order.

    Returns shard, name, n_docs, n_ids, start (ids in the files before it). Null texts are empty (their end id alone);
    null doc_ids come first; rows of one doc_id stand in the order of their texts. An empty table writes no file.
    Units between white space are encoded once a worker; the ids are those of whole texts.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    shards = shards or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(shards, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    done = written(ranged.mapInArrow(_writing(path, folder, end_id, kind), "shard long, name string, n_docs long, n_ids long"), "shards")
    before = W.orderBy("shard", "name").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    return done.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _reading(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc, at, n, crc in Reader(folder, name).documents():
                    rows.append((doc, start + at, n, crc))
                    if len(rows) == 1 << 16:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files that write_tokens listed."""
    files = index.select("name", "start")
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_reading(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 2, kind: str = "byte") -> DataFrame:
    """Write the tokens of docs to new files in the shared folder, and read them back."""
    folder = shared_folder(docs.sparkSession, "ids")
    return read_tokens(write_tokens(docs, folder, path, end_id, kind), folder)
