"""Byte-level BPE in DuckDB: a recursive query per partition contracts pairs until none is in the merge table."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import raw, release, slices
from .units import Encoded, units_of

#: Words of more bytes contract every place of their lowest pair at once; the others one place a round.
LONG = 200

#: Words or units that are encoded at once, and bytes of text: what a worker needs besides its caches is in proportion.
AT_ONCE, SLICE = 20_000, 3 << 20

#: No pair; no token stands at both ends of a word.
NONE, END = 1 << 30, -1

#: One round over words (tokens between two ENDs; ranks of each two neighbours, NONE: not in the merge table): the leftmost
#: pair of minimum rank becomes one token, and only the two pairs that this changes are looked up again. Words without a
#: pair leave.
ONE_PAIR = f"""
WITH RECURSIVE step(word, tokens, ranks, rank, i) AS (
    SELECT word, tokens, ranks, list_min(ranks), list_position(ranks, list_min(ranks)) FROM first_words
  UNION ALL
    SELECT word, tokens, ranks, list_min(ranks), list_position(ranks, list_min(ranks))
    FROM (SELECT word, s.tokens[1:i - 1] || [s.rank] || s.tokens[i + 2:] AS tokens,
                 s.ranks[1:i - 2] || [coalesce(a.rank, {NONE}), coalesce(b.rank, {NONE})] || s.ranks[i + 2:] AS ranks
          FROM step s
          LEFT JOIN merges a ON a.l = s.tokens[i - 1] AND a.r = s.rank
          LEFT JOIN merges b ON b.l = s.rank AND b.r = s.tokens[i + 2]
          WHERE s.rank < {NONE}))
SELECT word, tokens[2:len(tokens) - 1] AS tokens FROM step WHERE rank = {NONE}"""

#: The same over rows (word, place, token) with all places of a word's lowest pair at once, each second one in a run of overlapping pairs. Nothing
#: differs where every pair with the new token has a higher rank; of the other pairs (alone), only the leftmost.
ALL_PAIRS = """
WITH RECURSIVE step(round, word, place, token) AS (
    SELECT 0, word, place, token FROM first_tokens
  UNION ALL
    SELECT round + 1, word, place, CASE WHEN hit THEN rank ELSE token END
    FROM (SELECT *, lag(hit) OVER (ORDER BY place) AS eaten
          FROM (SELECT *, want AND CASE WHEN alone THEN seq = min(CASE WHEN want THEN seq END) OVER (PARTITION BY word)
                    ELSE (seq - coalesce(max(CASE WHEN NOT want THEN seq END) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 END AS hit
                FROM (SELECT *, coalesce(rank = low, false) AS want, row_number() OVER (ORDER BY place) AS seq
                      FROM (SELECT round, p.word, place, token, rank, alone, min(rank) OVER (PARTITION BY p.word) AS low
                            FROM (SELECT *, lead(token) OVER o AS next_token, lead(word) OVER o AS next_word
                                  FROM step WINDOW o AS (ORDER BY place)) p
                            LEFT JOIN merges ON word = next_word AND token = l AND next_token = r)
                      WHERE low IS NOT NULL)))
    WHERE NOT coalesce(eaten, false))
SELECT word, string_agg(token, ' ' ORDER BY place) AS ids, string_agg(piece, '' ORDER BY place) AS pieces, count(*) AS n
FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round) JOIN pieces USING (token)
GROUP BY word"""


class Bpe:
    """Ranks in DuckDB tables: merges (l, r, rank) and pieces (token, piece)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern, self.known = regex.compile(pattern), Encoded(self.words, 400_000, AT_ONCE)
        rows = [(self.ranks[p[:i]], self.ranks[p[i:]], k) for p, k in self.ranks.items() for i in range(1, len(p)) if p[:i] in self.ranks and p[i:] in self.ranks]
        early = {t for a, b, k in rows for t in (a, b) if k <= t}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        l, r, rank = (pa.array(np.array(c, np.int32)) for c in zip(*rows))
        pairs = pa.table({"l": l, "r": r, "rank": rank, "alone": pa.array([k in early for *_, k in rows])})  # noqa: F841
        spellings = pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "piece": pa.array([p.hex() for p in self.ranks])})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM pairs")
        self.db.execute("CREATE TABLE pieces AS SELECT * FROM spellings")
        byte = {int(t): i for i, t in enumerate(self.bytes)}
        self.pairs = np.full((257, 257), NONE, np.int32)  # ranks of two bytes, 256: an END
        for a, b, k in rows:
            if a in byte and b in byte:
                self.pairs[byte[a], byte[b]] = k
        by_id = {k: p for p, k in self.ranks.items()}
        ids = range(max(by_id) + 1)
        self.spelling, self.decimal = pa.array([by_id.get(k) for k in ids], pa.binary()), pa.array([b"%d" % k for k in ids], pa.binary())

    def words(self, words: list[bytes]) -> list[tuple[bytes, bytes, int]]:
        """Decimal ids, decoded bytes and number of ids of each pre-token."""
        out: list = [None] * len(words)
        spelled, long = [], []
        for i, w in enumerate(words):
            rank = self.ranks.get(w)
            if rank is not None:  # a piece of the vocabulary is its own token
                back = self.spelling[rank].as_py()
                out[i] = (b"%d" % rank, w if back == w else back, 1)
            else:
                (long if len(w) > LONG else spelled).append(i)
        if spelled:
            for w, ids, back, n in self._contracted([words[i] for i in spelled]):
                i = spelled[w]
                out[i] = (ids, words[i] if back == words[i] else back, n)
        if long:
            lengths = np.array([len(words[i]) for i in long])
            data = np.frombuffer(b"".join(words[i] for i in long), np.uint8)
            first_tokens = pa.table({"word": np.repeat(np.array(long, np.int32), lengths), "place": np.arange(len(data), dtype=np.int64), "token": self.bytes[data]})
            self.db.register("first_tokens", first_tokens)
            got = self.db.sql(ALL_PAIRS).to_arrow_table()
            for w, ids, pieces, n in zip(*(c.to_pylist() for c in got.columns)):
                back = bytes.fromhex(pieces)
                out[w] = (ids.encode(), words[w] if back == words[w] else back, n)
            self.db.unregister("first_tokens")
        return out

    def _contracted(self, words: list[bytes]) -> Iterator[tuple[int, bytes, bytes, int]]:
        """Number, decimal ids, decoded bytes and number of ids of each word, one pair a round."""
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths + 2)
        codes = np.full(ends[-1], 256)
        codes[np.arange(len(data)) + np.repeat(2 * np.arange(len(words)) + 1, lengths)] = data
        tokens = np.append(self.bytes, np.int32(END))[codes]
        ranks = np.delete(np.append(self.pairs[codes[:-1], codes[1:]], np.int32(NONE)), ends - 1)
        offsets = np.append(0, ends)
        lists = (pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v)) for o, v in ((offsets, tokens), (offsets - np.arange(len(offsets)), ranks)))
        self.db.register("first_words", pa.table([pa.array(np.arange(len(words), dtype=np.int32)), *lists], names=["word", "tokens", "ranks"]))
        got = self.db.sql(ONE_PAIR).to_arrow_table().combine_chunks()
        self.db.unregister("first_words")
        ids = got.column(1).combine_chunks()
        offsets, tokens = ids.offsets, ids.values
        names, pieces = (pc.binary_join(pa.ListArray.from_arrays(offsets, told.take(tokens)), separator) for told, separator in ((self.decimal, b" "), (self.spelling, b"")))
        return zip(got.column(0).to_pylist(), names.to_pylist(), pieces.to_pylist(), np.diff(offsets).tolist())

    def units(self, units: list[str]) -> list[tuple[bytes, bytes, int]]:
        """Decimal ids, decoded bytes and number of ids of each unit."""
        of = [[m.encode() for m in self.pattern.findall(u)] for u in units]
        words = list({w: None for x in of for w in x})
        known = dict(zip(words, self.known.values(words)))
        return [known[x[0]] if len(x) == 1 else (b" ".join(known[w][0] for w in x), b"".join(known[w][1] for w in x), sum(known[w][2] for w in x)) for x in of]


_workers: dict[tuple[str, str], Encoded] = {}


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _workers:
            release()
            _workers[path, pattern] = Encoded(Bpe(path, pattern).units, at_once=AT_ONCE)
        known = _workers[path, pattern]
        for batch in (part for whole in batches for part in slices(whole, limit=SLICE)):
            counts, codes, strings = units_of(batch.column(1))
            values = known.values(strings.to_pylist())
            sizes = np.array([v[2] for v in values], np.int64)
            ends = np.cumsum(counts)
            hashes: list[list[str]] = []
            for parts, cut in (([v[0] + b" " if v[2] else b"" for v in values], 1), ([v[1] for v in values], 0)):
                at, data = raw(pa.array(parts, pa.large_binary()).take(pa.array(codes)))
                at = np.asarray(at)
                hashes.append([hashlib.sha256(data[a : max(a, z - cut)]).hexdigest() for a, z in zip(at[ends - counts].tolist(), at[ends].tolist())])
            total = np.append(0, np.cumsum(sizes[codes])) if len(codes) else np.zeros(1, np.int64)
            yield pa.record_batch([batch.column(0), pa.array(total[ends] - total[ends - counts]), pa.array(hashes[0]), pa.array(hashes[1])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            release()

    return run


def bpe_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text; other columns are ignored).

    path: a file of ranks in tiktoken's format; pattern: what cuts texts into words, merged separately; defaults:
    the public byte-level vocabulary of 50k. Null texts are empty: no ids. Null doc_ids and repeated rows each give
    their row; an empty table gives none. Texts of any length are encoded whole.
    """
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encoder(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
