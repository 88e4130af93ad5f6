"""Quality classifier: quadratic discriminant analysis with shrunken covariances over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import raw, slices, sums, texts, words_of, written

CLASSES = ("upper", "lower", "digit", "shout", "pipe", "symbol", "stop", "line", "other")
_class = np.full(256, CLASSES.index("other"), np.uint8)
for _name, _chars in (("upper", bytes(range(65, 91))), ("lower", bytes(range(97, 123))), ("digit", b"0123456789"), ("shout", b"!?"), ("pipe", b"|"), ("symbol", b"#*$%&<>@^~={}[]\\/_+"), ("stop", b".,;:"), ("line", b"\n")):
    _class[list(_chars)] = CLASSES.index(_name)
FEATURES = ("words", "word_len", "upper", "shout", "pipe", "symbol", "stop", "digit", "distinct", "top_word", "echo", "triples", "lines", "dup_lines", "short", "long")


def statistics(column: pa.Array) -> np.ndarray:
    """Transformed statistics (rows: texts) of a column of texts; null: empty."""
    column = texts(column)
    n = len(column)
    ends, data = raw(column)
    size = np.diff(ends)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    of_byte = np.repeat(np.arange(n, dtype=np.int32), size)
    chars = np.bincount(of_byte.astype(np.int64) * len(CLASSES) + _class[data], minlength=n * len(CLASSES)).reshape(n, len(CLASSES)).astype(float)
    del of_byte
    of, words = words_of(column)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    letters = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0)
    n_words = np.bincount(of, minlength=n)
    _, at, times = np.unique(of * (len(coded.dictionary) + 1) + codes, return_index=True, return_counts=True)
    distinct, top = np.bincount(of[at], minlength=n), np.zeros(n)
    np.maximum.at(top, of[at], times)
    follows = of[1:] == of[:-1]
    echo = sums((codes[1:] == codes[:-1]) & follows, of[1:], n)
    triple = np.zeros(0, np.uint64)
    if len(codes) > 2:
        u = codes.astype(np.uint64)
        triple = (u[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ u[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ u[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xFF51AFD7ED558CCD) + of[2:].astype(np.uint64)
        triple, own = triple[follows[1:] & follows[:-1]], of[2:][follows[1:] & follows[:-1]]
        _, first = np.unique(triple, return_index=True)
        different = np.bincount(own[first], minlength=n)
    else:
        different = np.zeros(n)
    triples = np.maximum(n_words - 2, 0)
    parts = pc.split_pattern(column, "\n")
    lines, line_of = pc.list_flatten(parts).dictionary_encode(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    n_lines = np.bincount(line_of, minlength=n)
    _, first = np.unique(line_of * (len(lines.dictionary) + 1) + lines.indices.to_numpy(zero_copy_only=False), return_index=True)
    new_lines = np.bincount(line_of[first], minlength=n)
    total = chars.sum(1)

    def share(name: str, usual: float) -> np.ndarray:
        """Short texts lean to the usual share, as if 100 more characters had it."""
        return np.log((chars[:, CLASSES.index(name)] + 100 * usual) / (total + 100) + 0.003)

    def leaning(count: np.ndarray, usual: float, more: int = 12) -> np.ndarray:
        return (count + more * usual) / (n_words + more)

    repeated = (triples - different + 0.02) / (triples + 12)
    return np.column_stack([
        np.log1p(n_words), np.log(leaning(sums(letters, of, n), 6.0)), share("upper", 0.03), share("shout", 0), share("pipe", 0), share("symbol", 0), share("stop", 0.025), share("digit", 0),
        np.log(leaning(distinct, 0.95)), np.log(leaning(top, 0.1)), np.log(leaning(echo, 0) + 0.003), np.log(np.maximum(repeated, 0) + 0.003),
        np.log1p((n_words + 30) / (n_lines + 1)), np.log((n_lines - new_lines) / (n_lines + 3) + 0.01), np.log(leaning(sums(letters <= 3, of, n), 0.3)), np.log(leaning(sums(letters > 14, of, n), 0.03) + 0.01),
    ])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            x = statistics(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))], names=["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of the FEATURES) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_features, "doc_id long, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, position, value of the sums over x, and over x times x, of this partition."""
    d = len(FEATURES) + 1
    total = {0: np.zeros((d, d)), 1: np.zeros((d, d))}
    for batch in batches:
        x = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).reshape(-1, d - 1)
        x = np.column_stack([np.ones(len(x)), x])
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        for k in total:
            total[k] += x[labels == k].T @ x[labels == k]
    at = np.arange(d * d)
    yield pa.record_batch([pa.array(np.repeat([0, 1], d * d)), pa.array(np.tile(at, 2)), pa.array(np.concatenate([total[0].ravel(), total[1].ravel()]))], names=["label", "at", "value"])


class Discriminant:
    """Means, Cholesky factors and log-determinants of two classes, from their moments."""

    def __init__(self, moments: dict[int, np.ndarray], to_pooled: float = 0.2, to_sphere: float = 0.01, temper: float = 0.5):
        d = next(iter(moments.values())).shape[0] - 1
        counts = [moments[k][0, 0] for k in (0, 1)]
        self.known, self.temper = min(counts) > 0, temper
        self.prior = np.log((counts[1] + 1) / (counts[0] + 1))
        if not self.known:
            return
        means = [moments[k][0, 1:] / counts[k] for k in (0, 1)]
        scatter = [moments[k][1:, 1:] - counts[k] * np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = (scatter[0] + scatter[1]) / max(sum(counts) - 2, 1)
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.scale, self.means, self.factors, self.logdet = scale, [m / scale for m in means], [], []
        for k in (0, 1):
            s = (1 - to_pooled) * scatter[k] / max(counts[k] - 1, 1) + to_pooled * pooled
            s = s / np.outer(scale, scale)
            s = (1 - to_sphere) * s + to_sphere * np.trace(s) / d * np.eye(d)
            self.factors.append(np.linalg.inv(np.linalg.cholesky(s)))
            self.logdet.append(-2 * np.log(np.diag(self.factors[-1])).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: a tempered difference of the classes' log densities, and the prior."""
        z = np.full(len(x), self.prior)
        if self.known:
            distance = [(((x / self.scale - self.means[k]) @ self.factors[k].T) ** 2).sum(1) for k in (0, 1)]
            z = z + self.temper * 0.5 * (distance[0] + self.logdet[0] - distance[1] - self.logdet[1])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(statistics_of: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from all rows of labels (doc_id, quality 0 or 1) that statistics_of has; others are ignored.

    Only sums reach the driver: one matrix a class. Without a row of both classes, every score is the prior.
    """
    d = len(FEATURES) + 1
    rows = statistics_of.join(labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)"), "doc_id").select("label", "x")
    got = rows.mapInArrow(_moments, "label long, at long, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    moments = {0: np.zeros(d * d), 1: np.zeros(d * d)}
    for r in got:
        moments[r.label][r.at] = r.value
    return Discriminant({k: m.reshape(d, d) for k, m in moments.items()})


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _scorer(model: Discriminant, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(pc.list_flatten(batch.column(2)).to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text; other columns are never read).

    labels: doc_id, quality; those held out (crc32 of the doc_id as text, modulo 4, is 2) aren't learned from, nor
    are labels other than 0 and 1. Null texts are empty; a null doc_id isn't held out; repeated rows each give a
    row (and count as often in training). An empty table gives no rows; without labels of both classes the score
    is the prior.
    """
    rows = written(document_statistics(docs), "statistics")
    model = fit(rows, labels.select(F.col("doc_id").cast("long"), "quality").where(~held_out()))
    return rows.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(_scorer(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
