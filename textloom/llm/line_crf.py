"""Quality rules: counted rules over whole texts, and a linear-chain CRF that labels lines content or boilerplate.

The CRF's unary potentials are linear in the statistics of a line, its transitions a 2 x 2 table. It is trained on a
bounded sample of labelled documents by Viterbi training: lines of good documents are content; those of bad ones, which
hold lines of both kinds, begin as boilerplate and are then decoded and learned from in turn, and each keeps one line of
boilerplate at least. Viterbi decoding finds the best labels of a document's lines; the share of its characters in
content lines decides, from a threshold that tells the sample's documents apart best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import FEATURES, held_out, statistics
from .shared import slices, sums, texts, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Of a line's statistics, those that mean something for one line; then: equal to an earlier line.
USED = [FEATURES.index(f) for f in ("words", "word_len", "upper", "shout", "pipe", "symbol", "stop", "distinct", "top_word", "echo", "triples", "short", "long")]


def repeat_words(of: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Words in windows of 8 words that the same text has twice or more. Windows are compared exactly: runs of 2, 4
    and 8 words are numbered from the numbers of their halves."""
    size, ids = 1, codes
    while size < WINDOW:
        if len(ids) <= size:
            return np.zeros(n, np.int64)
        ids = pd.factorize(ids[:-size].astype(np.int64) * (int(ids.max()) + 1) + ids[size:])[0]
        size *= 2
    whole = of[: len(ids)] == of[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    keys = pd.factorize(ids[at].astype(np.int64) * n + of[at])[0]
    again = at[np.bincount(keys, minlength=1)[keys] > 1] if len(keys) else at
    edge = np.bincount(again, minlength=len(codes) + 1) - np.bincount(again + WINDOW, minlength=len(codes) + 1)
    return np.bincount(of[np.cumsum(edge)[: len(codes)] > 0], minlength=n)


def rules(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text (null: none)."""
    column = texts(column)
    n = len(column)
    of, words = words_of(column)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    letters = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0)
    doc, lines = lines_of(column)
    keys = pd.factorize(lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + doc)[0]
    _, first = np.unique(keys, return_index=True)
    return {
        "n_words": np.bincount(of, minlength=n), "word_chars": sums(letters, of, n).astype(np.int64), "n_symbols": pc.count_substring_regex(column, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n), "n_repeat_words": repeat_words(of, codes, n),
    }


def lines_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Text index of each line that has a word, and the lines."""
    parts = pc.split_pattern(column, "\n")
    flat, of = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    there = pc.match_substring_regex(flat, "[^\\x20\\x09-\\x0D]")
    return of[there.to_numpy(zero_copy_only=False)], flat.filter(there)


def line_statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, statistics and characters of each line with a word."""
    column = texts(column)
    of, lines = lines_of(column)
    if not len(lines):
        return of, np.zeros((0, len(USED) + 1)), np.zeros(0, np.int64)
    keys = pd.factorize(lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(column) + of)[0]
    again = np.ones(len(of))
    again[np.unique(keys, return_index=True)[1]] = 0
    return of, np.column_stack([statistics(lines)[:, USED], again]), pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)


def _in_steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from the longest to the shortest: order, starts (in that order), and how many have a step t."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(longest), "left") if longest else np.zeros(0, np.int64)
    return order, starts, active


class Crf:
    """weights: one row of potentials for content less boilerplate; moves[a, b]: from label a to label b (1: content)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, moves: np.ndarray, least_share: float = 0.5):
        self.mean, self.scale, self.weights, self.moves, self.least_share = mean, scale, weights, moves, least_share

    def unary(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -6, 6)]) @ self.weights

    def viterbi(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best label of each line; lengths: lines of each text. Ties go to content. All texts take a step together."""
        u = self.unary(x)
        labels, back = np.zeros(len(u), bool), np.zeros((len(u), 2), bool)
        order, starts, active = _in_steps(lengths)
        best = np.zeros((len(order), 2))
        m = self.moves
        for t, k in enumerate(active):
            at = starts[:k] + t
            if t:
                to0 = best[:k, [0]] + m[0, [0]], best[:k, [1]] + m[1, [0]]
                to1 = best[:k, [0]] + m[0, [1]], best[:k, [1]] + m[1, [1]]
                back[at, 0], back[at, 1] = (to0[1] >= to0[0])[:, 0], (to1[1] >= to1[0])[:, 0]
                best[:k] = np.hstack([np.maximum(*to0), np.maximum(*to1)])
            best[:k, 1] += u[at]
        now = best[:, 1] >= best[:, 0]
        for t in range(len(active) - 1, -1, -1):
            at = starts[: active[t]] + t
            labels[at] = now[: active[t]]
            if t:
                now[: active[t]] = back[at, now[: active[t]].astype(int)]
        return labels


#: Without labelled documents: symbols, pipes, shouting, repetition and copied lines speak against a line.
def default_crf() -> Crf:
    weights = {"upper": -0.8, "shout": -1.0, "pipe": -2.0, "symbol": -2.0, "distinct": 0.8, "echo": -1.0, "triples": -0.8}
    mean = np.array([2.5, 1.6, -3.0, -5.5, -5.5, -5.5, -3.5, 0.0, -1.6, -5.5, -5.5, -1.2, -3.0, 0.0])
    return Crf(mean, np.ones(len(USED) + 1), np.array([3.0, *(weights.get(FEATURES[i], 0.0) for i in USED), -1.0]), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def train_crf(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, rounds: int = 120, penalty: float = 1.0) -> Crf:
    """Maximum likelihood by Adam; gradients by forward-backward over all sequences at once."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    crf = Crf(mean, scale, np.zeros(x.shape[1] + 1), np.zeros((2, 2)))
    z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -6, 6)])
    order, starts, active = _in_steps(lengths)
    ends = np.cumsum(lengths)
    inner = np.ones(len(x), bool)
    inner[(ends - lengths)[lengths > 0]] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    m, v, theta = 0.0, 0.0, np.zeros(z.shape[1] + 4)
    for step in range(1, rounds + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        u = np.column_stack([np.zeros(len(z)), z @ w])
        ahead, behind = np.zeros_like(u), np.zeros_like(u)
        for t, k in enumerate(active):
            here = starts[:k] + t
            ahead[here] = u[here] + (np.logaddexp(ahead[here - 1, [0]][:, None] + moves[0], ahead[here - 1, [1]][:, None] + moves[1]) if t else 0)
        for t in range(len(active) - 2, -1, -1):
            here = starts[: active[t + 1]] + t
            nxt = u[here + 1] + behind[here + 1]
            behind[here] = np.logaddexp(moves[:, 0] + nxt[:, [0]], moves[:, 1] + nxt[:, [1]])
        both = ahead + behind
        total = np.logaddexp(both[:, 0], both[:, 1])
        p = np.exp(both[:, 1] - total)
        pair = ahead[at - 1][:, :, None] + moves + (u[at] + behind[at])[:, None, :] - total[at][:, None, None]
        grad = np.concatenate([z.T @ (y - p) - penalty * w, (seen - np.exp(pair).sum(0)).ravel() - penalty * theta[-4:]]) / len(x)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    crf.weights, crf.moves = theta[:-4], theta[-4:].reshape(2, 2)
    return crf


def relabelled(crf: Crf, x: np.ndarray, good: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Labels of all lines: content in good documents; in bad ones as decoded, with the worst line as boilerplate where
    all are decoded as content."""
    y, of = crf.viterbi(x, lengths), np.repeat(np.arange(len(lengths)), lengths)
    y[good[of]] = True
    clean = (np.bincount(of, ~y, len(lengths)) == 0) & ~good & (lengths > 0)
    order = np.lexsort((crf.unary(x), of))
    y[order[(np.cumsum(lengths) - lengths)[clean]]] = False
    return y


def train_on_documents(x: np.ndarray, size: np.ndarray, good: np.ndarray, lengths: np.ndarray, passes: int = 4) -> Crf:
    """Viterbi training from labels of documents (see above); the first pass takes every line alone.

    size: characters of each line, for the threshold on the share of content.
    """
    of = np.repeat(np.arange(len(lengths)), lengths)
    y = good[of]
    crf = train_crf(x, y.astype(float), np.ones(len(x), np.int64))
    for _ in range(passes):
        y = relabelled(crf, x, good, lengths)
        crf = train_crf(x, y.astype(float), lengths)
    n = len(lengths)
    share = sums(size * crf.viterbi(x, lengths), of, n) / np.maximum(sums(size, of, n), 1)
    # both kinds of documents weigh the same; between two shares all thresholds are equally good, so the one next to a half
    edges = np.unique(np.append(share, [0.0, 1.0]))
    marks = np.clip(0.5, edges[:-1] + 0.05 * np.diff(edges), edges[1:])
    right = [(share[good] >= m).mean() + (share[~good] < m).mean() for m in marks]
    best = max(right)
    crf.least_share = float(min((m for m, v in zip(marks, right) if v >= best - 1e-12), key=lambda m: abs(m - 0.5)))
    return crf


def fit_crf(docs: DataFrame, labels: DataFrame, sample: int = 800, most_lines: int = 400) -> Crf:
    """A CRF from at most `sample` labelled documents (by hash of their id, half of each label, none that the quality
    classifier holds out), at most `most_lines` lines of each. Without lines of both labels: default_crf().

    Of a doc_id that several rows have, all rows are taken.
    """
    order = F.xxhash64(F.lit(3), "doc_id")
    one = lambda k: labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where((F.col("quality") == k) & ~held_out()).select("doc_id", F.lit(k).alias("y")).distinct().orderBy(order, "doc_id").limit(sample // 2)
    chosen = one(0).unionByName(one(1))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                of, x, size = line_statistics(batch.column(1))
                first = np.searchsorted(of, np.arange(len(batch) + 1))
                for k, y in enumerate(batch.column(0).to_pylist()):
                    own = slice(first[k], min(first[k + 1], first[k] + most_lines))
                    yield pa.record_batch([pa.array([y]), pa.array([np.column_stack([x[own], size[own]]).ravel().tolist()], pa.list_(pa.float64()))], names=["y", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select(F.col("y").cast("long"), "text")
    got = [(r.y, np.array(r.x).reshape(-1, len(USED) + 2)) for r in rows.mapInArrow(lines, "y long, x array<double>").collect() if r.x]
    if {y for y, _ in got} != {0, 1}:
        return default_crf()
    got.sort(key=lambda r: (r[0], len(r[1]), r[1].sum()))
    x = np.concatenate([x for _, x in got])
    return train_on_documents(x[:, :-1], x[:, -1], np.array([y == 1 for y, _ in got]), np.array([len(x) for _, x in got]))


def _deciding(crf: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                r = rules(batch.column(1))
                of, x, size = line_statistics(batch.column(1))
                n = len(batch)
                content = crf.viterbi(x, np.bincount(of, minlength=n))
                share = sums(size * content, of, n) / np.maximum(sums(size, of, n), 1)
                failed = (r["n_words"] < 20) | (100 * r["n_repeat_words"] > 30 * r["n_words"])
                kept = ~failed & (share >= crf.least_share)
                yield pa.record_batch([batch.column(0), *(pa.array(r[c]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept), pa.array(share)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    return run


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, crf: Crf | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share of every row.

    docs: doc_id, text (others are ignored); labels: doc_id, quality, to train on; or a trained crf. Null texts have
    no words and fail; repeated rows each give a row; an empty table gives none.
    """
    if crf is None:
        crf = fit_crf(docs, labels) if labels is not None else default_crf()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_deciding(crf), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")
