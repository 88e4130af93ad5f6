"""Plain versions of whole operators, for tables that fit in lists."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from textloom.llm import mixing, quality

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def quadratic_scores(rows, labels, to_pooled=0.2, to_sphere=0.01, temper=0.5):
    """Scores of rows (doc_id, text) by densities written out; labels: doc_id -> 0 or 1."""
    x = quality.statistics(pa.array([t for _, t in rows], pa.large_string()))
    known = [(i, labels[d]) for i, (d, _) in enumerate(rows) if d in labels and not held_out(d)]
    own = [x[[i for i, y in known if y == k]] for k in (0, 1)]
    scatter = [(o - o.mean(0)).T @ (o - o.mean(0)) for o in own]
    pooled = (scatter[0] + scatter[1]) / (len(known) - 2)
    scale = np.sqrt(np.diag(pooled))
    logs = []
    for o, s in zip(own, scatter):
        c = ((1 - to_pooled) * s / (len(o) - 1) + to_pooled * pooled) / np.outer(scale, scale)
        c = (1 - to_sphere) * c + to_sphere * np.trace(c) / len(c) * np.eye(len(c))
        gap = (x - o.mean(0)) / scale
        logs.append(-0.5 * ((gap @ np.linalg.inv(c)) * gap).sum(1) - 0.5 * np.linalg.slogdet(c)[1])
    z = temper * (logs[1] - logs[0]) + np.log((len(own[1]) + 1) / (len(own[0]) + 1))
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def kept_copies(rows):
    """Which rows (doc_id, text) have the largest doc_id of their text."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[t.translate(LOW)].append(d)
    return [d == max(groups[t.translate(LOW)]) for d, t in rows]


def fingerprint(text):
    w = WORD.findall(text.translate(LOW))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, radius=4):
    """The smallest doc_id that each row reaches."""
    marks = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(rows))]


def mixture(spark, rows, share, epochs, seed=17):
    """Copies of rows (doc_id, text, lang, source) without ties of doc_id, by sorting whole leaves."""
    domain = lambda s: f"d{int(s[3:]) // 10}" if s and re.fullmatch("src[0-9]{1,9}", s) else "?"
    leaves = defaultdict(list)
    for i, (d, t, lang, source) in enumerate(rows):
        leaves[domain(source), lang or "?", source or "?"].append((i, d, len(WORD.findall(t or ""))))
    supplies = {k: sum(n for *_, n in v) for k, v in leaves.items()}
    given = mixing.budgets(supplies, mixing._weight, share * sum(supplies.values()), epochs)
    copies = [0] * len(rows)
    for k, own in leaves.items():
        n = supplies[k]
        whole = min(int(given[k] // n), int(epochs)) if n else 0
        rest = int(given[k]) - whole * n
        ids = spark.createDataFrame([(i, d) for i, d, _ in own], "i long, doc_id long")
        order = {r.i: r.o % (1 << 64) for r in ids.select("i", F.xxhash64(F.lit(seed), F.lit(whole).cast("long"), "doc_id").alias("o")).collect()}
        upto = 0
        for i, d, words in sorted(own, key=lambda r: (order[r[0]], r[1])):
            upto += words
            copies[i] = whole + (upto <= rest)
    return copies


def sha(data):
    return hashlib.sha256(data).hexdigest()
