"""Small matrices on the driver: principal components, classical scaling, hierarchical clustering of texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import ParameterError

MOST_TEXTS = 5000


def matrix(distances: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and the square matrix of text_a, text_b, distance; at most MOST_TEXTS texts."""
    rows = distances.limit(MOST_TEXTS * MOST_TEXTS // 2 + 1).collect()
    names = sorted({n for r in rows for n in (r.text_a, r.text_b)})
    if len(names) > MOST_TEXTS:
        raise ParameterError(f"more than {MOST_TEXTS} texts")
    at = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in rows:
        out[at[r.text_a], at[r.text_b]] = out[at[r.text_b], at[r.text_a]] = r.distance
    return names, out


def pca(z: DataFrame, components: int = 2, by: str = "text") -> DataFrame:
    """by, pc1, pc2, … of z-scores (by, word, z), signs fixed by the largest loading; texts x units fit the driver."""
    rows = z.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("word", "z"))).alias("v")).orderBy(by).limit(MOST_TEXTS + 1).collect()
    if len(rows) > MOST_TEXTS:
        raise ParameterError(f"more than {MOST_TEXTS} texts")
    x = np.array([[v.z for v in r.v] for r in rows])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])
    points = (u * s * sign)[:, :components]
    return z.sparkSession.createDataFrame([(r[by], *map(float, p)) for r, p in zip(rows, points)], [by, *(f"pc{i + 1}" for i in range(points.shape[1]))])


def mds(distances: DataFrame, dimensions: int = 2) -> DataFrame:
    """text, x1, x2: classical scaling."""
    names, d = matrix(distances)
    centre = np.eye(len(d)) - 1 / len(d)
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d**2) @ centre)
    top = np.argsort(values)[::-1][:dimensions]
    points = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
    points = points * np.sign(points[np.abs(points).argmax(0), np.arange(points.shape[1])])
    return distances.sparkSession.createDataFrame([(n, *map(float, p)) for n, p in zip(names, points)], ["text", *(f"x{i + 1}" for i in range(points.shape[1]))])


def linkage(distances: DataFrame, method: str = "ward") -> tuple[list[str], list[tuple[int, int, float, int]]]:
    """Names and merges (cluster, cluster, height, size) by Lance and Williams's update."""
    names, d = matrix(distances)
    n = len(names)
    size, live, d = dict.fromkeys(range(n), 1), list(range(n)), {(i, j): d[i, j] for i in range(n) for j in range(i)}
    get = lambda i, j: d[max(i, j), min(i, j)]
    merges = []
    for new in range(n, 2 * n - 1):
        i, j = min(((i, j) for a, i in enumerate(live) for j in live[:a]), key=lambda p: (get(*p), p))
        height = get(i, j)
        live = [k for k in live if k not in (i, j)]
        for k in live:
            a, b, ni, nj, nk = get(k, i), get(k, j), size[i], size[j], size[k]
            d[new, k] = {
                "single": min(a, b), "complete": max(a, b), "average": (ni * a + nj * b) / (ni + nj),
                "ward": np.sqrt(max(((ni + nk) * a * a + (nj + nk) * b * b - nk * height * height) / (ni + nj + nk), 0)),
            }[method]
        size[new] = size[i] + size[j]
        live.append(new)
        merges.append((min(i, j), max(i, j), float(height), size[new]))
    return names, merges


def within_between(distances: DataFrame, authors: DataFrame, bins: int = 20) -> DataFrame:
    """same_author, bin, n: a histogram of distances within and between authors (text, author)."""
    a, b = (authors.select(F.col("text").alias(f"text_{x}"), F.col("author").alias(f"author_{x}")) for x in "ab")
    rows = distances.join(a, "text_a").join(b, "text_b").withColumn("same_author", F.col("author_a") == F.col("author_b"))
    most = rows.agg(F.max("distance").alias("m"))
    return rows.crossJoin(F.broadcast(most)).groupBy("same_author", F.least(F.floor(F.col("distance") * bins / F.col("m")), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def network(collocations: DataFrame, top_n: int = 50) -> tuple[DataFrame, DataFrame]:
    """Edges (left, right, score, weight from 0 to 1) and nodes (word, degree) of the best collocations."""
    edges = collocations.orderBy(F.desc("score"), "left", "right").limit(top_n)
    span = edges.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    edges = edges.crossJoin(F.broadcast(span)).select("left", "right", "score", F.coalesce(F.try_divide(F.col("score") - F.col("low"), F.col("high") - F.col("low")), F.lit(1.0)).alias("weight"))
    nodes = edges.select(F.explode(F.array("left", "right")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("degree"))
    return edges, nodes
