"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (u, v long).

    Alternating large-star and small-star rounds: each is one aggregation and one join over the edges, written to
    the shared folder, so nothing but two sums a round reaches the driver. The number of rounds grows with the
    logarithm of the longest path.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, before = written(now, "edges"), None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark.n == 0 or mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        before = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, large.u == least.k).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("k", "m")).distinct()
        now = written(small, "edges")
    raise RuntimeError(f"the components didn't settle in {rounds} rounds")
