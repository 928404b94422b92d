"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node with an edge, the smallest node it can reach.

    Nulls and loops are ignored; repeated edges count once. A step moves edges by keys with
    pre-aggregated minima, so a node with very many edges is joined as any skewed key is. Each
    round is written to the shared folder; stars need two rounds, long chains a logarithmic number.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND a > b").distinct()
    e = written(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.withColumnRenamed("m", "b"))
        e = written(small.distinct(), "edges")
        before, state = state, _state(e)
        if before == state:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def local_roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the least node reachable by the pairs."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[pairs[:, 0]], low)
        np.minimum.at(new, root[pairs[:, 1]], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        root = new[root]
        pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
    return root
