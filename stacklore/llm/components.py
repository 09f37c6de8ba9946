"""Connected components by alternating large-star and small-star steps, or in one pass on the driver where edges are few."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: edges, of 16 bytes each, up to which the driver takes them all; rounds on many partitions would be mostly small files
FEW = 1 << 17


def _mark(edges: DataFrame) -> tuple:
    """Count and order-independent sum of hashes: equal marks, equal edges."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _at_once(u: list[int], v: list[int]) -> pd.DataFrame:
    """(node, root) of all nodes but the roots."""
    root = {}
    for a, b in zip(u, v, strict=True):
        for x in (a, b):  # to the roots, and every other node on the way nearer to them
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            a, b = b, x
        if a != b:
            root[max(a, b)] = min(a, b)
    for x in sorted(root):  # what a node points to is smaller, so it has its root already
        root[x] = root.get(root[x], root[x])
    return pd.DataFrame({"node": list(root), "root": list(root.values())}, dtype="int64")


def connected_components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node of its component.

    Roots themselves are not listed. Self-loops and repeated edges are harmless. Up to few
    edges are worked out at once. Of more, each round is checkpointed, so the plan does not
    grow, and the rounds grow with the square of the logarithm of the largest component.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    if mark[0] <= few:
        rows = now.toPandas()
        return now.sparkSession.createDataFrame(_at_once(rows["u"].tolist(), rows["v"].tolist()), "node long, root long")
    while mark[0]:
        now = cut(_small_star(_large_star(now)))
        if mark == (mark := _mark(now)):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
