"""Connected components of a large edge table by alternating star contractions; labels are the smallest node of each component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node in sight instead."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are tied to the smallest of them. Here u > v holds in every edge."""
    least = _smallest(edges)
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(
        least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; ``component`` is the smallest node that can be reached.

    Nulls and loops are left out, repeated edges count once, an empty table gives an empty result. A node with a huge number of neighbours meets its minimum in
    a join whose other side has one row for it, which Spark splits. Each round is cut by a reliable checkpoint; two sums tell when nothing changes.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    e, before = cut_lineage(e), None
    for _ in range(most_rounds):
        e = cut_lineage(_small_star(_large_star(e)))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
