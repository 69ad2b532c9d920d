"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import Workspace


def _mins(edges: DataFrame) -> DataFrame:
    """For each node its least neighbour, itself included; a partial aggregate before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the least of the node's neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour and the node itself are linked to the least smaller neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(u, v) edges of any ordered type -> (node, root): root is the least node reachable.

    Nodes without edges don't appear; self edges are ignored; edges may repeat and point either
    way. Each round is written to the shared folder, and the rounds end when the edge set stays
    as it is, seen by its row count and an order-free hash sum.
    """
    spark = edges.sparkSession
    now = work.save(edges.where("u is not null and v is not null and u != v").select("u", "v").distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        k += 1
        now = work.save(small_star(large_star(now)), f"{name}-{k}")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{k - 1}")
        if mark == seen or not mark[0]:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
