"""Connected components of an undirected edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges(u, v)``, u > v, has one edge down, or only edges up."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))).alias("e"))
    per = ends.groupBy("e.node").agg(F.sum("e.down").alias("n"), F.count("*").alias("all"))
    return not per.where("n > 1 or (n = 1 and all > 1)").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(u, v)`` of non-null comparable ids -> ``(node, root)`` for every node with an edge.

    ``root`` is the smallest id in the node's component. Each round rewires every
    node to smaller neighbours (large star, then small star); minima are taken by
    partial aggregation, so a node with many neighbours is no single task's load.
    Ends when the edge set is a forest of stars, after about log(n) rounds. Self
    loops and repeated edges are allowed; an empty table gives an empty result.
    """
    now = scratch.keep(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while not _is_forest_of_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = scratch.keep(small.distinct(), "edges")
        scratch.drop(large)
        scratch.drop(now)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
