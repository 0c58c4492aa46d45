"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.sources.shared import keep, shared_folder

__all__ = ["components", "keep", "shared_folder"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node reachable.

    Alternating large-star and small-star steps, each a grouped minimum; a hub's edges
    are spread by its neighbours after the first step, and the number of rounds grows
    with the logarithm of the longest path.  A self-loop keeps a node without links.
    """
    loops = edges.where("a = b").select("a").distinct()
    links = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # Large star: larger neighbours of a node go to the least of the node and all its neighbours.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        links = keep(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component")).join(nodes.unionByName(roots).select("node"), "node", "left_anti")
    return nodes.unionByName(roots).unionByName(alone)
