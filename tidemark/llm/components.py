"""Connected components by alternating stars: every round points nodes at the smallest neighbour they know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import staged


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a digest of them all."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (columns a, b; direction plays no part): root is the smallest node of
    its component. Each round is two aggregations and two joins on node; neighbours are never gathered in one row, and
    rounds grow with the logarithm of the largest component."""
    pairs = edges.where(F.col("a") != F.col("b"))
    now = staged(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (state := _mark(now)) != before:
        before = state
        # Large star: larger neighbours of a node point at the smallest of the node and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written first, so that the join shuffles both sides and Spark can split a node with many neighbours.
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        large = staged(large, "links")
        # Small star: a node and its smaller neighbours point at the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = staged(small.where(F.col("a") != F.col("b")).distinct(), "links")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
