"""Connected components by alternating large and small stars, in Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortmill.llm import base


def _large(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the node's smallest neighbour or itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(low, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(low.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, label: str = "stars") -> DataFrame:
    """(node, root) for every node that has an edge and isn't the smallest of its component.

    ``edges`` has columns a < b of one orderable type. Each round is written to
    the shared folder; rounds end when the edges stay the same, after about
    log2 of the longest path.
    """
    current, state = base.stored(edges.select("a", "b"), label), None
    while True:
        after = base.stored(_small(_large(current)), label)
        base.discard(current)
        row = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        current = after
        if (row["n"], row["s"]) == state:
            return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = (row["n"], row["s"])
