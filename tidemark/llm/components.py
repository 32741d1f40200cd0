"""Connected components by alternating stars, each step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize


def _done(edges: DataFrame) -> bool:
    """Every edge (a, b) leads from a node of its own to a smaller one that has no such edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("all"))
    return nodes.where("out > 1 OR out = 1 AND all > 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    ends = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return ends.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches; roots themselves are left out.

    Each round keeps one row per link and node at most, so a component of any size stays spread out.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "star")
    while not _done(now):
        before, now = now, materialize(_small_star(_large_star(now)), "star")
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
