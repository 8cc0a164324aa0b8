"""Connected components by alternating large and small stars, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import written


def _large(edges: DataFrame) -> DataFrame:
    """Links every greater neighbour of a node to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is a root or has its one link to a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(True).alias("lower")).union(edges.select("v", F.lit(False)))
    return ends.groupBy("node").agg(F.max("lower").alias("lower"), F.count("*").alias("links")).where("lower and links > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (u, v); the root is the least node reachable.

    Each round is written to the shared folder. Both steps keep what is connected, so it ends
    when a node with a link to a lesser one has no other link: then every node has one link,
    which leads straight to the only root of its component. That takes a number of rounds
    that grows with the logarithm of the size of a component, and none if the links are so
    from the start. The joins are told to merge: their small sides change with every round,
    and as broadcasts they would pile up in the driver.
    """
    edges = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(edges):
        edges = written(_small(_large(edges)), "stars")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
