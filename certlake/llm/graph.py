"""Connected components of links that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a long, b long): root is its component's smallest node.

    Rounds of large and small stars: first every larger neighbour of a node is linked to the
    smallest node around it, then every smaller one. The links become stars around the smallest
    nodes in a number of rounds that grows with the logarithm of the nodes. A smallest node with
    very many neighbours is a row per neighbour, and joins here have plain tables on both sides,
    so that adaptive execution can split them. Every round is a written table.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        smaller = stored(links.groupBy("a").agg(F.min("b").alias("low")))
        around = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        known = around.join(smaller, "a", "left").select("b", F.coalesce("low", "a").alias("low"))
        own = smaller.select(F.col("a").alias("b"), "low")
        large = stored(known.union(own).distinct())

        smaller = stored(large.groupBy("b").agg(F.min("low").alias("least")))
        met = large.join(smaller, "b")
        small = met.where("low <> least").select(F.col("low").alias("a"), F.col("least").alias("b"))
        links = stored(small.union(smaller.select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct())

        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b"), F.col("b")).distinct())
