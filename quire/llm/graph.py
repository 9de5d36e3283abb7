"""Connected components over link tables, without collecting nodes or links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import removed, staged


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of ``links``; component is the smallest node reachable.

    Alternating large-star and small-star rounds: each node's larger, then smaller,
    neighbours are hung onto the smallest neighbour, until a round changes nothing. The
    smallest neighbours are minima, combined before the shuffle; a node with a third of
    all links is a skewed join, which adaptive execution splits. Null nodes are ignored.
    """
    pairs = links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    edges = staged(pairs.where("low < high").distinct(), "links")
    before = None
    while True:
        # Large star: of each node, links to larger neighbours move to the smallest neighbour (or itself).
        both = edges.union(edges.select("high", "low")).toDF("node", "other")
        least = staged(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m")), "large-star")
        moved = edges.join(least.withColumnRenamed("node", "low"), "low").select(F.col("m").alias("low"), "high")
        large = staged(moved.where("low < high").distinct(), "links")
        removed(edges, least)
        # Small star: of each node, smaller neighbours and itself move to its smallest neighbour.
        least = staged(large.groupBy("high").agg(F.min("low").alias("m")), "small-star")
        moved = large.join(least, "high").select(F.col("m").alias("low"), F.col("low").alias("high")).where("low < high")
        edges = staged(moved.union(least.select(F.col("m").alias("low"), "high")).distinct(), "links")
        removed(large, least)
        # The forest is done once every node has one link, to a node that has none upwards: then it stays as it is.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(edges.select("low", "low").distinct())
        before = now
