"""Connected components by alternating stars (large-star, small-star), all of it joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrain.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect the larger (or not larger) neighbours of each node, and the node, to its smallest neighbour.

    The smallest neighbour is found with map-side combining and joined back, so a node with very many
    neighbours is never one group in one task.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("least"))
    least = staged(edges.sparkSession, least, "star-least")
    joined = both.join(least, both["a"] == least["node"])
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b); the component is its smallest node."""
    spark = links.sparkSession
    edges = staged(spark, links.select("a", "b").where("a != b").distinct(), "links")
    mark = None
    while True:
        edges = staged(spark, _star(staged(spark, _star(edges, True), "large-star"), False), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(members.select("component", "component").distinct())
