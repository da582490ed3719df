"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import forget, write_and_reread


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges of u > v, which it keeps so: neighbours of a node, in a small round the lesser ones, move to the least of them."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that a hub's neighbours meet their minimum in a join that Spark can split
    least = write_and_reread(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    met = both.join(least, "u")
    if large:
        # not distinct yet: the small round that follows takes the minimum and drops what repeats
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of every node in links(u, v)."""
    edges = write_and_reread(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    digest = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    seen = digest(edges)
    while True:
        before, edges = edges, write_and_reread(_star(_star(edges, True), False), "edges")
        forget(before)
        state = digest(edges)
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        seen = state
