"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, class: for each end of a link the smallest node that it is linked with, near or far.

    Each round reconnects neighbours to the smallest one (two aggregations that combine on the map
    side, so a node of very many links costs its map tasks one row each) and ends in a few rounds
    that grow with the logarithm of the nodes. Links of a node with itself and repeated links are
    harmless; nulls make no link. State between rounds is in the checkpoint folder."""
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi IS NOT NULL AND lo IS NOT NULL AND hi <> lo AND hi > lo").distinct()
    edges = checkpointed(edges)
    mark = None
    while True:
        # Large star: each larger neighbour goes to the smallest of the neighbourhood.
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        nearest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(nearest, "u").filter("v > u AND v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array("lo", "hi")).alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("class")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("class"))).distinct()
        mark = now
        release(edges.sparkSession)
