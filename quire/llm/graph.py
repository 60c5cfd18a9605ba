"""Connected components of a table of links, by rounds of joins; nothing of it comes to the driver but a count and a check sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _nearest(edges: DataFrame) -> DataFrame:
    """u, low: the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node in edges(u, v).

    Large-star and small-star rounds (Kiveris and others, 2014): links move to the smallest known neighbour until none moves.
    Loops are dropped; an empty table gives an empty one.
    """
    edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges, state = materialise(edges, "links"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _nearest(edges)
        large = both.join(low, "u").where("v > u").select(F.col("low").alias("u"), "v").where("u <> v").distinct()
        large = materialise(large, "large")
        least = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(least, "v").select(F.col("low").alias("a"), F.explode(F.array("u", "v")).alias("v")).where("a <> v").select(F.col("a").alias("u"), "v").distinct()
        edges = materialise(small, "small")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            break
        state = now
    stars = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.union(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
