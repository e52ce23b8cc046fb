"""Connected components of an edge table of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stash


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and root, the smallest node of its component, for every node with an edge.

    Each round hangs the larger neighbours of a node, then the smaller ones, under its smallest
    neighbour; after a few rounds every component is one star. The minimum per node is
    aggregated before the shuffle and joined back, so a node with any number of edges is never
    gathered in one task. Rounds are written, so lost executors cost one round at most.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    pairs, before = stash(pairs, "edges"), None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        pairs = stash(small.where("u > v").distinct(), "edges")
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u")).first()
        # Stars only: every node hangs under one root, and nothing moved.
        if now == before:
            break
        before = now
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
