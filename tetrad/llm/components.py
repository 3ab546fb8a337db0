"""Connected components by alternating large and small stars (Kiveris and others, 2014), on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its neighbours v as m. Only minima are gathered, so a hub is one row of the sum."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the links (u long, v long): component is the least node reachable.

    Self links and repeated links are allowed, nulls are not; no links give no rows. Rounds grow with the logarithm of the
    longest chain, each cut off by a checkpoint.
    """
    edges = checkpointed(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    before = None
    for _ in range(most_rounds):
        state = _state(edges)
        if state == before or not state[0]:
            break
        before = state
        both = edges.union(edges.select("v", "u"))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpointed(large)
        small = _star(large)
        edges = checkpointed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("least")), "node", "left").select("node", F.coalesce("least", "node").alias("component"))
