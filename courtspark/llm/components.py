"""Connected components by alternating stars, as plain joins and minimum aggregates.

Each round points every node at the smallest node it knows. No neighbour list is ever collected,
hubs are combined before the shuffle, and every round is a written table, so a lost executor costs
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import stage


def _minimum(edges: DataFrame) -> DataFrame:
    """u and the smallest of u and its neighbours v."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` has columns u and v of one orderable type. Gives node, component (the smallest
    node reachable) for every node that occurs in a link. Links to oneself, repeated and null
    links do no harm; an empty table gives an empty table."""
    edges = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(edges, "edges")
    before = _state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minimum(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = _minimum(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
