"""Connected components of an edge list, by alternating large-star and small-star rounds.

Each round is a few joins and min-aggregates over the edges (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014); edges are checkpointed to the shared folder in each
round, and only their number and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrack.llm.storage import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) pairs of one ordered type -> (node, component = smallest node reachable), for nodes with an edge.

    An empty edge list has no components; self-loops are ignored (a node that has nothing else
    has no row); pairs may repeat and have any order.
    """
    now = checkpointed(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        now = checkpointed(_star(_star(now, True), False))
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
