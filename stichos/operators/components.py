"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: links of each node move to its least neighbour."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    met = near.join(least, "a")
    if large:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.filter("a <> b").distinct()


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link; a component is named by its least node.

    Large-star and small-star steps in turn until nothing moves: a number of rounds that grows with the logarithm of the
    longest chain, each with sums before shuffles, so that a node with very many links is no hot group.  Each round is
    checkpointed.  Links with a null end and links of a node to itself are left out; repeated links count once.
    """
    now = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b").distinct())
    mark = None
    while True:
        now = cut(_star(_star(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
