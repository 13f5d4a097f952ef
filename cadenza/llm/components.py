"""Connected components of an edge table: alternating large-star and small-star rounds.

Every round is a grouped minimum and an equi-join, both of which Spark can split on a hot node, and its result is
written to the shared folder, so neither links nor components pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.session import materialise

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on its smallest neighbour: the larger ones (large), or the smaller ones and itself."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    met = near.join(low, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any orderable type -> node, component (the smallest node reachable). Nulls and loops are ignored."""
    now = materialise(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        now = materialise(_star(_star(now, True), False), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = seen
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
