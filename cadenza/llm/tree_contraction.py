"""Sums over the subtree of every node by parallel tree contraction, in rounds of joins.

A round has two steps. *Rake*: leaves leave the tree and their sums go to their parents, pre-aggregated, so a parent of a third of
all nodes costs no more than others. *Compress*: of the nodes that are left with one child, those go whose digest of the round
is below that of both neighbours. No two of them touch, so each is bridged by joining its child to its parent, and a third of a
long unary chain goes in one round. The new link carries what the bridged node held, and a rake takes it along. A tree of
n nodes needs about log(n) rounds, also where it is one chain.

Then the rounds are undone from the last to the first: a raked leaf knew its sum when it left, and a bridged node's sum is what
it and its link held when it left plus the sum of the child it had then, which left later. Every round's state is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import union_all
from cadenza.core.session import materialise


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """tree(node, parent, values...) -> node, values... summed over the node's subtree, itself included.

    ``node`` may have any type that can be ordered; a root's parent is null and there may be several roots. Every parent must be
    a node and the links must form no cycle.
    """
    kids = tree.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("_of")).agg(F.count("*").alias("kids"))
    state = tree.join(kids, F.col("node") == F.col("_of"), "left").select(
        "node", "parent", *values, *[(F.col(v) * 0).alias(f"up_{v}") for v in values], F.coalesce("kids", F.lit(0).cast("long")).alias("kids"))
    state = materialise(state, "tree")
    leaves, bridged = [], []
    while True:
        leaves.append(state.filter("kids = 0").select("node", *values))
        if state.filter("kids > 0").isEmpty():
            break
        gone = F.col("kids") == 0
        gains = state.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("_of")).agg(
            *[F.sum(F.when(gone, F.col(v) + F.col(f"up_{v}")).otherwise(F.col(v) * 0)).alias(f"_{v}") for v in values],
            *[F.sum(F.when(gone, F.col(v) * 0).otherwise(F.col(f"up_{v}"))).alias(f"below_{v}") for v in values],
            F.count(F.when(~gone, 1)).alias("_kids"), F.min(F.when(~gone, F.col("node"))).alias("child"))
        inner = state.filter("kids > 0").join(gains, F.col("node") == F.col("_of")).select(
            "node", "parent", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values], *[f"up_{v}" for v in values], *[f"below_{v}" for v in values],
            F.col("_kids").alias("kids"), "child")
        draw = lambda c: F.xxhash64(F.lit(len(leaves)), c)
        lower = (F.col("kids") == 1) & F.col("parent").isNotNull() & (draw("node") < draw("child")) & (draw("node") < draw("parent"))
        inner = materialise(inner.withColumn("bridge", F.coalesce(lower, F.lit(False))), "raked")
        bridged.append(inner.filter("bridge").select("node", "child", *[(F.col(v) + F.col(f"below_{v}")).alias(v) for v in values]))
        over = inner.filter("bridge").select(F.col("node").alias("_of"), F.col("parent").alias("_above"),
                                             *[(F.col(v) + F.col(f"up_{v}")).alias(f"_{v}") for v in values])
        state = inner.filter("NOT bridge").join(over, F.col("parent") == F.col("_of"), "left").select(
            "node", F.coalesce("_above", "parent").alias("parent"), *values,
            *[(F.col(f"up_{v}") + F.coalesce(F.col(f"_{v}"), F.col(v) * 0)).alias(f"up_{v}") for v in values], "kids")
        state = materialise(state, "tree")
    known = leaves[-1:]
    for out, chain in zip(leaves[-2::-1], bridged[::-1]):
        later = union_all(known).select(F.col("node").alias("_of"), *[F.col(v).alias(f"_{v}") for v in values])
        back = chain.join(later, F.col("child") == F.col("_of")).select("node", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])
        known += [out, materialise(back, "expanded")]
    return union_all(known)
