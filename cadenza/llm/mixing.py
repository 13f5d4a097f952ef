"""Mixing sources to target weights in a tree, with DataFrame functions only.

Leaves are the distinct values of the level columns (domain, language, source, ...). A node can hold as many tokens as
its documents have, times ``epochs``. The budget flows down level by level: children share their parent's tokens by
weight, a child that cannot hold its share is filled, and its shortage is shared among its siblings by weight. Since a
parent's capacity is the sum of its leaves', only what a whole subtree cannot hold is offered to its ancestors'
other children. Shares are whole tokens: floors by weight, and the remainder one by one in name order.

A leaf with more tokens than its documents takes whole epochs first. Of the last one it takes a prefix: documents in the
order of a seeded digest while the running total fits. The prefix is found from totals of digest ranges, so only the
documents of the one range that holds the cut are ever sorted; a leaf with a third of all rows is no different.

Null level values form leaves of their own. Documents without tokens are never taken. Repeated rows with one id go
together. A node without a weight counts 1; with weight 0 it takes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.core.common import lookup, md5_int
from cadenza.core.session import materialise

RANGE_ROWS = 1_000          # documents of a digest range
MAX_RANGES = 10_000
D = "decimal(38,0)"


def level_path(levels: Sequence[str | Column]) -> Column:
    """Unambiguous name of a node; null values have a name that no value has."""
    cols = [F.col(x) if isinstance(x, str) else x for x in levels]
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?")) for c in cols))


def node_name(path: Sequence[str | None]) -> str:
    return "\x1f".join("?" if p is None else f"={p}" for p in path)


def share(children: DataFrame) -> DataFrame:
    """children(parent, node, weight, cap, budget of the parent) -> node, tokens."""
    by_fill = Window.partitionBy("parent").orderBy(F.expr("cap / weight"), "node")
    c = children.filter("weight > 0 AND cap > 0").select(
        "*", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(D).alias("before"),
        F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)).cast(D).alias("open"))
    c = c.withColumn("full", F.expr("cap * open <= weight * (budget - before)"))
    own = Window.partitionBy("parent")
    c = c.withColumns({"left": (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(own), F.lit(0))).cast(D),
                       "sum": F.sum(F.when(~F.col("full"), F.col("weight"))).over(own).cast(D)})
    c = c.withColumn("floor", F.expr(f"CASE WHEN full THEN cap ELSE cast((weight * left) div sum as {D}) END"))
    rank = F.row_number().over(Window.partitionBy("parent", "full").orderBy("node"))
    rest = F.col("left") - F.sum(F.when(~F.col("full"), F.col("floor"))).over(own)
    return c.select("node", (F.col("floor") + F.when(~F.col("full") & (rank <= rest), 1).otherwise(0)).cast("long").alias("tokens"))


def allocate(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int], budget: DataFrame, epochs: int) -> DataFrame:
    """leaves(levels, total) and budget(budget, one row) -> leaf, total, tokens."""
    spark = leaves.sparkSession
    caps = leaves.withColumn("cap", (F.col("total") * epochs).cast(D))
    given = [(node_name(k), int(v)) for k, v in weights.items()]
    table = spark.createDataFrame(given, "node string, weight long") if given else spark.createDataFrame([], "node string, weight long")
    parents = caps.agg(F.sum("cap").cast(D).alias("cap")).join(budget).select(
        F.lit("").alias("parent"), F.least(F.col("budget").cast(D), F.col("cap")).alias("budget"))
    for k in range(1, len(levels) + 1):
        parent = level_path(levels[:k - 1]) if k > 1 else F.lit("")
        nodes = caps.groupBy(parent.alias("parent"), level_path(levels[:k]).alias("node")).agg(F.sum("cap").cast(D).alias("cap"))
        nodes = nodes.join(lookup(table, len(given)), "node", "left").withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")).cast(D))
        parents = materialise(share(nodes.join(parents, "parent")).select(F.col("node").alias("parent"), F.col("tokens").cast(D).alias("budget")), "budget")
    return leaves.select(level_path(levels).alias("leaf"), "total", "docs").join(
        parents.select(F.col("parent").alias("leaf"), F.col("budget").cast("long").alias("tokens")), "leaf").filter("tokens > 0")


def mix(docs: DataFrame, levels: Mapping[str, Column], tokens: Column, weights: Mapping[tuple, int], seed: int, epochs: int = 1,
        budget_tokens: int | None = None, budget_share: tuple[int, int] = (1, 1), id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs``, each as often as it is taken, with _epoch and _tokens added.

    The budget is ``budget_tokens``, or the share (numerator, denominator) of all tokens.
    """
    names = list(levels)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    narrow = docs.select(*(c.cast("string").alias(n) for n, c in levels.items()), key.alias("key"), tokens.cast("long").alias("n")).filter("n > 0")
    rows = materialise(narrow, "lengths")
    leaves = materialise(rows.groupBy(*names).agg(F.sum("n").alias("total"), F.count("*").alias("docs")), "leaves")
    share_, of = budget_share
    budget = leaves.agg((F.lit(budget_tokens) if budget_tokens is not None else F.expr(f"coalesce(sum(total), 0) * {share_} div {of}")).alias("budget"))
    plan = allocate(leaves, names, weights, budget, epochs).withColumns({
        "whole": F.expr("tokens div total"), "rest": F.expr("tokens % total"),
        "ranges": F.least(F.lit(MAX_RANGES), F.ceil(F.col("docs") / RANGE_ROWS)).cast("long")})
    plan = materialise(plan, "plan")
    plan = lookup(plan, plan.count())

    # Where the prefix of the last epoch ends in each leaf.
    drawn = rows.select(level_path(names).alias("leaf"), "key", "n").join(plan, "leaf").filter("rest > 0")
    drawn = drawn.withColumn("h", md5_int(F.lit(str(seed)), F.col("whole"), F.col("key")))
    drawn = drawn.withColumn("range", F.expr("h * ranges div 4294967296"))
    totals = drawn.groupBy("leaf", "range").agg(F.sum("n").alias("in_range"), F.max("rest").alias("rest"))
    before = F.coalesce(F.sum("in_range").over(Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = totals.withColumn("before", before).filter("before <= rest AND before + in_range > rest").select("leaf", "range", "before")
    cuts = materialise(cuts, "cuts")                    # one row per leaf
    near = drawn.join(lookup(cuts, cuts.count()), ["leaf", "range"]).groupBy("leaf", "before", "rest", "range", "h", "key").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy("leaf").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0))
    last = near.withColumn("upto", F.col("before") + running).filter("upto <= rest").groupBy("leaf").agg(F.max(F.struct("h", "key")).alias("last"))
    ends = cuts.select("leaf", "range").join(last, "leaf", "left")
    ends = plan.join(ends, "leaf", "left").select(F.col("leaf").alias("_leaf"), F.struct("whole", "rest", "ranges", "range", "last").alias("_mix"))
    ends = materialise(ends, "ends")

    taken = docs.withColumns({"_leaf": level_path([c.cast("string") for c in levels.values()]), "_tokens": tokens.cast("long"), "_key": key})
    taken = taken.filter("_tokens > 0").join(lookup(ends, ends.count()), "_leaf")
    whole, rest = F.col("_mix.whole"), F.col("_mix.rest")
    taken = taken.withColumn("_h", md5_int(F.lit(str(seed)), whole, F.col("_key")))
    in_range = F.expr("_h * _mix.ranges div 4294967296")
    at_cut = F.coalesce(F.struct(F.col("_h").alias("h"), F.col("_key").alias("key")) <= F.col("_mix.last"), F.lit(False))
    partly = (rest > 0) & ((in_range < F.col("_mix.range")) | at_cut)
    zero = F.lit(0).cast("long")
    epochs_taken = F.when(partly, F.sequence(zero, whole)).when(whole > 0, F.sequence(zero, whole - 1))
    return taken.withColumn("_epoch", F.explode(epochs_taken)).select(*docs.columns, "_epoch", "_tokens")


WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))
