"""Ordered work inside groups that may be arbitrarily large.

``Window.partitionBy(g).orderBy(o)`` puts a whole group into one task. ``Ordered``
keeps that plan while every group is small (the size is measured, not assumed) and
otherwise range-partitions on ``(group, order)``: a hot group then spans many slices.
Each slice is scanned on its own and receives what the slices before it carry over.
A slice continues at most one group, so the carried table has at most one row per slice
and is safe to broadcast.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cadenza.core.common import null_safe_join
from cadenza.core.session import group_rows, materialise

_FIRST, _CUR = Window.unboundedPreceding, Window.currentRow


def group_sizes(df: DataFrame, group: list[str]) -> tuple[int, int]:
    """(rows of the largest group, all rows), pre-aggregated before the shuffle."""
    if not group:
        n = df.count()
        return n, n
    row = df.groupBy(*group).count().agg(F.max("count"), F.sum("count")).first()
    return int(row[0] or 0), int(row[1] or 0)


class Ordered:
    """Rows of ``df`` grouped by ``group`` and ordered by ``order`` (a total order)."""

    def __init__(self, df: DataFrame, group: list[str], order: list, limit: int | None = None,
                 sizes_from: DataFrame | None = None):
        """``sizes_from`` may give group sizes more cheaply than ``df``; it must not be smaller."""
        spark = df.sparkSession
        self.group = list(group)
        self.order = [F.col(c) if isinstance(c, str) else c for c in order]
        limit = group_rows(spark) if limit is None else limit
        largest, total = group_sizes(df if sizes_from is None else sizes_from, self.group)
        self.sliced = largest > limit
        if self.sliced:
            slices = max(ceil(total / max(limit, 1)), int(spark.conf.get("spark.sql.shuffle.partitions")))
            laid = df.repartitionByRange(slices, *[F.col(g) for g in self.group], *self.order)
            df = materialise(laid.withColumn("_slice", F.spark_partition_id()), "ordered")
        self.df = df

    def _with(self, df: DataFrame) -> Ordered:
        out = object.__new__(Ordered)
        out.group, out.order, out.sliced, out.df = self.group, self.order, self.sliced, df
        return out

    def window(self) -> WindowSpec:
        keys = (["_slice"] if self.sliced else []) + self.group
        return Window.partitionBy(*(keys or [F.lit(1)])).orderBy(*self.order)

    def add(self, **ops: tuple[str, Column | None]) -> Ordered:
        """Add columns. Each op is ``(kind, expression)`` with kind one of

        ``row`` 1-based position; ``sum`` / ``sum_before`` running sum with or without the
        current row; ``max_before`` running maximum of earlier rows; ``lag`` / ``lead``
        neighbour; ``last`` / ``last_before`` latest non-null value; ``first_after``
        earliest non-null value of later rows.
        """
        w = self.window()
        upto, before = w.rowsBetween(_FIRST, _CUR), w.rowsBetween(_FIRST, -1)
        after = w.rowsBetween(1, Window.unboundedFollowing)
        local = {
            "row": lambda v: F.row_number().over(w).cast("long"),
            "sum": lambda v: F.sum(v).over(upto),
            "sum_before": lambda v: F.coalesce(F.sum(v).over(before), v * 0),
            "max_before": lambda v: F.max(v).over(before),
            "lag": lambda v: F.lag(v).over(w),
            "lead": lambda v: F.lead(v).over(w),
            "last": lambda v: F.last(v, ignorenulls=True).over(upto),
            "last_before": lambda v: F.last(v, ignorenulls=True).over(before),
            "first_after": lambda v: F.first(v, ignorenulls=True).over(after),
        }
        if not self.sliced:
            return self._with(self.df.select("*", *[local[k](v).alias(n) for n, (k, v) in ops.items()]))
        return self._with(self._add_sliced(local, ops, w))

    def _add_sliced(self, local, ops, w) -> DataFrame:
        values = {n: (F.lit(1).cast("long") if k == "row" else v) for n, (k, v) in ops.items()}
        keys = ["_slice", *self.group]
        posed = self.df.select("*", F.row_number().over(w).alias("_pos"),
                               *[v.alias(f"_v_{n}") for n, v in values.items()])
        per_slice = []
        for n, (k, _) in ops.items():
            v = F.col(f"_v_{n}")
            boxed = F.struct(v.alias("v"))
            per_slice.append({
                "row": F.sum(v), "sum": F.sum(v), "sum_before": F.sum(v), "max_before": F.max(v),
                "lag": F.max_by(boxed, "_pos"), "lead": F.min_by(boxed, "_pos"),
                "last": F.max_by(v, F.when(v.isNotNull(), F.col("_pos"))),
                "last_before": F.max_by(v, F.when(v.isNotNull(), F.col("_pos"))),
                "first_after": F.min_by(v, F.when(v.isNotNull(), F.col("_pos"))),
            }[k].alias(f"_c_{n}"))
        summary = posed.groupBy(*keys).agg(*per_slice)
        sw = Window.partitionBy(*(self.group or [F.lit(1)])).orderBy("_slice")
        earlier, later = sw.rowsBetween(_FIRST, -1), sw.rowsBetween(1, Window.unboundedFollowing)
        carries = []
        for n, (k, _) in ops.items():
            c = F.col(f"_c_{n}")
            carries.append({
                "row": F.sum(c).over(earlier), "sum": F.sum(c).over(earlier),
                "sum_before": F.sum(c).over(earlier), "max_before": F.max(c).over(earlier),
                "lag": F.lag(c).over(sw), "lead": F.lead(c).over(sw),
                "last": F.last(c, ignorenulls=True).over(earlier),
                "last_before": F.last(c, ignorenulls=True).over(earlier),
                "first_after": F.first(c, ignorenulls=True).over(later),
            }[k].alias(f"_k_{n}"))
        spans = F.count("*").over(Window.partitionBy(*(self.group or [F.lit(1)])))
        # Only groups spanning several slices are kept: at most two rows per slice.
        carry = summary.select(*keys, *carries, spans.alias("_spans")).filter("_spans > 1").drop("_spans")
        scanned = posed.select("*", *[local[k](F.col(f"_v_{n}")).alias(f"_l_{n}") for n, (k, _) in ops.items()])
        joined = null_safe_join(scanned, F.broadcast(carry), keys, "left")
        out = []
        for n, (k, _) in ops.items():
            mine, kept = F.col(f"_l_{n}"), F.col(f"_k_{n}")
            if k in ("row", "sum", "sum_before"):
                total = F.when(mine.isNull(), kept).otherwise(mine + F.coalesce(kept, mine * 0))
            elif k == "max_before":
                total = F.greatest(mine, kept)
            elif k in ("lag", "lead"):
                edge = F.col("_pos") == (F.lit(1) if k == "lag" else F.col("_end"))
                total = F.when(edge, kept["v"]).otherwise(mine)
            else:
                total = F.coalesce(mine, kept)
            out.append(total.alias(n))
        if any(k == "lead" for k, _ in ops.values()):
            joined = joined.withColumn("_end", F.max("_pos").over(Window.partitionBy(*keys)))
        return joined.select(*self.df.columns, *out)

    def result(self) -> DataFrame:
        return self.df.drop("_slice")


def quantiles(df: DataFrame, group: list[str], value: str, qs: dict[str, float],
              limit: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group; NULL and NaN values are ignored.

    Small groups use the built-in exact percentile. A hot group would keep all of its
    distinct values in one task there, so it is ranked in slices instead.
    """
    spark = df.sparkSession
    limit = group_rows(spark) if limit is None else limit
    v = F.col(value)
    rows = df.filter(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*group, v.cast("double").alias("_v"))
    if group_sizes(rows, group)[0] <= limit:
        return rows.groupBy(*group).agg(*[F.percentile("_v", F.lit(q)).alias(n) for n, q in qs.items()])
    counts = rows.groupBy(*group, "_v").agg(F.count("*").alias("_n"))
    ranked = Ordered(counts, group, ["_v"], limit).add(_cum=("sum", F.col("_n"))).result()
    if group:
        joined = null_safe_join(ranked, counts.groupBy(*group).agg(F.sum("_n").alias("_total")), group, "inner")
    else:
        joined = ranked.withColumn("_total", F.lit(rows.count()))
    aggs, outs = [], []
    for n, q in qs.items():
        at = (F.col("_total") - 1) * F.lit(float(q))
        aggs.append(F.min(F.when(F.col("_cum") > F.floor(at), F.col("_v"))).alias(f"_lo_{n}"))
        aggs.append(F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_v"))).alias(f"_hi_{n}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_fr_{n}"))
        lo, hi, fr = F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), F.col(f"_fr_{n}")
        outs.append((lo + (hi - lo) * fr).alias(n))
    return joined.groupBy(*group).agg(*aggs).select(*group, *outs)


def median(df: DataFrame, group: list[str], value: str, name: str = "median", limit: int | None = None) -> DataFrame:
    return quantiles(df, group, value, {name: 0.5}, limit)


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark prunes to ``k`` rows per map task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
