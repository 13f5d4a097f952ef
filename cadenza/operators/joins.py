"""Interval, as-of, tolerance and ordinal joins. Time is part of the key, so a long track spreads over many tasks."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import explode_range, never_broadcast
from cadenza.core.ordered import Ordered

EPS = 1e-6


def interval_overlap(ref: DataFrame, est: DataFrame, by: tuple[str, ...] = ("track_id",), bucket: float = 60.0) -> DataFrame:
    """Intersections of two interval sets ``(start, end, label)``: start, end, duration, ref_label, est_label.

    Intervals are copied into the time buckets they touch and joined on (track, bucket);
    each overlap is reported only in the bucket where it begins.
    """
    def spread(d: DataFrame, p: str) -> DataFrame:
        named = d.select(*by, F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.col("label").alias(f"{p}_label"))
        cell = lambda c: F.floor(F.col(f"{p}_{c}") / bucket)
        return explode_range(named, cell("end") + 1, "_b", start=cell("start"))

    j = spread(ref, "ref").join(never_broadcast(spread(est, "est")), [*by, "_b"])
    lo, hi = F.greatest("ref_start", "est_start"), F.least("ref_end", "est_end")
    return j.filter((lo < hi) & (F.floor(lo / bucket) == F.col("_b"))).select(
        *by, lo.alias("start"), hi.alias("end"), (hi - lo).alias("duration"), "ref_label", "est_label")


def asof(points: DataFrame, timeline: DataFrame, value: str, by: tuple[str, ...] = ("track_id",), eps: float = EPS) -> DataFrame:
    """Latest ``timeline.value`` at or before each point's ``t`` (+ eps), and how many entries have passed."""
    cols = points.columns
    p = points.select(*cols, F.col("t").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(timeline.schema[value].dataType).alias("_v"))
    t = timeline.select(*[F.col(c) if c in by else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in cols],
                        (F.col("t") - eps).alias("_t"), F.lit(0).alias("_kind"), F.col(value).alias("_v"))
    tie = [c for c in cols if c not in (*by, "t")]
    o = Ordered(t.unionByName(p), list(by), ["_t", "_kind", "_v", *tie]).add(
        **{value: ("last", F.col("_v")), "n_passed": ("sum", F.lit(1) - F.col("_kind"))})
    return o.result().filter("_kind = 1").select(*cols, value, "n_passed")


def frames_to_beats(frames: DataFrame, beats: DataFrame, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Number each frame's piece between beats; the part before the first beat is a piece of its own if it has frames."""
    marked = asof(frames, beats.select(*by, "t", F.lit(1).alias("_beat")), "_beat", by, eps=0.0).drop("_beat")
    first = marked.groupBy(*by).agg(F.min("n_passed").alias("_first"))
    return marked.join(first, list(by)).withColumn("piece", F.col("n_passed") - F.least(F.col("_first"), F.lit(1))).drop("n_passed", "_first")


def match_within(ref: DataFrame, est: DataFrame, tolerance: float = 0.07, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """One-to-one pairs with |ref - est| <= tolerance, as many as possible: (by..., ref_t, est_t).

    Events farther apart than the tolerance cannot influence each other, so the merged
    timeline is cut there and the pieces are distributed. Inside a piece the earliest waiting
    event of the other kind is taken, which is optimal on a line; rows are streamed, so a
    piece of any length needs only the events waiting within the tolerance.
    """
    keys = list(by)
    u = ref.select(*keys, "t", F.lit(0).alias("kind")).unionByName(est.select(*keys, "t", F.lit(1).alias("kind")))
    o = Ordered(u, keys, ["t", "kind"]).add(_prev=("lag", F.col("t")))
    cut = (F.col("_prev").isNull() | (F.col("t") - F.col("_prev") > tolerance)).cast("int")
    pieces = o.add(piece=("sum", cut)).result().select(*keys, "piece", "t", "kind")
    laid = pieces.repartition(*keys, "piece").sortWithinPartitions(*keys, "piece", "t", "kind")
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "ref_t double", "est_t double"])

    def pairs(batches):
        here, waiting, kind_waiting = None, deque(), 0
        for pdf in batches:
            out = []
            for *key, piece, t, kind in zip(*(pdf[c].tolist() for c in [*keys, "piece", "t", "kind"])):
                if here != (key, piece):
                    here, waiting = (key, piece), deque()
                while waiting and t - waiting[0] > tolerance:
                    waiting.popleft()
                if waiting and kind_waiting != kind:
                    other = waiting.popleft()
                    out.append((*key, *((other, t) if kind else (t, other))))
                else:
                    waiting.append(t)
                    kind_waiting = kind
            yield pd.DataFrame(out, columns=[*keys, "ref_t", "est_t"])

    return laid.mapInPandas(pairs, schema)


def zip_by_ordinal(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("track_id",), names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Join ``(by, pos, t)`` rows position by position; the shorter side ends the result."""
    return a.select(*by, "pos", F.col("t").alias(names[0])).join(b.select(*by, "pos", F.col("t").alias(names[1])), [*by, "pos"])
