"""Separation metrics over sample pairs ``(track_id, stem, i, ref, est)`` and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import finite, finite_or_null, require_columns
from cadenza.core.ordered import Ordered, quantiles

NAN, INF = float("nan"), float("inf")
# The four stems in evaluation order and the constant of the global SDR definition.
STEMS = ("vocals", "drums", "bass", "other")
SDR_DELTA = 1e-7
# Sums of the same values taken in another order differ in their last digits; such values still tie with a threshold.
TIE = 1e-11


def sdr(signal: Column, noise: Column) -> Column:
    return 10 * F.log10((signal + SDR_DELTA) / (noise + SDR_DELTA))


def global_sdr(pairs: DataFrame, by: tuple[str, ...] = ("track_id", "stem")) -> DataFrame:
    """One SDR per group over all samples and channels; partial sums before the shuffle."""
    r, e = F.col("ref"), F.col("est")
    s = pairs.groupBy(*by).agg(F.sum(r * r).alias("_s"), F.sum((r - e) * (r - e)).alias("_n"))
    return s.select(*by, sdr(F.col("_s"), F.col("_n")).alias("usdr"))


def si_sdr(pairs: DataFrame, by: tuple[str, ...] = ("track_id", "stem"), zero_mean: bool = True) -> DataFrame:
    """Scale-invariant SDR from centred second moments.

    Silent reference gives NaN, silent estimate -inf, a scaled copy +inf.
    """
    p = pairs
    if zero_mean:
        means = pairs.groupBy(*by).agg(F.avg("ref").alias("_mr"), F.avg("est").alias("_me"))
        p = pairs.join(means, list(by)).withColumn("ref", F.col("ref") - F.col("_mr")).withColumn("est", F.col("est") - F.col("_me"))
    m = p.groupBy(*by).agg(F.sum(F.col("ref") * F.col("ref")).alias("rr"), F.sum(F.col("est") * F.col("est")).alias("ee"),
                           F.sum(F.col("ref") * F.col("est")).alias("re"))
    rr, ee, re = F.col("rr"), F.col("ee"), F.col("re")
    target = re * F.try_divide(re, rr)
    rest = ee - target
    noise = F.when(rest <= ee * 1e-14, 0.0).otherwise(rest)
    value = (F.when(rr == 0, F.lit(NAN))
             .when(noise == 0, F.when(target > 0, F.lit(INF)).otherwise(F.lit(-INF)))
             .when(target == 0, F.lit(-INF)).otherwise(10 * F.log10(target / noise)))
    return m.select(*by, value.alias("si_sdr"))


def block_sdr(pairs: DataFrame, samples_per_block: int, by: tuple[str, ...] = ("track_id", "stem")) -> DataFrame:
    """SDR of every block of consecutive samples."""
    b = pairs.withColumn("block", F.floor(F.col("i") / samples_per_block))
    return global_sdr(b, (*by, "block")).withColumnRenamed("usdr", "value")


def block_median(blocks: DataFrame, by: tuple[str, ...] = ("track_id", "stem")) -> DataFrame:
    """Track metric: median over blocks, NaN blocks ignored, NaN when no block is left."""
    med = quantiles(blocks, list(by), "value", {"value": 0.5})
    groups = blocks.select(*by).distinct()
    return groups.join(med, list(by), "left").withColumn("value", F.coalesce("value", F.lit(NAN)))


def track_mean(metrics: DataFrame, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Arithmetic mean over the finite stem values of a track."""
    return metrics.groupBy(*by).agg(F.coalesce(F.avg(finite_or_null(F.col("value"))), F.lit(NAN)).alias("mean"))


def aggregate_metrics(metrics: DataFrame, agg: str = "median") -> DataFrame:
    """Across tracks per metric and stem; the row 'mean' is the plain mean of the stem values."""
    ok = metrics.filter(finite(F.col("value")))
    keys = ["metric", "stem"]
    if agg == "median":
        per = quantiles(ok, keys, "value", {"value": 0.5})
    else:
        per = ok.groupBy(*keys).agg(F.avg("value").alias("value"))
    mean = per.groupBy("metric").agg(F.avg("value").alias("value")).select("metric", F.lit("mean").alias("stem"), "value")
    return per.unionByName(mean)


def per_stem_matrix(metrics: DataFrame, stems: tuple[str, ...] = STEMS, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """One row per track, one column per stem; a missing stem is NaN."""
    m = metrics.groupBy(*by).pivot("stem", list(stems)).agg(F.first("value"))
    return m.select(*by, *[F.coalesce(F.col(s), F.lit(NAN)).alias(s) for s in stems])


def missing_stems(ref: DataFrame, est: DataFrame) -> DataFrame:
    """(track_id, stem) with a reference but no estimate."""
    key = ["track_id", "stem"]
    return ref.select(*key).distinct().join(est.select(*key).distinct(), key, "left_anti")


def assert_stems(ref: DataFrame, est: DataFrame) -> None:
    bad = missing_stems(ref, est).orderBy("track_id", "stem").limit(5).collect()
    if bad:
        raise KeyError(f"estimates lack stems: {[tuple(r) for r in bad]}")


def rtf_summary(times: DataFrame) -> DataFrame:
    """(rtf_median, total_audio, speedup): the upper median of seconds / audio_seconds.

    Rows without audio count for the total only.
    """
    require_columns(times, ["seconds", "audio_seconds"])
    r = times.filter(F.col("audio_seconds") != 0).groupBy((F.col("seconds") / F.col("audio_seconds")).alias("rtf")).agg(F.count("*").alias("n"))
    total = times.agg(F.sum("audio_seconds").alias("a"), F.count_if(F.col("audio_seconds") != 0).alias("n")).first()
    ranked = Ordered(r, [], ["rtf"]).add(cum=("sum", F.col("n"))).result()
    mid = ranked.filter(F.col("cum") > (total["n"] // 2)).agg(F.min("rtf").alias("rtf"))
    return mid.select(F.coalesce("rtf", F.lit(NAN)).alias("rtf_median"), F.lit(float(total["a"] or 0.0)).alias("total_audio"),
                      F.coalesce(F.try_divide(F.lit(1.0), F.col("rtf")), F.lit(NAN)).alias("speedup"))


def timing_stats(runs: DataFrame, warmup: int = 1) -> DataFrame:
    """Per label, warm-up runs dropped: median, mean, population std, min, RTF and speed-up."""
    kept = runs.filter(F.col("run") > warmup)
    s = kept.groupBy("label").agg(F.avg("seconds").alias("mean_s"), F.stddev_pop("seconds").alias("std_s"), F.min("seconds").alias("min_s"),
                                  F.count("*").alias("n_runs"), F.max("audio_seconds").alias("audio_seconds"))
    out = s.join(quantiles(kept, ["label"], "seconds", {"median_s": 0.5}), "label")
    audio = F.when(F.col("audio_seconds") > 0, F.col("audio_seconds"))
    return out.select("label", "median_s", "mean_s", "std_s", "min_s", "n_runs", (F.col("median_s") / audio).alias("rtf"),
                      F.try_divide(audio, F.col("median_s")).alias("speedup"))


# ---------------------------------------------------------------- case diagnosis

def worst_best(df: DataFrame, value: str, worst: int = 5, best: int = 2, key: str = "track_id") -> DataFrame:
    low = df.orderBy(value, key).limit(worst).withColumn("pick", F.lit("worst"))
    high = df.orderBy(F.desc(value), F.desc(key)).limit(best).withColumn("pick", F.lit("best"))
    return low.unionByName(high)


def diagnose_case(cases: DataFrame, quiet_db: float = 6.0, fail_below: float = 5.0) -> DataFrame:
    """quiet: the stem is far softer than usual; failure: a real miss; ok otherwise."""
    med = quantiles(cases, ["stem"], "energy_db", {"energy_median_db": 0.5})
    quiet = F.col("energy_db") < F.col("energy_median_db") - quiet_db
    return cases.join(med, "stem").withColumn("diagnosis", F.when(quiet, "quiet").when(F.col("csdr") < fail_below, "failure").otherwise("ok"))


def true_failures(cases: DataFrame) -> DataFrame:
    """Lowest-quartile metric although the stem is at least as loud as the median; with r(energy, metric).

    A value that differs from a threshold by less than ``TIE``, relative to it, lies on it.
    """
    q = quantiles(cases, ["stem"], "csdr", {"csdr_q25": 0.25})
    e = quantiles(cases, ["stem"], "energy_db", {"energy_median_db": 0.5})
    r = cases.groupBy("stem").agg(F.corr("energy_db", "csdr").alias("pearson_r"))
    c = cases.join(q, "stem").join(e, "stem").join(r, "stem")
    slack = lambda x: F.greatest(F.abs(x), F.lit(1.0)) * TIE
    low, loud = F.col("csdr_q25"), F.col("energy_median_db")
    return c.filter((F.col("csdr") <= low + slack(low)) & (F.col("energy_db") >= loud - slack(loud)))
