"""Operators on sample series ``(track_id, stem, ch, i, v)`` and spectrogram bins ``(…, ch, f, t, re, im)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.core.common import explode_range, require

EPS = 1e-10
# Self-inverse variants of a stereo signal (swap channels, flip polarity).
TTA = ("identity", "swap", "flip", "swap_flip")


def align_min_length(df: DataFrame, group: tuple[str, ...] = ("track_id",), series: str = "stem", index: str = "i") -> DataFrame:
    """Cut every series of a group to the shortest one."""
    n = df.groupBy(*group, series).agg((F.max(index) + 1).alias("_n")).groupBy(*group).agg(F.min("_n").alias("_n"))
    return df.join(n, list(group)).filter(F.col(index) < F.col("_n")).drop("_n")


def match_length(df: DataFrame, n: int, by: tuple[str, ...] = ("track_id", "stem"), index: str = "i", value: str = "v") -> DataFrame:
    """Truncate or zero-pad each series to n samples. Only the missing tail is generated."""
    have = df.groupBy(*by).agg((F.max(index) + 1).alias("_n"))
    pad = explode_range(have.filter(F.col("_n") < n), F.lit(n), index, start=F.col("_n"))
    cols = [*by, index, value]
    return df.filter(F.col(index) < n).select(*cols).unionByName(pad.select(*by, index, F.lit(0.0).alias(value)))


def to_stereo(df: DataFrame, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Mono is doubled, channels past the first two are dropped."""
    n = df.groupBy(*by).agg(F.max("ch").alias("_top"))
    two = df.join(n, list(by)).filter("ch < 2")
    chans = F.when(F.col("_top") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("ch").cast("int")))
    return two.withColumn("ch", F.explode(chans)).drop("_top")


def downmix(df: DataFrame, by: tuple[str, ...] = ("track_id", "i")) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("v").alias("v"))


def head_seconds(df: DataFrame, seconds: float, sr: int, index: str = "i") -> DataFrame:
    return df.filter(F.col(index) < int(seconds * sr))


def equal_lengths(df: DataFrame, case: str = "track_id", series: str = "stem") -> DataFrame:
    """Cases whose series differ in length: (case, min_n, max_n)."""
    n = df.groupBy(case, series).agg(F.count("*").alias("n"))
    return n.groupBy(case).agg(F.min("n").alias("min_n"), F.max("n").alias("max_n")).filter("min_n <> max_n")


def baseline_estimates(mix: DataFrame, kind: str, stems: tuple[str, ...]) -> DataFrame:
    """Anchors: 'silence' estimates zero, 'mixture' passes the mixture through as every stem."""
    if kind not in ("silence", "mixture"):
        raise ValueError(f"unknown baseline {kind!r}")
    e = mix.withColumn("stem", F.explode(F.array(*[F.lit(s) for s in stems])))
    return e.withColumn("v", F.lit(0.0)) if kind == "silence" else e


def tta_transform(df: DataFrame, name: Column | str) -> DataFrame:
    """Apply a variant; applying it twice restores the input."""
    n = F.lit(name) if isinstance(name, str) else name
    swap, flip = n.isin("swap", "swap_flip"), n.isin("flip", "swap_flip")
    return df.withColumn("ch", F.when(swap, 1 - F.col("ch")).otherwise(F.col("ch"))).withColumn(
        "v", F.when(flip, -F.col("v")).otherwise(F.col("v")))


def tta_average(outputs: DataFrame, by: tuple[str, ...] = ("track_id", "stem", "ch", "i")) -> DataFrame:
    """Undo each row's ``variant`` and average."""
    return tta_transform(outputs, F.col("variant")).groupBy(*by).agg(F.avg("v").alias("v"))


def ensemble(outputs: DataFrame, weights: DataFrame | None = None, by: tuple[str, ...] = ("track_id", "stem", "i")) -> DataFrame:
    """Weighted mean over models, after cutting to the shortest output; weights per model or per model and stem."""
    o = align_min_length(outputs, ("track_id",), "model")
    if weights is None:
        o = o.withColumn("w", F.lit(1.0))
    else:
        o = o.join(weights, [c for c in ("model", "stem") if c in weights.columns], "left").na.fill(1.0, ["w"])
    return o.groupBy(*by).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def _magnitude() -> Column:
    return F.hypot("re", "im")


def _with_mix(bins: DataFrame, mix: DataFrame, key: list[str]) -> DataFrame:
    return bins.join(mix.select(*key, F.col("re").alias("mix_re"), F.col("im").alias("mix_im")), key)


def ratio_mask(bins: DataFrame, mix: DataFrame, alpha: float = 2.0) -> DataFrame:
    """Every stem receives its share of the magnitudes, applied to the mixture's bin."""
    key = ["track_id", "ch", "f", "t"]
    b = bins.withColumn("_m", F.pow(_magnitude(), F.lit(alpha)))
    total = F.sum("_m").over(W.partitionBy(*key))               # a bin has one row per stem
    b = b.withColumn("mask", F.col("_m") / (total + EPS))
    return _with_mix(b, mix, key).select(*key, "stem", "mask", (F.col("mask") * F.col("mix_re")).alias("re"),
                                         (F.col("mask") * F.col("mix_im")).alias("im"))


def binary_mask(bins: DataFrame, mix: DataFrame, stems: tuple[str, ...]) -> DataFrame:
    """The loudest stem takes the whole bin; the first stem in order wins ties."""
    key = ["track_id", "ch", "f", "t"]
    order = F.array_position(F.lit(list(stems)), F.col("stem"))
    won = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_m"), "_o")) == 1
    b = bins.withColumn("_m", _magnitude()).withColumn("_o", order).withColumn("mask", won.cast("int"))
    return _with_mix(b, mix, key).select(*key, "stem", "mask", (F.col("mask") * F.col("mix_re")).alias("re"),
                                         (F.col("mask") * F.col("mix_im")).alias("im"))


def phase_swap(bins: DataFrame, mix: DataFrame) -> DataFrame:
    """Keep each stem's magnitude, take the mixture's phase."""
    key = ["track_id", "ch", "f", "t"]
    b = _with_mix(bins, mix, key).withColumn("_m", _magnitude()).withColumn("_p", F.atan2("mix_im", "mix_re"))
    return b.select(*key, "stem", (F.col("_m") * F.cos("_p")).alias("re"), (F.col("_m") * F.sin("_p")).alias("im"))


def loss_share(base: Column, phase: Column, mask: Column) -> Column:
    """Percent of the total loss that replacing the phase alone explains; NULL without any loss."""
    return F.try_divide(phase - base, mask - base) * 100


def chunk(df: DataFrame, seg: int, overlap: float, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Copy samples into overlapping chunks: adds (k, j), chunk number and offset inside it."""
    hop = max(1, int(seg * (1 - overlap)))
    n = df.groupBy(*by).agg((F.max("i") + 1).alias("_n"))
    # The last chunk is the first one reaching the end; a one-sample rest is not started.
    last = F.when(F.col("_n") <= seg, F.lit(0)).otherwise(F.least(
        F.ceil((F.col("_n") - seg) / F.lit(float(hop))), F.floor((F.col("_n") - 2) / F.lit(float(hop)))))
    first_k = F.greatest(F.lit(0), F.ceil((F.col("i") - (seg - 1)) / F.lit(float(hop)))).cast("long")
    last_k = F.least(F.floor(F.col("i") / F.lit(float(hop))), last).cast("long")
    c = df.join(n, list(by)).withColumn("_a", first_k).withColumn("_b", last_k).filter("_a <= _b")
    return c.withColumn("k", F.explode(F.sequence("_a", "_b"))).withColumn("j", F.col("i") - F.col("k") * hop).drop("_a", "_b").withColumnRenamed("_n", "n")


def fade(j: Column, seg: int, overlap: float) -> Column:
    """Weight of offset j: linear in over the first half overlap, linear out over the last."""
    ramp = int(seg * overlap / 2) or 1
    rise = (j / F.lit(float(max(ramp - 1, 1)))) if ramp > 1 else F.lit(0.0)
    back = j - (seg - ramp)
    fall = (1 - back / F.lit(float(max(ramp - 1, 1)))) if ramp > 1 else F.lit(1.0)
    return F.when(back >= 0, fall).when(j < ramp, rise).otherwise(F.lit(1.0))


def overlap_add(chunks: DataFrame, seg: int, overlap: float, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Merge (k, j, n, v) back to one value per sample: sum(w v) / max(sum w, 1e-8)."""
    w = F.when(F.col("n") <= seg, F.lit(1.0)).otherwise(fade(F.col("j"), seg, overlap))
    c = chunks.withColumn("_w", w)
    return c.groupBy(*by, "i").agg((F.sum(F.col("_w") * F.col("v")) / F.greatest(F.sum("_w"), F.lit(1e-8))).alias("v"))


def envelope(df: DataFrame, n: int, mode: str = "peak", by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Shrink a series to n buckets. 'peak' is max |v| over whole steps; 'range' is min and max through zero."""
    size = df.groupBy(*by).agg((F.max("i") + 1).alias("_n"))
    d = df.join(size, list(by))
    if mode == "range":
        x = F.expr(f"cast(((i + 1) * {n} + _n - 1) div _n - 1 as int)")
        return d.groupBy(*by, x.alias("x")).agg(F.least(F.min("v"), F.lit(0.0)).alias("lo"), F.greatest(F.max("v"), F.lit(0.0)).alias("hi"))
    step = F.greatest(F.expr(f"_n div {n}"), F.lit(1))
    peaks = d.withColumn("x", F.floor(F.col("i") / step).cast("int")).filter(F.col("x") < n).groupBy(*by, "x").agg(F.max(F.abs("v")).alias("peak"))
    short = explode_range(size.filter(F.col("_n") < n), F.lit(n), "x", start=F.col("_n"))
    return peaks.unionByName(short.select(*by, F.col("x").cast("int").alias("x"), F.lit(0.0).alias("peak")))


def stem_levels(df: DataFrame, by: tuple[str, ...] = ("track_id", "stem")) -> DataFrame:
    """RMS level in dB relative to full scale."""
    return df.groupBy(*by).agg((20 * F.log10(F.sqrt(F.avg(F.col("v") * F.col("v"))) + 1e-12)).alias("rms_db"))


def peak_normalise(df: DataFrame, peak: float = 0.99, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    m = df.groupBy(*by).agg(F.max(F.abs("v")).alias("_m"))
    scaled = F.when(F.col("_m") == 0, F.col("v")).otherwise(F.col("v") * (F.lit(peak) / F.col("_m")))
    return df.join(m, list(by)).withColumn("v", scaled).drop("_m")


def sum_error(mix: DataFrame, stems: DataFrame, by: tuple[str, ...] = ("track_id",), index: tuple[str, ...] = ("i",)) -> DataFrame:
    """max |mixture - sum of stems| over the common samples."""
    total = stems.groupBy(*by, *index).agg(F.sum("v").alias("_s"))
    return mix.join(total, [*by, *index]).groupBy(*by).agg(F.max(F.abs(F.col("v") - F.col("_s"))).alias("max_error"))


def zscore_stats(df: DataFrame, by: tuple[str, ...] = ("track_id",), mode: str = "mixture") -> DataFrame:
    """'mixture': sample std; 'clip': sqrt(population variance + 1e-7)."""
    std = F.stddev_samp("v") if mode == "mixture" else F.sqrt(F.var_pop("v") + 1e-7)
    return df.groupBy(*by).agg(F.avg("v").alias("mean"), F.coalesce(std, F.lit(0.0)).alias("std"))


def group_zscore(df: DataFrame, stats: DataFrame, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Standardise per group; a silent group (std < 1e-8) becomes zeros."""
    z = F.when(F.col("std") < 1e-8, F.lit(0.0)).otherwise(F.try_divide(F.col("v") - F.col("mean"), F.col("std")))
    return df.join(stats, list(by)).withColumn("v", z).drop("mean", "std")


def restore(df: DataFrame, stats: DataFrame, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    back = F.when(F.col("std") < 1e-8, F.lit(0.0)).otherwise(F.col("v") * F.col("std") + F.col("mean"))
    return df.join(stats, list(by)).withColumn("v", back).drop("mean", "std")


def use_segments(frames: DataFrame, n_segments: int, segments: tuple[int, ...], by: tuple[str, ...] = ("track_id",), length: int | None = None) -> DataFrame:
    """Frames of the requested segments, renumbered in the requested order.

    The frame count of a track must divide. With ``length``, tracks have that many frames by contract, and one that ends early
    lacks frames of its last segments.
    """
    bad = [s for s in segments if not 0 <= s < n_segments]
    if n_segments <= 1 or bad:
        raise ValueError(f"segment numbers out of range: {bad or n_segments}")
    if length is not None:
        if length % n_segments:
            raise ValueError(f"{length} frames do not divide into {n_segments} segments")
        f = frames.withColumn("_t", F.lit(length))
    else:
        size = frames.groupBy(*by).agg((F.max("frame") + 1).alias("_t"))
        f = frames.join(size, list(by))
        f = require(f, F.col("_t") % n_segments == 0, F.concat(F.col("_t").cast("string"), F.lit(f" frames do not divide into {n_segments} segments")))
    per = F.expr(f"_t div {n_segments}")
    where = F.array_position(F.lit(list(segments)), F.floor(F.col("frame") / per).cast("int"))
    f = f.withColumn("_w", where).filter("_w > 0")
    return f.withColumn("frame", ((F.col("_w") - 1) * per + F.col("frame") % per).cast("int")).drop("_t", "_w")
