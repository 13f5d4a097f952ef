"""Pooling, fusion and linear probes over frame vectors ``(track_id, …, frame, vec array<double>)``.

Vector means and maxima use spark.ml's Summarizer: it aggregates whole vectors map-side and
shuffles one vector per group and task instead of one row per component.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import require
from cadenza.core.session import materialise
from cadenza.operators import tagging
from cadenza.operators.probes import probe_scores

# Segment combinations of the ablation, by name.
COMBOS = {"s0": (0,), "s1": (1,), "s2": (2,), "s3": (3,), "s0+s1": (0, 1), "s1+s2": (1, 2), "s0+s3": (0, 3),
          "s0+s2": (0, 2), "all4": (0, 1, 2, 3)}
# Pairs in order of growing span.
SPAN_ORDER = ("s1+s2", "s0+s2", "s0+s3")


def _summary(df: DataFrame, by: tuple[str, ...], metric: str, weight: str | None = None) -> DataFrame:
    d = df.withColumn("_vec", array_to_vector("vec"))
    pick = {"mean": Summarizer.mean, "max": Summarizer.max}[metric]
    col = pick(F.col("_vec"), F.col(weight)) if weight else pick(F.col("_vec"))
    return d.groupBy(*by).agg(vector_to_array(col).alias("vec"))


def pool(frames: DataFrame, mode: str = "mean", by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    if mode not in ("mean", "max"):
        raise ValueError(f"unknown pooling {mode!r}")
    return _summary(frames, by, mode)


def stride_pool(frames: DataFrame, stride: int, by: tuple[str, ...] = ("track_id",), length: int | None = None) -> DataFrame:
    """Mean of every ``stride`` frames; an incomplete tail is dropped.

    With ``length``, tracks have that many frames by contract: their last ``length % stride`` frames are dropped, and a track that
    ends early keeps the frames it has.
    """
    if length is None:
        size = frames.groupBy(*by).agg((F.max("frame") + 1).alias("_t"))
        f = frames.join(size, list(by)).filter(F.col("frame") < F.expr(f"_t div {stride} * {stride}"))
    else:
        f = frames.filter(F.col("frame") < length // stride * stride)
    return _summary(f.withColumn("frame", F.floor(F.col("frame") / stride).cast("int")), (*by, "frame"), "mean")


def softmax_pool(frames: DataFrame, score: str = "score", mask: str | None = None, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Mean weighted by softmax of a frame score over the track; masked frames weigh nothing."""
    f = frames.filter(F.col(mask)) if mask else frames
    top = f.groupBy(*by).agg(F.max(score).alias("_top"))
    return _summary(f.join(top, list(by)).withColumn("_w", F.exp(F.col(score) - F.col("_top"))), by, "mean", "_w")


def masked_mean(frames: DataFrame, mask: str, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Mean of the valid frames; a track without any valid frame becomes zeros (divisor at least 1)."""
    some = _summary(frames.filter(F.col(mask)), by, "mean").withColumnRenamed("vec", "_m")
    zero = frames.groupBy(*by).agg(F.max(F.size("vec")).alias("_d"))
    return zero.join(some, list(by), "left").select(*by, F.coalesce("_m", F.expr("array_repeat(0.0D, _d)")).alias("vec"))


def segment_means(frames: DataFrame, n_segments: int, by: tuple[str, ...] = ("track_id",), length: int | None = None, strict: bool = True) -> DataFrame:
    """(…, segment, vec): mean of each equal segment; the frame count must divide.

    With ``length``, tracks have that many frames by contract, and one that ends early lacks its last segments or parts of them.
    If not ``strict``, frames that are left over after ``n_segments`` equal segments are dropped, and so are tracks with fewer frames than segments.
    """
    message = f"frames do not divide into {n_segments} segments"
    if length is not None:
        if length % n_segments:
            raise ValueError(message)
        f = frames.withColumn("segment", F.expr(f"cast(frame div {length // n_segments} as int)"))
        return _summary(f.filter(F.col("segment") < n_segments), (*by, "segment"), "mean")
    size = frames.groupBy(*by).agg((F.max("frame") + 1).alias("_t"))
    f = frames.join(size, list(by))
    f = require(f, F.col("_t") % n_segments == 0, message) if strict else f.filter(F.col("_t") >= n_segments)
    f = f.withColumn("segment", F.expr(f"cast(frame div (_t div {n_segments}) as int)"))
    return _summary(f.filter(F.col("segment") < n_segments), (*by, "segment"), "mean")


def combine_segments(means: DataFrame, combos: dict[str, tuple[int, ...]], by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """(combo, …, vec): mean over the segments of each combination."""
    names = F.filter(F.array(*[F.struct(F.lit(n).alias("combo"), F.lit(list(s)).alias("segs")) for n, s in combos.items()]),
                     lambda c: F.array_contains(c["segs"], F.col("segment")))
    m = means.withColumn("combo", F.explode(F.transform(names, lambda c: c["combo"])))
    return _summary(m, ("combo", *by), "mean")


def fuse(sources: DataFrame, mode: str, order: tuple[str, ...], logits: dict[str, float] | None = None,
         by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Combine one vector per source: 'concat' in the given order, 'sum' as plain mean, 'gate' by softmax weights."""
    s = sources.withColumn("_o", F.array_position(F.lit(list(order)), F.col("source"))).filter("_o > 0")
    if mode == "concat":
        rows = s.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_o", "vec"))).alias("p"))   # one entry per source
        return rows.select(*by, F.flatten(F.col("p.vec")).alias("vec"))
    if mode == "gate":
        w = F.create_map(*[x for k in order for x in (F.lit(k), F.lit(float((logits or {}).get(k, 0.0))))])
        return softmax_pool(s.withColumn("score", w[F.col("source")]), "score", by=by)
    if mode == "sum":
        return _summary(s, by, "mean")
    raise ValueError(f"unknown fusion {mode!r}")


# ---------------------------------------------------------------- linear probes

def probe(features: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """(key, map, roc_auc, n_valid) for each feature set; all sets and tags are fitted together."""
    scores = materialise(probe_scores(features, key, labels), "probe-scores")
    per = tagging.ranking(scores, (key, "tag"))
    ok = F.col("valid")
    return per.groupBy(key).agg(F.avg(F.when(ok, F.col("ap"))).alias("map"), F.avg(F.when(ok, F.col("auc"))).alias("roc_auc"),
                                F.count_if(ok).alias("n_valid"))


def layer_probe(layer_means: DataFrame, labels: DataFrame) -> DataFrame:
    """Validation mAP and AUC per layer with marks for the best, worst and last one."""
    r = materialise(probe(layer_means, "layer", labels), "layers")
    e = r.agg(F.max_by("layer", "map").alias("b"), F.min_by("layer", "map").alias("w"), F.max("map").alias("m"), F.max("layer").alias("l")).first()
    return r.withColumn("mark", F.concat_ws(",", F.when(F.col("layer") == e["b"], "best"), F.when(F.col("layer") == e["w"], "worst"),
                                            F.when(F.col("layer") == e["l"], "last"))).withColumn(
        "below_best_pct", (F.lit(e["m"]) - F.col("map")) / F.lit(e["m"]) * 100)


def segment_ablation(frames: DataFrame, labels: DataFrame, center: DataFrame | None = None, n_segments: int = 4, strict: bool = True) -> DataFrame:
    """Probe every segment combination (and the centre window): map, mean of its single parts and the gain over it.

    ``strict`` is that of ``segment_means``.
    """
    means = segment_means(frames, n_segments, ("split", "track_id"), strict=strict)
    feats = materialise(combine_segments(means, COMBOS, ("split", "track_id")), "combos")
    if center is not None:
        feats = feats.unionByName(center.select(F.lit("center").alias("combo"), "split", "track_id", "vec"))
    r = materialise(probe(feats, "combo", labels), "ablation")
    parts = F.create_map(*[x for n, s in COMBOS.items() for x in (F.lit(n), F.lit([f"s{i}" for i in s]))])
    single = r.select(F.col("combo").alias("part"), F.col("map").alias("part_map"))
    need = r.withColumn("part", F.explode_outer(parts[F.col("combo")])).join(F.broadcast(single), "part", "left")
    mean = need.groupBy("combo").agg(F.avg("part_map").alias("parts_mean"), F.count("part").cast("int").alias("n_segments"))
    return r.join(mean, "combo").withColumn("gain", F.col("map") - F.col("parts_mean"))


def ablation_summary(ablation: DataFrame) -> DataFrame:
    """(gain_1_to_2, gain_2_to_4, span_monotone) over the combinations."""
    avg = lambda n: F.avg(F.when((F.col("n_segments") == n) & (F.col("combo") != "center"), F.col("map")))
    one = lambda c: F.max(F.when(F.col("combo") == c, F.col("map")))
    a, b, c = (one(x) for x in SPAN_ORDER)
    return ablation.agg((avg(2) - avg(1)).alias("gain_1_to_2"), (one("all4") - avg(2)).alias("gain_2_to_4"), ((a < b) & (b < c)).alias("span_monotone"))
