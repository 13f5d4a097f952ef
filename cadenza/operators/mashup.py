"""Pairing tracks by tempo and key, and the arithmetic of aligning them.

``features(track_id, bpm, key, bar_seconds)`` describes a track; bar_seconds is 0 when unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import never_broadcast
from cadenza.core.ordered import Ordered, quantiles, top_per_group
from cadenza.core.session import materialise
from cadenza.functions import music as U
from cadenza.operators.joins import zip_by_ordinal
from cadenza.operators.signal import align_min_length

# The usual pitch-fader range and the largest unobtrusive pitch shift.
MAX_STRETCH = 0.08
MAX_SEMITONES = 2
# Octave corrections, tried in this order.
OCTAVES = (0.5, 1.0, 2.0)
COST_DIGITS = 9  # costs are rounded before ranking so that ties fall to the smaller id


def bar_seconds(downbeats: DataFrame) -> DataFrame:
    """(track_id, bar_seconds): median gap of the downbeats, 0 with fewer than three."""
    o = Ordered(downbeats, ["track_id"], ["pos"]).add(_next=("lead", F.col("t"))).result()
    med = quantiles(o.withColumn("_g", F.col("_next") - F.col("t")), ["track_id"], "_g", {"g": 0.5})
    n = downbeats.groupBy("track_id").agg(F.count("*").alias("n"))
    return n.join(med, "track_id", "left").select("track_id", F.when(F.col("n") >= 3, F.col("g")).otherwise(F.lit(0.0)).alias("bar_seconds"))


def pair_semitones(ta: Column, ma: Column, tb: Column, mb: Column) -> tuple[Column, Column]:
    """Shift and relation of a pair: neighbours on the circle of fifths in one mode overlap unshifted."""
    shift, relation = U.pitch_distance(ta, ma, tb, mb)
    near = (shift != 0) & (ma == mb) & (U.circle_distance(ta, tb) <= 1)
    return F.when(near, 0).otherwise(shift), F.when(near, F.concat(relation, F.lit(" (adjacent, unshifted)"))).otherwise(relation)


def octave_step(ratio: Column, m: float) -> Column:
    """Replace the ratio by its multiple if that is closer to 1."""
    return F.when(F.abs(ratio * m - 1) < F.abs(ratio - 1), ratio * m).otherwise(ratio)


def plan_mashup(pairs: DataFrame, features: DataFrame, max_stretch: float = MAX_STRETCH,
                max_semitones: int = MAX_SEMITONES) -> DataFrame:
    """Cost of laying ``donor`` over ``base`` for rows (base, donor)."""
    def side(p: str) -> DataFrame:
        k = F.col("key")
        return features.select(F.col("track_id").alias(p), F.col("bpm").alias(f"{p}_bpm"), F.col("bar_seconds").alias(f"{p}_bar_seconds"),
                               U.tonic(k).alias(f"{p}_tonic"), U.mode(k).alias(f"{p}_mode"))

    j = pairs.join(side("base"), "base").join(side("donor"), "donor")
    known = (F.col("base_bpm") > 0) & (F.col("donor_bpm") > 0)
    bars = (F.col("base_bar_seconds") > 0) & (F.col("donor_bar_seconds") > 0)
    ratio = F.when(bars, F.try_divide("donor_bar_seconds", "base_bar_seconds")).otherwise(F.try_divide("base_bpm", "donor_bpm"))
    j = j.withColumn("_ratio", ratio)
    for m in OCTAVES:
        j = j.withColumn("_ratio", octave_step(F.col("_ratio"), m))
    j = j.withColumn("stretch", F.when(known, F.col("_ratio")).otherwise(F.lit(1.0)))
    shift, relation = pair_semitones(F.col("base_tonic"), F.col("base_mode"), F.col("donor_tonic"), F.col("donor_mode"))
    j = j.withColumn("semitones", F.when(known, shift).otherwise(0)).withColumn("key_relation", F.when(known, relation).otherwise("unknown"))
    far, off = F.abs(F.col("stretch") - 1) > max_stretch, F.abs("semitones") > max_semitones
    reason = F.when(~known, "tempo unknown").otherwise(F.concat_ws("; ", F.when(far, "speed change over limit"), F.when(off, "pitch shift over limit")))
    return j.withColumn("reason", reason).withColumn("feasible", F.col("reason") == "").select(
        "base", "donor", "base_bpm", "donor_bpm", "stretch", ((F.col("stretch") - 1) * 100).alias("speed_change_percent"),
        "semitones", "key_relation", "feasible", "reason")


def nearest_lengths(donors: DataFrame, lookups: DataFrame, lists: list[str], k: int) -> DataFrame:
    """(base, donor): for each lookup (lists..., base, target) the k donors (lists..., donor, len) on either side.

    Both sides are merged in one ordered pass that turns a target into a rank; neighbours are
    then fetched by rank with an equi-join. Tempo values shared by many tracks cost nothing
    extra, and no band of pairs is expanded. Equal lengths are taken by ascending donor id.

    Costs are compared after rounding, so lengths that differ by less than that tie as well, and the smaller id may be the one farther
    away. Therefore the donors whose length ties with the farthest one of a side are added, up to k of every such length.
    """
    donors = materialise(donors.select(*lists, "donor", "len"), "donors")
    d = donors.select(*lists, "donor", "len", F.lit(None).cast(lookups.schema["base"].dataType).alias("base"), F.lit(1).alias("_is"))
    q = lookups.select(*lists, F.lit(None).cast(donors.schema["donor"].dataType).alias("donor"), F.col("target").alias("len"), "base", F.lit(0).alias("_is"))
    o = Ordered(d.unionByName(q), lists, ["len", "_is", "donor", "base"]).add(_rank=("sum", F.col("_is"))).result()
    o = materialise(o, "ranks")
    up = o.filter("_is = 1").select(*lists, "donor", "_rank", F.col("len").alias("_len"))
    down = Ordered(donors, lists, ["len", F.desc("donor")]).add(_rank=("row", None)).result().select(*lists, "donor", "_rank", F.col("len").alias("_len"))
    at = o.filter("_is = 0").select(*lists, "base", F.col("len").alias("_target"), F.col("_rank").alias("_p"))
    side = lambda first, last, far, rows: at.select(*lists, "base", "_target", far.alias("_edge"), F.explode(F.sequence(first, last)).alias("_rank")).join(
        never_broadcast(rows), [*lists, "_rank"])
    p = F.col("_p")
    found = materialise(side(p + 1, p + k, p + k, up).unionByName(side(p - k + 1, p, p - k + 1, down)), "neighbours")
    ties = _rounding_ties(found.filter("_rank = _edge AND _len > 0").select(*lists, "base", "_target", F.col("_len").alias("_far")), donors, lists, k)
    return found.select("base", "donor").unionByName(ties).distinct()


def _rounding_ties(edges: DataFrame, donors: DataFrame, lists: list[str], k: int) -> DataFrame:
    """(base, donor): the first k donors of every length that may cost the same, after rounding, as the length ``_far`` of (lists..., base, _target, _far).

    Lengths meet in cells of their logarithm, a few units of rounding wide, never as pairs of all.
    """
    unit = 10.0 ** -COST_DIGITS
    cell = lambda c: F.floor(F.log(c) / (4 * unit))
    near = top_per_group(donors.filter("len > 0"), [*lists, "len"], ["donor"], k).select(*lists, "donor", "len", cell(F.col("len")).alias("_cell"))
    far, e = F.col("_far"), F.abs("_target") * (2 * unit)
    low = F.greatest(far - e, far / 2)
    reach = edges.distinct().withColumn("_cell", F.explode(F.sequence(cell(low), cell(far + e))))
    met = reach.join(never_broadcast(near), [*lists, "_cell"]).filter(F.abs(F.col("len") - far) <= e)
    return met.select("base", "donor")


def _entries(features: DataFrame) -> Column:
    """How a track can be found as donor: by bar length, by beat length, or only by id."""
    known, bars = F.col("bpm") > 0, F.col("bar_seconds") > 0
    beat = F.try_divide(F.lit(1.0), F.col("bpm"))
    none = F.lit(None)
    e = lambda when, kind, length: F.when(when, F.struct(F.lit(kind).alias("kind"), length.alias("len"))).otherwise(none)
    return F.array_compact(F.array(e(known & bars, "bar", F.col("bar_seconds")), e(known & bars, "beat of barred", beat),
                                   e(known & ~bars, "beat of unbarred", beat), e(~known, "unknown", F.lit(0.0))))


def _lookups() -> Column:
    """Which donor lists a base consults and with which length."""
    known, bars = F.col("bpm") > 0, F.col("bar_seconds") > 0
    beat = F.try_divide(F.lit(1.0), F.col("bpm"))
    e = lambda when, kind, length: F.when(when, F.struct(F.lit(kind).alias("kind"), length.alias("len"))).otherwise(F.lit(None))
    return F.array_compact(F.array(e(known & bars, "bar", F.col("bar_seconds")), e(known, "beat of unbarred", beat),
                                   e(known & ~bars, "beat of barred", beat), e(known, "unknown", F.lit(-1.0))))



def _targets(lookups: DataFrame) -> DataFrame:
    keyed = F.when(F.col("kind") == "unknown", F.array(F.lit(1.0))).otherwise(F.lit(list(OCTAVES)))
    return lookups.withColumn("target", F.explode(F.transform(keyed, lambda m: F.col("len") * m)))


def tempo_neighbours(features: DataFrame, k: int) -> DataFrame:
    """Candidate pairs (base, donor) that contain each base's k closest tempos after octave correction."""
    f = features.filter("bpm > 0")
    donors = f.select(F.col("track_id").alias("donor"), F.explode(_entries(f)).alias("e")).select("donor", "e.kind", "e.len")
    looks = f.select(F.col("track_id").alias("base"), F.explode(_lookups()).alias("e")).select("base", "e.kind", "e.len").filter("kind <> 'unknown'")
    return nearest_lengths(donors, _targets(looks), ["kind"], k + 1).filter("base <> donor")


def rank_candidates(features: DataFrame, k: int, max_stretch: float = MAX_STRETCH, max_semitones: int = MAX_SEMITONES) -> DataFrame:
    """The k donors per base with the least manipulation: feasible first, then |semitones|, then |stretch - 1|.

    Donors are listed per key of the base and shift cost. Inside such a list only the tempo
    matters, so the k nearest lengths on either side of each octave contain the k best plans
    of that cost; their union over all costs contains the k best plans overall. Exact, and
    linear in the number of tracks.
    """
    keys = F.array(*[F.struct(F.lit(f"{p} {m}").alias("key"), F.lit(t).alias("tonic"), F.lit(m).alias("mode"))
                     for t, p in enumerate(U.PITCHES) for m in ("major", "minor")])
    donors = features.select(F.col("track_id").alias("donor"), U.tonic(F.col("key")).alias("tonic"), U.mode(F.col("key")).alias("mode"),
                             F.explode(_entries(features)).alias("e"))
    tuned = donors.filter("e.kind <> 'unknown'").withColumn("b", F.explode(keys))
    shift = pair_semitones(F.col("b.tonic"), F.col("b.mode"), F.col("tonic"), F.col("mode"))[0]
    tuned = tuned.select("donor", "e.kind", "e.len", F.col("b.key").alias("base_key"), F.abs(shift).cast("int").alias("cost"))
    unknown = donors.filter("e.kind = 'unknown'").select("donor", "e.kind", "e.len", F.lit("").alias("base_key"), F.lit(0).alias("cost"))
    looks = features.select(F.col("track_id").alias("base"), "key", F.explode(_lookups()).alias("e")).select("base", "key", "e.kind", "e.len")
    keyless = F.col("kind") == "unknown"
    looks = looks.withColumn("base_key", F.when(keyless, "").otherwise(F.col("key"))).withColumn(
        "cost", F.explode(F.when(keyless, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(6)))))
    listed, sought = tuned.unionByName(unknown), _targets(looks).select("base", "kind", "base_key", "cost", "target")
    # A base without tempo rates every donor alike: its list is simply ordered by id.
    lost = features.filter("bpm <= 0")
    if lost.limit(1).count():
        everyone = features.select(F.col("track_id").alias("donor"), F.lit("any").alias("kind"), F.lit(0.0).alias("len"), F.lit("").alias("base_key"), F.lit(0).alias("cost"))
        listed = listed.unionByName(everyone)
        sought = sought.unionByName(lost.select(F.col("track_id").alias("base"), F.lit("any").alias("kind"), F.lit("").alias("base_key"), F.lit(0).alias("cost"), F.lit(-1.0).alias("target")))
    pairs = nearest_lengths(listed, sought, ["kind", "base_key", "cost"], k + 1).filter("base <> donor")
    plans = plan_mashup(pairs, features, max_stretch, max_semitones)
    return top_per_group(plans, ["base"], rank_order(), k)


def rank_order() -> list[Column]:
    return [F.desc("feasible"), F.abs("semitones"), F.round(F.abs(F.col("stretch") - 1), COST_DIGITS), F.col("donor")]


def choose_donor(plans: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """One donor per base: the requested one, kept with a warning if infeasible, else the best feasible one."""
    best = top_per_group(plans.filter("feasible"), ["base"], rank_order(), 1).drop("rank")
    if requested is None:
        return best.withColumn("warning", F.lit(""))
    asked = plans.join(requested.select("base", "donor"), ["base", "donor"], "left_semi")
    rest = best.join(requested.select("base"), "base", "left_anti")
    both = asked.unionByName(rest.select(*asked.columns))
    return both.withColumn("warning", F.when(F.col("feasible"), "").otherwise(F.concat(F.lit("requested donor is not feasible: "), "reason")))


# ---------------------------------------------------------------- alignment

PAIR = ("base", "donor")


def _pair_downbeats(pairs: DataFrame, downbeats: DataFrame, side: str) -> DataFrame:
    return pairs.select(*PAIR).join(downbeats.select(F.col("track_id").alias(side), "pos", "t"), side)


def bar_rates(pairs: DataFrame, downbeats: DataFrame, sr: int) -> DataFrame:
    """(base, donor, pos, src_samples, rate, dst_seconds) per common bar; empty and non-increasing bars are skipped."""
    z = zip_by_ordinal(_pair_downbeats(pairs, downbeats, "donor"), _pair_downbeats(pairs, downbeats, "base"), PAIR, ("src", "dst"))
    o = Ordered(z, list(PAIR), ["pos"]).add(_s1=("lead", F.col("src")), _d1=("lead", F.col("dst"))).result().filter("_s1 IS NOT NULL")
    samples = (F.col("_s1") * sr).cast("long") - (F.col("src") * sr).cast("long")
    ok = o.withColumn("src_samples", samples).filter((F.col("src_samples") >= 2) & (F.col("_d1") > F.col("dst")))
    return ok.select(*PAIR, "pos", "src_samples", ((F.col("_s1") - F.col("src")) / (F.col("_d1") - F.col("dst"))).alias("rate"), (F.col("_d1") - F.col("dst")).alias("dst_seconds"))


def landings(bars: DataFrame, heads: DataFrame, sr: int) -> DataFrame:
    """(base, donor, pos, t): where the bar lines land after concatenating ``out_samples`` behind the head, shifted to the base.

    ``heads(base, donor, src0, dst0)`` are the first downbeats of donor and base.
    """
    h = heads.withColumn("_head", (F.col("src0") * sr).cast("long")).withColumn("_shift", F.col("dst0") - F.col("src0"))
    o = Ordered(bars, list(PAIR), ["pos"]).add(_n=("row", None), _cum=("sum", F.col("out_samples"))).result()
    moved = o.join(h, list(PAIR)).select(*PAIR, F.col("_n").alias("pos"), ((F.col("_head") + F.col("_cum")) / F.lit(float(sr)) + F.col("_shift")).alias("t"))
    first = h.select(*PAIR, F.lit(0).cast("long").alias("pos"), (F.col("_head") / F.lit(float(sr)) + F.col("_shift")).alias("t"))
    return first.unionByName(moved)


def align_error(pairs: DataFrame, downbeats: DataFrame, landed: DataFrame) -> DataFrame:
    """(base, donor, align_error_ms, n_bars): median distance between base bar lines and landings."""
    z = zip_by_ordinal(_pair_downbeats(pairs, downbeats, "base"), landed, PAIR, ("want", "got")).withColumn("_e", F.abs(F.col("want") - F.col("got")) * 1000)
    n = z.groupBy(*PAIR).agg(F.count("*").alias("n_bars"))
    return n.join(quantiles(z, list(PAIR), "_e", {"align_error_ms": 0.5}), list(PAIR))


def accompaniment(samples: DataFrame, stems: tuple[str, ...] = ("drums", "bass", "other")) -> DataFrame:
    """Sum of the given stems over their common length."""
    s = align_min_length(samples.filter(F.col("stem").isin(*stems)))
    return s.groupBy("track_id", "i").agg(F.sum("v").alias("v"))


def mix(base: DataFrame, donor: DataFrame, gain_db: float = -3.0, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Base plus attenuated donor, cut or padded to the base; scaled down only if the peak exceeds 1."""
    d = donor.select(*by, "i", F.col("v").alias("_d"))
    m = base.join(d, [*by, "i"], "left").withColumn("v", F.col("v") + F.coalesce("_d", F.lit(0.0)) * F.pow(F.lit(10.0), F.lit(gain_db / 20)))
    peak = m.groupBy(*by).agg(F.max(F.abs("v")).alias("_peak"))
    return m.join(peak, list(by)).withColumn("v", F.when(F.col("_peak") > 1, F.col("v") / F.col("_peak")).otherwise(F.col("v"))).select(*by, "i", "v")
