"""Beats, keys, chords and sections on long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.core.blocks import blocked_topk
from cadenza.core.common import PART, explode_range
from cadenza.core.ordered import Ordered, quantiles
from cadenza.core.session import materialise
from cadenza.functions import music as U
from cadenza.operators.joins import interval_overlap, match_within

HOP = 512
PIECE_FRAMES = 4096         # frames of a piece that one row may hold
LETTERS = "ABCDEFGH"


def _pitch_array(df: DataFrame, by: tuple[str, ...], agg) -> DataFrame:
    """One 12-element array per group from rows (pc, v)."""
    return df.groupBy(*by).agg(F.array(*[F.coalesce(agg(F.when(F.col("pc") == i, F.col("v"))), F.lit(0.0)) for i in range(12)]).alias("chroma"))


def chroma_mean(chroma: DataFrame) -> DataFrame:
    """(track_id, chroma): mean over frames per pitch class, scaled to sum 1."""
    total = _pitch_array(chroma, ("track_id",), F.sum).join(chroma.groupBy("track_id").agg((F.max("frame") + 1).alias("_n")), "track_id")
    mean = F.transform("chroma", lambda x: x / F.col("_n"))
    d = total.select("track_id", mean.alias("chroma"))
    s = F.aggregate("chroma", F.lit(0.0), lambda a, x: a + x) + 1e-12
    return d.withColumn("_s", s).select("track_id", F.transform("chroma", lambda x: x / F.col("_s")).alias("chroma"))


def estimate_key(means: DataFrame) -> DataFrame:
    """Best of 24 keys by Pearson correlation; all candidates are compared inside the row."""
    profiles = F.array(*[F.struct(F.lit(t).alias("tonic"), F.lit(m).alias("mode"), F.lit(p).alias("p")) for t, m, p in U.unit_profiles()])
    mean = F.aggregate("chroma", F.lit(0.0), lambda a, x: a + x) / 12
    d = means.withColumn("_c", mean).withColumn("_v", F.transform("chroma", lambda x: x - F.col("_c")))
    d = d.withColumn("_n", F.sqrt(U.dot("_v", F.col("_v"))))
    scored = F.transform(profiles, lambda k: F.struct(F.try_divide(U.dot(F.col("_v"), k["p"]), F.col("_n")).alias("corr"), k["tonic"].alias("tonic"), k["mode"].alias("mode")))
    d = d.withColumn("_k", F.sort_array(scored, asc=False))
    best, second = F.col("_k")[0], F.col("_k")[1]
    return d.select("track_id", F.concat(U.pitch_name(best["tonic"]), F.lit(" "), best["mode"]).alias("key"), best["tonic"].alias("tonic"),
                    best["mode"].alias("mode"), best["corr"].alias("correlation"), (best["corr"] - second["corr"]).alias("margin"),
                    U.relative_key(best["tonic"], best["mode"]).alias("relative_alternative"))


# ---------------------------------------------------------------- chords

def beat_sync(frames: DataFrame, limit: int | None = None) -> DataFrame:
    """(track_id, piece, pc, v): median chroma per piece from rows (track_id, piece, pc, v)."""
    return quantiles(frames, ["track_id", "piece", "pc"], "v", {"v": 0.5}, limit)


def _median(x: Column) -> Column:
    """Interpolated median of an ascending array; NULL if it is empty."""
    lo, hi = F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")), F.get(x, F.floor(F.size(x) / 2).cast("int"))
    return F.when(F.size(x) % 2 == 1, lo).otherwise(lo * 0.5 + hi * 0.5)


def chroma_sync(frames: DataFrame, limit: int = PIECE_FRAMES) -> DataFrame:
    """(track_id, piece, chroma): median chroma per piece from rows (track_id, piece, chroma), the values of ``beat_sync``.

    NULL and NaN values are ignored; a tone without any other is NULL, and a piece without any is left out. A piece of at most ``limit`` frames is one row of arrays, so
    frames are shuffled once and not once per tone; only longer pieces are ranked tone by tone.
    """
    key = ["track_id", "piece"]
    large = materialise(frames.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(*key), "large-pieces")
    known = lambda x: F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v))
    tones = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.sort_array(known(F.transform("_rows", lambda r: F.get(r, i).cast("double")))))
    split = not large.isEmpty()
    small = frames.join(F.broadcast(large), key, "left_anti") if split else frames     # at most rows / limit keys
    out = small.groupBy(*key).agg(F.collect_list("chroma").alias("_rows")).select(*key, F.transform(tones, _median).alias("chroma"))
    out = out.filter(F.exists("chroma", lambda v: v.isNotNull()))
    if not split:
        return out
    long = frames.join(F.broadcast(large), key, "left_semi").select(*key, F.posexplode("chroma").alias("pc", "v"))
    tone = lambda i: F.max(F.when(F.col("pc") == i, F.col("v")))
    return out.unionByName(beat_sync(long).groupBy(*key).agg(F.array(*[tone(i) for i in range(12)]).alias("chroma")))


def triad_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate(U.triads())], "cls int, label string, template array<double>")


def chord_per_beat(sync: DataFrame) -> DataFrame:
    """(track_id, piece, cls, label, confidence): most similar triad by cosine, the lowest class on ties.

    Rows are those of ``beat_sync`` or, with nothing to shuffle, of ``chroma_sync``. Triads have three tones, so every similarity is a short sum of plain columns.
    """
    at = lambda i: F.col(f"_c{i}")
    if "chroma" in sync.columns:
        d = sync.select("track_id", "piece", *[F.coalesce(F.get("chroma", F.lit(i)), F.lit(0.0)).alias(f"_c{i}") for i in range(12)])
    else:
        d = sync.groupBy("track_id", "piece").agg(*[F.coalesce(F.max(F.when(F.col("pc") == i, F.col("v"))), F.lit(0.0)).alias(f"_c{i}") for i in range(12)])
    energy = sum((at(i) * at(i) for i in range(1, 12)), at(0) * at(0))
    d = d.withColumn("_n", F.sqrt(energy) + 1e-12)
    sims = []
    for cls, (_, tpl) in enumerate(U.triads()):
        tones = [at(i) * w for i, w in enumerate(tpl) if w]
        sims.append(F.struct(F.round(sum(tones[1:], tones[0]) / F.col("_n"), 9).alias("sim"), F.lit(-cls).alias("neg")))
    d = d.select("track_id", "piece", F.greatest(*sims).alias("_b"))
    names = F.lit([n for n, _ in U.triads()])
    return d.select("track_id", "piece", (-F.col("_b.neg")).alias("cls"), F.element_at(names, 1 - F.col("_b.neg")).alias("label"), F.col("_b.sim").alias("confidence"))


def mode_smooth(df: DataFrame, k: int = 3, by: tuple[str, ...] = ("track_id",), order: str = "pos", value: str = "cls") -> DataFrame:
    """Replace each value by the most frequent one of its window (lowest on ties); the edges stay."""
    if k < 3:
        return df
    o, back, ahead = Ordered(df, list(by), [order]), F.col(value), F.col(value)
    made = []
    for i in range(k // 2):
        o = o.add(**{f"_b{i}": ("lag", back), f"_f{i}": ("lead", ahead)})
        back, ahead = F.col(f"_b{i}"), F.col(f"_f{i}")
        made += [f"_b{i}", f"_f{i}"]
    win = F.array(value, *made)
    votes = F.transform(F.array_distinct(win), lambda v: F.struct(F.size(F.filter(win, lambda x: x == v)).alias("n"), (-v).alias("neg")))
    whole = F.col(made[-2]).isNotNull() & F.col(made[-1]).isNotNull()
    return o.result().withColumn(value, F.when(whole, -F.array_max(votes)["neg"]).otherwise(F.col(value))).drop(*made)


def merge_runs(df: DataFrame, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Rows (pos, t, label, confidence) to intervals of equal neighbours.

    A row lasts until its ``until`` column if there is one, else until the next row's t.
    """
    until = ("lead", F.col("t")) if "until" not in df.columns else ("row", None)
    o = Ordered(df, list(by), ["pos"]).add(_next=until, _prev=("lag", F.col("label")))
    if "until" in df.columns:
        o.df = o.df.withColumn("_next", F.col("until"))
    o = o.add(run=("sum", (~F.col("label").eqNullSafe(F.col("_prev"))).cast("int")))
    rows = o.result().filter(F.col("_next").isNotNull())
    return rows.groupBy(*by, "run").agg(F.min("t").alias("start"), F.max("_next").alias("end"), F.min("label").alias("label"),
                                        F.avg("confidence").alias("confidence"), F.count("*").alias("n_beats"))


def fill_gaps(d: DataFrame, label: str = "N") -> DataFrame:
    """Intervals of a track plus one of ``label`` wherever time between two of them is uncovered."""
    cols = ["track_id", "start", "end", "label"]
    o = Ordered(d.select(*cols), ["track_id"], ["start", "end", "label"])
    o = o.add(_reach=("max_before", F.col("end"))).result()
    none = o.filter("start > _reach").select("track_id", F.col("_reach").alias("start"), F.col("start").alias("end"), F.lit(label).alias("label"))
    return d.select(*cols).unionByName(none)


def weighted_accuracy(ref: DataFrame, est: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Share of the common time in which both label the same chord; 0 without common time.

    Time inside the common span that a side leaves uncovered counts as its 'no chord'.
    """
    span = lambda d, p: d.groupBy("track_id").agg(F.min("start").alias(f"{p}_lo"), F.max("end").alias(f"{p}_hi"))
    s = span(ref, "r").join(span(est, "e"), "track_id")
    s = s.select("track_id", F.greatest("r_lo", "e_lo").alias("lo"), F.least("r_hi", "e_hi").alias("hi"))
    j = interval_overlap(fill_gaps(ref), fill_gaps(est), bucket=bucket)
    same = (U.to_eval_label(F.col("ref_label")) == U.to_eval_label(F.col("est_label"))).cast("int")
    a = j.groupBy("track_id").agg(F.sum(F.col("duration") * same).alias("_hit"), F.sum("duration").alias("_all"))
    ok = F.col("hi") > F.col("lo")
    return s.join(a, "track_id", "left").select(
        "track_id", F.coalesce(F.when(ok, F.try_divide(F.col("_hit"), F.col("_all"))), F.lit(0.0)).alias("weighted_accuracy"),
        F.when(ok, F.col("hi") - F.col("lo")).otherwise(F.lit(0.0)).alias("overlap_seconds"))


# ---------------------------------------------------------------- beats

def beat_strength(beats: DataFrame, onset: DataFrame, sr: int) -> DataFrame:
    """Look up the onset strength of each beat's frame, clipped to the last frame (half frames round to even)."""
    last = onset.groupBy("track_id").agg(F.max("frame").alias("_last"))
    b = beats.join(last, "track_id").withColumn("frame", F.least(F.greatest(F.bround(F.col("t") * sr / HOP).cast("long"), F.lit(0)), F.col("_last")))
    return b.join(onset.select("track_id", "frame", "strength"), ["track_id", "frame"]).drop("_last")


def downbeat_phase(beats: DataFrame, beats_per_bar: int = 4) -> DataFrame:
    """(track_id, phase, confidence): strongest phase of the bar; without energy phase 0 at confidence 1."""
    p = beats.groupBy("track_id").agg(*[F.sum(F.when(F.col("pos") % beats_per_bar == i, F.col("strength")).otherwise(0.0)).alias(f"_p{i}")
                                        for i in range(beats_per_bar)])
    best = F.array_max(F.array(*[F.struct(F.col(f"_p{i}").alias("s"), F.lit(-i).alias("neg")) for i in range(beats_per_bar)]))
    total = sum((F.col(f"_p{i}") for i in range(beats_per_bar)), F.lit(0.0))
    d = p.withColumn("_b", best).withColumn("_t", total)
    loud = F.col("_t") > 0
    return d.select("track_id", F.when(loud, -F.col("_b.neg")).otherwise(0).alias("phase"),
                    F.when(loud, F.try_divide(F.col("_b.s") * beats_per_bar, F.col("_t"))).otherwise(F.lit(1.0)).alias("confidence"))


def downbeats(beats: DataFrame, phases: DataFrame, beats_per_bar: int = 4) -> DataFrame:
    return beats.join(phases, "track_id").filter(F.col("pos") % beats_per_bar == F.col("phase")).select(
        "track_id", F.floor(F.col("pos") / beats_per_bar).cast("long").alias("pos"), "t")


def extend_beats(beats: DataFrame, durations: DataFrame) -> DataFrame:
    """Continue the median period back to 0 and up to the duration; detected beats are untouched."""
    o = Ordered(beats.select("track_id", "t"), ["track_id"], ["t"]).add(_next=("lead", F.col("t"))).result()
    period = quantiles(o.withColumn("_d", F.col("_next") - F.col("t")), ["track_id"], "_d", {"period": 0.5})
    ends = beats.groupBy("track_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    e = ends.join(period.filter("period > 0"), "track_id").join(durations, "track_id")
    head = explode_range(e, F.floor(F.col("first") / F.col("period") + 1e-9) + 1, "m", start=1).select(
        "track_id", F.greatest(F.col("first") - F.col("m") * F.col("period"), F.lit(0.0)).alias("t"))
    tail = explode_range(e, F.ceil((F.col("duration") - F.col("last")) / F.col("period")), "m", start=1).select(
        "track_id", (F.col("last") + F.col("m") * F.col("period")).alias("t"))
    made = head.unionByName(tail).withColumn("added", F.lit(True))
    return beats.select("track_id", "t", F.lit(False).alias("added")).unionByName(made)


def beat_f_measure(ref: DataFrame, est: DataFrame, tolerance: float = 0.07, trim: float = 5.0) -> DataFrame:
    """F-measure per track of beats after the first seconds; 0 when either side is empty."""
    r, e = ref.filter(F.col("t") >= trim), est.filter(F.col("t") >= trim)
    hits = match_within(r, e, tolerance).groupBy("track_id").agg(F.count("*").alias("hits"))
    n = lambda d, c: d.groupBy("track_id").agg(F.count("*").alias(c))
    tracks = ref.select("track_id").unionByName(est.select("track_id")).distinct()
    t = tracks.join(n(r, "n_ref"), "track_id", "left").join(n(e, "n_est"), "track_id", "left").join(hits, "track_id", "left").na.fill(0)
    return t.select("track_id", "hits", "n_ref", "n_est", F.coalesce(F.try_divide(2 * F.col("hits"), F.when((F.col("n_ref") > 0) & (F.col("n_est") > 0), F.col("n_ref") + F.col("n_est"))), F.lit(0.0)).alias("f_measure"))


def beat_cemgil(ref: DataFrame, est: DataFrame, sigma: float = 0.04, trim: float = 5.0) -> DataFrame:
    """Gaussian beat accuracy per track: each reference beat scores by its distance to the nearest estimate, relative to the mean count.

    The nearest estimate is the last one before or the first one after, both from one ordered pass; 0 when either side is empty.
    """
    v = F.col("_v")
    side = lambda d, k: d.filter(F.col("t") >= trim).select("track_id", "t", F.lit(k).alias("_k"), (F.col("t") if k == 0 else F.lit(None).cast("double")).alias("_v"))
    o = Ordered(side(est, 0).unionByName(side(ref, 1)), ["track_id"], ["t", "_k"]).add(_before=("last", v), _after=("first_after", v)).result()
    d = F.least(F.col("t") - F.col("_before"), F.col("_after") - F.col("t"))
    near = F.coalesce(F.exp(-d * d / (2 * sigma ** 2)), F.lit(0.0))
    s = o.groupBy("track_id").agg(F.sum(F.when(F.col("_k") == 1, near)).alias("s"), F.count("*").alias("n"))
    tracks = ref.select("track_id").unionByName(est.select("track_id")).distinct()
    return tracks.join(s, "track_id", "left").select("track_id", F.coalesce(2 * F.col("s") / F.col("n"), F.lit(0.0)).alias("cemgil"))


# ---------------------------------------------------------------- sections

def merge_sections(beats: DataFrame, durations: DataFrame, min_seconds: float = 4.0, n_sections: int = 4) -> DataFrame:
    """Clustered beats (pos, t, cluster) to sections. A short run joins the section before it.

    Absorbing is associative: a run opens a section exactly if it is the first or long enough.
    """
    o = Ordered(beats.join(durations, "track_id"), ["track_id"], ["pos"]).add(_prev=("lag", F.col("cluster")), _next=("lead", F.col("t")))
    o = o.add(_run=("sum", (~F.col("cluster").eqNullSafe(F.col("_prev"))).cast("int")))
    runs = o.result().groupBy("track_id", "_run").agg(F.min("t").alias("start"), F.max(F.coalesce("_next", "duration")).alias("end"),
                                                      F.min("cluster").alias("cluster"))
    opens = ((F.col("_run") == 1) | (F.col("end") - F.col("start") >= min_seconds)).cast("int")
    s = Ordered(runs, ["track_id"], ["_run"]).add(section=("sum", opens)).result()
    s = s.groupBy("track_id", "section").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("cluster", "_run").alias("cluster"))
    n = s.groupBy("track_id").agg(F.max("section").alias("_n"))
    letter = F.substring(F.lit(LETTERS), F.col("cluster") % len(LETTERS) + 1, F.lit(1))
    edge = F.when((F.col("_n") >= 3) & (F.col("section") == 1), "intro").when((F.col("_n") >= 3) & (F.col("section") == F.col("_n")), "outro")
    full = s.join(n, "track_id").select("track_id", "section", "start", "end", F.coalesce(edge, letter).alias("label"), F.col("cluster").cast("int").alias("cluster"))
    size = beats.groupBy("track_id").agg(F.count("*").alias("_n")).join(durations, "track_id")
    short = size.filter((F.col("_n") < n_sections * 2) | (F.col("duration") < min_seconds * 2))
    whole = short.select("track_id", F.lit(1).cast("long").alias("section"), F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.lit("A").alias("label"), F.lit(0).alias("cluster"))
    return full.join(short, "track_id", "left_anti").unionByName(whole)


def beat_affinity(sync: DataFrame, k: int) -> DataFrame:
    """(track_id, a, b, affinity): mutual k-nearest beats of a track by chroma distance, plus the neighbour band.

    The affinity is exp(-distance / bandwidth), the bandwidth being the track's median
    distance to the k-th neighbour. Adjacent beats get at least the track's largest affinity.
    Distances are computed in blocks, so no table of all beat pairs exists.
    """
    v = _pitch_array(sync, ("track_id", "piece"), F.max).select("track_id", F.col("piece").alias("id"), F.col("chroma").alias("vec"))
    near = blocked_topk(v.withColumnRenamed("id", "q"), v, k, cell=["track_id"], merge_on=["track_id"], metric="euclid").withColumn("d", -F.col("score"))
    width = quantiles(near.filter(F.col("rank") == k), ["track_id"], "d", {"bw": 0.5})
    back = near.select("track_id", F.col("item").alias("q"), F.col("q").alias("item"))
    links = near.join(back, ["track_id", "q", "item"], "left_semi").join(width, "track_id")
    aff = links.select("track_id", F.col("q").alias("a"), F.col("item").alias("b"),
                       F.coalesce(F.exp(-F.try_divide(F.col("d"), F.col("bw"))), F.lit(1.0)).alias("affinity"))
    top = aff.groupBy("track_id").agg(F.max("affinity").alias("_top"))
    last = v.groupBy("track_id").agg(F.max("id").alias("_last"))
    band = v.join(top, "track_id").join(last, "track_id").select(
        "track_id", F.col("id").alias("a"), F.explode(F.array(F.col("id") - 1, F.col("id") + 1)).alias("b"), F.col("_top").alias("affinity"), "_last")
    band = band.filter("b >= 0 AND b <= _last").drop("_last")
    return aff.unionByName(band).groupBy("track_id", "a", "b").agg(F.max("affinity").alias("affinity"))


# ---------------------------------------------------------------- documents

def _parts(df: DataFrame, fields: list[Column], name: str) -> DataFrame:
    part = F.floor(F.col("pos") / PART).cast("int").alias("part")
    rows = df.select("track_id", part, F.struct("pos", F.struct(*fields).alias("x") if len(fields) > 1 else fields[0].alias("x")).alias("r"))
    return rows.groupBy("track_id", "part").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["x"]).alias(name))


def analysis_document(head: DataFrame, beats: DataFrame, downbeats_: DataFrame, chords: DataFrame, sections: DataFrame) -> DataFrame:
    """Rounded analysis documents ``(track_id, part, bpm, …, beats, downbeats, chords, segments)``.

    Arrays hold at most PART elements: a longer track continues in part 1, 2, … so no task
    and no row ever holds an unbounded track. Positions are gapless from 0, so element i of
    part p has position p * PART + i.
    """
    r = lambda c, n: F.round(c, n).alias(c)
    span = [r("start", 3), r("end", 3), F.col("label")]
    pieces = [_parts(beats, [F.round("t", 4)], "beats"), _parts(downbeats_, [F.round("t", 4)], "downbeats"),
              _parts(chords, [*span, r("confidence", 3)], "chords"), _parts(sections, [*span, F.col("cluster")], "segments")]
    h = head.select("track_id", F.lit(0).alias("part"), r("bpm", 2), F.lit("4/4").alias("time_signature"), "key", r("duration", 3),
                    U.tempo_candidates(F.col("bpm")).alias("tempo_candidates"), F.lit(False).alias("ground_truth"))
    keys = pieces[0].select("track_id", "part")
    for p in pieces[1:]:
        keys = keys.unionByName(p.select("track_id", "part"))
    doc = h.select("track_id", "part").unionByName(keys).distinct().join(h.drop("part"), "track_id")
    for p in pieces:
        doc = doc.join(p, ["track_id", "part"], "left")
    return doc


def duration_check(df: DataFrame, expected: str = "duration", decoded: str = "decoded") -> DataFrame:
    """Reject rows whose decoded length is off by more than max(1 s, 2 %); flag a zero tempo."""
    off = F.abs(F.col(decoded) - F.col(expected)) > F.greatest(F.lit(1.0), F.col(expected) * 0.02)
    return df.withColumn("reason", F.when(off, "duration mismatch").when(F.col("bpm") <= 0, "no tempo").otherwise("ok"))
