import math

import pytest
from pyspark.sql import functions as F

from cadenza.core.ordered import median
from cadenza.operators import separation as S
from cadenza.operators import signal as G

PAIR = "track_id string, stem string, i long, ref double, est double"


def pairs(spark, ref, est, stem="vocals"):
    return spark.createDataFrame([("a", stem, i, float(r), float(e)) for i, (r, e) in enumerate(zip(ref, est))], PAIR)


REF = [math.sin(i / 3) for i in range(200)]


def test_silence_scores_exactly_zero(spark):
    assert S.global_sdr(pairs(spark, REF, [0] * 200)).first()["usdr"] == 0.0


def test_sdr_equals_designed_snr(spark):
    for db in (10, 20):
        est = [r * (1 - 10 ** (-db / 20)) for r in REF]
        assert S.global_sdr(pairs(spark, REF, est)).first()["usdr"] == pytest.approx(db, abs=1e-4)


def test_si_sdr_special_cases(spark):
    one = lambda r, e: S.si_sdr(pairs(spark, r, e)).first()["si_sdr"]
    assert one(REF, REF) == math.inf and one(REF, [2 * r for r in REF]) == math.inf
    assert one(REF, [0.0] * 200) == -math.inf
    assert math.isnan(one([1.0] * 200, REF))
    noisy = [r + (.1 if i % 2 else -.1) for i, r in enumerate(REF)]
    assert one(REF, noisy) == pytest.approx(one(REF, [5 * x + 1 for x in noisy]), abs=1e-6)


def test_block_median_ignores_nan(spark):
    b = spark.createDataFrame([("a", "v", i, x) for i, x in enumerate([1., 2., float("nan"), 9.])] + [("a", "d", 0, float("nan"))], "track_id string, stem string, block int, value double")
    got = {r["stem"]: r["value"] for r in S.block_median(b).collect()}
    assert got["v"] == 2 and math.isnan(got["d"])


def test_aggregate_mean_is_not_a_second_median(spark):
    rows = [("cSDR", t, s, m + d) for s, m in zip(S.STEMS, (8., 7., 6., 5.)) for t, d in (("a", 0.), ("b", 5.), ("c", -1.))] + [("cSDR", "d", "vocals", float("inf"))]
    m = spark.createDataFrame(rows, "metric string, track_id string, stem string, value double")
    got = {r["stem"]: r["value"] for r in S.aggregate_metrics(m, "median").collect()}
    assert got == {"vocals": 8, "drums": 7, "bass": 6, "other": 5, "mean": 6.5}
    assert S.track_mean(m.filter("track_id = 'd'")).filter(F.isnan("mean")).count() == 1
    assert S.per_stem_matrix(m).count() == 4


def test_missing_stem_is_reported(spark):
    ref, est = pairs(spark, REF, REF), pairs(spark, REF, REF, "drums")
    assert S.missing_stems(ref, est).count() == 1
    with pytest.raises(KeyError):
        S.assert_stems(ref, est)


def test_rtf_takes_the_upper_median(spark):
    t = spark.createDataFrame([(1., 10.), (2., 10.), (3., 10.), (4., 10.), (9., 0.)], "seconds double, audio_seconds double")
    r = S.rtf_summary(t).first()
    assert r["rtf_median"] == pytest.approx(.3) and r["total_audio"] == 40 and r["speedup"] == pytest.approx(1 / .3)
    runs = spark.createDataFrame([("x", 1, 99., 10.), ("x", 2, 1., 10.), ("x", 3, 3., 10.), ("y", 2, 5., None)], "label string, run int, seconds double, audio_seconds double")
    s = {r["label"]: r for r in S.timing_stats(runs, 1).collect()}
    assert s["x"]["median_s"] == 2 and s["x"]["std_s"] == 1 and s["x"]["rtf"] == .2 and s["x"]["speedup"] == 5
    assert s["y"]["std_s"] == 0 and s["y"]["rtf"] is None


def test_case_diagnosis(spark):
    rows = [("a", "v", -9., -25.), ("b", "v", 3., -7.), ("c", "v", 8., -6.), ("d", "v", 9., -6.5), ("e", "v", 9., -5.)]
    c = spark.createDataFrame(rows, "track_id string, stem string, csdr double, energy_db double")
    got = {r["track_id"]: r["diagnosis"] for r in S.diagnose_case(c).collect()}
    assert got == {"a": "quiet", "b": "failure", "c": "ok", "d": "ok", "e": "ok"}
    assert S.true_failures(c).count() == 0


def test_true_failures_keep_values_that_tie_but_for_their_last_digit(spark):
    low, up = 0.3, 0.1 + 0.2
    assert low < up
    rows = [(f"t{i}", "bass", c, e) for i, (c, e) in enumerate([(low, low), (up, up), (low, up), (up, low), (9., 9.), (9., -9.)])]
    c = spark.createDataFrame(rows, "track_id string, stem string, csdr double, energy_db double")
    assert {r["track_id"] for r in S.true_failures(c).collect()} == {"t0", "t1", "t2", "t3"}


def mono(spark, n, track="a"):
    return spark.createDataFrame([(track, i, float(i + 1)) for i in range(n)], "track_id string, i long, v double")


@pytest.mark.parametrize("n", [5, 40, 41, 70, 71, 72, 100, 101, 163])
def test_overlap_add_restores_the_signal(spark, n):
    seg, overlap = 40, .25
    hop, starts = 30, [0]
    while n > seg and starts[-1] + seg < n and n - (starts[-1] + hop) >= 2:
        starts.append(starts[-1] + hop)
    c = G.chunk(mono(spark, n), seg, overlap)
    assert sorted(r[0] for r in c.select("k").distinct().collect()) == list(range(len(starts)))
    out = {r["i"]: r["v"] for r in G.overlap_add(c, seg, overlap).collect()}
    # The very first and last sample of a windowed signal have weight zero.
    assert all(out[i] == pytest.approx(i + 1) for i in out if 0 < i < n - 1 or n <= seg)


def test_lengths_channels_and_transforms(spark):
    s = mono(spark, 5).withColumn("stem", F.lit("v"))
    assert [r["v"] for r in G.match_length(s, 7).orderBy("i").collect()] == [1, 2, 3, 4, 5, 0, 0]
    assert G.match_length(s, 3).count() == 3
    one = s.withColumn("ch", F.lit(0))
    st = G.to_stereo(one)
    assert st.count() == 10 and G.to_stereo(st.unionByName(one.withColumn("ch", F.lit(2)))).count() == 10
    for name in G.TTA:
        back = G.tta_transform(G.tta_transform(st, name), name)
        assert back.select(*st.columns).exceptAll(st).count() == 0
    assert G.downmix(st).exceptAll(mono(spark, 5).select("track_id", "i", "v")).count() == 0
    two = s.unionByName(mono(spark, 3).withColumn("stem", F.lit("d")))
    assert G.align_min_length(two).count() == 6 and G.equal_lengths(two).count() == 1


def test_masks_share_the_mixture(spark):
    b = spark.createDataFrame([("a", s, 0, f, 0, x, y) for f in range(3) for s, x, y in (("v", 3., 4.), ("d", 0., 5.), ("b", 0., 0.))], "track_id string, stem string, ch int, f int, t int, re double, im double")
    mix = b.groupBy("track_id", "ch", "f", "t").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    total = G.ratio_mask(b, mix).groupBy("f").agg(F.sum("re").alias("re"), F.sum("mask").alias("m")).first()
    assert total["re"] == pytest.approx(3) and total["m"] == pytest.approx(1)
    won = G.binary_mask(b, mix, ("v", "d", "b")).filter("mask = 1").select("stem").distinct().collect()
    assert [r[0] for r in won] == ["v"]                                    # a tie goes to the first stem
    sw = G.phase_swap(b.filter("stem = 'v'"), mix).first()
    assert math.hypot(sw["re"], sw["im"]) == pytest.approx(5)


def test_envelope_levels_and_zscore(spark):
    s = mono(spark, 3)
    assert [r["peak"] for r in G.envelope(s, 5).orderBy("x").collect()] == [1, 2, 3, 0, 0]
    r = G.envelope(mono(spark, 10), 3, "range").orderBy("x").collect()
    assert [(x["lo"], x["hi"]) for x in r] == [(0, 3), (0, 6), (0, 10)]
    quiet = s.withColumn("v", F.lit(0.0))
    st = G.zscore_stats(quiet)
    assert G.group_zscore(quiet, st).filter("v <> 0").count() == 0
    z = G.zscore_stats(s)
    back = G.restore(G.group_zscore(s, z), z)
    assert [round(r["v"], 9) for r in back.orderBy("i").collect()] == [1, 2, 3]
    assert G.peak_normalise(quiet).filter("v <> 0").count() == 0
    assert G.peak_normalise(s).agg(F.max("v")).first()[0] == pytest.approx(.99)


def test_segments_keep_the_requested_order(spark):
    f = spark.createDataFrame([("a", i, i // 3) for i in range(12)], "track_id string, frame int, seg int")
    assert [r["seg"] for r in G.use_segments(f, 4, (2, 0)).orderBy("frame").collect()] == [2, 2, 2, 0, 0, 0]
    with pytest.raises(ValueError):
        G.use_segments(f, 4, (4,))
    with pytest.raises(Exception, match="do not divide"):
        G.use_segments(f, 5, (0,)).collect()


def test_median_of_even_count_interpolates(spark):
    assert median(spark.createDataFrame([(1.,), (2.,), (4.,), (9.,)], "v double"), [], "v").first()[0] == 3.0
