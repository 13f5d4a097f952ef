import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import music as U
from cadenza.operators import mashup as M

FEATURES = "track_id long, bpm double, key string, bar_seconds double"


def plan(spark, a, b, **kw):
    f = spark.createDataFrame([(1, *a), (2, *b)], FEATURES)
    return M.plan_mashup(spark.createDataFrame([(1, 2)], "base long, donor long"), f, **kw).first()


def test_stretch_direction(spark):
    p = plan(spark, (100., "C major", 0.), (105., "C major", 0.))
    assert p["stretch"] == pytest.approx(100 / 105) and p["speed_change_percent"] < 0 and p["feasible"]
    bars = plan(spark, (100., "C major", 2.4), (100., "C major", 2.3))
    assert bars["stretch"] == pytest.approx(2.3 / 2.4)


@pytest.mark.parametrize("a,b,want", [(117., 60., 117 / 120), (60., 117., 120 / 117), (100., 100., 1.0), (90., 140., 180 / 140 if abs(180 / 140 - 1) < abs(90 / 140 - 1) else 90 / 140)])
def test_octaves(spark, a, b, want):
    assert plan(spark, (a, "C major", 0.), (b, "C major", 0.))["stretch"] == pytest.approx(want)


def test_keys(spark):
    same = (100., "C major", 0.)
    assert plan(spark, same, (100., "A minor", 0.))["semitones"] == 0
    near = plan(spark, same, (100., "G major", 0.))
    assert near["semitones"] == 0 and near["feasible"] and "adjacent" in near["key_relation"]
    far = plan(spark, same, (100., "F# major", 0.))
    assert far["semitones"] == -6 and not far["feasible"] and far["reason"] == "pitch shift over limit"
    both = plan(spark, same, (130., "F# major", 0.))
    assert both["reason"] == "speed change over limit; pitch shift over limit"
    assert plan(spark, same, (0., "C major", 0.))["reason"] == "tempo unknown"


def test_circle_distance_is_symmetric_and_bounded(spark):
    d = spark.range(144).select(F.floor(F.col("id") / 12).cast("int").alias("a"), (F.col("id") % 12).cast("int").alias("b"))
    r = {(x["a"], x["b"]): x["d"] for x in d.select("a", "b", U.circle_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert all(r[(a, b)] == r[(b, a)] and 0 <= r[(a, b)] <= 6 for a, b in r) and r[(0, 7)] == 1 and r[(0, 6)] == 6 and r[(3, 3)] == 0


def test_bar_length_needs_three_downbeats(spark):
    d = spark.createDataFrame([("a", i, t) for i, t in enumerate([0., 2., 4.5])] + [("b", i, 2. * i) for i in range(2)], "track_id string, pos long, t double")
    assert {r["track_id"]: r["bar_seconds"] for r in M.bar_seconds(d).collect()} == {"a": 2.25, "b": 0}


@pytest.mark.parametrize("spread,k", [(40, 3), (3, 4)])
def test_ranking_equals_all_pairs(spark, spread, k):
    """Many equal tempos, unknown tempos and missing bars; every plan of every pair is the reference."""
    rnd = random.Random(spread)
    keys = [f"{p} {m}" for p in U.PITCHES for m in ("major", "minor")]
    rows = [(i, 0.0 if i % 11 == 3 else 60.0 + rnd.randint(0, spread), rnd.choice(keys), rnd.choice([0.0, 2.0, 2.0, 1.9, 4.1])) for i in range(70)]
    f = spark.createDataFrame(rows, FEATURES)
    all_pairs = spark.createDataFrame([(a[0], b[0]) for a in rows for b in rows if a[0] != b[0]], "base long, donor long")
    want = M.top_per_group(M.plan_mashup(all_pairs, f), ["base"], M.rank_order(), k)
    key = lambda df: sorted((r["base"], r["rank"], r["donor"], r["feasible"]) for r in df.collect())
    assert key(M.rank_candidates(f, k)) == key(want)


def test_choice(spark):
    f = spark.createDataFrame([(1, 100., "C major", 0.), (2, 101., "C major", 0.), (3, 150., "C major", 0.)], FEATURES)
    plans = M.rank_candidates(f, 2).drop("rank")
    assert {r["base"]: r["donor"] for r in M.choose_donor(plans).collect()} == {1: 2, 2: 1}
    asked = M.choose_donor(plans, spark.createDataFrame([(1, 3)], "base long, donor long"))
    r = asked.filter("base = 1").first()
    assert r["donor"] == 3 and "not feasible" in r["warning"]


def test_bars_are_aligned(spark):
    sr = 1000
    d = spark.createDataFrame([(1, i, .5 + 2.0 * i) for i in range(5)] + [(2, i, .2 + 2.1 * i + .05 * (i % 2)) for i in range(7)], "track_id long, pos long, t double")
    pairs = spark.createDataFrame([(1, 2)], "base long, donor long")
    bars = M.bar_rates(pairs, d, sr)
    assert bars.count() == 4 and bars.filter("pos = 0").first()["rate"] == pytest.approx(2.15 / 2)
    exact = bars.withColumn("out_samples", F.round(F.col("dst_seconds") * sr).cast("long"))
    heads = spark.createDataFrame([(1, 2, .2, .5)], "base long, donor long, src0 double, dst0 double")
    e = M.align_error(pairs, d, M.landings(exact, heads, sr)).first()
    assert e["n_bars"] == 5 and e["align_error_ms"] < 1e-6


def test_mix_is_scaled_only_when_it_clips(spark):
    s = lambda *v: spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "track_id string, i long, v double")
    soft = [r["v"] for r in M.mix(s(.1, .2, .3), s(.1, .1), 0.0).orderBy("i").collect()]
    assert soft == pytest.approx([.2, .3, .3])
    loud = [r["v"] for r in M.mix(s(1., .5), s(1., 0.), 0.0).orderBy("i").collect()]
    assert loud == pytest.approx([1, .25])


@pytest.mark.parametrize("k", [1, 3])
def test_lengths_that_tie_after_rounding(spark, k):
    """Bar lengths differ by rounding noise only, and the larger id is the closer one."""
    rows = [(i, 100.0 + i % 2, "C major", 2.0 + i % 2 / 2 - i * 4e-16 * (1 + i % 3)) for i in range(60)]
    rows += [(100 + i, 100.0, "C major", 3.0 + 8.88e-16 * (i % 5 < 4)) for i in range(12)]
    f = spark.createDataFrame(rows, FEATURES)
    all_pairs = spark.createDataFrame([(a[0], b[0]) for a in rows for b in rows if a[0] != b[0]], "base long, donor long")
    plans = M.plan_mashup(all_pairs, f)
    key = lambda d: sorted((r["base"], r["rank"], r["donor"]) for r in d.collect())
    assert key(M.rank_candidates(f, k)) == key(M.top_per_group(plans, ["base"], M.rank_order(), k))
    by_tempo = [F.round(F.abs(F.col("stretch") - 1), 9), F.col("donor")]
    got = M.top_per_group(M.plan_mashup(M.tempo_neighbours(f, k), f), ["base"], by_tempo, k)
    assert key(got) == key(M.top_per_group(plans, ["base"], by_tempo, k))
