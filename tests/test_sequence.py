import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import music as U
from cadenza.operators import joins as J
from cadenza.operators import sequence as Q

BEATS = "track_id string, pos long, t double, strength double"


def beats(spark, times, strength=None, track="a"):
    return spark.createDataFrame([(track, i, float(t), float(strength[i]) if strength else 1.0) for i, t in enumerate(times)], BEATS)


def test_gaussian_beat_accuracy(spark):
    from math import exp

    rows = lambda ts: spark.createDataFrame([(k, float(t)) for k, v in ts.items() for t in v], "track_id long, t double")
    ref, est = {1: [6, 7, 8], 2: [6, 7], 3: [6, 7], 4: [1, 2]}, {1: [6, 7, 8], 2: [6.04, 7.02, 7.5, 9], 4: [6]}
    for limit in (None, "2"):
        if limit:
            spark.conf.set("spark.cadenza.groupRows", limit)
        try:
            got = {r["track_id"]: r["cemgil"] for r in Q.beat_cemgil(rows(ref), rows(est)).collect()}
        finally:
            spark.conf.unset("spark.cadenza.groupRows")
        assert got == pytest.approx({1: 1.0, 2: (exp(-.5) + exp(-.125)) / 3, 3: 0.0, 4: 0.0})


def test_downbeat_phase(spark):
    r = Q.downbeat_phase(beats(spark, range(8), [1, 5, 1, 1, 1, 5, 1, 1])).first()
    assert r["phase"] == 1 and r["confidence"] == pytest.approx(10 / 4)
    z = Q.downbeat_phase(beats(spark, range(8), [0] * 8))
    assert (z.first()["phase"], z.first()["confidence"]) == (0, 1.0)
    tie = Q.downbeat_phase(beats(spark, range(8), [1, 3, 3, 1, 1, 3, 3, 1])).first()
    assert tie["phase"] == 1
    assert [r["t"] for r in Q.downbeats(beats(spark, range(8)), z).orderBy("t").collect()] == [0, 4]


def test_beats_are_extended_to_both_ends(spark):
    dur = spark.createDataFrame([("a", 4.0)], "track_id string, duration double")
    out = Q.extend_beats(beats(spark, [1.0, 1.5, 2.0, 2.5]), dur)
    assert [round(r["t"], 9) for r in out.orderBy("t").collect()] == [0, .5, 1, 1.5, 2, 2.5, 3, 3.5]
    assert out.filter("NOT added").count() == 4
    assert Q.extend_beats(beats(spark, [1.0]), dur).count() == 1


def test_onset_lookup_is_clipped(spark):
    onset = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "track_id string, frame long, strength double")
    b = beats(spark, [0.0, 0.05, 99.0]).drop("strength")
    assert [r["strength"] for r in Q.beat_strength(b, onset, 22050).orderBy("t").collect()] == [0, 2, 4]


@pytest.mark.parametrize("k,want", [(1, [1, 2, 1, 1, 2, 2, 3, 9]), (3, [1, 1, 1, 1, 2, 2, 2, 9]), (5, [1, 2, 1, 2, 1, 2, 3, 9])])
def test_mode_smoothing(spark, k, want):
    d = spark.createDataFrame([("a", i, c) for i, c in enumerate([1, 2, 1, 1, 2, 2, 3, 9])], "track_id string, pos long, cls int")
    assert [r["cls"] for r in Q.mode_smooth(d, k).orderBy("pos").collect()] == want


def test_runs_merge_with_mean_confidence(spark):
    d = spark.createDataFrame([("a", i, float(i), l, c) for i, (l, c) in enumerate([("F", .5), ("F", .7), ("C", .9), ("F", .4)])],
                              "track_id string, pos long, t double, label string, confidence double")
    got = [(r["start"], r["end"], r["label"], round(r["confidence"], 6)) for r in Q.merge_runs(d).orderBy("start").collect()]
    assert got == [(0, 2, "F", .6), (2, 3, "C", .9)]


def test_key_of_a_scale(spark):
    for key, tonic, profile in (("A minor", 9, "minor"), ("G major", 7, "major")):
        v = [U.KEY_PROFILES[profile][(i - tonic) % 12] for i in range(12)]
        c = spark.createDataFrame([("a", f, i, x) for f in range(2) for i, x in enumerate(v)], "track_id string, frame int, pc int, v double")
        r = Q.estimate_key(Q.chroma_mean(c)).first()
        assert r["key"] == key and r["correlation"] == pytest.approx(1) and r["margin"] > 0
    assert r["relative_alternative"] == "E minor"
    flat = spark.createDataFrame([("a", 0, i, 1.0) for i in range(12)], "track_id string, frame int, pc int, v double")
    assert Q.estimate_key(Q.chroma_mean(flat)).first()["correlation"] is None


def test_chord_templates(spark):
    sync = spark.createDataFrame([("a", p, pc, 1.0) for p, pcs in enumerate([(9, 0, 4), (5, 9, 0), (0, 4, 7)]) for pc in pcs], "track_id string, piece long, pc int, v double")
    assert [r["label"] for r in Q.chord_per_beat(sync).orderBy("piece").collect()] == ["Am", "F", "C"]
    t = Q.triad_templates(spark).collect()
    assert len(t) == 24 and all(sum(x * x for x in r["template"]) == pytest.approx(1) for r in t)


def test_labels_and_tempo(spark):
    d = spark.createDataFrame([("Am",), ("F",), ("C#m",), ("N",), ("",), ("X",)], "l string")
    assert [r[0] for r in d.select(U.to_eval_label(F.col("l"))).collect()] == ["A:min", "F:maj", "C#:min", "N", "N", "N"]
    assert spark.range(1).select(U.tempo_candidates(F.lit(96.004))).first()[0] == [48.0, 96.0, 192.01]


def spans(spark, rows):
    return spark.createDataFrame([("a", float(s), float(e), l) for s, e, l in rows], "track_id string, start double, end double, label string")


def test_weighted_accuracy(spark):
    ref = spans(spark, [(0, 2, "Am"), (2, 4, "F"), (100, 300, "C")])
    est = spans(spark, [(1, 3, "Am"), (3, 4, "F"), (100, 200, "C"), (200, 300, "N")])
    r = Q.weighted_accuracy(ref, est).first()
    # Both leave 4..100 uncovered, which counts as "no chord" on both sides.
    assert r["weighted_accuracy"] == pytest.approx((1 + 0 + 1 + 96 + 100) / 299) and r["overlap_seconds"] == 299
    half = Q.weighted_accuracy(spans(spark, [(0, 8, "C")]), spans(spark, [(0, 2, "C"), (6, 8, "C")])).first()
    assert half["weighted_accuracy"] == 0.5 and half["overlap_seconds"] == 8
    assert Q.weighted_accuracy(ref, spans(spark, [(400, 500, "C")])).first()["weighted_accuracy"] == 0


def test_interval_overlap_reports_each_pair_once(spark):
    a, b = spans(spark, [(0, 1000, "x"), (10, 130, "y")]), spans(spark, [(5, 600, "p"), (600, 601, "q")])
    for bucket in (7.0, 60.0, 5000.0):
        got = {(r["ref_label"], r["est_label"], r["start"], r["end"]) for r in J.interval_overlap(a, b, bucket=bucket).collect()}
        assert got == {("x", "p", 5, 600), ("x", "q", 600, 601), ("y", "p", 10, 130)}


def test_asof_and_pieces(spark):
    t = spark.createDataFrame([("a", 1.0, "v"), ("a", 2.0, "w")], "track_id string, t double, label string")
    p = spark.createDataFrame([("a", x) for x in (.5, 1.0 - 5e-7, 1.5, 2.0)], "track_id string, t double")
    got = [(r["label"], r["n_passed"]) for r in J.asof(p, t, "label").orderBy("t").collect()]
    assert got == [(None, 0), ("v", 1), ("v", 1), ("w", 2)]
    assert [r["piece"] for r in J.frames_to_beats(p, t).orderBy("t").collect()] == [0, 0, 1, 2]
    assert [r["piece"] for r in J.frames_to_beats(p.filter("t > 1.2"), t).orderBy("t").collect()] == [0, 1]


def brute_match(ref, est, tol):
    i = j = n = 0
    ref, est = sorted(ref), sorted(est)
    while i < len(ref) and j < len(est):
        if abs(ref[i] - est[j]) <= tol:
            i, j, n = i + 1, j + 1, n + 1
        elif ref[i] < est[j]:
            i += 1
        else:
            j += 1
    return n


def test_tolerance_join_is_one_to_one_and_maximal(spark):
    rnd = random.Random(2)
    ref, est = [rnd.uniform(0, 6) for _ in range(60)], [rnd.uniform(0, 6) for _ in range(70)]
    m = J.match_within(beats(spark, ref), beats(spark, est)).collect()
    assert len(m) == brute_match(ref, est, .07) == len({r["ref_t"] for r in m}) == len({r["est_t"] for r in m})
    assert all(abs(r["ref_t"] - r["est_t"]) <= .07 for r in m)


def test_beat_f_measure(spark):
    t = [5 + .5 * i for i in range(20)]
    f = lambda a, b: Q.beat_f_measure(beats(spark, a), beats(spark, b)).first()["f_measure"]
    assert f(t, t) == 1 and f(t, [x + .05 for x in t]) == 1 and f(t, [x + .2 for x in t]) == 0
    assert f(t, t[::2]) == pytest.approx(2 * 10 / 30)
    assert f(t, [1.0, 2.0]) == 0


def test_sections(spark):
    c = [0] * 10 + [1] * 2 + [0] * 10 + [2] * 10
    b = beats(spark, range(32)).withColumn("cluster", F.element_at(F.lit(c), (F.col("pos") + 1).cast("int")))
    dur = spark.createDataFrame([("a", 33.0)], "track_id string, duration double")
    got = [(r["start"], r["end"], r["label"], r["cluster"]) for r in Q.merge_sections(b, dur).orderBy("start").collect()]
    assert got == [(0, 12, "intro", 0), (12, 22, "A", 0), (22, 33, "outro", 2)]
    two = [(r["label"]) for r in Q.merge_sections(b.filter("pos < 12"), dur).orderBy("start").collect()]
    assert two == ["A", "B"]
    assert [(r["start"], r["end"], r["label"]) for r in Q.merge_sections(b.filter("pos < 7"), dur).collect()] == [(0, 33, "A")]


def test_affinity_band(spark):
    sync = spark.createDataFrame([("a", p, p % 3, 1.0) for p in range(9)], "track_id string, piece long, pc int, v double")
    a = {(r["a"], r["b"]): r["affinity"] for r in Q.beat_affinity(sync, 2).collect()}
    top = max(a.values())
    assert all(a[(i, i + 1)] == top == a[(i + 1, i)] for i in range(8)) and (0, 3) in a


def test_long_documents_continue_in_parts(spark, monkeypatch):
    monkeypatch.setattr(Q, "PART", 4)
    b = beats(spark, range(10))
    head = spark.createDataFrame([("a", 96.004, "A minor", 10.0)], "track_id string, bpm double, key string, duration double")
    c = spark.createDataFrame([("a", 0, 0.0, 10.0, "Am", .5)], "track_id string, pos long, start double, end double, label string, confidence double")
    s = spark.createDataFrame([("a", 0, 0.0, 10.0, "A", 0)], "track_id string, pos long, start double, end double, label string, cluster int")
    doc = Q.analysis_document(head, b, b.filter("pos % 4 = 0"), c, s).orderBy("part").collect()
    assert [len(r["beats"]) for r in doc] == [4, 4, 2] and doc[0]["bpm"] == 96.0 and doc[1]["chords"] is None


@pytest.mark.parametrize("limit", [4096, 3])
def test_chroma_of_pieces_as_arrays(spark, limit):
    """The medians of whole frames are those of their twelve tones, NULL and NaN included, and no frame becomes twelve rows."""
    rnd = random.Random(2)
    value = lambda: rnd.choice([None, float("nan"), rnd.random(), rnd.random(), .5])
    rows = [(t, p, [value() if pc != 4 else None for pc in range(12)]) for t in range(3) for p in range(4) for _ in range(rnd.randint(1, 6))]
    frames = spark.createDataFrame(rows, "track_id long, piece long, chroma array<double>")
    long = Q.beat_sync(frames.select("track_id", "piece", F.posexplode("chroma").alias("pc", "v")))
    want = {(r["track_id"], r["piece"], r["pc"]): r["v"] for r in long.collect()}
    packed = Q.chroma_sync(frames, limit)
    got = {(r["track_id"], r["piece"], i): v for r in packed.collect() for i, v in enumerate(r["chroma"]) if v is not None}
    assert got == pytest.approx(want) and packed.count() == 12
    as_rows = lambda d: sorted(map(tuple, d.collect()))
    one, two = Q.chord_per_beat(packed).join(long.select("track_id", "piece").distinct(), ["track_id", "piece"], "left_semi"), Q.chord_per_beat(long)
    assert as_rows(one) == as_rows(two)
    if limit > 6:
        assert "Generate" not in packed._jdf.queryExecution().optimizedPlan().toString()
