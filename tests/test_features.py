import math

import pytest
from pyspark.sql import functions as F

from cadenza.operators import features as E
from cadenza.operators import labels as L
from cadenza.operators import sampling as S


def frames(spark, n=12, k=3):
    """Frame i of segment s holds (s, i)."""
    return spark.createDataFrame([("a", i, [float(i // k), float(i)]) for i in range(n)], "track_id string, frame int, vec array<double>")


def test_pooling(spark):
    f = frames(spark)
    assert E.pool(f).first()["vec"] == pytest.approx([1.5, 5.5]) and E.pool(f, "max").first()["vec"] == [3, 11]
    assert [r["vec"][1] for r in E.stride_pool(f, 5).orderBy("frame").collect()] == pytest.approx([2, 7])
    flat = f.withColumn("score", F.lit(1000.0))
    assert E.softmax_pool(flat).first()["vec"] == pytest.approx([1.5, 5.5])
    peak = f.withColumn("score", F.when(F.col("frame") == 4, 900.0).otherwise(-900.0))
    assert E.softmax_pool(peak).first()["vec"] == pytest.approx([1, 4])
    assert E.masked_mean(f.withColumn("ok", F.col("frame") < 2), "ok").first()["vec"] == pytest.approx([0, .5])
    assert E.masked_mean(f.withColumn("ok", F.lit(False)), "ok").first()["vec"] == [0, 0]
    with pytest.raises(ValueError):
        E.pool(f, "sum")


def test_segments(spark):
    m = E.segment_means(frames(spark), 4)
    assert [r["vec"][0] for r in m.orderBy("segment").collect()] == [0, 1, 2, 3]
    c = {r["combo"]: r["vec"][0] for r in E.combine_segments(m, E.COMBOS).collect()}
    assert c["s0+s3"] == 1.5 and c["s2"] == 2 and c["all4"] == 1.5 and len(c) == 9
    with pytest.raises(Exception, match="do not divide"):
        E.segment_means(frames(spark, 10), 4).collect()


def test_fusion(spark):
    s = spark.createDataFrame([("a", "drums", [1.0, 2.0]), ("a", "mix", [3.0, 4.0])], "track_id string, source string, vec array<double>")
    order = ("mix", "drums")
    assert E.fuse(s, "concat", order).first()["vec"] == [3, 4, 1, 2]
    assert E.fuse(s, "sum", order).first()["vec"] == [2, 3]
    w = math.e / (1 + math.e)
    assert E.fuse(s, "gate", order, {"mix": 1.0}).first()["vec"][0] == pytest.approx(3 * w + 1 - w)


def test_probe_finds_the_informative_layer(spark):
    rows = []
    for t in range(80):
        y = t % 2
        rows += [("validation" if t >= 60 else "train", t, 0, [float((t * 7) % 5), float((t * 3) % 7)]), ("validation" if t >= 60 else "train", t, 1, [2.0 * y + (t % 5) * .1, 1.0])]
    f = spark.createDataFrame(rows, "split string, track_id long, layer int, vec array<double>")
    lab = spark.createDataFrame([(t, "odd") for t in range(80) if t % 2] + [(t, "always") for t in range(80)], "track_id long, tag string")
    r = {x["layer"]: x for x in E.layer_probe(f, lab).collect()}
    assert r[1]["map"] == 1 and r[1]["roc_auc"] == 1 and r[1]["n_valid"] == 1      # the constant tag is skipped
    assert "best" in r[1]["mark"] and "last" in r[1]["mark"] and "worst" in r[0]["mark"] and r[0]["map"] < 1


def test_probes_reach_the_optimum_in_few_passes(spark, monkeypatch):
    """Two feature sets of different width, several tags: the gradient of every problem vanishes, whatever their number."""
    import numpy as np

    from cadenza.operators import probes as P

    rng = np.random.default_rng(2)
    feats, labels = [], []
    for t in range(120):
        split = "validation" if t % 4 == 3 else "train"
        feats += [("narrow", split, t, [float(x) for x in rng.normal(size=3)]), ("wide", split, t, [float(x) for x in rng.normal(size=20)] + [1.0])]
        labels += [(t, f"tag{k}") for k in range(12) if (t * (k + 3)) % 7 < 3] + [(t, "all")]
    f = spark.createDataFrame(feats, "name string, split string, track_id long, vec array<double>").repartition(3)
    lab = spark.createDataFrame(labels, "track_id long, tag string")
    calls = []
    plain = P._added_up
    monkeypatch.setattr(P, "_added_up", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(P, "FAN", 1)                                            # also adds up in groups
    _, sets, solved = P.fit_probes(f, "name", lab)
    assert len(solved) == 20 and len(calls) < 60 and {s.name for s in sets} == {"narrow", "wide"}
    positive = set(labels)
    for p in solved:
        rows = [(r[2], r[3]) for r in feats if r[0] == p.name and r[1] == "train"]
        x = np.array([v for _, v in rows])
        std = x.std(axis=0)
        x = np.hstack([(x - x.mean(axis=0)) / np.where(std > 0, std, 1), np.ones((len(x), 1))])
        y = np.array([float((t, p.tag) in positive) for t, _ in rows])
        g = x.T @ (1 / (1 + np.exp(-x @ p.weights)) - y) / len(x)
        g[:-1] += p.weights[:-1] / len(x)
        assert np.abs(g).max() < 1e-6 and p.n == len(x) and p.n_pos == y.sum()
    scores = P.probe_scores(f, "name", lab)
    assert scores.count() == 20 * 30 and scores.filter("score <= 0 OR score >= 1").count() == 0


def test_windows_and_starts(spark):
    n = spark.createDataFrame([(10,), (100,), (45,)], "n long")
    got = [tuple(r) for r in n.select(*S.pick_window(F.col("n"), 30, 60)).collect()]
    assert got == [(0, 10), (60, 90), (15, 45)]
    assert [tuple(r) for r in n.select(*S.center_window(F.col("n"), 30)).collect()] == [(0, 10, 20), (35, 65, 0), (7, 37, 0)]
    d = spark.createDataFrame([("a", 240.0), ("b", 20.0)], "track_id string, d double")
    st = {t: [r["start"] for r in S.segment_starts(d, "d", 30.0, 4).filter(F.col("track_id") == t).orderBy("segment").collect()] for t in "ab"}
    assert st == {"a": [0, 70, 140, 210], "b": [0, 0, 0, 0]}
    assert S.segment_starts(d, "d", 30.0, 1).orderBy("track_id").first()["start"] == 105


def test_samples_and_orders(spark):
    d = spark.range(50).withColumn("chunk", F.col("id") % 5)
    assert [r["id"] for r in S.equi_sample(d, 7, ["id"]).orderBy("id").collect()] == [0, 7, 14, 21, 28, 35, 42]
    o = S.epoch_order(d, 1, 0, 8, "id")
    rows = o.orderBy("position").collect()
    assert sorted(r["id"] for r in rows) == list(range(50)) and rows[-1]["batch"] == 6
    runs = [c for i, c in enumerate(r["chunk"] for r in rows) if i == 0 or c != rows[i - 1]["chunk"]]
    assert len(runs) == 5                                                          # a chunk's rows stay together
    assert [r["id"] for r in S.epoch_order(d, 1, 1, 8, "id").orderBy("position").collect()] != [r["id"] for r in rows]
    c = S.random_crop(d.withColumn("n", F.lit(40)), 3, 1, "n", 30, "id")
    assert c.agg(F.min("start"), F.max("start")).first()[1] <= 10 and c.select("start").distinct().count() > 5


def test_standardise_with_training_statistics(spark):
    f = spark.createDataFrame([("a", [1.0, 5.0]), ("b", [3.0, 5.0])], "track_id string, vec array<double>")
    z = L.standardise_by_dimension(f, L.dimension_stats(f)).orderBy("track_id").collect()
    assert [r["vec"] for r in z] == [[-1, 0], [1, 0]]
    s = L.norm_stats(f).first()
    assert s["mean"] == 3.5 and L.standardise(f, 3.5, 0.5).first()["vec"] == [-5, 3]
    with pytest.raises(ValueError):
        L.assert_frame_count(f, 2, 2)
