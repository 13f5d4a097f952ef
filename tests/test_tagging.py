import math
import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import losses
from cadenza.functions.student import correlation_p_value
from cadenza.operators import labels as L
from cadenza.operators import sampling as S
from cadenza.operators import tagging as T

SCHEMA = "track_id long, tag string, y int, score double"


def separable(spark):
    """100 rows, two tags: frequent tag scored .9/.1, rare tag .45/.05."""
    rows = [(i, "a---t0", int(i < 50), .9 if i < 50 else .1) for i in range(100)]
    rows += [(i, "b---t1", int(i < 5), .45 if i < 5 else .05) for i in range(100)]
    return spark.createDataFrame(rows, SCHEMA)


def test_separable_scores(spark):
    s = separable(spark)
    th = T.tune_thresholds(s)
    r = T.evaluate_tagging(s, th).first()
    assert r["map"] == 1 and r["roc_auc"] == 1 and r["n_tags"] == 2 and r["n_valid_tags"] == 2
    assert r["macro_f1_default"] == .5 and r["macro_f1_tuned"] == 1
    assert {x["tag"]: x["threshold"] for x in th.collect()} == {"a---t0": .11, "b---t1": .06}
    assert {x["category"]: x["macro_f1_default"] for x in T.evaluate_groups(s, th).collect()} == {"a": 1, "b": 0, "all": .5}


def test_ties_and_degenerate_tags(spark):
    rows = [(i, "t---tie", int(i < 3), .5) for i in range(10)] + [(i, "t---none", 0, .3) for i in range(10)] + [(i, "t---all", 1, .3) for i in range(10)]
    r = {x["tag"]: x for x in T.ranking(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert r["t---tie"]["ap"] == pytest.approx(.3) and r["t---tie"]["auc"] == pytest.approx(.5)
    assert math.isnan(r["t---none"]["ap"]) and math.isnan(r["t---all"]["auc"])
    s = spark.createDataFrame(rows, SCHEMA)
    assert T.macro_ap(s).first()["n_valid"] == 1
    th = {x["tag"]: x["threshold"] for x in T.tune_thresholds(s).collect()}
    assert th["t---none"] == .5 and th["t---all"] == .5
    assert T.hardest_tags(T.per_tag_ap(s)).count() == 1


def brute_ap(rows):
    pos, ap, tp, n = sum(y for y, _ in rows), 0.0, 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        here = [y for y, x in rows if x == s]
        tp, n = tp + sum(here), n + len(here)
        ap += sum(here) / pos * tp / n
    return ap


def brute_threshold(rows):
    best, where = -1.0, .5
    for k in range(1, 100):
        t = k / 100
        tp = sum(y for y, s in rows if s >= t)
        fp, fn = sum(1 - y for y, s in rows if s >= t), sum(y for y, s in rows if s < t)
        f = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        if f > best:
            best, where = f, t
    return where


def test_ranking_and_thresholds_against_brute_force(spark):
    rnd = random.Random(1)
    data = {t: [(int(rnd.random() < p), round(rnd.random(), 2)) for _ in range(120)] for t, p in (("x", .1), ("y", .5), ("z", .9))}
    s = spark.createDataFrame([(i, t, y, x) for t, v in data.items() for i, (y, x) in enumerate(v)], SCHEMA)
    got = {r["tag"]: r for r in T.ranking(s).collect()}
    th = {r["tag"]: r["threshold"] for r in T.tune_thresholds(s).collect()}
    for t, v in data.items():
        auc = [(a > b) + (a == b) / 2 for y, a in v if y for z, b in v if not z]
        assert got[t]["ap"] == pytest.approx(brute_ap(v)) and got[t]["auc"] == pytest.approx(sum(auc) / len(auc))
        assert th[t] == pytest.approx(brute_threshold(v))


def test_random_scores_have_lift_near_one(spark):
    base = spark.range(20000).select(F.col("id").alias("track_id"), F.explode(F.lit([.05, .2, .5])).alias("p"))
    s = base.select("track_id", F.concat(F.lit("t---"), F.col("p")).alias("tag"), (S.md5_uniform("y", F.col("track_id"), F.col("p")) < F.col("p")).cast("int").alias("y"),
                    S.md5_uniform("s", F.col("track_id"), F.col("p")).alias("score"))
    assert all(.9 < r["lift"] < 1.15 for r in T.tag_lift(s).collect())


def test_random_baseline_is_prevalence(spark):
    lab = spark.range(2000).select(F.col("id").alias("track_id"), F.lit("t").alias("tag"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    r = S.random_baseline(lab, 5).first()
    assert r["n_trials"] == 5 and .08 < r["map"] < .14


def test_losses(spark):
    d = spark.createDataFrame([(x, y) for x in (-800., -2., 0., 3., 800.) for y in (0., 1.)], "logit double, y double")
    for r in d.select("*", losses.bce(F.col("logit"), F.col("y")).alias("b"), losses.focal(F.col("logit"), F.col("y"), 0.0).alias("f"),
                      losses.asymmetric(F.col("logit"), F.col("y"), 0.0, 0.0, 0.0).alias("a")).collect():
        assert math.isfinite(r["b"]) and r["f"] == pytest.approx(r["b"])
        if abs(r["logit"]) < 10:
            p = 1 / (1 + math.exp(-r["logit"]))
            assert r["b"] == pytest.approx(-math.log(p if r["y"] else 1 - p)) and r["a"] == pytest.approx(r["b"], abs=1e-6)


def test_confusions_and_min_support(spark):
    rows = []
    for i in range(60):
        rock, guitar = int(i < 30), int(i % 2)
        rows += [(i, "g---rock", rock, .9 * rock), (i, "i---guitar", guitar, .8 if rock else .1)]
    c = {(r["present"], r["false_fire"]): r for r in T.confusions(spark.createDataFrame(rows, SCHEMA), .5, 10).collect()}
    r = c[("g---rock", "i---guitar")]
    assert r["fp_given_present"] == 1 and r["base_fp"] == .5 and r["excess"] == .5 and r["support"] == 15 and r["cooccur"] == .5
    assert T.confusions(spark.createDataFrame(rows, SCHEMA), .5, 40).count() == 0


def test_early_stop_replay(spark):
    h = spark.createDataFrame([("r", e, v) for e, v in enumerate([.1, .3, .2, .3, .1, .9], 1)] + [("s", e, v) for e, v in enumerate([.1, .2, .3], 1)], "run string, epoch int, val_map double")
    got = {r["run"]: r for r in T.best_epoch(h, 3).collect()}
    assert (got["r"]["best_epoch"], got["r"]["stop_epoch"]) == (2, 5)      # an equal value is no improvement
    assert (got["s"]["best_epoch"], got["s"]["stop_epoch"]) == (3, None)


def test_correlation_p_value():
    assert correlation_p_value(0.5, 27) == pytest.approx(0.00791, abs=1e-4)
    assert correlation_p_value(-0.632, 10) == pytest.approx(0.05, abs=1e-3)
    assert correlation_p_value(0.0, 50) == pytest.approx(1.0)


def planted(spark):
    rows = []
    for i in range(1000):
        tags = (["c", "p"] if i < 100 else ["p"] if i < 500 else []) + (["x", "y"] if i % 3 == 0 else []) + (["z"] if i == 7 else [])
        rows.append(("train" if i < 900 else "test", str(i), tags))
    return spark.createDataFrame(rows, "split string, track_id string, tags array<string>")


def test_rules_are_mined_and_propagated(spark):
    t = planted(spark)
    rules = L.mine_rules(L.long_labels(t.filter("split = 'train'"))).select("a", "b")
    assert [tuple(r) for r in rules.collect()] == [("c", "p")]
    chain = spark.createDataFrame([("z", "c"), ("c", "p"), ("p", "c")], "a string, b string")
    lab = spark.createDataFrame([("train", "1", "z"), ("train", "2", "x"), ("test", "3", "z")], "split string, track_id string, tag string")
    out = {(r["track_id"], r["tag"]) for r in L.propagate(lab, chain, L.vocab(t)).collect()}
    assert out == {("1", "z"), ("1", "c"), ("1", "p"), ("2", "x"), ("3", "z")}
    with pytest.raises(ValueError):
        L.propagate(lab, spark.createDataFrame([("z", "typo")], "a string, b string"), L.vocab(t))
    assert L.semantic_rules(spark).count() == 5


def test_encode_and_statistics(spark):
    t = spark.createDataFrame([("1", ["g---a", "g---a", "i---b"], 3600.), ("2", ["g---a", "m---new"], 1800.)], "track_id string, tags array<string>, duration double")
    voc = spark.createDataFrame([("g---a", 0, "g", 2), ("i---b", 1, "i", 1)], "tag string, idx int, category string, n_train long")
    y = {(r["track_id"], r["tag"]): r["y"] for r in L.encode(t, voc).collect()}
    assert y == {("1", "g---a"): 1, ("1", "i---b"): 1, ("2", "g---a"): 1, ("2", "i---b"): 0}
    assert L.encode(t, voc.limit(0)).count() == 0
    s = L.tag_statistics(t, voc).first()
    assert s["tags_per_track"] == 2.5 and s["n_tags"] == 2 and s["total_hours"] == 1.5 and s["head10pct_share"] == pytest.approx(.75)
    assert L.leakage(t.withColumn("split", F.lit("train")).unionByName(t.withColumn("split", F.lit("test"))), ("track_id",)).first()["n_shared"] == 2
    with pytest.raises(ValueError):
        L.assert_vocab(voc, voc.withColumn("idx", 1 - F.col("idx")))
