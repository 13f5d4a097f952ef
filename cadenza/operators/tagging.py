"""Multi-label metrics over a long table ``scores(tag, track_id, y, score)``.

Ranking metrics first collapse equal scores of a tag into one point, map-side, so ties are
handled once and the ordered scan sees each distinct score only once. A tag may hold any
share of the rows: ``Ordered`` slices it when it is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.core.common import DIMENSION_ROWS
from cadenza.core.ordered import Ordered
from cadenza.core.session import materialise
from cadenza.functions import losses
from cadenza.functions.student import correlation_p_value
from cadenza.operators.labels import category
from cadenza.operators.tagbits import pair_counts

NAN = float("nan")


def valid_tags(scores: DataFrame, by: tuple[str, ...] = ("tag",)) -> DataFrame:
    """A tag counts only with at least one positive and one negative."""
    return scores.groupBy(*by).agg(F.sum("y").alias("n_pos"), F.count("*").alias("n")).withColumn(
        "valid", (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")))


def ranking(scores: DataFrame, by: tuple[str, ...] = ("tag",), weight: Column | None = None) -> DataFrame:
    """Average precision and ROC-AUC per tag in one ordered pass; NaN for degenerate tags."""
    w = F.lit(1) if weight is None else weight
    # Written once: the scores may be expanded where they are read, and are not to be expanded again for the sizes.
    points = materialise(scores.groupBy(*by, "score").agg(F.sum(F.col("y") * w).alias("tp"), F.sum(w).alias("m")).filter("m > 0"), "points")
    o = Ordered(points, list(by), [F.desc("score")])
    o = o.add(ctp=("sum", F.col("tp")), cm=("sum", F.col("m")))
    tp, fp, ctp, cfp = F.col("tp"), F.col("m") - F.col("tp"), F.col("ctp"), F.col("cm") - F.col("ctp")
    s = o.result().groupBy(*by).agg(
        F.sum("tp").alias("n_pos"), F.sum("m").alias("n"),
        F.sum(tp * (ctp / F.col("cm"))).alias("_ap"), F.sum(tp * (cfp - fp / 2)).alias("_lost"))
    valid = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    pairs = F.col("n_pos") * (F.col("n") - F.col("n_pos"))
    return s.select(*by, "n_pos", "n", valid.alias("valid"),
                    F.when(valid, F.col("_ap") / F.col("n_pos")).otherwise(F.lit(NAN)).alias("ap"),
                    F.when(valid, 1 - F.col("_lost") / pairs).otherwise(F.lit(NAN)).alias("auc"))


def per_tag_ap(scores: DataFrame, by: tuple[str, ...] = ("tag",)) -> DataFrame:
    return ranking(scores, by).select(*by, "n_pos", "ap")


def _mean_valid(per_tag: DataFrame, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    v = F.avg(F.when(F.col("valid"), F.col(value)))
    return per_tag.groupBy(*by).agg(F.coalesce(v, F.lit(NAN)).alias(name), F.count_if("valid").alias("n_valid"))


def macro_ap(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _mean_valid(ranking(scores, (*by, "tag")), "ap", "map", by)


def macro_roc_auc(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _mean_valid(ranking(scores, (*by, "tag")), "auc", "roc_auc", by)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def _with_threshold(scores: DataFrame, thresholds: DataFrame | float, by: tuple[str, ...], default: float) -> DataFrame:
    if isinstance(thresholds, DataFrame):
        return scores.join(thresholds.select(*by, "threshold"), list(by), "left").withColumn(
            "threshold", F.coalesce("threshold", F.lit(default)))
    return scores.withColumn("threshold", F.lit(float(thresholds)))


def _counts(hit: Column, suffix: str = "") -> list[Column]:
    y, p = F.col("y"), hit.cast("int")
    return [F.sum(y * p).alias(f"tp{suffix}"), F.sum((1 - y) * p).alias(f"fp{suffix}"), F.sum(y * (1 - p)).alias(f"fn{suffix}")]


def per_tag_f1(scores: DataFrame, thresholds: DataFrame | float = 0.5, by: tuple[str, ...] = ("tag",)) -> DataFrame:
    """TP, FP, FN and F1 per tag with ``score >= threshold``."""
    s = _with_threshold(scores, thresholds, by, 0.5)
    c = s.groupBy(*by).agg(F.sum("y").alias("n_pos"), F.count("*").alias("n"), *_counts(F.col("score") >= F.col("threshold")))
    return c.select(*by, "n_pos", "n", ((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))).alias("valid"),
                    "tp", "fp", "fn", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def macro_micro_f1(scores: DataFrame, thresholds: DataFrame | float = 0.5) -> DataFrame:
    t = per_tag_f1(scores, thresholds).filter("valid")
    s = t.agg(F.coalesce(F.avg("f1"), F.lit(NAN)).alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return s.select("macro_f1", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("micro_f1"))


def macro_f1(scores: DataFrame, thresholds: DataFrame | float = 0.5) -> DataFrame:
    return macro_micro_f1(scores, thresholds).select("macro_f1")


def micro_f1(scores: DataFrame, thresholds: DataFrame | float = 0.5) -> DataFrame:
    return macro_micro_f1(scores, thresholds).select("micro_f1")


def tune_thresholds(scores: DataFrame, steps: int = 100, default: float = 0.5) -> DataFrame:
    """Best F1 threshold per tag over 1/steps .. (steps-1)/steps; the lowest one wins ties.

    One histogram of grid cells per tag replaces steps comparisons per row, so only
    tags x steps rows are shuffled. The result is written: thresholds are frozen.
    """
    s = F.col("score")
    guess = F.floor(s * steps)
    exact = guess + F.when(s >= (guess + 1) / F.lit(float(steps)), 1).when(s < guess / F.lit(float(steps)), -1).otherwise(0)
    cell = F.least(F.greatest(exact, F.lit(0)), F.lit(steps - 1)).cast("int")
    hist = scores.groupBy("tag", cell.alias("k")).agg(F.sum("y").alias("tp"), F.count("*").alias("m"))
    grid = hist.select("tag").distinct().select("tag", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))).alias("k"),
                                                F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("m"))
    cells = hist.unionByName(grid).groupBy("tag", "k").agg(F.sum("tp").alias("tp"), F.sum("m").alias("m"))
    down = W.partitionBy("tag").orderBy(F.desc("k"))          # at most `steps` rows per tag
    whole = W.partitionBy("tag")
    c = cells.select("tag", "k", F.sum("tp").over(down).alias("tp"), F.sum("m").over(down).alias("hit"),
                     F.sum("tp").over(whole).alias("pos"), F.sum("m").over(whole).alias("n")).filter("k > 0")
    score = f1(F.col("tp"), F.col("hit") - F.col("tp"), F.col("pos") - F.col("tp"))
    best = c.groupBy("tag").agg(F.max(F.struct(score.alias("f1"), (-F.col("k")).alias("k"))).alias("b"),
                                F.max("pos").alias("pos"), F.max("n").alias("n"))
    ok = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    return materialise(best.select("tag", F.when(ok, -F.col("b.k") / F.lit(float(steps))).otherwise(F.lit(default)).alias("threshold")), "thresholds")


def per_tag_report(scores: DataFrame, thresholds: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per tag: AP, AUC and the counts at 0.5 and at the tuned threshold."""
    by = ("tag", *extra)
    s = _with_threshold(scores, 0.5 if thresholds is None else thresholds, ("tag",), 0.5)
    counts = s.groupBy(*by).agg(*_counts(F.col("score") >= 0.5, "_d"), *_counts(F.col("score") >= F.col("threshold"), "_t"))
    return ranking(scores, by).join(counts, list(by))


def _report(per_tag: DataFrame, keys: list) -> DataFrame:
    on = lambda c: F.when(F.col("valid"), c)
    mean = lambda c: F.coalesce(F.avg(on(c)), F.lit(NAN))
    t = per_tag.withColumn("f1_d", f1(F.col("tp_d"), F.col("fp_d"), F.col("fn_d"))).withColumn(
        "f1_t", f1(F.col("tp_t"), F.col("fp_t"), F.col("fn_t")))
    grouped = t.groupingSets([[], keys], *keys) if keys else t.groupBy()
    total = lambda k: F.sum(on(F.col(k)))
    micro = lambda x: f1(total(f"tp{x}"), total(f"fp{x}"), total(f"fn{x}"))
    return grouped.agg(
        mean(F.col("auc")).alias("roc_auc"), mean(F.col("ap")).alias("map"),
        mean(F.col("f1_d")).alias("macro_f1_default"), mean(F.col("f1_t")).alias("macro_f1_tuned"),
        micro("_d").alias("micro_f1_default"), micro("_t").alias("micro_f1_tuned"),
        F.count("*").alias("n_tags"), F.count_if("valid").alias("n_valid_tags"))


def evaluate_tagging(scores: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    return _report(per_tag_report(scores, thresholds), [])


def evaluate_groups(scores: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """The same row per category and over all tags (category 'all')."""
    t = per_tag_report(scores, thresholds).withColumn("category", category())
    return _report(t, ["category"]).withColumn("category", F.coalesce("category", F.lit("all")))


def hardest_tags(per_tag: DataFrame, k: int = 20) -> DataFrame:
    return per_tag.filter(~F.isnan("ap")).orderBy("ap", "tag").limit(k)


def tag_lift(scores: DataFrame) -> DataFrame:
    """AP relative to prevalence, the value of random scores."""
    r = ranking(scores)
    prevalence = F.col("n_pos") / F.col("n")
    return r.select("tag", "ap", "n_pos", prevalence.alias("prevalence"),
                    (F.col("ap") / F.greatest(prevalence, F.lit(1e-9))).alias("lift"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ascending ranks, ties averaged."""
    points = df.groupBy(value).agg(F.count("*").alias("_n"))
    r = Ordered(points, [], [value]).add(_b=("sum_before", F.col("_n"))).result()
    return df.join(r.select(value, (F.col("_b") + (F.col("_n") + 1) / 2).alias(name)), value)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, n) of two columns; rows with NULL or NaN are left out."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(x, y)
    ranked = average_ranks(average_ranks(ok, x, "_rx"), y, "_ry")
    return ranked.agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def spearman_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, n, p_value): the one row of ``spearman`` with its two-sided Student-t probability."""
    r = spearman(df, x, y).first()
    p = float("nan") if r["rho"] is None else correlation_p_value(r["rho"], r["n"])
    return df.sparkSession.createDataFrame([(r["rho"], r["n"], p)], "rho double, n long, p_value double")


def frequency_residuals(per_tag: DataFrame) -> DataFrame:
    """Residual of AP after regressing on log(training frequency + 1)."""
    x = per_tag.filter(~F.isnan("ap")).withColumn("log_n", F.log(F.col("n_train") + 1))
    line = x.agg(F.regr_slope("ap", "log_n").alias("slope"), F.regr_intercept("ap", "log_n").alias("base")).first()
    slope, base = (line["slope"] or 0.0), (line["base"] or 0.0)
    return x.withColumn("residual", F.col("ap") - (F.col("log_n") * F.lit(slope) + F.lit(base)))


def residual_hard(per_tag: DataFrame, k: int = 10) -> DataFrame:
    return frequency_residuals(per_tag).orderBy("residual", "tag").limit(k)


def category_metrics(lifts: DataFrame) -> DataFrame:
    ok = ~F.isnan("ap")
    return lifts.withColumn("category", category()).groupBy("category").agg(
        F.count("*").alias("n_tags"), F.avg(F.when(ok, F.col("ap"))).alias("mean_ap"),
        F.avg(F.when(ok, F.col("lift"))).alias("mean_lift"), F.avg("prevalence").alias("mean_prevalence"))


def confusions(scores: DataFrame, thresholds: DataFrame | float = 0.5, min_support: int = 20) -> DataFrame:
    """Excess false positives: how much more often tag j fires wrongly when tag i is present.

    A track's row of tags is bounded by the vocabulary and travels as small numbers. Tasks count the pairs of their tracks as matrix
    products of tags by tags, so no pair is expanded and only these counts are summed.
    """
    s = _with_threshold(scores, thresholds, ("tag",), 0.5).withColumn("p", (F.col("score") >= F.col("threshold")).cast("int"))
    base = materialise(s.groupBy("tag").agg(F.avg(F.when(F.col("y") == 0, F.col("p"))).alias("base_fp")), "base-fp")
    tags = sorted(r["tag"] for r in base.select("tag").limit(DIMENSION_ROWS + 1).collect())
    if len(tags) > DIMENSION_ROWS:
        raise ValueError(f"more than {DIMENSION_ROWS} tags")
    names = s.sparkSession.createDataFrame(list(enumerate(tags)), "t int, tag string")
    coded = s.join(F.broadcast(names), "tag").select("track_id", (F.col("t") * 4 + F.col("y") * 2 + F.col("p")).cast("int").alias("c"))
    rows = coded.groupBy("track_id").agg(F.collect_list("c").alias("c")).select("c")
    agg = rows.mapInArrow(pair_counts(len(tags)), "i int, j int, n_present long, support long, fires long, positive long").groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n_present", "support", "fires", "positive")])
    kept = agg.filter((F.col("i") != F.col("j")) & (F.col("n_present") >= min_support) & (F.col("support") >= min_support))
    kept = kept.join(F.broadcast(names.select(F.col("t").alias("i"), F.col("tag").alias("present"))), "i").join(
        F.broadcast(names.select(F.col("t").alias("j"), F.col("tag").alias("false_fire"))), "j")
    fp = F.col("fires") / F.col("support")
    return kept.join(base.withColumnRenamed("tag", "false_fire"), "false_fire").select(
        "present", "false_fire", fp.alias("fp_given_present"), "base_fp", (fp - F.col("base_fp")).alias("excess"),
        (F.col("positive") / F.col("n_present")).alias("cooccur"), "support")


def loss_metrics(logits: DataFrame, by: tuple[str, ...] = (), pos_weight: float = 1.0, gamma: float = 2.0,
                 alpha: float | None = None) -> DataFrame:
    x, y = F.col("logit"), F.col("y").cast("double")
    return logits.groupBy(*by).agg(F.avg(losses.bce(x, y, pos_weight)).alias("bce"),
                                   F.avg(losses.focal(x, y, gamma, alpha)).alias("focal"),
                                   F.avg(losses.asymmetric(x, y)).alias("asl"))


def best_epoch(history: DataFrame, patience: int) -> DataFrame:
    """Replay early stopping: (run, best_epoch, best_map, stop_epoch); NULL stop when never triggered."""
    o = Ordered(history, ["run"], ["epoch"]).add(_top=("max_before", F.col("val_map")), _row=("row", None))
    better = F.col("val_map") > F.coalesce("_top", F.lit(-1.0))
    o = o.add(_hit=("last", F.when(better, F.col("_row"))))
    rows = o.result().withColumn("_better", better).withColumn("_bad", F.col("_row") - F.coalesce("_hit", F.lit(0)))
    stop = rows.groupBy("run").agg(F.min(F.when(F.col("_bad") >= patience, F.col("epoch"))).alias("stop_epoch"))
    seen = rows.join(stop, "run").filter(F.col("_better") & (F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch"))))
    return seen.groupBy("run").agg(F.max("epoch").alias("best_epoch"), F.max("val_map").alias("best_map"), F.max("stop_epoch").alias("stop_epoch"))
