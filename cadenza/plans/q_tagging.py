"""Queries G01-G17: thresholds come from validation, reports from test."""

from pyspark.sql import functions as F

from cadenza.operators import tagging as T
from cadenza.plans import canonical as C
from cadenza.plans.registry import query, sql, view


def rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


# Reusable SQL: points, cumulative counts and per-tag metrics of model a on a split.
for _s in ("validation", "test"):
    view(f"s_{_s}", f"SELECT * FROM scores_a WHERE split = '{_s}'", "scores_a")
RANK_SQL = """SELECT tag, sum(tp) AS n_pos, sum(m) AS n, sum(tp) > 0 AND sum(tp) < sum(m) AS valid,
  CASE WHEN sum(tp) > 0 AND sum(tp) < sum(m) THEN sum(tp * (ctp / cm)) / sum(tp) ELSE 'nan'::DOUBLE END AS ap,
  CASE WHEN sum(tp) > 0 AND sum(tp) < sum(m) THEN 1 - sum(tp * ((cm - ctp) - (m - tp) / 2.0::DOUBLE)) / (sum(tp) * (sum(m) - sum(tp))) ELSE 'nan'::DOUBLE END AS auc
  FROM (SELECT *, sum(tp) OVER w AS ctp, CAST(sum(m) OVER w AS DOUBLE) AS cm FROM (
    SELECT tag, score, CAST(sum(y) AS DOUBLE) AS tp, count(*) AS m FROM {src} GROUP BY tag, score)
    WINDOW w AS (PARTITION BY tag ORDER BY score DESC)) GROUP BY tag"""
view("rank_test", RANK_SQL.format(src="s_test"), "s_test")
view("grid_f1", """SELECT tag, k / 100.0::DOUBLE AS t, 2.0::DOUBLE * sum(y) FILTER (score >= k / 100.0::DOUBLE) AS tp2,
  sum(y) AS pos, count(*) AS n, count(*) FILTER (score >= k / 100.0::DOUBLE) AS hit
  FROM s_validation, range(1, 100) g(k) GROUP BY tag, k""", "s_validation")
view("thresholds", """SELECT tag, CASE WHEN any_value(pos) > 0 AND any_value(pos) < any_value(n)
  THEN arg_min(t, (-coalesce(tp2 / (hit + pos), 0), t)) ELSE 0.5 END AS threshold FROM grid_f1 GROUP BY tag""", "grid_f1")
view("counts_test", """SELECT tag, sum(y) FILTER (score >= 0.5::DOUBLE) AS tp_d, count(*) FILTER (score >= 0.5::DOUBLE) - coalesce(sum(y) FILTER (score >= 0.5::DOUBLE), 0) AS fp_d,
  sum(y) FILTER (score < 0.5::DOUBLE) AS fn_d, sum(y) FILTER (score >= threshold) AS tp_t,
  count(*) FILTER (score >= threshold) - coalesce(sum(y) FILTER (score >= threshold), 0) AS fp_t, sum(y) FILTER (score < threshold) AS fn_t
  FROM s_test JOIN thresholds USING (tag) GROUP BY tag""", "s_test", "thresholds")
view("report", """SELECT r.*, split_part(tag, '---', 1) AS category, coalesce(tp_d, 0) AS tp_d, fp_d, coalesce(fn_d, 0) AS fn_d, coalesce(tp_t, 0) AS tp_t, fp_t, coalesce(fn_t, 0) AS fn_t,
  coalesce(2 * tp_d / (2.0::DOUBLE * tp_d + fp_d + fn_d), 0) AS f1_d, coalesce(2 * tp_t / (2.0::DOUBLE * tp_t + fp_t + fn_t), 0) AS f1_t
  FROM rank_test r JOIN counts_test USING (tag)""", "rank_test", "counts_test")
REPORT_COLS = """round(avg(auc) FILTER (valid), 6) AS roc_auc, round(avg(ap) FILTER (valid), 6) AS map,
  round(avg(f1_d) FILTER (valid), 6) AS macro_f1_default, round(avg(f1_t) FILTER (valid), 6) AS macro_f1_tuned,
  round(2 * sum(tp_d) FILTER (valid) / (2.0::DOUBLE * sum(tp_d) FILTER (valid) + sum(fp_d) FILTER (valid) + sum(fn_d) FILTER (valid)), 6) AS micro_f1_default,
  round(2 * sum(tp_t) FILTER (valid) / (2.0::DOUBLE * sum(tp_t) FILTER (valid) + sum(fp_t) FILTER (valid) + sum(fn_t) FILTER (valid)), 6) AS micro_f1_tuned,
  count(*) AS n_tags, count(*) FILTER (valid) AS n_valid_tags"""
REPORT = ["roc_auc", "map", "macro_f1_default", "macro_f1_tuned", "micro_f1_default", "micro_f1_tuned"]


def test_scores(spark, d):
    return C.scores(spark, d, split="test")


def thresholds(spark, d):
    return T.tune_thresholds(C.scores(spark, d, split="validation"))


@query("G01", sql("SELECT tag, sum(y) AS n_pos, count(*) AS n, sum(y) > 0 AND sum(y) < count(*) AS valid FROM doc_scores GROUP BY tag", "doc_scores"))
def g01(spark, d):
    return T.valid_tags(C.doc_scores(spark, d))


@query("G02", sql("SELECT tag, n_pos, round(ap, 6) AS ap FROM rank_test", "rank_test"))
def g02(spark, d):
    return rounded(T.per_tag_ap(test_scores(spark, d)), "ap")


@query("G03", sql("SELECT round(avg(auc) FILTER (valid), 6) AS roc_auc, count(*) FILTER (valid) AS n_valid FROM rank_test", "rank_test"))
def g03(spark, d):
    return rounded(T.macro_roc_auc(test_scores(spark, d)), "roc_auc")


@query("G04", sql("""c AS (SELECT tag, sum(y) AS n_pos, count(*) AS n, sum(y) > 0 AND sum(y) < count(*) AS valid,
  coalesce(sum(y) FILTER (score >= 0.5::DOUBLE), 0) AS tp, coalesce(sum(1 - y) FILTER (score >= 0.5::DOUBLE), 0) AS fp,
  coalesce(sum(y) FILTER (score < 0.5::DOUBLE), 0) AS fn FROM s_test GROUP BY tag)
SELECT *, round(coalesce(2 * tp / (2.0::DOUBLE * tp + fp + fn), 0), 6) AS f1 FROM c""", "s_test"))
def g04(spark, d):
    return rounded(T.per_tag_f1(test_scores(spark, d), 0.5), "f1")


@query("G05", sql("SELECT round(avg(ap) FILTER (valid), 6) AS map, count(*) FILTER (valid) AS n_valid FROM rank_test", "rank_test"))
def g05(spark, d):
    return rounded(T.macro_ap(test_scores(spark, d)), "map")


@query("G06", sql("""SELECT round(avg(f1_t) FILTER (valid), 6) AS macro_f1,
  round(2 * sum(tp_t) FILTER (valid) / (2.0::DOUBLE * sum(tp_t) FILTER (valid) + sum(fp_t) FILTER (valid) + sum(fn_t) FILTER (valid)), 6) AS micro_f1 FROM report""", "report"))
def g06(spark, d):
    return rounded(T.macro_micro_f1(test_scores(spark, d), thresholds(spark, d)), "macro_f1", "micro_f1")


@query("G07", sql("SELECT tag, threshold FROM thresholds", "thresholds"))
def g07(spark, d):
    return thresholds(spark, d)


@query("G08", sql(f"SELECT {REPORT_COLS} FROM report", "report"))
def g08(spark, d):
    return rounded(T.evaluate_tagging(test_scores(spark, d), thresholds(spark, d)), *REPORT)


@query("G09", sql(f"SELECT coalesce(category, 'all') AS category, {REPORT_COLS} FROM report GROUP BY GROUPING SETS ((), (category))", "report"))
def g09(spark, d):
    return rounded(T.evaluate_groups(test_scores(spark, d), thresholds(spark, d)), *REPORT)


@query("G10", sql("SELECT tag, n_pos, round(ap, 6) AS ap FROM (SELECT * FROM rank_test WHERE valid ORDER BY round(ap, 9), tag LIMIT 20)", "rank_test"))
def g10(spark, d):
    ap = T.per_tag_ap(test_scores(spark, d)).withColumn("ap", F.round("ap", 9))
    return rounded(T.hardest_tags(ap, 20), "ap")


view("lift_test", """SELECT tag, ap, n_pos, n_pos / n AS prevalence, ap / greatest(n_pos / n, 1e-9) AS lift, valid, v.n_train
  FROM rank_test JOIN vocab v USING (tag)""", "rank_test", "vocab")


@query("G11", sql("SELECT tag, n_pos, round(ap, 6) AS ap, round(prevalence, 6) AS prevalence, round(lift, 6) AS lift FROM lift_test", "lift_test"))
def g11(spark, d):
    return rounded(T.tag_lift(test_scores(spark, d)), "ap", "prevalence", "lift")


def lifts(spark, d):
    """Per-tag lift with the training frequency, rounded so equal values rank equally everywhere."""
    v = C.vocab(spark, d).select("tag", "n_train")
    return rounded(T.tag_lift(test_scores(spark, d)).join(v, "tag"), "ap", "lift").withColumn("log_n", F.log(F.col("n_train") + 1))


@query("G12", sql("""r AS (SELECT tag, round(ap, 6) AS ap, round(lift, 6) AS lift, n_train FROM lift_test WHERE valid),
k AS (SELECT rank() OVER (ORDER BY n_train) + (count(*) OVER (PARTITION BY n_train) - 1) / 2.0::DOUBLE AS rn,
  rank() OVER (ORDER BY ap) + (count(*) OVER (PARTITION BY ap) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (ORDER BY lift) + (count(*) OVER (PARTITION BY lift) - 1) / 2.0::DOUBLE AS rl FROM r),
c AS (SELECT 'ap' AS metric, corr(rn, ra) AS rho, count(*) AS n FROM k UNION ALL SELECT 'lift', corr(rn, rl), count(*) FROM k)
SELECT metric, round(rho, 6) AS rho, n, round(CASE WHEN n % 2 = 0
  THEN 1 - abs(rho) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow(1 - rho * rho, k)))
  ELSE 1 - 2 / pi() * (asin(abs(rho)) + abs(rho) * coalesce(list_sum(list_transform(range(0, (n - 2) // 2),
    lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow(1 - rho * rho, k + 0.5))), 0)) END, 6) AS p_value FROM c""", "lift_test"))
def g12(spark, d):
    """The SQL sums the Student-t probability for whole degrees of freedom term by term."""
    x = lifts(spark, d)
    one = lambda m: rounded(T.spearman_test(x, "log_n", m).select(F.lit(m).alias("metric"), "rho", "n", "p_value"), "rho", "p_value")
    return one("ap").unionByName(one("lift"))


@query("G13", sql("""r AS (SELECT tag, round(ap, 6) AS ap, n_train, ln(n_train + 1) AS x FROM lift_test WHERE valid),
l AS (SELECT regr_slope(ap, x) AS s, regr_intercept(ap, x) AS b FROM r)
SELECT tag, ap, n_train, round(ap - (x * s + b), 6) AS residual FROM r, l ORDER BY round(ap - (x * s + b), 6), tag LIMIT 10""", "lift_test"))
def g13(spark, d):
    res = T.frequency_residuals(lifts(spark, d)).select("tag", "ap", "n_train", F.round("residual", 6).alias("residual"))
    return res.orderBy("residual", "tag").limit(10)


@query("G14", sql("""SELECT split_part(tag, '---', 1) AS category, count(*) AS n_tags, round(avg(ap) FILTER (valid), 6) AS mean_ap,
  round(avg(lift) FILTER (valid), 6) AS mean_lift, round(avg(prevalence), 6) AS mean_prevalence FROM lift_test GROUP BY 1""", "lift_test"))
def g14(spark, d):
    return rounded(T.category_metrics(T.tag_lift(test_scores(spark, d))), "mean_ap", "mean_lift", "mean_prevalence")


@query("G15", sql("""p AS (SELECT track_id, tag, y, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS p FROM s_test JOIN thresholds USING (tag)),
base AS (SELECT tag, avg(p) AS base_fp FROM p WHERE y = 0 GROUP BY tag),
pairs AS (SELECT a.tag AS present, b.tag AS false_fire, count(*) AS n_present, count(*) FILTER (b.y = 0) AS support,
  coalesce(sum(b.p) FILTER (b.y = 0), 0) / nullif(count(*) FILTER (b.y = 0), 0)::DOUBLE AS fp, avg(b.y) AS cooccur
  FROM p a JOIN p b USING (track_id) WHERE a.y = 1 AND a.tag <> b.tag GROUP BY 1, 2)
SELECT present, false_fire, round(fp, 6) AS fp_given_present, round(base_fp, 6) AS base_fp, round(fp - base_fp, 6) AS excess,
  round(cooccur, 6) AS cooccur, support FROM pairs JOIN base ON base.tag = false_fire WHERE n_present >= 20 AND support >= 20""", "s_test", "thresholds"))
def g15(spark, d):
    return rounded(T.confusions(test_scores(spark, d), thresholds(spark, d)), "fp_given_present", "base_fp", "excess", "cooccur")


@query("G16", sql("""x AS (SELECT tag, y, (score - 0.5) * 8 AS x FROM doc_scores),
p AS (SELECT *, 1 / (1 + exp(-x)) AS p, (1 - y) * x + (1 + (3.0 - 1) * y) * (ln(1 + exp(-abs(x))) + greatest(-x, 0)) AS bce,
  (1 - y) * x + ln(1 + exp(-abs(x))) + greatest(-x, 0) AS ce FROM x),
q AS (SELECT *, p * y + (1 - p) * (1 - y) AS pt, least(1 - p + 0.05, 1) AS pn FROM p)
SELECT tag, round(avg(bce), 6) AS bce, round(avg(ce * pow(1 - pt, 2.0) * (0.25 * y + 0.75 * (1 - y))), 6) AS focal,
  round(avg(-(y * ln(greatest(p, 1e-8)) + (1 - y) * ln(greatest(pn, 1e-8))) * pow(1 - (p * y + pn * (1 - y)), 4.0 * (1 - y))), 6) AS asl
  FROM q GROUP BY tag""", "doc_scores"))
def g16(spark, d):
    x = C.doc_scores(spark, d).withColumn("logit", (F.col("score") - 0.5) * 8)
    return rounded(T.loss_metrics(x, ("tag",), pos_weight=3.0, gamma=2.0, alpha=0.25), "bce", "focal", "asl")


@query("G17", sql("""h AS (SELECT track_id AS run, pos + 1 AS epoch, strength AS val_map FROM beats),
b AS (SELECT *, val_map > coalesce(max(val_map) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better FROM h),
l AS (SELECT *, epoch - max(CASE WHEN better THEN epoch ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch) AS bad FROM b),
s AS (SELECT run, min(epoch) FILTER (bad >= 8) AS stop_epoch FROM l GROUP BY run)
SELECT run, max(epoch) AS best_epoch, max(val_map) AS best_map, any_value(stop_epoch) AS stop_epoch FROM l JOIN s USING (run)
  WHERE better AND (stop_epoch IS NULL OR epoch <= stop_epoch) GROUP BY run""", "beats"))
def g17(spark, d):
    h = C.beats(spark, d).select(F.col("track_id").alias("run"), (F.col("pos") + 1).alias("epoch"), F.col("strength").alias("val_map"))
    return T.best_epoch(h, 8)
