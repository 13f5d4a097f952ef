"""Queries D01-D09, E06-E07, E10-E17, P12-P16, P18-P21."""

from pyspark.sql import functions as F

from cadenza.operators import separation as S
from cadenza.operators import signal as G
from cadenza.plans import canonical as C
from cadenza.plans.q_tagging import rounded
from cadenza.plans.registry import query, sql, view

FLAGS = ("A", "N", "R")
TYPES = ("click", "error", "purchase", "signup", "view")

view("usdr", """SELECT track_id, stem, 10 * log10((sum(ref * ref) + 1e-7) / (sum((ref - est) * (ref - est)) + 1e-7)) AS usdr
  FROM samples GROUP BY ALL""", "samples")
view("cdr", """SELECT *, ref - avg(ref) OVER w AS r, est - avg(est) OVER w AS e FROM samples WINDOW w AS (PARTITION BY track_id, stem)""", "samples")
view("blocks", """SELECT track_id, stem, i // 16 AS block, 10 * log10((sum(ref * ref) + 1e-7) / (sum((ref - est) * (ref - est)) + 1e-7)) AS value
  FROM samples GROUP BY ALL""", "samples")


def stereo(spark, d):
    """samples(track_id, stem, ch, i, v): even and odd lines as two channels."""
    return C.sample_rows(spark, d).select("track_id", "stem", (F.col("i") % 2).cast("int").alias("ch"),
                                          F.floor(F.col("i") / 2).alias("i"), F.col("ref").alias("v"), "est")


view("stereo", "SELECT track_id, stem, CAST(i % 2 AS INTEGER) AS ch, i // 2 AS i, ref AS v, est FROM samples", "samples")


def mono(spark, d):
    return C.sample_rows(spark, d).select("track_id", "stem", "i", F.col("ref").alias("v"), "est")


@query("D01", sql("SELECT track_id, stem, round(usdr, 6) AS usdr FROM usdr", "usdr"))
def d01(spark, d):
    return rounded(S.global_sdr(C.sample_rows(spark, d)), "usdr")


@query("D02", sql("""SELECT track_id, stem, round(10 * log10((sum(r * e) * (sum(r * e) / sum(r * r))) / (sum(e * e) - sum(r * e) * (sum(r * e) / sum(r * r)))), 5) AS si_sdr
  FROM cdr GROUP BY ALL""", "cdr"))
def d02(spark, d):
    return S.si_sdr(C.sample_rows(spark, d)).withColumn("si_sdr", F.round("si_sdr", 5))


@query("D03", sql("SELECT track_id, stem, round(median(value), 6) AS value FROM blocks GROUP BY ALL", "blocks"))
def d03(spark, d):
    return rounded(S.block_median(S.block_sdr(C.sample_rows(spark, d), 16)), "value")


@query("D04", sql("SELECT track_id, round(avg(usdr), 6) AS mean FROM usdr GROUP BY track_id", "usdr"))
def d04(spark, d):
    return rounded(S.track_mean(S.global_sdr(C.sample_rows(spark, d)).withColumnRenamed("usdr", "value")), "mean")


def metric_rows(spark, d):
    u = S.global_sdr(C.sample_rows(spark, d)).select("track_id", "stem", F.lit("uSDR").alias("metric"), F.col("usdr").alias("value"))
    c = S.block_median(S.block_sdr(C.sample_rows(spark, d), 16)).select("track_id", "stem", F.lit("cSDR").alias("metric"), "value")
    return u.unionByName(c)


@query("D05", sql("""m AS (SELECT 'uSDR' AS metric, stem, usdr AS value FROM usdr
  UNION ALL SELECT 'cSDR', stem, v FROM (SELECT track_id, stem, median(value) AS v FROM blocks GROUP BY ALL)),
p AS (SELECT metric, stem, median(value) AS value FROM m GROUP BY ALL)
SELECT metric, stem, round(value, 6) AS value FROM p UNION ALL SELECT metric, 'mean', round(avg(value), 6) FROM p GROUP BY metric""", "usdr", "blocks"))
def d05(spark, d):
    return rounded(S.aggregate_metrics(metric_rows(spark, d), "median"), "value")


@query("D06", sql(f"""SELECT model, track_id, {", ".join(f"coalesce(round(max(value) FILTER (stem = '{s}'), 6), 'nan'::DOUBLE) AS {s}" for s in TYPES)}
  FROM track_metric GROUP BY ALL""", "track_metric"))
def d06(spark, d):
    m = rounded(C.track_metric(spark, d), "value")
    return S.per_stem_matrix(m, TYPES, ("model", "track_id"))


@query("D07", """SELECT DISTINCT l_suppkey AS track_id, l_returnflag AS stem FROM lineitem a WHERE NOT EXISTS (
  SELECT 1 FROM lineitem b WHERE b.l_suppkey = a.l_suppkey AND b.l_returnflag = a.l_returnflag AND b.l_tax > 0.07 AND b.l_quantity > 45)""")
def d07(spark, d):
    key = [F.col("l_suppkey").alias("track_id"), F.col("l_returnflag").alias("stem")]
    li = C.table(spark, d, "lineitem")
    return S.missing_stems(li.select(*key), li.filter("l_tax > 0.07 AND l_quantity > 45").select(*key))


def run_times(spark, d):
    return C.table(spark, d, "events").select(F.col("value").alias("seconds"), F.when(F.col("event_id") % 10 == 0, 0).otherwise(10 + F.col("event_id") % 90).alias("audio_seconds"))


@query("D08", """WITH r AS (SELECT value / (10 + event_id % 90) AS rtf, row_number() OVER (ORDER BY value / (10 + event_id % 90)) - 1 AS i
  FROM events WHERE event_id % 10 <> 0)
SELECT round(rtf, 6) AS rtf_median, (SELECT sum(CASE WHEN event_id % 10 = 0 THEN 0 ELSE 10 + event_id % 90 END)::DOUBLE FROM events) AS total_audio, round(1 / rtf, 6) AS speedup
  FROM r WHERE i = (SELECT count(*) // 2 FROM r)""")
def d08(spark, d):
    return rounded(S.rtf_summary(run_times(spark, d)), "rtf_median", "speedup")


def timings(spark, d):
    from cadenza.core.ordered import Ordered

    e = C.table(spark, d, "events").select(F.col("event_type").alias("label"), F.col("value").alias("seconds"), "event_id")
    o = Ordered(e, ["label"], ["event_id"]).add(run=("row", None)).result()
    return o.select("label", "run", "seconds", F.when(F.col("label") != "view", 30.0).alias("audio_seconds"))


@query("D09", """WITH t AS (SELECT event_type AS label, value AS seconds, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM events)
SELECT label, round(median(seconds), 6) AS median_s, round(avg(seconds), 6) AS mean_s, round(stddev_pop(seconds), 6) AS std_s, round(min(seconds), 6) AS min_s,
  count(*) AS n_runs, CASE WHEN label <> 'view' THEN round(median(seconds) / 30, 6) END AS rtf, CASE WHEN label <> 'view' THEN round(30 / median(seconds), 6) END AS speedup
  FROM t WHERE run > 3 GROUP BY label""")
def d09(spark, d):
    return rounded(S.timing_stats(timings(spark, d), 3), "median_s", "mean_s", "std_s", "min_s", "rtf", "speedup")


# ---------------------------------------------------------------- series

@query("P12", sql("""n AS (SELECT track_id, min(n) AS n FROM (SELECT track_id, stem, max(i) + 1 AS n FROM samples GROUP BY ALL) GROUP BY track_id)
SELECT track_id, stem, count(*) AS n, round(sum(ref), 4) AS total FROM samples JOIN n USING (track_id) WHERE i < n.n GROUP BY ALL""", "samples"))
def p12(spark, d):
    a = G.align_min_length(mono(spark, d))
    return a.groupBy("track_id", "stem").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("P13", sql("""g AS (SELECT DISTINCT track_id, stem FROM samples), s AS (SELECT track_id, stem, unnest(range(0, 210)) AS i FROM g)
SELECT s.track_id, s.stem, s.i, round(coalesce(x.ref, 0), 6) AS v FROM s LEFT JOIN samples x USING (track_id, stem, i)""", "samples"))
def p13(spark, d):
    return rounded(G.match_length(mono(spark, d), 210), "v")


@query("P14", sql("""c AS (SELECT track_id, stem, CAST(i % (1 + track_id % 3) AS INTEGER) AS ch, i, ref AS v FROM samples),
n AS (SELECT track_id, stem, max(ch) AS top FROM c GROUP BY ALL)
SELECT track_id, stem, u.ch, count(*) AS n, round(sum(v), 4) AS total FROM c JOIN n USING (track_id, stem), (VALUES (0), (1)) u(ch)
  WHERE c.ch < 2 AND (top = 0 OR c.ch = u.ch) GROUP BY ALL""", "samples"))
def p14(spark, d):
    c = mono(spark, d).withColumn("ch", (F.col("i") % (1 + F.col("track_id") % 3)).cast("int"))
    return G.to_stereo(c, ("track_id", "stem")).groupBy("track_id", "stem", "ch").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


view("mix", "SELECT track_id, i, sum(ref) AS v FROM samples GROUP BY ALL", "samples")


@query("P15", sql("""e AS (SELECT s.track_id, s.stem, s.ref, m.v FROM samples s JOIN mix m USING (track_id, i))
SELECT 'silence' AS kind, track_id, stem, round(10 * log10((sum(ref * ref) + 1e-7) / (sum(ref * ref) + 1e-7)), 6) AS usdr FROM e GROUP BY ALL
UNION ALL SELECT 'mixture', track_id, stem, round(10 * log10((sum(ref * ref) + 1e-7) / (sum((ref - v) * (ref - v)) + 1e-7)), 6) FROM e GROUP BY ALL""", "samples", "mix"))
def p15(spark, d):
    ref = C.sample_rows(spark, d).select("track_id", "stem", "i", "ref")
    mix = ref.groupBy("track_id", "i").agg(F.sum("ref").alias("v"))
    outs = []
    for kind in ("silence", "mixture"):
        est = G.baseline_estimates(mix, kind, FLAGS).withColumnRenamed("v", "est")
        outs.append(S.global_sdr(ref.join(est, ["track_id", "stem", "i"])).select(F.lit(kind).alias("kind"), "track_id", "stem", F.round(F.col("usdr") + 0.0, 6).alias("usdr")))
    return outs[0].unionByName(outs[1])


@query("P16", sql("""SELECT x.name, track_id, stem, CASE WHEN x.name IN ('swap', 'swap_flip') THEN 1 - ch ELSE ch END AS ch,
  round(sum(CASE WHEN x.name IN ('flip', 'swap_flip') THEN -v ELSE v END), 4) AS total
  FROM stereo, (VALUES ('identity'), ('swap'), ('flip'), ('swap_flip')) x(name) GROUP BY ALL""", "stereo"))
def p16(spark, d):
    s = stereo(spark, d).withColumn("name", F.explode(F.array(*[F.lit(n) for n in G.TTA])))
    return G.tta_transform(s, F.col("name")).groupBy("name", "track_id", "stem", "ch").agg(F.round(F.sum("v"), 4).alias("total"))


view("cases", """SELECT m.track_id, m.stem, m.value / 25 AS csdr, ln(m.value + 1) * 4 - (m.track_id % 11) AS energy_db FROM track_metric m WHERE model = 'base'""", "track_metric")


def cases(spark, d):
    m = C.track_metric(spark, d).filter("model = 'base'")
    return m.select("track_id", "stem", (F.col("value") / 25).alias("csdr"), (F.log(F.col("value") + 1) * 4 - F.col("track_id") % 11).alias("energy_db"))


@query("P18", sql("""q AS (SELECT stem, median(energy_db) AS m FROM cases GROUP BY stem)
SELECT track_id, c.stem, round(csdr, 6) AS csdr, round(energy_db, 6) AS energy_db, round(m, 6) AS energy_median_db,
  CASE WHEN energy_db < m - 6 THEN 'quiet' WHEN csdr < 5 THEN 'failure' ELSE 'ok' END AS diagnosis FROM cases c JOIN q USING (stem)""", "cases"))
def p18(spark, d):
    return rounded(S.diagnose_case(cases(spark, d)), "csdr", "energy_db", "energy_median_db")


@query("P19", sql("""q AS (SELECT stem, quantile_cont(csdr, 0.25) AS q, median(energy_db) AS m, corr(energy_db, csdr) AS r FROM cases GROUP BY stem)
SELECT track_id, c.stem, round(csdr, 6) AS csdr, round(energy_db, 6) AS energy_db, round(q, 6) AS csdr_q25, round(m, 6) AS energy_median_db, round(r, 6) AS pearson_r
  FROM cases c JOIN q USING (stem) WHERE csdr <= q AND energy_db >= m""", "cases"))
def p19(spark, d):
    return rounded(S.true_failures(cases(spark, d)), "csdr", "energy_db", "csdr_q25", "energy_median_db", "pearson_r")


@query("P05", sql("""m AS (SELECT track_id, round(avg(usdr), 9) AS mean FROM usdr GROUP BY track_id)
SELECT track_id, round(mean, 6) AS mean, 'worst' AS pick FROM (SELECT * FROM m ORDER BY mean, track_id LIMIT 5)
UNION ALL SELECT track_id, round(mean, 6), 'best' FROM (SELECT * FROM m ORDER BY mean DESC, track_id DESC LIMIT 2)""", "usdr"))
def p05(spark, d):
    m = S.track_mean(S.global_sdr(C.sample_rows(spark, d)).withColumnRenamed("usdr", "value")).withColumn("mean", F.round("mean", 9))
    return rounded(S.worst_best(m, "mean", 5, 2), "mean")


@query("P20", sql("SELECT track_id, stem, i, round(avg(v), 6) AS v FROM stereo WHERE i < 40 GROUP BY ALL", "stereo"))
def p20(spark, d):
    return rounded(G.downmix(G.head_seconds(stereo(spark, d), 2.5, 16), ("track_id", "stem", "i")), "v")


@query("P21", sql("""SELECT track_id, min(n) AS min_n, max(n) AS max_n FROM (SELECT track_id, stem, count(*) AS n FROM samples GROUP BY ALL)
  GROUP BY track_id HAVING min(n) <> max(n)""", "samples"))
def p21(spark, d):
    return G.equal_lengths(mono(spark, d))


# ---------------------------------------------------------------- ensembles and bins

def two_models(spark, d):
    m = F.array(F.struct(F.lit("a").alias("model"), F.col("v").alias("v")), F.struct(F.lit("b").alias("model"), F.col("est").alias("v")))
    return mono(spark, d).filter("NOT (i > 150 AND track_id % 2 = 0 AND stem = 'A')").select("track_id", "stem", "i", F.explode(m).alias("m")).select(
        "track_id", "stem", "i", "m.model", "m.v").filter("NOT (model = 'b' AND i > 120 AND track_id % 3 = 0)")


@query("E06", sql("""o AS (SELECT track_id, stem, i, m.model, CASE WHEN m.model = 'a' THEN ref ELSE est END AS v FROM samples, (VALUES ('a'), ('b')) m(model)
  WHERE NOT (i > 150 AND track_id % 2 = 0 AND stem = 'A') AND NOT (m.model = 'b' AND i > 120 AND track_id % 3 = 0)),
n AS (SELECT track_id, min(n) AS n FROM (SELECT track_id, model, max(i) + 1 AS n FROM o GROUP BY ALL) GROUP BY track_id),
w AS (SELECT * FROM (VALUES ('a', 'A', 0.75), ('b', 'A', 0.25), ('a', 'N', 0.5), ('b', 'N', 0.25), ('a', 'R', 1.0), ('b', 'R', 1.0)) w(model, stem, w))
SELECT track_id, stem, i, round(sum(w * v) / sum(w), 6) AS v FROM o JOIN n USING (track_id) JOIN w USING (model, stem) WHERE i < n.n GROUP BY ALL""", "samples"))
def e06(spark, d):
    w = spark.createDataFrame([("a", "A", .75), ("b", "A", .25), ("a", "N", .5), ("b", "N", .25), ("a", "R", 1.), ("b", "R", 1.)], "model string, stem string, w double")
    return rounded(G.ensemble(two_models(spark, d), w), "v")


@query("E07", sql("""SELECT track_id, stem, ch, i, round(avg(v), 6) AS v FROM (
  SELECT track_id, stem, ch, i, v FROM stereo UNION ALL SELECT track_id, stem, 1 - ch, i, est FROM stereo UNION ALL SELECT track_id, stem, ch, i, -v / 2 FROM stereo) GROUP BY ALL""", "stereo"))
def e07(spark, d):
    variants = F.array(F.struct(F.lit("identity").alias("variant"), F.col("v").alias("v")), F.struct(F.lit("swap").alias("variant"), F.col("est").alias("v")),
                       F.struct(F.lit("flip").alias("variant"), (F.col("v") / 2).alias("v")))
    o = stereo(spark, d).select("track_id", "stem", "ch", "i", F.explode(variants).alias("x")).select("track_id", "stem", "ch", "i", "x.variant", "x.v")
    return rounded(G.tta_average(o), "v")


def bins(spark, d):
    return C.sample_rows(spark, d).select("track_id", "stem", F.lit(0).alias("ch"), (F.col("i") % 16).cast("int").alias("f"),
                                          F.floor(F.col("i") / 16).cast("int").alias("t"), (F.col("ref") - 40).alias("re"), (F.col("est") / 2 - 20).alias("im"))


def mix_bins(b):
    return b.groupBy("track_id", "ch", "f", "t").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


view("bins", "SELECT track_id, stem, 0 AS ch, CAST(i % 16 AS INTEGER) AS f, CAST(i // 16 AS INTEGER) AS t, ref - 40 AS re, est / 2 - 20 AS im FROM samples", "samples")
view("binmix", "SELECT track_id, ch, f, t, sum(re) AS mre, sum(im) AS mim FROM bins GROUP BY ALL", "bins")
view("masks", """SELECT *, pow(sqrt(re * re + im * im), 2) / (sum(pow(sqrt(re * re + im * im), 2)) OVER w + 1e-10) AS mask,
  row_number() OVER (PARTITION BY track_id, ch, f, t ORDER BY re * re + im * im DESC, stem) AS won FROM bins JOIN binmix USING (track_id, ch, f, t) WINDOW w AS (PARTITION BY track_id, ch, f, t)""", "bins", "binmix")


@query("E10", sql("SELECT track_id, ch, f, t, stem, round(mask, 6) AS mask, round(mask * mre, 6) AS re, round(mask * mim, 6) AS im FROM masks", "masks"))
def e10(spark, d):
    b = bins(spark, d)
    return rounded(G.ratio_mask(b, mix_bins(b), 2.0), "mask", "re", "im")


@query("E11", sql("SELECT track_id, ch, f, t, stem, CASE WHEN won = 1 THEN 1 ELSE 0 END AS mask, round(CASE WHEN won = 1 THEN mre ELSE 0 END, 6) AS re, round(CASE WHEN won = 1 THEN mim ELSE 0 END, 6) AS im FROM masks", "masks"))
def e11(spark, d):
    b = bins(spark, d)
    return rounded(G.binary_mask(b, mix_bins(b), FLAGS), "re", "im")


@query("E12", sql("""v AS (SELECT track_id, stem, re, im, re * 0.9 AS bre, im * 1.1 AS bim, sqrt(re * re * 0.81 + im * im * 1.21) AS bm, atan2(mim, mre) AS p, mask * mre AS kre, mask * mim AS kim FROM masks),
s AS (SELECT track_id, 10 * log10((sum(re * re + im * im) + 1e-7) / (sum((re - bre) ** 2 + (im - bim) ** 2) + 1e-7)) AS base,
  10 * log10((sum(re * re + im * im) + 1e-7) / (sum((re - bm * cos(p)) ** 2 + (im - bm * sin(p)) ** 2) + 1e-7)) AS phase,
  10 * log10((sum(re * re + im * im) + 1e-7) / (sum((re - kre) ** 2 + (im - kim) ** 2) + 1e-7)) AS mask FROM v GROUP BY track_id)
SELECT track_id, round(base, 6) AS base, round(phase, 6) AS phase, round(mask, 6) AS mask, round((phase - base) / (mask - base) * 100, 4) AS phase_share FROM s""", "masks"))
def e12(spark, d):
    ref = bins(spark, d)
    mix = mix_bins(ref)
    key = ["track_id", "stem", "ch", "f", "t"]
    est = ref.withColumn("re", F.col("re") * 0.9).withColumn("im", F.col("im") * 1.1)
    truth = ref.select(*key, F.col("re").alias("ref_re"), F.col("im").alias("ref_im"))

    def level(x, name):
        parts = F.explode(F.array(F.struct(F.col("ref_re").alias("ref"), F.col("re").alias("est")), F.struct(F.col("ref_im").alias("ref"), F.col("im").alias("est"))))
        p = x.select(*key, "re", "im").join(truth, key).select("track_id", parts.alias("p")).select("track_id", "p.ref", "p.est")
        return S.global_sdr(p, ("track_id",)).withColumnRenamed("usdr", name)

    s = level(est, "base").join(level(G.phase_swap(est, mix), "phase"), "track_id").join(level(G.ratio_mask(ref, mix), "mask"), "track_id")
    share = G.loss_share(F.col("base"), F.col("phase"), F.col("mask"))
    return rounded(s.withColumn("phase_share", F.round(share, 4)), "base", "phase", "mask")


@query("E13", sql("""c AS (SELECT track_id, stem, i, v, n, k, i - k * 30 AS j FROM (SELECT track_id, stem, i, ref AS v, max(i) OVER (PARTITION BY track_id, stem) + 1 AS n FROM samples) s, range(0, 200) r(k)
  WHERE i >= k * 30 AND i < k * 30 + 40 AND (k = 0 OR ((k - 1) * 30 + 40 < n AND n - k * 30 >= 2))),
w AS (SELECT *, CASE WHEN n <= 40 THEN 1.0::DOUBLE WHEN j >= 35 THEN 1 - (j - 35) / 4.0::DOUBLE WHEN j < 5 THEN j / 4.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM c)
SELECT track_id, stem, i, round(sum(w * v * (1 + k / 10.0::DOUBLE)) / greatest(sum(w), 1e-8), 6) AS v FROM w GROUP BY ALL""", "samples"))
def e13(spark, d):
    by = ("track_id", "stem")
    c = G.chunk(mono(spark, d).drop("est"), 40, 0.25, by)
    return rounded(G.overlap_add(c.withColumn("v", F.col("v") * (1 + F.col("k") / 10.0)), 40, 0.25, by), "v")


@query("E14", sql("""s AS (SELECT track_id, stem, i, ref - 45 AS v, max(i) OVER (PARTITION BY track_id, stem) + 1 AS n FROM samples),
p AS (SELECT track_id, stem, CAST(i // greatest(n // 24, 1) AS INTEGER) AS x, max(abs(v)) AS peak FROM s WHERE i // greatest(n // 24, 1) < 24 GROUP BY ALL),
g AS (SELECT track_id, stem, CAST(unnest(range(0, 24)) AS INTEGER) AS x FROM (SELECT DISTINCT track_id, stem FROM s)),
q AS (SELECT track_id, stem, CAST(((i + 1) * 24 + n - 1) // n - 1 AS INTEGER) AS x, least(min(v), 0) AS lo, greatest(max(v), 0) AS hi FROM s GROUP BY ALL)
SELECT track_id, stem, x, round(coalesce(peak, 0), 6) AS peak, round(lo, 6) AS lo, round(hi, 6) AS hi FROM g LEFT JOIN p USING (track_id, stem, x) LEFT JOIN q USING (track_id, stem, x)""", "samples"))
def e14(spark, d):
    s, by = mono(spark, d).withColumn("v", F.col("v") - 45), ("track_id", "stem")
    out = G.envelope(s, 24, "peak", by).join(G.envelope(s, 24, "range", by), [*by, "x"], "left")
    return rounded(out, "peak", "lo", "hi")


@query("E15", sql("""l AS (SELECT track_id, stem, 20 * log10(sqrt(avg(ref * ref)) + 1e-12) AS rms_db FROM samples GROUP BY ALL),
m AS (SELECT track_id, max(ref) AS m FROM samples GROUP BY ALL)
SELECT track_id, stem, round(rms_db, 6) AS rms_db, round(20 * log10(sqrt(avg((ref * (0.99 / m.m)) ** 2)) + 1e-12), 6) AS normalised_db
  FROM samples JOIN m USING (track_id) JOIN l USING (track_id, stem) GROUP BY track_id, stem, rms_db""", "samples"))
def e15(spark, d):
    s = mono(spark, d)
    out = G.stem_levels(s).join(G.stem_levels(G.peak_normalise(s)).withColumnRenamed("rms_db", "normalised_db"), ["track_id", "stem"])
    return rounded(out, "rms_db", "normalised_db")


@query("E16", sql("""t AS (SELECT track_id, i, sum(est) AS s, sum(ref) AS v FROM samples GROUP BY ALL)
SELECT track_id, round(max(abs(v - s)), 6) AS max_error FROM t GROUP BY track_id""", "samples"))
def e16(spark, d):
    s = mono(spark, d)
    mix = s.groupBy("track_id", "i").agg(F.sum("v").alias("v"))
    return rounded(G.sum_error(mix, s.withColumn("v", F.col("est"))), "max_error")


@query("E17", sql("""z AS (SELECT *, (ref - avg(ref) OVER w) / stddev_samp(ref) OVER w AS zm, (ref - avg(ref) OVER w) / sqrt(var_pop(ref) OVER w + 1e-7) AS zc
  FROM samples WINDOW w AS (PARTITION BY track_id))
SELECT track_id, stem, i, round(zm, 6) AS z_mixture, round(zc, 6) AS z_clip, round(ref, 6) AS restored FROM z""", "samples"))
def e17(spark, d):
    s, key = mono(spark, d).drop("est"), ["track_id", "stem", "i"]
    st = G.zscore_stats(s)
    z = G.group_zscore(s, st)
    c = G.group_zscore(s, G.zscore_stats(s, mode="clip")).withColumnRenamed("v", "z_clip")
    out = z.withColumnRenamed("v", "z_mixture").join(c, key).join(G.restore(z, st).withColumnRenamed("v", "restored"), key)
    return rounded(out, "z_mixture", "z_clip", "restored")
