"""Queries M01-M12."""

from pyspark.sql import functions as F

from cadenza.functions import music as U
from cadenza.operators import mashup as M
from cadenza.plans import canonical as C
from cadenza.plans.q_separation import mono
from cadenza.plans.q_tagging import rounded
from cadenza.plans.registry import query, sql, view

SR = 1000
view("bars", """SELECT a.track_id, CASE WHEN n_bars >= 3 THEN coalesce(g, 0) ELSE 0 END AS bar_seconds FROM analysis a LEFT JOIN (
  SELECT track_id, median(d) AS g FROM (SELECT track_id, lead(t) OVER (PARTITION BY track_id ORDER BY pos) - t AS d FROM downbeats) GROUP BY 1) USING (track_id)""", "analysis", "downbeats")
view("feats", "SELECT track_id, CASE WHEN track_id % 23 = 5 THEN 0 ELSE bpm END AS bpm, key, bar_seconds, track_id % 24 % 12 AS tonic, track_id % 24 < 12 AS major FROM analysis JOIN bars USING (track_id)", "analysis", "bars")
view("plans", """SELECT *, CASE WHEN NOT known THEN 'tempo unknown' ELSE concat_ws('; ', CASE WHEN abs(stretch - 1) > 0.08::DOUBLE THEN 'speed change over limit' END,
    CASE WHEN abs(semitones) > 2 THEN 'pitch shift over limit' END) END AS reason FROM (
  SELECT *, CASE WHEN NOT known THEN 1 ELSE CASE WHEN abs(r1 * 2 - 1) < abs(r1 - 1) THEN r1 * 2 ELSE r1 END END AS stretch,
    CASE WHEN NOT known OR near THEN 0 ELSE shift END AS semitones,
    CASE WHEN NOT known THEN 'unknown' WHEN near THEN relation || ' (adjacent, unshifted)' ELSE relation END AS key_relation FROM (
  SELECT *, CASE WHEN abs(r0 * 0.5 - 1) < abs(r0 - 1) THEN r0 * 0.5 ELSE r0 END AS r1, shift <> 0 AND smode AND fifths <= 1 AS near FROM (
  SELECT *, CASE WHEN same OR rel THEN 0 ELSE (dt - bt + 18) % 12 - 6 END AS shift,
    CASE WHEN same THEN 'same key' WHEN rel THEN 'relative key' ELSE CASE WHEN smode THEN 'same' ELSE 'other' END || ' mode, fifths distance ' || fifths END AS relation FROM (
  SELECT a.track_id AS base, b.track_id AS donor, a.bpm AS base_bpm, b.bpm AS donor_bpm, a.tonic AS bt, b.tonic AS dt, a.major = b.major AS smode,
    a.tonic = b.tonic AND a.major = b.major AS same, a.major <> b.major AND (a.tonic + CASE WHEN a.major THEN 9 ELSE 3 END) % 12 = b.tonic AS rel,
    least((a.tonic * 7 - b.tonic * 7 + 84) % 12, 12 - (a.tonic * 7 - b.tonic * 7 + 84) % 12) AS fifths, a.bpm > 0 AND b.bpm > 0 AS known,
    CASE WHEN a.bar_seconds > 0 AND b.bar_seconds > 0 THEN b.bar_seconds / a.bar_seconds ELSE a.bpm / nullif(b.bpm, 0) END AS r0
  FROM feats a JOIN feats b ON a.track_id <> b.track_id))))""", "feats")
PLAN_COLS = "base, donor, base_bpm, donor_bpm, round(stretch, 6) AS stretch, round((stretch - 1) * 100, 4) AS speed_change_percent, semitones, key_relation, reason = '' AS feasible, reason"
view("ordered_plans", """SELECT *, row_number() OVER (PARTITION BY base ORDER BY reason = '' DESC, abs(semitones), round(abs(stretch - 1), 9), donor) AS rank FROM plans""", "plans")
view("mpairs", "SELECT s_suppkey AS base, (s_suppkey + j * j) % (SELECT count(*) FROM supplier) AS donor FROM supplier, range(1, 7) r(j)")


@C.stored("features")
def features(spark, d):
    a = C.analysis(spark, d)
    b = a.select("track_id").join(M.bar_seconds(C.downbeats(spark, d)), "track_id", "left").na.fill(0.0, ["bar_seconds"])
    bpm = F.when(F.col("track_id") % 23 == 5, 0.0).otherwise(F.col("bpm"))
    return a.select("track_id", bpm.alias("bpm"), "key").join(b, "track_id")


def pairs(spark, d):
    s = C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("base"))
    n = s.count()
    return s.select("base", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("j")).select("base", ((F.col("base") + F.col("j") * F.col("j")) % n).alias("donor"))


def trimmed(plans):
    return rounded(plans, "stretch").withColumn("speed_change_percent", F.round("speed_change_percent", 4))


@query("M01", sql("""SELECT a.track_id AS base, b.track_id AS donor, least((a.tonic * 7 - b.tonic * 7 + 84) % 12, 12 - (a.tonic * 7 - b.tonic * 7 + 84) % 12) AS distance
  FROM mpairs p JOIN feats a ON a.track_id = p.base JOIN feats b ON b.track_id = p.donor""", "feats", "mpairs"))
def m01(spark, d):
    k = features(spark, d).select("track_id", U.tonic(F.col("key")).alias("t"))
    j = pairs(spark, d).join(k.select(F.col("track_id").alias("base"), F.col("t").alias("a")), "base").join(k.select(F.col("track_id").alias("donor"), F.col("t").alias("b")), "donor")
    return j.select("base", "donor", U.circle_distance(F.col("a"), F.col("b")).alias("distance"))


@query("M02", sql("SELECT base, donor, shift AS semitones, relation FROM plans JOIN mpairs USING (base, donor)", "plans", "mpairs"))
def m02(spark, d):
    k = features(spark, d)
    j = pairs(spark, d).join(k.select(F.col("track_id").alias("base"), F.col("key").alias("a")), "base").join(k.select(F.col("track_id").alias("donor"), F.col("key").alias("b")), "donor")
    s, r = U.key_distance(F.col("a"), F.col("b"))
    return j.select("base", "donor", s.alias("semitones"), r.alias("relation"))


@query("M03", sql("SELECT track_id, round(bar_seconds, 6) AS bar_seconds FROM bars WHERE track_id IN (SELECT track_id FROM downbeats)", "bars"))
def m03(spark, d):
    return rounded(M.bar_seconds(C.downbeats(spark, d)), "bar_seconds")


@query("M04", sql(f"SELECT {PLAN_COLS} FROM plans JOIN mpairs USING (base, donor)", "plans", "mpairs"))
def m04(spark, d):
    return trimmed(M.plan_mashup(pairs(spark, d), features(spark, d)))


@query("M05", sql(f"SELECT {PLAN_COLS}, rank FROM ordered_plans WHERE rank <= 5", "ordered_plans"))
def m05(spark, d):
    return trimmed(M.rank_candidates(features(spark, d), 5))


@query("M06", sql(f"""q AS (SELECT base, donor FROM mpairs WHERE base % 4 = 0 AND donor = (base + 1) % (SELECT count(*) FROM supplier)),
x AS (SELECT * FROM ordered_plans JOIN q USING (base, donor) UNION ALL SELECT base, donor, * EXCLUDE (base, donor) FROM ordered_plans WHERE rank = 1 AND reason = '' AND base NOT IN (SELECT base FROM q))
SELECT {PLAN_COLS}, CASE WHEN reason = '' THEN '' ELSE 'requested donor is not feasible: ' || reason END AS warning FROM x""", "ordered_plans", "mpairs"))
def m06(spark, d):
    f = features(spark, d)
    n = f.count()
    asked = pairs(spark, d).filter((F.col("base") % 4 == 0) & (F.col("donor") == (F.col("base") + 1) % n))
    plans = M.rank_candidates(f, 1).drop("rank").unionByName(M.plan_mashup(asked, f)).distinct()
    return trimmed(M.choose_donor(plans, asked))


@query("M07", sql(f"""SELECT {PLAN_COLS}, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY round(abs(stretch - 1), 9), donor) AS r
  FROM plans WHERE known) WHERE r <= 4""", "plans"))
def m07(spark, d):
    f = features(spark, d)
    plans = M.plan_mashup(M.tempo_neighbours(f, 4), f)
    return trimmed(M.top_per_group(plans, ["base"], [F.round(F.abs(F.col("stretch") - 1), 9), F.col("donor")], 4))


view("zipped", """SELECT base, donor, s.pos, s.t AS a0, lead(s.t) OVER w AS a1, x.t AS b0, lead(x.t) OVER w AS b1 FROM mpairs JOIN downbeats s ON s.track_id = donor
  JOIN downbeats x ON x.track_id = base AND x.pos = s.pos WINDOW w AS (PARTITION BY base, donor ORDER BY s.pos)""", "mpairs", "downbeats")
view("rates", """SELECT base, donor, pos, CAST(trunc(a1 * 1000) - trunc(a0 * 1000) AS BIGINT) AS src_samples, (a1 - a0) / (b1 - b0) AS rate, b1 - b0 AS dst_seconds FROM zipped
  WHERE a1 IS NOT NULL AND b1 > b0 AND trunc(a1 * 1000) - trunc(a0 * 1000) >= 2""", "zipped")
view("landed", """SELECT base, donor, n AS pos, t FROM (SELECT r.base, r.donor, row_number() OVER w AS n,
    (trunc(s.t * 1000) + sum(CAST(floor(src_samples / rate) AS BIGINT)) OVER w) / 1000.0::DOUBLE + x.t - s.t AS t FROM rates r
    JOIN downbeats s ON s.track_id = donor AND s.pos = 0 JOIN downbeats x ON x.track_id = base AND x.pos = 0 WINDOW w AS (PARTITION BY r.base, r.donor ORDER BY r.pos))
  UNION ALL SELECT base, donor, 0, trunc(s.t * 1000) / 1000.0::DOUBLE + x.t - s.t FROM mpairs JOIN downbeats s ON s.track_id = donor AND s.pos = 0 JOIN downbeats x ON x.track_id = base AND x.pos = 0""", "rates", "mpairs", "downbeats")


def landed(spark, d):
    p, db = pairs(spark, d), C.downbeats(spark, d)
    first = db.filter("pos = 0")
    heads = p.join(first.select(F.col("track_id").alias("donor"), F.col("t").alias("src0")), "donor").join(first.select(F.col("track_id").alias("base"), F.col("t").alias("dst0")), "base")
    bars = M.bar_rates(p, db, SR).withColumn("out_samples", F.floor(F.col("src_samples") / F.col("rate")))
    return M.landings(bars, heads, SR)


@query("M08", sql("SELECT base, donor, pos, src_samples, round(rate, 6) AS rate, round(dst_seconds, 6) AS dst_seconds FROM rates", "rates"))
def m08(spark, d):
    return rounded(M.bar_rates(pairs(spark, d), C.downbeats(spark, d), SR), "rate", "dst_seconds")


@query("M09", sql("SELECT base, donor, pos, round(t, 6) AS t FROM landed", "landed"))
def m09(spark, d):
    return rounded(landed(spark, d), "t")


@query("M10", sql("""SELECT l.base, l.donor, count(*) AS n_bars, round(median(abs(x.t - l.t) * 1000), 5) AS align_error_ms FROM landed l
  JOIN downbeats x ON x.track_id = l.base AND x.pos = l.pos GROUP BY ALL""", "landed", "downbeats"))
def m10(spark, d):
    e = M.align_error(pairs(spark, d), C.downbeats(spark, d), landed(spark, d))
    return e.withColumn("align_error_ms", F.round("align_error_ms", 5))


view("acc", """SELECT track_id, i, sum(ref) AS v FROM samples s JOIN (SELECT track_id, min(n) AS n FROM (SELECT track_id, stem, count(*) AS n FROM samples WHERE stem <> 'R' GROUP BY ALL) GROUP BY 1) USING (track_id)
  WHERE stem <> 'R' AND i < n GROUP BY ALL""", "samples")


@query("M11", sql("""m AS (SELECT b.stem, b.track_id, b.i, b.ref / 200 + coalesce(d.ref, 0) / 400 * pow(10.0::DOUBLE, -3.0 / 20) AS v FROM samples b
  LEFT JOIN samples d ON d.track_id = b.track_id AND d.i = b.i AND d.stem = 'R' WHERE b.stem <> 'R'),
p AS (SELECT stem, track_id, max(abs(v)) AS peak FROM m GROUP BY ALL)
SELECT stem, track_id, i, round(CASE WHEN peak > 1 THEN v / peak ELSE v END, 6) AS v FROM m JOIN p USING (stem, track_id)""", "samples"))
def m11(spark, d):
    """The returned lines as donor of both other stems."""
    s = mono(spark, d)
    donor = s.filter("stem = 'R'").select("track_id", "i", (F.col("v") / 400).alias("v"))
    one = lambda x: M.mix(s.filter(F.col("stem") == x).select("track_id", "i", (F.col("v") / 200).alias("v")), donor, -3.0).withColumn("stem", F.lit(x))
    return rounded(one("A").unionByName(one("N")).select("stem", "track_id", "i", "v"), "v")


@query("M12", sql("SELECT track_id, i, round(v, 6) AS v FROM acc", "acc"))
def m12(spark, d):
    return rounded(M.accompaniment(mono(spark, d), ("A", "N")), "v")
