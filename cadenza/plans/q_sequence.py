"""Queries T01-T04, T06-T18."""

from pyspark.sql import functions as F

from cadenza.core.ordered import Ordered
from cadenza.functions import music as U
from cadenza.operators import sequence as Q
from cadenza.plans import canonical as C
from cadenza.plans.q_joins import frame_pieces, intervals, two_beat_sets
from cadenza.plans.q_tagging import rounded
from cadenza.plans.registry import query, sql, view

PITCH_SQL = "(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])"
view("pcs", "SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS pc")
view("chroma_mean", """SELECT u.track_id, p.pc, coalesce(s, 0) / n / (sum(coalesce(s, 0) / n) OVER (PARTITION BY u.track_id) + 1e-12) AS v
  FROM (SELECT track_id, count(*) AS n FROM beats GROUP BY 1) u CROSS JOIN pcs p
  LEFT JOIN (SELECT track_id, event_id % 12 AS pc, sum(strength) AS s FROM beats GROUP BY ALL) x ON x.track_id = u.track_id AND x.pc = p.pc""", "beats", "pcs")
view("profiles", f"""SELECT t AS tonic, mode, pc, p[CAST((pc - t + 12) % 12 + 1 AS INTEGER)] AS p FROM range(0, 12) r(t), pcs,
  (VALUES ('major', {U.KEY_PROFILES["major"]}::DOUBLE[]), ('minor', {U.KEY_PROFILES["minor"]}::DOUBLE[])) m(mode, p)""", "pcs")
view("key_scores", """SELECT track_id, tonic, mode, c, row_number() OVER w AS r, c - lead(c) OVER w AS margin
  FROM (SELECT track_id, tonic, mode, corr(v, p) AS c FROM chroma_mean JOIN profiles USING (pc) GROUP BY ALL)
  WINDOW w AS (PARTITION BY track_id ORDER BY c DESC, tonic DESC, mode DESC)""", "chroma_mean", "profiles")


def chroma(spark, d):
    return C.beats(spark, d).select("track_id", F.col("pos").alias("frame"), (F.col("event_id") % 12).cast("int").alias("pc"), F.col("strength").alias("v"))


@query("T01", sql("SELECT track_id, pc, round(v, 6) AS v FROM chroma_mean", "chroma_mean"))
def t01(spark, d):
    return Q.chroma_mean(chroma(spark, d)).select("track_id", F.posexplode("chroma").alias("pc", "x")).select("track_id", "pc", F.round("x", 6).alias("v"))


@query("T02", sql(f"""SELECT track_id, key, CASE WHEN key LIKE '%major' THEN {PITCH_SQL}[CAST((track_id % 24 % 12 + 9) % 12 + 1 AS INTEGER)] || ' minor'
  ELSE {PITCH_SQL}[CAST((track_id % 24 % 12 + 3) % 12 + 1 AS INTEGER)] || ' major' END AS relative FROM analysis""", "analysis"))
def t02(spark, d):
    k = F.col("key")
    return C.analysis(spark, d).select("track_id", "key", U.relative_key(U.tonic(k), U.mode(k)).alias("relative"))


@query("T03", sql(f"""SELECT track_id, {PITCH_SQL}[CAST(tonic + 1 AS INTEGER)] || ' ' || mode AS key, CAST(tonic AS INTEGER) AS tonic, mode, round(c, 6) AS correlation, round(margin, 6) AS margin,
  CASE WHEN mode = 'major' THEN {PITCH_SQL}[CAST((tonic + 9) % 12 + 1 AS INTEGER)] || ' minor' ELSE {PITCH_SQL}[CAST((tonic + 3) % 12 + 1 AS INTEGER)] || ' major' END AS relative_alternative
  FROM key_scores WHERE r = 1""", "key_scores"))
def t03(spark, d):
    return rounded(Q.estimate_key(Q.chroma_mean(chroma(spark, d))), "correlation", "margin")


# Dense chroma: twelve values per event, pieces cut at every third event.
view("dense_chroma", """SELECT p.track_id, p.pos, p.piece, pc, ((b.event_id * 7 + pc * 13 + b.pos * pc) % 23) + b.strength / 1000 AS v
  FROM pieces p JOIN beats b USING (track_id, pos), pcs""", "pieces", "beats", "pcs")
view("sync", "SELECT track_id, piece, pc, median(v) AS v FROM dense_chroma GROUP BY ALL", "dense_chroma")
view("triads", """SELECT CAST(r * 2 + m AS INTEGER) AS cls, p AS label, pc, CASE WHEN pc IN (r, (r + 4 - m) % 12, (r + 7) % 12) THEN 1 / sqrt(3.0::DOUBLE) ELSE 0 END AS w
  FROM (SELECT r, m, (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[CAST(r + 1 AS INTEGER)] || CASE WHEN m = 1 THEN 'm' ELSE '' END AS p FROM range(0, 12) a(r), range(0, 2) b(m)), pcs""", "pcs")
view("chord_beats", """SELECT track_id, piece, cls, label, sim FROM (SELECT *, row_number() OVER (PARTITION BY track_id, piece ORDER BY sim DESC, cls) AS r FROM (
  SELECT track_id, piece, cls, label, round(sum(v * w) / (sqrt(sum(v * v)) + 1e-12), 9) AS sim FROM sync JOIN triads USING (pc) GROUP BY ALL)) WHERE r = 1""", "sync", "triads")
view("smooth", """SELECT track_id, piece, CASE WHEN a IS NULL OR c IS NULL THEN cls WHEN a = c THEN a WHEN a = cls OR c = cls THEN cls ELSE least(a, cls, c) END AS cls, sim FROM (
  SELECT *, lag(cls) OVER w AS a, lead(cls) OVER w AS c FROM chord_beats WINDOW w AS (PARTITION BY track_id ORDER BY piece))""", "chord_beats")


@C.stored("chroma-sync")
def synced(spark, d):
    """(track_id, piece, chroma): a frame's twelve values stay one row."""
    tone = lambda pc: (F.col("event_id") * 7 + pc * 13 + F.col("pos") * pc) % 23 + F.col("strength") / 1000
    chroma = F.transform(F.sequence(F.lit(0), F.lit(11)), tone)
    return Q.chroma_sync(frame_pieces(spark, d, "event_id", "strength").select("track_id", "piece", chroma.alias("chroma")))


def sync(spark, d):
    return synced(spark, d).select("track_id", "piece", F.posexplode("chroma").alias("pc", "v")).filter("v IS NOT NULL")


def smoothed(spark, d):
    return Q.mode_smooth(Q.chord_per_beat(synced(spark, d)), 3, order="piece")


@query("T04", sql("SELECT track_id, piece, pc, round(v, 6) AS v FROM sync", "sync"))
def t04(spark, d):
    return rounded(sync(spark, d), "v")


@query("T06", sql("SELECT track_id, piece, cls, label, round(sim, 6) AS confidence FROM chord_beats", "chord_beats"))
def t06(spark, d):
    return rounded(Q.chord_per_beat(synced(spark, d)), "confidence")


@query("T07", sql("SELECT track_id, piece, cls FROM smooth", "smooth"))
def t07(spark, d):
    return smoothed(spark, d).select("track_id", "piece", "cls")


view("chord_rows", """SELECT s.track_id, s.piece, b.t, b.nt, s.cls, s.sim FROM smooth s JOIN (
  SELECT track_id, pos // 3 AS piece, t, lead(t) OVER (PARTITION BY track_id ORDER BY pos) AS nt FROM beats WHERE pos % 3 = 1) b USING (track_id, piece) WHERE nt IS NOT NULL""", "smooth", "beats")
view("chord_runs", """SELECT track_id, min(t) AS start, max(nt) AS "end", cls, avg(sim) AS confidence, count(*) AS n_beats FROM (
  SELECT *, sum(f) OVER (PARTITION BY track_id ORDER BY piece) AS run FROM (
    SELECT *, CASE WHEN cls IS DISTINCT FROM lag(cls) OVER (PARTITION BY track_id ORDER BY piece) THEN 1 ELSE 0 END AS f FROM chord_rows))
  GROUP BY track_id, run, cls""", "chord_rows")


def chord_intervals(spark, d):
    """Chord i lasts from beat i to beat i + 1; the last beat opens none."""
    b = C.beats(spark, d).filter("pos % 3 = 1").select("track_id", F.floor(F.col("pos") / 3).cast("long").alias("piece"), "t")
    b = Ordered(b, ["track_id"], ["piece"]).add(until=("lead", F.col("t"))).result()
    rows = smoothed(spark, d).join(b, ["track_id", "piece"]).filter("until IS NOT NULL")
    label = F.element_at(F.lit([n for n, _ in U.triads()]), F.col("cls") + 1)
    return Q.merge_runs(rows.select("track_id", F.col("piece").alias("pos"), "t", "until", label.alias("label"), "confidence"))


@query("T08", sql("""SELECT r.track_id, round(start, 6) AS start, round("end", 6) AS "end", t.label, round(confidence, 6) AS confidence, n_beats
  FROM chord_runs r JOIN (SELECT DISTINCT cls, label FROM triads) t USING (cls)""", "chord_runs", "triads"))
def t08(spark, d):
    return rounded(chord_intervals(spark, d).drop("run"), "start", "end", "confidence")


@query("T09", sql("""k AS (SELECT track_id, CASE WHEN track_id % 25 = 24 THEN 'N' WHEN track_id % 25 = 23 THEN '' ELSE split_part(key, ' ', 1) || CASE WHEN key LIKE '%minor' THEN 'm' ELSE '' END END AS label FROM analysis)
SELECT track_id, label, CASE WHEN label IN ('', 'N', 'X') THEN 'N' WHEN label LIKE '%m' THEN left(label, -1) || ':min' ELSE label || ':maj' END AS eval_label FROM k""", "analysis"))
def t09(spark, d):
    k, t = F.split("key", " "), F.col("track_id") % 25
    label = F.when(t == 24, "N").when(t == 23, "").otherwise(F.concat(k[0], F.when(k[1] == "minor", "m").otherwise("")))
    a = C.analysis(spark, d).select("track_id", label.alias("label"))
    return a.withColumn("eval_label", U.to_eval_label(F.col("label")))


def chord_sets(spark, d):
    names = F.lit(["Am", "F", "C", "G", "Dm", "N"])
    pick = lambda n: F.element_at(names, (F.col("event_id") % n + 1).cast("int")).alias("label")
    cols = ["track_id", "start", "end"]
    return intervals(spark, d, 1).select(*cols, pick(6)), intervals(spark, d, 2).select(*cols, pick(4))


view("chord_ref", """SELECT track_id, start, "end", (['Am','F','C','G','Dm','N'])[CAST(event_id % 6 + 1 AS INTEGER)] AS label FROM intervals1""", "intervals1")
view("chord_est", """SELECT track_id, start, "end", (['Am','F','C','G','Dm','N'])[CAST(event_id % 4 + 1 AS INTEGER)] AS label FROM intervals2""", "intervals2")


for _c in ("chord_ref", "chord_est"):
    view(f"{_c}_full", f"""SELECT track_id, start, "end", label FROM {_c} UNION ALL SELECT track_id, reach, start, 'N' FROM (
  SELECT *, max("end") OVER (PARTITION BY track_id ORDER BY start, "end", label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_c}) WHERE start > reach""", _c)


@query("T10", sql("""o AS (SELECT track_id, sum(dur) AS total, coalesce(sum(dur) FILTER (same), 0) AS hit FROM (
  SELECT a.track_id, least(a."end", b."end") - greatest(a.start, b.start) AS dur, a.label = b.label AS same
  FROM chord_ref_full a JOIN chord_est_full b ON a.track_id = b.track_id AND a.start < b."end" AND b.start < a."end") GROUP BY track_id),
s AS (SELECT track_id, greatest(rl, el) AS lo, least(rh, eh) AS hi FROM (SELECT track_id, min(start) AS rl, max("end") AS rh FROM chord_ref GROUP BY 1)
  JOIN (SELECT track_id, min(start) AS el, max("end") AS eh FROM chord_est GROUP BY 1) USING (track_id))
SELECT track_id, CASE WHEN hi > lo THEN round(hit / total, 6) ELSE 0 END AS weighted_accuracy, CASE WHEN hi > lo THEN round(hi - lo, 6) ELSE 0 END AS overlap_seconds
  FROM s LEFT JOIN o USING (track_id)""", "chord_ref_full", "chord_est_full"))
def t10(spark, d):
    ref, est = chord_sets(spark, d)
    # Interval lengths here are hours, so the join buckets are days.
    return rounded(Q.weighted_accuracy(ref, est, bucket=86400.0), "weighted_accuracy", "overlap_seconds")


view("phases", """SELECT track_id, CASE WHEN tot > 0 THEN arg_max(p, (s, -p)) ELSE 0 END AS phase, CASE WHEN tot > 0 THEN max(s) * 4 / tot ELSE 1 END AS confidence FROM (
  SELECT *, sum(s) OVER (PARTITION BY track_id) AS tot FROM (SELECT track_id, CAST(p AS INTEGER) AS p, coalesce(sum(strength) FILTER (pos % 4 = p), 0) AS s FROM beats, range(0, 4) r(p) GROUP BY ALL)) GROUP BY track_id, tot""", "beats")


@query("T11", sql("""SELECT b.track_id, p.phase, round(p.confidence, 6) AS confidence, count(*) AS n_bars, round(sum(t), 3) AS total FROM beats b JOIN phases p USING (track_id)
  WHERE pos % 4 = phase GROUP BY ALL""", "beats", "phases"))
def t11(spark, d):
    b = C.beats(spark, d)
    ph = Q.downbeat_phase(b, 4)
    n = Q.downbeats(b, ph, 4).groupBy("track_id").agg(F.count("*").alias("n_bars"), F.round(F.sum("t"), 3).alias("total"))
    return rounded(ph.join(n, "track_id"), "confidence")


@query("T11_strength", sql("""o AS (SELECT track_id, CAST(floor(t / 64) AS BIGINT) AS frame, round(sum(strength), 6) AS strength FROM beats GROUP BY ALL),
e AS (SELECT track_id, max(frame) AS last FROM o GROUP BY 1),
b AS (SELECT track_id, pos, least(greatest(CAST(round_even(t / 64, 0) AS BIGINT), 0), last) AS frame FROM beats JOIN e USING (track_id))
SELECT track_id, pos, frame, strength FROM b JOIN o USING (track_id, frame)""", "beats"))
def t11_strength(spark, d):
    """Onset frames of 64 s: at 8 samples a second a hop of 512 samples."""
    b = C.beats(spark, d)
    onset = b.groupBy("track_id", F.floor(F.col("t") / 64).alias("frame")).agg(F.round(F.sum("strength"), 6).alias("strength"))
    return Q.beat_strength(b.select("track_id", "pos", "t"), onset, 8).select("track_id", "pos", "frame", "strength")


@query("T12", sql("""x AS (SELECT track_id, t + 100000 AS t FROM beats),
p AS (SELECT track_id, median(g) AS p, min(t) AS f, max(t) AS l FROM (SELECT track_id, t, lead(t) OVER (PARTITION BY track_id ORDER BY t) - t AS g FROM x) GROUP BY 1),
a AS (SELECT track_id, greatest(f - m * p, 0) AS t, true AS added FROM p, range(1, 100000) r(m) WHERE p > 0 AND m <= floor(f / p + 1e-9)
  UNION ALL SELECT track_id, l + m * p, true FROM p, range(1, 100000) r(m) WHERE p > 0 AND l + m * p < 2800000 UNION ALL SELECT track_id, t, false FROM x)
SELECT track_id, round(t, 5) AS t, added FROM a""", "beats"))
def t12(spark, d):
    b = C.beats(spark, d).select("track_id", (F.col("t") + 100000).alias("t"))
    out = Q.extend_beats(b, b.select("track_id").distinct().withColumn("duration", F.lit(2800000.0)))
    return out.withColumn("t", F.round("t", 5))


@query("T13", sql("SELECT DISTINCT track_id, round(bpm * f, 2) AS candidate FROM analysis, (VALUES (0.5::DOUBLE), (1), (2)) v(f)", "analysis"))
def t13(spark, d):
    return C.analysis(spark, d).select("track_id", F.explode(U.tempo_candidates(F.col("bpm"))).alias("candidate"))


@query("T14", sql("""h AS (SELECT track_id, count(*) AS hits FROM matched5 GROUP BY 1), r AS (SELECT track_id, count(*) AS n_ref FROM ref_beats WHERE t >= 5 GROUP BY 1),
e AS (SELECT track_id, count(*) AS n_est FROM est_beats WHERE t >= 5 GROUP BY 1)
SELECT u.track_id, coalesce(hits, 0) AS hits, coalesce(n_ref, 0) AS n_ref, coalesce(n_est, 0) AS n_est,
  round(CASE WHEN n_ref > 0 AND n_est > 0 THEN 2.0::DOUBLE * coalesce(hits, 0) / (n_ref + n_est) ELSE 0 END, 6) AS f_measure
  FROM (SELECT DISTINCT track_id FROM beats) u LEFT JOIN h USING (track_id) LEFT JOIN r USING (track_id) LEFT JOIN e USING (track_id)""", "matched5", "beats"))
def t14(spark, d):
    return rounded(Q.beat_f_measure(*two_beat_sets(spark, d)), "f_measure")


@query("T14_cemgil", sql("""near AS (SELECT r.track_id, r.event_id, min(abs(r.t - e.t)) AS d FROM ref_beats r JOIN est_beats e USING (track_id) WHERE r.t >= 5 AND e.t >= 5 GROUP BY ALL),
n AS (SELECT track_id, count(*) AS n FROM (SELECT track_id FROM ref_beats WHERE t >= 5 UNION ALL SELECT track_id FROM est_beats WHERE t >= 5) GROUP BY 1),
s AS (SELECT track_id, sum(exp(-d * d / (2 * 0.04 * 0.04)::DOUBLE)) AS s FROM near GROUP BY 1)
SELECT u.track_id, round(coalesce(2 * s / n, 0), 6) AS cemgil FROM (SELECT DISTINCT track_id FROM beats) u LEFT JOIN s USING (track_id) LEFT JOIN n USING (track_id)""", "ref_beats", "est_beats", "beats"))
def t14_cemgil(spark, d):
    return rounded(Q.beat_cemgil(*two_beat_sets(spark, d)), "cemgil")


def clustered(spark, d):
    return C.beats(spark, d).select("track_id", "pos", (F.col("t") * 1e-4).alias("t"), (F.floor(F.col("pos") / 3) * 5 % 7 % 4).cast("int").alias("cluster"))


def durations(spark, d):
    return clustered(spark, d).groupBy("track_id").agg((F.max("t") + 3).alias("duration"))


view("cb", "SELECT track_id, pos, t * 1e-4::DOUBLE AS t, CAST(pos // 3 * 5 % 7 % 4 AS INTEGER) AS cluster, max(t * 1e-4::DOUBLE) OVER (PARTITION BY track_id) + 3 AS duration FROM beats", "beats")
view("cruns", """SELECT track_id, run, min(t) AS start, max(coalesce(nt, duration)) AS "end", min(cluster) AS cluster FROM (
  SELECT *, sum(f) OVER (PARTITION BY track_id ORDER BY pos) AS run FROM (SELECT *, lead(t) OVER w AS nt, CASE WHEN cluster IS DISTINCT FROM lag(cluster) OVER w THEN 1 ELSE 0 END AS f
    FROM cb WINDOW w AS (PARTITION BY track_id ORDER BY pos))) GROUP BY track_id, run""", "cb")
view("sections", """SELECT *, max(section) OVER (PARTITION BY track_id) AS n FROM (SELECT track_id, section, min(start) AS start, max("end") AS "end", arg_min(cluster, run) AS cluster FROM (
  SELECT *, CAST(sum(CASE WHEN run = 1 OR "end" - start >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY run) AS BIGINT) AS section FROM cruns) GROUP BY track_id, section)""", "cruns")


@query("T15", sql("""z AS (SELECT track_id, count(*) < 8 OR any_value(duration) < 8 AS short, any_value(duration) AS duration FROM cb GROUP BY 1)
SELECT s.track_id, section, round(start, 6) AS start, round("end", 6) AS "end", CASE WHEN n >= 3 AND section = 1 THEN 'intro' WHEN n >= 3 AND section = n THEN 'outro'
  ELSE substr('ABCDEFGH', cluster % 8 + 1, 1) END AS label, cluster FROM sections s JOIN z USING (track_id) WHERE NOT short
UNION ALL SELECT track_id, 1, 0, round(duration, 6), 'A', 0 FROM z WHERE short""", "sections", "cb"))
def t15(spark, d):
    return rounded(Q.merge_sections(clustered(spark, d), durations(spark, d)), "start", "end")


@query("T16", sql("""d AS (SELECT a.track_id, a.piece AS a, b.piece AS b, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 9) AS d FROM sync a JOIN sync b ON a.track_id = b.track_id AND a.pc = b.pc AND a.piece <> b.piece GROUP BY ALL),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, a ORDER BY d, b) AS r FROM d) WHERE r <= 4),
w AS (SELECT track_id, median(d) AS bw FROM n WHERE r = 4 GROUP BY 1),
l AS (SELECT n.track_id, n.a, n.b, coalesce(exp(-n.d / nullif(bw, 0)), 1) AS aff FROM n JOIN n m ON m.track_id = n.track_id AND m.a = n.b AND m.b = n.a JOIN w ON w.track_id = n.track_id),
t AS (SELECT track_id, max(aff) AS top FROM l GROUP BY 1), p AS (SELECT DISTINCT track_id, piece FROM sync),
x AS (SELECT * FROM l UNION ALL SELECT track_id, p.piece, q.piece, top FROM p JOIN p q USING (track_id) JOIN t USING (track_id) WHERE abs(p.piece - q.piece) = 1)
SELECT track_id, a, b, round(max(aff), 6) AS affinity FROM x GROUP BY ALL""", "sync"))
def t16(spark, d):
    return rounded(Q.beat_affinity(sync(spark, d), 4), "affinity")


@query("T17", sql(f"""h AS (SELECT track_id, 60.0::DOUBLE + track_id % 97 / 3.0::DOUBLE AS bpm FROM (SELECT DISTINCT track_id FROM beats)),
c AS (SELECT track_id, count(*) AS n, any_value(label) FILTER (start = m) AS first_chord FROM (SELECT *, min(start) OVER (PARTITION BY track_id) AS m FROM chord_ref) GROUP BY 1)
SELECT h.track_id, 0 AS part, round(bpm, 2) AS bpm, '4/4' AS time_signature, count(*) AS n_beats, round(sum(round(t, 4)), 2) AS beat_sum, count(*) FILTER (pos % 4 = 0) AS n_downbeats,
  any_value(c.n) AS n_chords, any_value(c.first_chord) AS first_chord, (SELECT count(*) FROM sections s WHERE s.track_id = h.track_id) AS n_segments
  FROM h JOIN beats USING (track_id) LEFT JOIN c USING (track_id) GROUP BY h.track_id, bpm""", "beats", "chord_ref", "sections"))
def t17(spark, d):
    b = C.beats(spark, d)
    head = b.groupBy("track_id").agg(F.max("t").alias("duration")).select("track_id", (F.lit(60.0) + F.col("track_id") % 97 / F.lit(3.0)).alias("bpm"), F.lit("C major").alias("key"), "duration")
    bars = b.filter("pos % 4 = 0").select("track_id", F.floor(F.col("pos") / 4).cast("long").alias("pos"), "t")
    ref, _ = chord_sets(spark, d)
    chords = Ordered(ref, ["track_id"], ["start"]).add(_r=("row", None)).result().select("track_id", (F.col("_r") - 1).alias("pos"), "start", "end", "label", F.lit(0.5).alias("confidence"))
    secs = Q.merge_sections(clustered(spark, d), durations(spark, d), n_sections=0, min_seconds=4.0).withColumn("pos", F.col("section") - 1)
    doc = Q.analysis_document(head, b, bars, chords, secs)
    total = F.aggregate("beats", F.lit(0.0), lambda a, x: a + x)
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(None))
    return doc.select("track_id", "part", "bpm", "time_signature", n("beats").alias("n_beats"), F.round(total, 2).alias("beat_sum"), n("downbeats").alias("n_downbeats"),
                      n("chords").alias("n_chords"), F.col("chords")[0]["label"].alias("first_chord"), n("segments").alias("n_segments"))


@query("T18", sql("""x AS (SELECT track_id, CASE WHEN track_id % 20 = 0 THEN 0 ELSE bpm END AS bpm, duration, duration + (track_id % 9 - 4) * 0.9::DOUBLE AS decoded FROM analysis)
SELECT track_id, CASE WHEN abs(decoded - duration) > greatest(1.0, duration * 0.02::DOUBLE) THEN 'duration mismatch' WHEN bpm <= 0 THEN 'no tempo' ELSE 'ok' END AS reason FROM x""", "analysis"))
def t18(spark, d):
    k = F.col("track_id")
    a = C.analysis(spark, d).withColumn("bpm", F.when(k % 20 == 0, 0.0).otherwise(F.col("bpm"))).withColumn("decoded", F.col("duration") + (k % 9 - 4) * 0.9)
    return Q.duration_check(a).select("track_id", "reason")
