"""Queries J04-J08."""

from pyspark.sql import functions as F

from cadenza.core.ordered import Ordered
from cadenza.operators import joins as J
from cadenza.plans import canonical as C
from cadenza.plans.q_tagging import rounded
from cadenza.plans.registry import query, sql, view

DAY = 86400.0


def intervals(spark, d, every: int):
    """Consecutive intervals between every n-th beat of a user."""
    b = C.beats(spark, d).filter(F.col("pos") % every == 0)
    o = Ordered(b, ["track_id"], ["pos"]).add(end=("lead", F.col("t"))).result()
    return o.filter("end IS NOT NULL").select("track_id", F.col("t").alias("start"), "end", "label", "event_id")


for _n in (1, 2, 3):
    view(f"intervals{_n}", f"""SELECT * FROM (SELECT track_id, t AS start, lead(t) OVER (PARTITION BY track_id ORDER BY pos) AS "end", label, event_id
      FROM beats WHERE pos % {_n} = 0) WHERE "end" IS NOT NULL""", "beats")


@query("J04", sql("""SELECT a.track_id, round(greatest(a.start, b.start), 6) AS start, round(least(a."end", b."end"), 6) AS "end",
  round(least(a."end", b."end") - greatest(a.start, b.start), 6) AS duration, a.label AS ref_label, b.label AS est_label
  FROM intervals1 a JOIN intervals3 b ON a.track_id = b.track_id AND a.start < b."end" AND b.start < a."end" """, "intervals1", "intervals3"))
def j04(spark, d):
    return rounded(J.interval_overlap(intervals(spark, d, 1), intervals(spark, d, 3), bucket=DAY), "start", "end", "duration")


view("passed", """SELECT f.track_id, f.pos, f.t, (SELECT count(*) FROM beats b WHERE b.track_id = f.track_id AND b.pos % 3 = 1 AND b.t <= f.t) AS n FROM beats f""", "beats")
view("pieces", "SELECT track_id, pos, t, n - least(min(n) OVER (PARTITION BY track_id), 1) AS piece FROM passed", "passed")


def frame_pieces(spark, d, *extra):
    """The pieces of all beats; their ``extra`` columns come along."""
    b = C.beats(spark, d)
    return J.frames_to_beats(b.select("track_id", "pos", "t", *extra), b.filter("pos % 3 = 1"))


@query("J05", sql("SELECT track_id, pos, piece FROM pieces", "pieces"))
def j05(spark, d):
    return frame_pieces(spark, d).select("track_id", "pos", "piece")


@query("J06", sql("""SELECT p.track_id, p.pos, l.label, CAST((SELECT count(*) FROM beats b WHERE b.track_id = p.track_id AND b.pos % 5 = 0 AND b.t <= p.t + 1e-6) AS BIGINT) AS n_passed
  FROM beats p LEFT JOIN beats l ON l.track_id = p.track_id AND l.pos % 5 = 0 AND l.pos = (p.pos // 5) * 5""", "beats"))
def j06(spark, d):
    b = C.beats(spark, d)
    points = b.select("track_id", "pos", "t")
    return J.asof(points, b.filter("pos % 5 = 0").select("track_id", "t", "label"), "label").select("track_id", "pos", "label", "n_passed")


def two_beat_sets(spark, d):
    """Reference beats and shifted estimates, one in five of them doubled, on a compressed clock."""
    b = C.beats(spark, d).select("track_id", (F.col("t") * 1e-5).alias("t"), "event_id")
    shift = F.element_at(F.lit([0.03, 0.05, 0.09, -0.02]), (F.col("event_id") % 4 + 1).cast("int"))
    extra = b.filter("event_id % 5 = 0").select("track_id", (F.col("t") + 0.06).alias("t"))
    return b.select("track_id", "t"), b.select("track_id", (F.col("t") + shift).alias("t")).unionByName(extra)


view("ref_beats", "SELECT track_id, t * 1e-5::DOUBLE AS t, event_id FROM beats", "beats")
view("est_beats", """SELECT track_id, t + ([0.03, 0.05, 0.09, -0.02]::DOUBLE[])[CAST(event_id % 4 + 1 AS INTEGER)] AS t FROM ref_beats
  UNION ALL SELECT track_id, t + 0.06::DOUBLE FROM ref_beats WHERE event_id % 5 = 0""", "ref_beats")
for _name, _cut in (("matched", "-1"), ("matched5", "5")):
    view(f"{_name}_lists", f"""SELECT track_id, rs, es FROM (SELECT track_id, list(t ORDER BY t) AS rs FROM ref_beats WHERE t >= {_cut} GROUP BY 1)
      JOIN (SELECT track_id, list(t ORDER BY t) AS es FROM est_beats WHERE t >= {_cut} GROUP BY 1) USING (track_id)""", "ref_beats", "est_beats")
    view(f"{_name}_steps", f"""SELECT track_id, 1 AS i, 1 AS j, NULL::DOUBLE AS ref_t, NULL::DOUBLE AS est_t FROM {_name}_lists UNION ALL
      SELECT s.track_id, CASE WHEN abs(rs[i] - es[j]) <= 0.07::DOUBLE OR rs[i] < es[j] THEN i + 1 ELSE i END,
        CASE WHEN abs(rs[i] - es[j]) <= 0.07::DOUBLE OR rs[i] >= es[j] THEN j + 1 ELSE j END,
        CASE WHEN abs(rs[i] - es[j]) <= 0.07::DOUBLE THEN rs[i] END, CASE WHEN abs(rs[i] - es[j]) <= 0.07::DOUBLE THEN es[j] END
      FROM {_name}_steps s JOIN {_name}_lists l ON l.track_id = s.track_id WHERE i <= len(rs) AND j <= len(es)""", f"{_name}_lists")
    view(_name, f"SELECT track_id, ref_t, est_t FROM {_name}_steps WHERE ref_t IS NOT NULL", f"{_name}_steps")


@query("J07", sql("SELECT track_id, round(ref_t, 6) AS ref_t, round(est_t, 6) AS est_t FROM matched", "matched"))
def j07(spark, d):
    ref, est = two_beat_sets(spark, d)
    return rounded(J.match_within(ref, est), "ref_t", "est_t")


@query("J08", sql("SELECT a.track_id, a.pos, round(a.t, 6) AS a, round(b.t, 6) AS b FROM beats a JOIN beats b ON a.track_id = b.track_id AND b.pos % 2 = 0 AND b.pos // 2 = a.pos", "beats"))
def j08(spark, d):
    b = C.beats(spark, d)
    half = b.filter("pos % 2 = 0").select("track_id", F.floor(F.col("pos") / 2).cast("long").alias("pos"), "t")
    return rounded(J.zip_by_ordinal(b, half), "a", "b")
