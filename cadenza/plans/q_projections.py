"""Queries P04, P06-P11, P17."""

from pyspark.sql import functions as F

from cadenza.operators import sampling as S
from cadenza.operators import signal as G
from cadenza.plans import canonical as C
from cadenza.plans.q_tagging import rounded
from cadenza.plans.registry import query, sql


def md5_sql(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8))::BIGINT"


@query("P04", sql("""SELECT track_id, path FROM (SELECT *, row_number() OVER (ORDER BY path) - 1 AS r, (SELECT count(*) // 25 FROM tracks) AS step FROM tracks)
  WHERE r % step = 0 AND r < step * 25""", "tracks"))
def p04(spark, d):
    return S.equi_sample(C.track_rows(spark, d).select("track_id", "path"), 25, ["path"])


@query("P06", sql("""SELECT track_id, CAST(CASE WHEN n <= 3000 THEN 0 ELSE least(6000, n - 3000) END AS BIGINT) AS start,
  CAST(CASE WHEN n <= 3000 THEN n ELSE least(6000, n - 3000) + 3000 END AS BIGINT) AS stop FROM (SELECT track_id, CAST((duration - 50) * 100 AS BIGINT) AS n FROM tracks)""", "tracks"))
def p06(spark, d):
    n = ((F.col("duration") - 50) * 100).cast("long")
    start, stop = S.pick_window(n, 3000, 6000)
    return C.track_rows(spark, d).select("track_id", start.cast("long").alias("start"), stop.cast("long").alias("stop"))


@query("P07", sql("""w AS (SELECT track_id, CAST(duration * 10 AS BIGINT) AS n FROM tracks)
SELECT track_id, CASE WHEN n <= 1501 THEN 0 ELSE (n - 1501) // 2 END AS start, CASE WHEN n <= 1501 THEN n ELSE (n - 1501) // 2 + 1501 END AS stop,
  greatest(1501 - n, 0) AS pad FROM w""", "tracks"))
def p07(spark, d):
    a, b, z = S.center_window((F.col("duration") * 10).cast("long"), 1501)
    return C.track_rows(spark, d).select("track_id", a.cast("long").alias("start"), b.cast("long").alias("stop"), z.cast("long").alias("pad"))


@query("P08", sql("""SELECT track_id, CAST(s AS INTEGER) AS segment, round(greatest(0, duration - 90) * s / 3.0::DOUBLE, 6) AS start FROM tracks, range(0, 4) g(s)""", "tracks"))
def p08(spark, d):
    return rounded(S.segment_starts(C.track_rows(spark, d).select("track_id", "duration"), "duration", 90.0, 4).select("track_id", "segment", "start"), "start")


@query("P09", sql(f"""SELECT track_id, {md5_sql("'3'", "'5'", "track_id")} % (greatest(n - 900, 0) + 1) AS start
  FROM (SELECT track_id, CAST(duration * 10 AS BIGINT) AS n FROM tracks)""", "tracks"))
def p09(spark, d):
    t = C.track_rows(spark, d).select("track_id", (F.col("duration") * 10).cast("long").alias("n"))
    return S.random_crop(t, 3, 5, "n", 900).select("track_id", "start")


@query("P10", sql(f"""SELECT track_id, chunk, row_number() OVER w - 1 AS position, (row_number() OVER w - 1) // 32 AS batch FROM tracks WHERE split = 'train'
  WINDOW w AS (ORDER BY {md5_sql("'9'", "'chunk'", "chunk")}, chunk, {md5_sql("'9'", "track_id")}, track_id)""", "tracks"))
def p10(spark, d):
    t = C.track_rows(spark, d).filter("split = 'train'").select("track_id", "chunk")
    return S.epoch_order(t, seed=7, epoch=2, batch=32)


@query("P11", sql("""SELECT track_id, CAST((CASE WHEN frame // 2 = 3 THEN 0 WHEN frame // 2 = 0 THEN 1 ELSE 2 END) * 2 + frame % 2 AS INTEGER) AS frame, frame AS source_frame
  FROM frames WHERE frame // 2 IN (3, 0, 4)""", "frames"))
def p11(spark, d):
    f = C.frames(spark, d).select("track_id", "frame", F.col("frame").alias("source_frame"))
    return G.use_segments(f, 5, (3, 0, 4), length=C.TRACK_FRAMES)


@query("P17_two_tags", sql(f"""s AS (SELECT t AS trial, tag, y, {md5_sql("'0'", "t", "id", "tag")} / 4294967296.0::DOUBLE AS score FROM doc_scores, range(0, 20) g(t)),
c AS (SELECT *, sum(y) OVER w AS ctp, count(*) OVER w AS cm FROM s WINDOW w AS (PARTITION BY trial, tag ORDER BY score DESC)),
a AS (SELECT trial, tag, sum(y * (ctp / cm::DOUBLE)) / sum(y) AS ap FROM c GROUP BY ALL),
m AS (SELECT trial, avg(ap) AS map, count(*) AS v FROM a GROUP BY trial)
SELECT round(avg(map), 6) AS map, count(*) AS n_trials, max(v) AS n_valid_tags FROM m""", "doc_scores"))
def p17_two_tags(spark, d):
    """The floor on the two tags of the labelled documents."""
    return rounded(S.random_baseline(C.doc_scores(spark, d), 20, 0, "id"), "map")


@query("P17", sql(f"""s AS (SELECT t AS trial, tag, y, {md5_sql("'0'", "t", "track_id", "tag")} / 4294967296.0::DOUBLE AS score FROM dense, range(0, 20) g(t)),
g AS (SELECT trial, tag, score, sum(y) AS tp, count(*) AS m FROM s GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER w AS ctp, sum(m) OVER w AS cm FROM g WINDOW w AS (PARTITION BY trial, tag ORDER BY score DESC)),
a AS (SELECT trial, tag, sum(tp * (ctp / cm::DOUBLE)) / sum(tp) AS ap FROM c GROUP BY ALL HAVING sum(tp) > 0 AND sum(tp) < sum(m)),
m AS (SELECT trial, avg(ap) AS map, count(*) AS v FROM a GROUP BY trial)
SELECT round(avg(map), 6) AS map, count(*) AS n_trials, max(v) AS n_valid_tags FROM m""", "dense"))
def p17(spark, d):
    """Every tag of the vocabulary."""
    return rounded(S.random_baseline_of_tracks(C.tracks(spark, d), C.vocab(spark, d), 20), "map")
