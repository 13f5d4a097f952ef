"""Queries A01-A11, L02-L04, P01-P03."""

from pyspark.sql import functions as F

from cadenza.operators import labels as L
from cadenza.plans import canonical as C
from cadenza.plans.registry import query, sql, view


@query("A01", sql("SELECT tag, idx, category, n_train FROM vocab", "vocab"))
def a01(spark, d):
    return C.vocab(spark, d)


@query("A02", sql("SELECT split, tag, idx, y, count(*) AS n FROM dense GROUP BY ALL", "dense"))
def a02(spark, d):
    t = C.tracks(spark, d)
    voc = L.vocab(t.filter("split = 'train'"), C.MIN_POSITIVES)
    return L.encode(t, voc, ["split"]).groupBy("split", "tag", "idx", "y").agg(F.count("*").alias("n"))


view("voc_counts", "SELECT l.tag, count(*) AS n FROM labels_l l JOIN vocab v ON v.tag = l.tag GROUP BY l.tag", "labels_l", "vocab")
view("counts", "SELECT tag, count(*) AS n FROM labels_l GROUP BY tag", "labels_l")


@query("A03", sql("""SELECT (SELECT count(*) FROM tracks) AS n_tracks, count(*) AS n_tags,
  round((SELECT sum(duration) / 3600 FROM tracks), 6) AS total_hours,
  round((SELECT count(*) FROM labels_l) / (SELECT count(*)::DOUBLE FROM tracks), 6) AS tags_per_track,
  round(sum(n) / ((SELECT count(*) FROM tracks) * count(*))::DOUBLE, 6) AS label_density,
  max(n) AS freq_max, CAST(trunc(median(n)) AS INTEGER) AS freq_median, min(n) AS freq_min,
  round((SELECT sum(n) FROM (SELECT n FROM voc_counts ORDER BY n DESC LIMIT greatest(1, (SELECT count(*) FROM voc_counts) // 10))) / sum(n)::DOUBLE, 6) AS head10pct_share,
  count(*) FILTER (n < 50) AS n_below_50 FROM voc_counts""", "voc_counts", "tracks"))
def a03(spark, d):
    t = C.tracks(spark, d)
    s = L.tag_statistics(t, L.vocab(t.filter("split = 'train'"), C.MIN_POSITIVES))
    r = lambda c: F.round(c, 6).alias(c)
    return s.select("n_tracks", "n_tags", r("total_hours"), r("tags_per_track"), r("label_density"), "freq_max",
                    "freq_median", "freq_min", r("head10pct_share"), "n_below_50")


@query("A04", sql("""SELECT round((SELECT sum(n) FROM (SELECT n FROM counts ORDER BY n DESC
  LIMIT greatest(1, (SELECT count(*) FROM counts) // 10))) / sum(n)::DOUBLE, 6) AS head_share FROM counts""", "counts"))
def a04(spark, d):
    return L.head_share(L.tag_counts(C.tracks(spark, d))).select(F.round("head_share", 6).alias("head_share"))


@query("A05", sql("""SELECT split_part(tag, '---', 1) AS category, count(*) AS n_tags, min(n) AS min, max(n) AS max,
  CAST(trunc(median(n)) AS INTEGER) AS median FROM counts GROUP BY 1""", "counts"))
def a05(spark, d):
    return L.category_stats(L.tag_counts(C.tracks(spark, d)))


@query("A06", sql("""per_tag AS (SELECT t.split, l.tag, count(*) AS n FROM labels_l l JOIN tracks t USING (track_id)
  JOIN vocab v ON v.tag = l.tag GROUP BY ALL)
SELECT split, count(*) AS n_tracks, round(sum(duration) / 3600, 6) AS hours,
  (SELECT count(*) FROM per_tag p WHERE p.split = t.split) AS n_tags,
  (SELECT count(*) FROM per_tag p WHERE p.split = t.split AND n < 500) AS n_thin FROM tracks t GROUP BY split""", "vocab"))
def a06(spark, d):
    t = C.tracks(spark, d)
    voc = L.vocab(t.filter("split = 'train'"), C.MIN_POSITIVES)
    return L.split_stats(t, voc, thin=500).withColumn("hours", F.round("hours", 6))


@query("A07", sql("""SELECT row_number() OVER w AS rank, tag, n, round(row_number() OVER w / (SELECT count(*)::DOUBLE FROM counts), 6) AS tag_share,
  round(sum(n) OVER (ORDER BY n DESC, tag ROWS UNBOUNDED PRECEDING) / (SELECT sum(n)::DOUBLE FROM counts), 6) AS cum_share
  FROM counts WINDOW w AS (ORDER BY n DESC, tag)""", "counts"))
def a07(spark, d):
    r = L.cumulative_share(L.tag_counts(C.tracks(spark, d)))
    return r.withColumn("tag_share", F.round("tag_share", 6)).withColumn("cum_share", F.round("cum_share", 6))


@query("A08", sql("""SELECT 'top' AS side, tag, n, round(n / (SELECT count(*)::DOUBLE FROM tracks) * 100, 6) AS percent
  FROM (SELECT * FROM counts ORDER BY n DESC, tag LIMIT 15)
  UNION ALL SELECT 'bottom', tag, n, round(n / (SELECT count(*)::DOUBLE FROM tracks) * 100, 6)
  FROM (SELECT * FROM counts ORDER BY n, tag DESC LIMIT 15)""", "counts", "tracks"))
def a08(spark, d):
    t = C.tracks(spark, d)
    return L.top_bottom(L.tag_counts(t), t.count(), 15).withColumn("percent", F.round("percent", 6))


@query("A09", sql("SELECT round(avg(v), 6) AS mean, round(stddev_pop(v) + 1e-8, 6) AS std FROM frame_dims", "frame_dims"))
def a09(spark, d):
    """All tracks."""
    return L.norm_stats(C.frames(spark, d)).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("A09_sample", sql("""SELECT round(avg(v), 6) AS mean, round(stddev_pop(v) + 1e-8, 6) AS std FROM frame_dims
  WHERE track_id IN (SELECT track_id FROM (SELECT DISTINCT track_id FROM frames)
    ORDER BY ('0x' || substr(md5('0:' || track_id), 1, 8))::BIGINT, track_id LIMIT 30)""", "frame_dims"))
def a09_sample(spark, d):
    """The sampling form of A09: thirty tracks by the order of their hashes."""
    return L.norm_stats(C.frames(spark, d), 30).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("A10", sql("""st AS (SELECT i, avg(v) AS mean, stddev_pop(v) AS std FROM frame_dims WHERE track_id % 5 < 4 GROUP BY i)
SELECT f.track_id, f.frame, f.i, round((v - mean) / std, 6) AS z FROM frame_dims f JOIN st USING (i)""", "frame_dims"))
def a10(spark, d):
    f = C.frames(spark, d)
    st = L.dimension_stats(f.filter("track_id % 5 < 4"))
    z = L.standardise_by_dimension(f, st)
    return z.select("track_id", "frame", F.posexplode("vec").alias("p", "v")).select(
        "track_id", "frame", (F.col("p") + 1).alias("i"), F.round("v", 6).alias("z"))


@query("A11", sql("""stored AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS idx FROM (
  SELECT DISTINCT tag FROM labels_l JOIN tracks USING (track_id) WHERE split = 'validation' AND tag <> 'brand---Brand#3'))
SELECT idx, s.tag AS stored_tag, v.tag AS current_tag FROM stored s FULL JOIN vocab v USING (idx)
WHERE s.tag IS DISTINCT FROM v.tag""", "vocab"))
def a11(spark, d):
    t = C.tracks(spark, d)
    older = t.filter("split = 'validation'").withColumn("tags", F.array_remove("tags", "brand---Brand#3"))
    return L.vocab_contract(L.vocab(older),
                            L.vocab(t.filter("split = 'train'"), C.MIN_POSITIVES))


view("train_labels", "SELECT track_id, tag FROM labels_l JOIN tracks USING (track_id) WHERE split = 'train'", "labels_l", "tracks")
view("cooc", """SELECT x.tag AS a, y.tag AS b, count(*) AS n_ab FROM train_labels x JOIN train_labels y USING (track_id) GROUP BY ALL""",
     "train_labels")
view("cooc_p", """SELECT c.a, c.b, c.n_ab, p.n_ab AS n_a, q.n_ab AS n_b, c.n_ab / p.n_ab::DOUBLE AS p_b_given_a, c.n_ab / q.n_ab::DOUBLE AS p_a_given_b
  FROM cooc c JOIN cooc p ON p.a = c.a AND p.b = c.a JOIN cooc q ON q.a = c.b AND q.b = c.b""", "cooc")
view("rules", "SELECT a, b FROM cooc_p WHERE a <> b AND n_a >= 20 AND p_b_given_a >= 0.5 AND p_a_given_b < 0.3", "cooc_p")


def _train_labels(spark, d):
    return L.long_labels(C.tracks(spark, d).filter("split = 'train'"))


GENRES = [a for a, _ in L.SEMANTIC_RULES] + ["genre---electronic"]
view("genres", f"""SELECT DISTINCT t.split, l.track_id, ({GENRES})[v.idx % {len(GENRES)} + 1] AS tag FROM labels_l l JOIN vocab v USING (tag) JOIN tracks t USING (track_id)""",
     "labels_l", "vocab", "tracks")


@query("L01", sql("""SELECT split, track_id, tag FROM genres UNION SELECT split, track_id, 'genre---electronic' FROM genres WHERE split = 'train'""", "genres"))
def l01(spark, d):
    """The fixed rules on labels renamed to their genres."""
    name = F.element_at(F.lit(GENRES), (F.col("idx") % len(GENRES)).cast("int") + 1)
    rows = L.long_labels(C.tracks(spark, d), ("split",)).join(C.vocab(spark, d).select("tag", "idx"), "tag").select("split", "track_id", name.alias("tag")).distinct()
    return L.propagate(rows, L.semantic_rules(spark), spark.createDataFrame([(g,) for g in GENRES], "tag string"))


@query("L02", sql("""SELECT a, b, n_ab, n_a, n_b, round(p_b_given_a, 6) AS p_b_given_a, round(p_a_given_b, 6) AS p_a_given_b
  FROM cooc_p""", "cooc_p"))
def l02(spark, d):
    return L.cooccurrence(_train_labels(spark, d)).withColumn("p_b_given_a", F.round("p_b_given_a", 6)).withColumn(
        "p_a_given_b", F.round("p_a_given_b", 6))


@query("L03", sql("SELECT a, b FROM rules", "rules"))
def l03(spark, d):
    return L.mine_rules(_train_labels(spark, d)).select("a", "b")


@query("L04", sql("""edges AS (SELECT a, b FROM rules UNION ALL SELECT 'type---ECONOMY', 'priority---5-LOW'
    UNION ALL SELECT 'priority---5-LOW', 'type---ECONOMY'),
closed AS (SELECT a, b FROM edges UNION SELECT c.a, e.b FROM closed c JOIN edges e ON c.b = e.a),
grown AS (SELECT t.split, l.track_id, l.tag FROM labels_l l JOIN tracks t USING (track_id)
  UNION SELECT 'train', l.track_id, c.b FROM train_labels l JOIN closed c ON c.a = l.tag)
SELECT split, tag, count(*) AS n FROM grown GROUP BY ALL""", "rules", "tracks"))
def l04(spark, d):
    t = C.tracks(spark, d)
    rules = L.mine_rules(L.long_labels(t.filter("split = 'train'"))).select("a", "b").unionByName(spark.createDataFrame(
        [("type---ECONOMY", "priority---5-LOW"), ("priority---5-LOW", "type---ECONOMY")], "a string, b string"))
    grown = L.propagate(L.long_labels(t, ("split",)), rules, L.vocab(t))
    return grown.groupBy("split", "tag").agg(F.count("*").alias("n"))


@query("P01", sql("""SELECT tag, split_part(tag, '---', 1) AS category, substr(tag, strpos(tag, '---') + 3) AS name, count(*) AS n
  FROM labels_l GROUP BY ALL""", "labels_l"))
def p01(spark, d):
    return L.with_category(C.label_rows(spark, d)).groupBy("tag", "category", "name").agg(F.count("*").alias("n"))


@query("P02", sql("""ids AS (SELECT DISTINCT split, u.attr, u.id FROM tracks, LATERAL (VALUES ('track_id', track_id), ('artist_id', artist_id), ('album_id', album_id)) u(attr, id))
SELECT a.attr, a.split AS split_a, b.split AS split_b, count(*) AS n_shared FROM ids a JOIN ids b
  ON a.attr = b.attr AND a.id = b.id AND a.split < b.split GROUP BY ALL""", "tracks"))
def p02(spark, d):
    return L.leakage(C.track_rows(spark, d), ("track_id", "artist_id", "album_id"))


@query("P03", """SELECT l_orderkey AS track_id, count(*) AS n_rows FROM lineitem WHERE l_orderkey IN (
  SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3) GROUP BY 1""")
def p03(spark, d):
    f = C.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.col("l_returnflag").alias("source"))
    return L.complete_cases(f, ("A", "N", "R")).groupBy("track_id").agg(F.count("*").alias("n_rows"))
