"""Queries R01-R15."""

from pyspark.sql import functions as F

from cadenza.core.session import materialise
from cadenza.operators import retrieval as R
from cadenza.plans import canonical as C
from cadenza.plans.q_tagging import rounded
from cadenza.plans.registry import query, sql, view

DEPTH = 50
view("unit", """SELECT id, label, tags, list_transform(vec, lambda x: x / n) AS vec FROM (
  SELECT *, greatest(sqrt(list_dot_product(vec, vec)), 1e-12) AS n FROM emb)""", "emb")
view("sims", "SELECT a.id AS q, b.id AS item, round(list_dot_product(a.vec, b.vec), 9) AS score FROM unit a JOIN unit b ON a.id <> b.id", "unit")
view("ranked", f"SELECT * FROM (SELECT q, item, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS rank FROM sims) WHERE rank <= {DEPTH}", "sims")
view("shared", "SELECT a.id AS q, b.id AS item, len(list_intersect(a.tags, b.tags)) AS shared FROM emb a JOIN emb b ON a.id <> b.id", "emb")
view("nrel", "SELECT q, count(*) FILTER (shared >= 3) AS n_relevant FROM shared GROUP BY q", "shared")
view("judged", """SELECT r.q, r.item, r.rank, s.shared AS gain, CASE WHEN s.shared >= 3 THEN 1 ELSE 0 END AS rel, n_relevant
  FROM ranked r JOIN shared s USING (q, item) JOIN nrel USING (q)""", "ranked", "shared", "nrel")
view("ideal", f"SELECT * FROM (SELECT q, shared AS gain, row_number() OVER (PARTITION BY q ORDER BY shared DESC) AS rank FROM shared) WHERE rank <= {DEPTH}", "shared")
view("perq", """SELECT q, k, sum(rel) AS hits, sum(rel * cum / rank::DOUBLE) AS ap, sum(gain / log2(rank + 1)) AS dcg, any_value(n_relevant) AS n_relevant,
  (SELECT sum(i.gain / log2(i.rank + 1)) FROM ideal i WHERE i.q = j.q AND i.rank <= j.k) AS idcg FROM (
  SELECT d.*, k, sum(rel) OVER (PARTITION BY q, k ORDER BY rank) AS cum FROM judged d, (VALUES (1), (5), (10), (50)) v(k)) j
  WHERE rank <= k GROUP BY q, k""", "judged", "ideal")


def corpus(spark, d):
    return C.embeddings(spark, d)


@C.stored("ranked")
def ranked(spark, d):
    e = corpus(spark, d)
    return R.exact_topk(e, e, DEPTH)


@C.stored("histogram")
def histogram(spark, d):
    e = corpus(spark, d)
    return R.gain_histogram(e, e)


def judged(spark, d):
    e = corpus(spark, d)
    return R.relevance(ranked(spark, d), e, e, histogram(spark, d))


@query("R01", sql("SELECT id, i, round(vec[i], 6) AS v FROM (SELECT id, vec, unnest(range(1, 65)) AS i FROM unit)", "unit"))
def r01(spark, d):
    n = R.l2_normalise(corpus(spark, d))
    return n.select("id", F.posexplode("vec").alias("p", "x")).select("id", (F.col("p") + 1).alias("i"), F.round("x", 6).alias("v"))


@query("R02", sql("SELECT q, shared, count(*) AS n_items FROM shared WHERE shared > 0 GROUP BY ALL", "shared"))
def r02(spark, d):
    e = corpus(spark, d)
    return R.gain_histogram(e, e)


@query("R02_orders", sql("""v AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS i FROM (SELECT DISTINCT tag FROM labels_l)),
m AS MATERIALIZED (SELECT track_id, (sum(CASE WHEN i < 60 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS x, (sum(CASE WHEN i BETWEEN 60 AND 119 THEN 1::BIGINT << (i - 60) ELSE 0 END))::BIGINT AS y,
  (sum(CASE WHEN i BETWEEN 120 AND 179 THEN 1::BIGINT << (i - 120) ELSE 0 END))::BIGINT AS z, list(tag) FILTER (i >= 180) AS more FROM labels_l JOIN v USING (tag) GROUP BY track_id),
s AS (SELECT a.track_id AS q, (bit_count(a.x & b.x) + bit_count(a.y & b.y) + bit_count(a.z & b.z) + coalesce(len(list_intersect(a.more, b.more)), 0))::INTEGER AS shared
  FROM m a JOIN m b ON a.track_id <> b.track_id)
SELECT q, shared, count(*) AS n_items FROM s WHERE shared > 0 GROUP BY ALL""", "labels_l"))
def r02_orders(spark, d):
    """The tag sets of all orders, some of them larger than a list of subsets can be."""
    t = C.tracks(spark, d).select(F.col("track_id").alias("id"), "tags")
    return R.gain_histogram(t, t)


@query("R03", sql("SELECT q, item, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10", "ranked"))
def r03(spark, d):
    e = corpus(spark, d)
    return rounded(R.exact_topk(e, e, 10).select("q", "item", "rank", "score"), "score")


@query("R04", sql("SELECT q, item, rank, gain, rel, n_relevant FROM judged", "judged"))
def r04(spark, d):
    return judged(spark, d).select("q", "item", "rank", "gain", "rel", "n_relevant")


@query("R05", sql("""SELECT k, round(avg(CASE WHEN hits > 0 THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(hits / k::DOUBLE), 6) AS precision,
  round(avg(hits / n_relevant::DOUBLE) FILTER (n_relevant > 0), 6) AS recall FROM perq GROUP BY k""", "perq"))
def r05(spark, d):
    return rounded(R.hit_precision_recall(judged(spark, d)), "hit_rate", "precision", "recall")


@query("R06", sql("SELECT round(avg(ap / least(n_relevant, k)), 6) AS map, count(*) AS n FROM perq WHERE k = 10 AND n_relevant > 0", "perq"))
def r06(spark, d):
    return rounded(R.map_at_k(judged(spark, d), 10), "map")


@query("R07", sql("SELECT round(avg(dcg / idcg), 6) AS ndcg, count(*) AS n FROM perq WHERE k = 10 AND idcg > 0", "perq"))
def r07(spark, d):
    return rounded(R.ndcg_at_k(judged(spark, d), R.ideal_gains(histogram(spark, d), 10), 10), "ndcg")


@query("R08", sql("SELECT q, rank, gain FROM ideal WHERE gain > 0 AND rank <= 20", "ideal"))
def r08(spark, d):
    return R.ideal_gains(histogram(spark, d), 20)


@query("R09", sql("""SELECT round(avg(j), 6) AS jaccard, count(*) AS n_queries FROM (
  SELECT r.q, avg(len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags)))::DOUBLE) AS j
  FROM ranked r JOIN emb a ON a.id = r.q JOIN emb b ON b.id = r.item WHERE rank <= 10 GROUP BY r.q)""", "ranked"))
def r09(spark, d):
    e = corpus(spark, d)
    return rounded(R.jaccard_at_k(ranked(spark, d), e, e, 10), "jaccard")


@query("R10", sql("""SELECT k, round(avg(CASE WHEN hits > 0 THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(hits / n_relevant::DOUBLE) FILTER (n_relevant > 0), 6) AS recall,
  round(avg(hits / k::DOUBLE), 6) AS precision, round(avg(ap / least(n_relevant, k)) FILTER (n_relevant > 0), 6) AS map,
  round(avg(dcg / idcg) FILTER (idcg > 0), 6) AS ndcg, count(*) AS n_queries, round(avg(n_relevant), 6) AS mean_n_relevant FROM perq GROUP BY k""", "perq"))
def r10(spark, d):
    out = R.evaluate_retrieval(judged(spark, d), R.ideal_gains(histogram(spark, d), DEPTH), (1, 5, 10, 50, 100000))
    return rounded(out, "hit_rate", "recall", "precision", "map", "ndcg", "mean_n_relevant")


@query("R11", """SELECT count(*) AS n_queries, count(*) * 10 AS n_results, 0 AS n_misplaced, TRUE AS recall_reached FROM embeddings""")
def r11(spark, d):
    """k-means lists, as many probes as 0.9 of the exact result need: what holds for any seed. R11_all_lists has the rows."""
    e = corpus(spark, d)
    lists, centroids = R.ivf_build(e, 16)
    probes = R.ivf_probes(e, centroids, R.probes_for_recall(e, lists, centroids, 10))
    found = materialise(R.ivf_search(e, lists, probes, 10), "found")
    n = found.agg(F.countDistinct("q").alias("n_queries"), F.count("*").alias("n_results"))
    bad = R.misplaced(lists, centroids).agg(F.count("*").cast("int").alias("n_misplaced"))
    reached = R.index_recall(found, R.exact_topk(e, e, 10), 10).select((F.col("index_recall") >= 0.9).alias("recall_reached"))
    k = lambda df: df.withColumn("_k", F.lit(1))
    return k(n).join(k(bad), "_k").join(k(reached), "_k").drop("_k")


@query("R11_all_lists", sql("SELECT q, item, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10", "ranked"))
def r11_all(spark, d):
    """The same lists with every list probed: exact search, whatever k-means found."""
    e = corpus(spark, d)
    lists, centroids = R.ivf_build(e, 16)
    every = R.ivf_probes(e, centroids, centroids.count())
    return rounded(R.ivf_search(e, lists, every, 10).select("q", "item", "rank", "score"), "score")


# Lists given by the label column: the same search with an assignment SQL can repeat.
view("centroids", """SELECT label AS list_id, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12)) AS vec FROM (
  SELECT label, list(a ORDER BY i) AS m FROM (SELECT label, i, avg(vec[i]) AS a FROM (SELECT label, vec, unnest(range(1, 65)) AS i FROM unit) GROUP BY ALL) GROUP BY label)""", "unit")
view("probes_all", """SELECT q, list_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, list_id) AS pr FROM (
  SELECT u.id AS q, c.list_id, round(list_dot_product(u.vec, c.vec), 9) AS s FROM unit u, centroids c)""", "unit", "centroids")
APPROX = """SELECT q, item FROM (SELECT s.q, s.item, row_number() OVER (PARTITION BY s.q ORDER BY s.score DESC, s.item) AS rank
  FROM sims s JOIN unit u ON u.id = s.item JOIN probes_all p ON p.q = s.q AND p.list_id = u.label AND p.pr <= {n}) WHERE rank <= 10"""
RECALL = "SELECT avg(h) FROM (SELECT r.q, count(a.item) / 10.0::DOUBLE AS h FROM ranked r LEFT JOIN ({a}) a ON a.q = r.q AND a.item = r.item WHERE r.rank <= 10 GROUP BY r.q)"
WORK = "SELECT count(*) FROM sims s JOIN unit u ON u.id = s.item JOIN probes_all p ON p.q = s.q AND p.list_id = u.label AND p.pr <= {n}"


def label_lists(spark, d):
    lists = R.l2_normalise(corpus(spark, d)).select("id", "vec", F.col("label").alias("list_id"))
    return lists, R.list_centroids(lists)


@query("R12", sql(f"SELECT round(({RECALL.format(a=APPROX.format(n=3))}), 6) AS index_recall, (SELECT count(*) FROM unit) AS n_queries", "ranked", "probes_all"))
def r12(spark, d):
    e = corpus(spark, d)
    lists, centroids = label_lists(spark, d)
    approx = R.ivf_search(e, lists, R.ivf_probes(e, centroids, 3), 10)
    return rounded(R.index_recall(approx, ranked(spark, d), 10), "index_recall")


@query("R13", sql(f"SELECT ({WORK.format(n=3)}) AS n_compared", "sims", "probes_all"))
def r13(spark, d):
    lists, centroids = label_lists(spark, d)
    return R.n_compared(R.ivf_probes(corpus(spark, d), centroids, 3), lists)


@query("R14", sql("""n AS (SELECT count(*) AS n FROM emb),
p AS (SELECT n, (SELECT min(x) FROM range(n, n + 200) r(x) WHERE NOT EXISTS (SELECT 1 FROM range(2, 1000) f(y) WHERE y * y <= x AND x % y = 0)) AS p FROM n),
walk AS (SELECT e.id AS q, r, (('0x' || substr(md5('7:start:' || e.id), 1, 8))::BIGINT % p + r * (1 + ('0x' || substr(md5('7:step:' || e.id), 1, 8))::BIGINT % (p - 1))) % p AS pos, n
  FROM emb e, p, range(0, 10 + p - n) w(r))
SELECT q, item, rank FROM (SELECT q, pos, row_number() OVER (PARTITION BY q ORDER BY r) AS rank FROM walk WHERE pos < n)
JOIN (SELECT id AS item, row_number() OVER (ORDER BY id) - 1 AS pos FROM emb) USING (pos) WHERE rank <= 10""", "emb"))
def r14(spark, d):
    e = corpus(spark, d)
    return R.random_topk(e, e, 10, seed=7)


@query("R15", sql(f"""SELECT 'exact' AS method, (SELECT count(*) * count(*) FROM unit) AS n_compared, 1.0 AS index_recall
{" ".join(f"UNION ALL SELECT 'ivf_probe{n}', ({WORK.format(n=n)}), round(({RECALL.format(a=APPROX.format(n=n))}), 6)" for n in (1, 4, 16))}""", "ranked", "probes_all"))
def r15(spark, d):
    lists, centroids = label_lists(spark, d)
    return rounded(R.tradeoff(corpus(spark, d), lists, centroids, 10), "index_recall")


@query("R15_best", sql(f"""SELECT max_by(embedding, recall) AS embedding, round(max(recall), 6) AS recall FROM (
  {" UNION ALL ".join(f"SELECT 'probe{n}' AS embedding, ({RECALL.format(a=APPROX.format(n=n))}) AS recall" for n in (1, 4))})""", "ranked", "probes_all"))
def r15_best(spark, d):
    """The reports compared are those of one and four probed lists."""
    e = corpus(spark, d)
    lists, centroids = label_lists(spark, d)
    report = lambda n: R.index_recall(R.ivf_search(e, lists, R.ivf_probes(e, centroids, n), 10), ranked(spark, d), 10).select(
        F.lit(f"probe{n}").alias("embedding"), F.lit(10).alias("k"), F.col("index_recall").alias("recall"))
    return rounded(R.best_embedding(report(1).unionByName(report(4))), "recall")
