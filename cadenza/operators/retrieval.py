"""Embedding search and retrieval metrics with tag overlap as the relevance proxy."""

from __future__ import annotations

from math import comb, isqrt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.core.blocks import blocked_topk, nearest_of_table, probed_topk
from cadenza.core.common import md5_int, never_broadcast, union_all
from cadenza.core.ordered import Ordered
from cadenza.core.session import materialise
from cadenza.operators.tagbits import shared_histograms, table_histograms, table_plan

NAN = float("nan")
# Tag sets up to this size are counted through their subsets, at most 31 rows a set; larger ones meet the others as blocks of bits.
SUBSET_TAGS = 5
KS = (1, 5, 10, 50)
RECALL_SAMPLE = 2000        # queries on which the number of probes is chosen


def l2_normalise(df: DataFrame, vec: str = "vec", eps: float = 1e-12) -> DataFrame:
    """Vectors of length one. The norm is a lambda's variable: as a column it would be put in for, and computed at, every component."""
    norm = F.greatest(F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x)), F.lit(eps))
    scaled = F.transform(F.array(norm), lambda n: F.transform(vec, lambda x: x / n))
    return df.withColumn(vec, F.element_at(scaled, 1))


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """Cosine top-k of ``corpus(id, vec)`` for each ``queries(id, vec)``; ``exclude_self`` leaves out the query's own row."""
    return blocked_topk(queries.select(F.col("id").alias("q"), "vec"), corpus.select("id", "vec"), k, exclude_self=exclude_self)


# ---------------------------------------------------------------- shared tags

def _tag_sets(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col("id").alias(key), F.sort_array(F.array_distinct("tags")).alias("s"))


def _subsets(sets: DataFrame) -> DataFrame:
    """One row per non-empty subset of ``s``: its size and a text key."""
    masks = sets.filter((F.size("s") > 0) & (F.size("s") <= SUBSET_TAGS)).withColumn(
        "mask", F.explode(F.expr("sequence(1, cast(pow(2, size(s)) as int) - 1)")))
    return masks.withColumn("sub", F.expr("filter(s, (x, i) -> getbit(mask, i) = 1)")).select(
        *sets.columns, F.size("sub").alias("i"), F.concat_ws("\u0001", "sub").alias("sub"))


def _subset_histograms(q_sets: DataFrame, c_sets: DataFrame) -> DataFrame:
    """(sid, shared, n_items): small sets through their subsets, larger ones as blocks of bits."""
    holds = _subsets(c_sets).groupBy("sub").agg(F.sum("w").alias("n"))
    sums = _subsets(q_sets).join(never_broadcast(holds), "sub").groupBy("sid", "i").agg(F.sum("n").alias("n"))
    choose = F.array(*[F.lit([comb(i, g) * (-1) ** (i - g) for g in range(SUBSET_TAGS + 1)]) for i in range(SUBSET_TAGS + 1)])
    spread = sums.select("sid", "i", "n", F.explode(F.sequence(F.lit(1), F.col("i"))).alias("shared"))
    small = spread.groupBy("sid", "shared").agg(
        F.sum(F.col("n") * F.element_at(F.element_at(choose, F.col("i") + 1), F.col("shared") + 1)).alias("n_items"))
    parts = [small]
    big_c, big_q = c_sets.filter(F.size("s") > SUBSET_TAGS), q_sets.filter(F.size("s") > SUBSET_TAGS)
    for left, right in ((q_sets.filter(F.size("s") <= SUBSET_TAGS), big_c), (big_q, c_sets)):
        if not left.isEmpty() and not right.isEmpty():
            parts.append(shared_histograms(left, right))
    return union_all(parts).groupBy("sid", "shared").agg(F.sum("n_items").alias("n_items"))


def gain_histogram(queries: DataFrame, corpus: DataFrame, self_in_corpus: bool = True) -> DataFrame:
    """(q, shared, n_items): how many corpus items share exactly ``shared`` >= 1 tags with the query.

    This is the query-by-corpus shared-tag matrix summed per row. It is computed from
    distinct tag sets: N(S), the number of items whose tags contain S, is counted once per
    subset, and inclusion-exclusion over the query's subsets gives the exact counts. Popular
    tags therefore never produce item pairs, and the work is linear in the sets. Sets of more than
    SUBSET_TAGS tags have too many subsets; they meet the others as blocks of bits, which is quadratic in the
    distinct sets but moves only their histograms. Where that would cost more, all sets meet in tables of superset sums.
    A set has a number, and only that is joined.
    """
    one = _tag_sets(queries, "q")
    q_sets = materialise(one.select("s").distinct().withColumn("sid", F.monotonically_increasing_id()), "query-sets")
    qs = one.join(never_broadcast(q_sets), "s").select("q", "sid", F.size("s").alias("_size"))
    c_sets = materialise(_tag_sets(corpus, "c").groupBy("s").agg(F.count("*").alias("w")), "tagsets")
    tables = None if q_sets.filter(F.size("s") > SUBSET_TAGS).isEmpty() and c_sets.filter(F.size("s") > SUBSET_TAGS).isEmpty() else table_plan(q_sets, c_sets)
    hist = table_histograms(q_sets, c_sets, tables) if tables else _subset_histograms(q_sets, c_sets)
    own = F.when(F.lit(self_in_corpus) & (F.col("shared") == F.col("_size")), 1).otherwise(0)
    return qs.join(never_broadcast(hist), "sid").select("q", "shared", (F.col("n_items") - own).cast("long").alias("n_items")).filter("n_items > 0")


def shared_tags(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Shared-tag count for given (q, item) pairs; a pair of an item with itself counts 0."""
    a = queries.select(F.col("id").alias("q"), F.col("tags").alias("_qt"))
    b = corpus.select(F.col("id").alias("item"), F.col("tags").alias("_ct"))
    n = F.size(F.array_intersect("_qt", "_ct"))
    return pairs.join(a, "q").join(b, "item").withColumn(
        "gain", F.when(F.col("q") == F.col("item"), 0).otherwise(n)).drop("_qt", "_ct")


def n_relevant(hist: DataFrame, min_shared: int = 3) -> DataFrame:
    return hist.groupBy("q").agg(F.sum(F.when(F.col("shared") >= min_shared, F.col("n_items")).otherwise(0)).alias("n_relevant"))


def relevance(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, hist: DataFrame, min_shared: int = 3) -> DataFrame:
    """Ranked rows with gain, rel (gain >= min_shared) and the query's corpus-wide n_relevant."""
    g = shared_tags(ranked, queries, corpus).withColumn("rel", (F.col("gain") >= min_shared).cast("int"))
    return g.join(n_relevant(hist, min_shared), "q", "left").na.fill(0, ["n_relevant"])


def ideal_gains(hist: DataFrame, k: int) -> DataFrame:
    """(q, rank, gain): the k best gains of the whole corpus (zero gains are left out)."""
    w = W.partitionBy("q").orderBy(F.desc("shared"))           # at most as many rows as the query has tags
    c = hist.withColumn("_hi", F.sum("n_items").over(w)).withColumn("_lo", F.col("_hi") - F.col("n_items"))
    c = c.filter(F.col("_lo") < k)
    return c.select("q", F.explode(F.sequence(F.col("_lo") + 1, F.least(F.col("_hi"), F.lit(k)))).alias("rank"), F.col("shared").alias("gain"))


# ---------------------------------------------------------------- metrics

def _depth_check(ranked: DataFrame, ks: tuple[int, ...]) -> list[int]:
    depth = ranked.agg(F.max("rank")).first()[0] or 0
    kept = [k for k in ks if k <= depth]
    if not kept:
        raise ValueError(f"every k exceeds the search depth {depth}")
    return kept


def per_query(judged: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(q, k, hits, ap, dcg, n_relevant) from judged ranked rows; a query's rows are bounded by the depth."""
    w = W.partitionBy("q").orderBy("rank")
    r = judged.withColumn("_cum", F.sum("rel").over(w))
    r = r.withColumn("k", F.explode(F.lit(list(ks)))).filter(F.col("rank") <= F.col("k"))
    return r.groupBy("q", "k").agg(
        F.sum("rel").alias("hits"), F.sum(F.col("rel") * F.col("_cum") / F.col("rank")).alias("_ap"),
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"), F.max("n_relevant").alias("n_relevant"))


def evaluate_retrieval(judged: DataFrame, ideal: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row per k: hit rate, recall, precision, mAP, NDCG, n_queries, mean n_relevant."""
    kept = _depth_check(judged, ks)
    q = per_query(judged, tuple(kept))
    best = ideal.withColumn("k", F.explode(F.lit(kept))).filter(F.col("rank") <= F.col("k")).groupBy("q", "k").agg(
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("idcg"))
    q = q.join(best, ["q", "k"], "left")
    nan = lambda c: F.coalesce(c, F.lit(NAN))
    has = F.col("n_relevant") > 0
    return q.groupBy("k").agg(
        F.avg((F.col("hits") > 0).cast("int")).alias("hit_rate"),
        nan(F.avg(F.when(has, F.col("hits") / F.col("n_relevant")))).alias("recall"),
        F.avg(F.col("hits") / F.col("k")).alias("precision"),
        nan(F.avg(F.when(has, F.col("_ap") / F.least(F.col("n_relevant"), F.col("k"))))).alias("map"),
        nan(F.avg(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")))).alias("ndcg"),
        F.count("*").alias("n_queries"), F.avg("n_relevant").alias("mean_n_relevant"))


def hit_precision_recall(judged: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    q = per_query(judged, tuple(_depth_check(judged, ks)))
    return q.groupBy("k").agg(
        F.avg((F.col("hits") > 0).cast("int")).alias("hit_rate"), F.avg(F.col("hits") / F.col("k")).alias("precision"),
        F.coalesce(F.avg(F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant"))), F.lit(NAN)).alias("recall"))


def map_at_k(judged: DataFrame, k: int) -> DataFrame:
    q = per_query(judged, (k,)).filter("n_relevant > 0")
    return q.agg(F.coalesce(F.avg(F.col("_ap") / F.least(F.col("n_relevant"), F.lit(k))), F.lit(NAN)).alias("map"), F.count("*").alias("n"))


def ndcg_at_k(judged: DataFrame, ideal: DataFrame, k: int) -> DataFrame:
    best = ideal.filter(F.col("rank") <= k).groupBy("q").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("idcg"))
    q = per_query(judged, (k,)).join(best, "q").filter("idcg > 0")
    return q.agg(F.coalesce(F.avg(F.col("dcg") / F.col("idcg")), F.lit(NAN)).alias("ndcg"), F.count("*").alias("n"))


def jaccard_at_k(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    a = queries.select(F.col("id").alias("q"), F.col("tags").alias("_qt"))
    b = corpus.select(F.col("id").alias("item"), F.col("tags").alias("_ct"))
    j = ranked.filter(F.col("rank") <= k).join(a, "q").join(b, "item").withColumn(
        "j", F.coalesce(F.try_divide(F.size(F.array_intersect("_qt", "_ct")), F.size(F.array_union("_qt", "_ct"))), F.lit(0.0)))
    return j.groupBy("q").agg(F.avg("j").alias("j")).agg(F.avg("j").alias("jaccard"), F.count("*").alias("n_queries"))


# ---------------------------------------------------------------- inverted lists

def ivf_build(corpus: DataFrame, n_lists: int = 64, seed: int = 0, max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """(lists(id, vec, list_id), centroids(list_id, vec, n_iter)) from k-means on unit vectors; both are written.

    Centres are scaled to unit length and an item lies in the list of the one it is most similar to, as queries probe. ``n_iter`` below ``max_iter`` tells that the centres had settled.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = materialise(l2_normalise(corpus.select("id", "vec")), "unit")
    k = max(1, min(n_lists, unit.count() // 2))
    feats = unit.withColumn("features", array_to_vector("vec"))
    if k == 1:
        mean = unit.select(F.posexplode("vec").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()
        centres = [[r["v"] for r in mean]]
        n_iter = 0
    else:
        model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(feats)
        n_iter = model.summary.numIter
        centres = [[float(x) for x in c] for c in model.clusterCenters()]
    cent = corpus.sparkSession.createDataFrame(list(enumerate(centres)), "list_id int, vec array<double>")
    cent = materialise(l2_normalise(cent).withColumn("n_iter", F.lit(n_iter)), "centroids")
    near = nearest_of_table(unit.select(F.col("id").alias("q"), "vec"), cent.select(F.col("list_id").alias("id"), "vec"), 1)
    return materialise(unit.join(near.select(F.col("q").alias("id"), F.col("item").alias("list_id")), "id"), "lists"), cent


def list_centroids(lists: DataFrame) -> DataFrame:
    """Unit mean vector of every list of an existing assignment."""
    dims = lists.select("list_id", F.posexplode("vec").alias("i", "v")).groupBy("list_id", "i").agg(F.avg("v").alias("v"))
    means = dims.groupBy("list_id").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("p"))   # one entry per dimension
    return materialise(l2_normalise(means.select("list_id", F.col("p.v").alias("vec"))), "centroids")


def ivf_probes(queries: DataFrame, centroids: DataFrame, n_probe: int) -> DataFrame:
    """(q, list_id): the n_probe lists nearest to each query(id, vec), scored where the queries lie."""
    q = queries.select(F.col("id").alias("q"), "vec")
    c = centroids.select(F.col("list_id").alias("id"), "vec")
    return nearest_of_table(q, c, n_probe).select("q", F.col("item").alias("list_id"))


def ivf_search(queries: DataFrame, lists: DataFrame, probes: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """Top-k among the probed lists only. A hot list is just more blocks, and a query is not copied for its lists."""
    return probed_topk(queries.select(F.col("id").alias("q"), "vec"), probes, lists.select("id", "vec", "list_id"), k, cell="list_id", exclude_self=exclude_self)


def probes_for_recall(queries: DataFrame, lists: DataFrame, centroids: DataFrame, k: int = 10, target: float = 0.9,
                      sample: int = RECALL_SAMPLE) -> int:
    """Fewest lists to probe, doubling from 1, whose recall@k reaches ``target`` on at most ``sample`` queries drawn by hash."""
    some = materialise(queries.orderBy(md5_int("recall", F.col("id")), "id").limit(sample).select("id", "vec"), "recall-sample")
    exact = materialise(exact_topk(some, lists, k), "recall-exact")
    n_lists, n = centroids.count(), 1
    while n < n_lists:
        found = index_recall(ivf_search(some, lists, ivf_probes(some, centroids, n), k), exact, k).first()["index_recall"]
        if found is None or found >= target:
            return n
        n *= 2
    return n_lists


def misplaced(lists: DataFrame, centroids: DataFrame) -> DataFrame:
    """Rows of ``lists`` whose own centroid is less similar than another one. The centroids travel as a literal."""
    rows = {r["list_id"]: r["vec"] for r in centroids.collect()}
    dot = lambda c: F.aggregate(F.zip_with("vec", c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    every = F.transform(F.lit([rows[k] for k in sorted(rows)]), dot)
    own = F.element_at(every, F.array_position(F.lit(sorted(rows)), F.col("list_id")).cast("int"))
    return lists.filter(own < F.array_max(every) - 1e-8).select("id", "list_id")


def index_recall(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Mean over queries of |approx top-k and exact top-k| / k."""
    a, e = approx.filter(F.col("rank") <= k).select("q", "item"), exact.filter(F.col("rank") <= k).select("q", "item")
    hits = e.join(a.withColumn("hit", F.lit(1)), ["q", "item"], "left").groupBy("q").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("h"))
    return hits.agg(F.avg(F.col("h") / F.lit(k)).alias("index_recall"), F.count("*").alias("n_queries"))


def n_compared(probes: DataFrame, lists: DataFrame) -> DataFrame:
    """Inner products a probed search computes, from list sizes; no candidate row is produced."""
    sizes = lists.groupBy("list_id").agg(F.count("*").alias("n"))
    total = probes.groupBy("list_id").agg(F.count("*").alias("m")).join(sizes, "list_id").agg(F.sum(F.col("m") * F.col("n")).alias("all"))
    own = probes.join(lists.select(F.col("id").alias("q"), "list_id"), ["q", "list_id"], "left_semi").agg(F.count("*").alias("own"))
    k = F.lit(1).alias("_k")
    return total.select("all", k).join(own.select("own", k), "_k").select((F.col("all") - F.col("own")).alias("n_compared"))


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, isqrt(n) + 1)):
        n += 1
    return n


def random_topk(queries: DataFrame, corpus: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Random ranking as a lower bound: k distinct items per query, possibly the query itself.

    Positions walk through a prime field from a hashed start with a hashed step, so they
    are distinct; values past the corpus end are skipped.
    """
    c = Ordered(corpus.select(F.col("id").alias("item")), [], ["item"]).add(_r=("row", None)).result()
    n = corpus.count()
    p = next_prime(n)
    start = md5_int(seed, "start", F.col("q")) % p
    step = 1 + md5_int(seed, "step", F.col("q")) % F.lit(max(p - 1, 1))
    walk = queries.select(F.col("id").alias("q")).select("q", F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(k + p - n - 1)), lambda r: (start + r * step) % p),
        lambda x: x < n).alias("pos"))
    picked = walk.select("q", F.posexplode(F.slice("pos", 1, min(k, n))).alias("i", "pos"))
    return picked.join(c.select("item", (F.col("_r") - 1).alias("pos")), "pos").select("q", "item", (F.col("i") + 1).alias("rank"))


def tradeoff(queries: DataFrame, lists: DataFrame, centroids: DataFrame, k: int = 10,
             n_probes: tuple[int, ...] = (1, 4, 16)) -> DataFrame:
    """(method, n_compared, index_recall) for exact search and each number of probed lists."""
    exact = materialise(exact_topk(queries, lists, k), "exact")
    n_q, n_c = queries.count(), lists.count()
    out = queries.sparkSession.createDataFrame([("exact", n_q * n_c, 1.0)], "method string, n_compared long, index_recall double")
    for p in n_probes:
        probes = materialise(ivf_probes(queries, centroids, p), "probes")
        rec = index_recall(ivf_search(queries, lists, probes, k), exact, k).withColumn("_k", F.lit(1))
        work = n_compared(probes, lists).withColumn("_k", F.lit(1))
        out = out.unionByName(rec.join(work, "_k").select(F.lit(f"ivf_probe{p}").alias("method"), "n_compared", "index_recall"))
    return out


def best_embedding(reports: DataFrame) -> DataFrame:
    """Embedding with the highest recall at k = 10 from rows (embedding, k, recall)."""
    r = reports.filter("k = 10")
    return r.agg(F.max_by("embedding", "recall").alias("embedding"), F.max("recall").alias("recall"))
