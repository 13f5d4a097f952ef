import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.core import blocks
from cadenza.core.blocks import blocked_topk, nearest_of_table, probed_topk, streamed_topk
from cadenza.operators import retrieval as R
from cadenza.operators import tagbits


def corpus(spark, n=120, d=8, tags=4, seed=0):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(d)], rnd.sample([f"t{k}" for k in range(2 * tags)], rnd.randint(0, tags)), i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, vec array<double>, tags array<string>, list_id int")


def brute(rows, k):
    unit = {i: [x / sum(y * y for y in v) ** .5 for x in v] for i, v, *_ in rows}
    out = {}
    for q in unit:
        sims = sorted((-round(sum(a * b for a, b in zip(unit[q], unit[c])), 9), c) for c in unit if c != q)
        out[q] = [c for _, c in sims[:k]]
    return out


def as_lists(df):
    got = {}
    for r in df.orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["item"])
    return got


def test_exact_search_blocks_and_ties(spark):
    rows, c = corpus(spark)
    rows = rows + [(200, rows[5][1], [], 0), (201, rows[5][1], [], 0)]          # equal vectors: smaller id first
    c = spark.createDataFrame(rows, c.schema)
    unit = R.l2_normalise(c.select("id", "vec"))
    want = brute(rows, 5)
    assert as_lists(R.exact_topk(c, c, 5)) == want
    assert as_lists(blocked_topk(unit.withColumnRenamed("id", "q"), unit, 5, block=13)) == want
    scaled = c.withColumn("vec", F.transform("vec", lambda x: x * 7))
    assert as_lists(R.exact_topk(scaled, c, 5)) == want


@pytest.mark.parametrize("block,group_bytes", [(2048, 1 << 26), (7, 1 << 26), (7, 500)])
def test_streamed_search_in_groups_of_query_blocks(spark, block, group_bytes):
    rows, c = corpus(spark, 90)
    rows = rows + [(300 + i, rows[4][1], [], 0) for i in range(40)]             # a third of all rows are one vector
    c = spark.createDataFrame(rows, c.schema).repartition(5)
    got = streamed_topk(c.select(F.col("id").alias("q"), "vec"), c, 6, block=block, group_bytes=group_bytes)
    assert as_lists(got) == brute(rows, 6)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_small_table_is_scored_without_a_shuffle(spark, monkeypatch):
    from cadenza.core import blocks

    rows, c = corpus(spark, 60)
    table = spark.createDataFrame([r[:2] for r in rows[:9]], "id long, vec array<double>")
    q = c.select(F.col("id").alias("q"), "vec")
    one = nearest_of_table(q, table, 3)
    assert "hashpartitioning" not in one._jdf.queryExecution().executedPlan().toString()
    want = as_lists(streamed_topk(q, table, 3, exclude_self=False))
    assert as_lists(one) == want and len(want) == 60
    monkeypatch.setattr(blocks, "GROUP_BYTES", 10)
    assert as_lists(nearest_of_table(q, table, 3)) == want


def test_probes_are_chosen_for_a_recall(spark):
    _, c = corpus(spark, 200)
    lists, cent = R.ivf_build(c, 16)
    assert R.misplaced(lists, cent).count() == 0
    assert R.misplaced(lists.withColumn("list_id", (F.col("list_id") + 1) % cent.count()), cent).count() > 100
    exact, n = R.exact_topk(c, c, 10), R.probes_for_recall(c, lists, cent, 10, 0.9)
    recall = lambda p: R.index_recall(R.ivf_search(c, lists, R.ivf_probes(c, cent, p), 10), exact, 10).first()["index_recall"]
    assert 1 < n <= 16 and recall(n) >= 0.9 > recall(n // 2)


def test_norm_is_computed_once_a_vector(spark):
    _, c = corpus(spark, 5)
    got = R.l2_normalise(c.select("id", "vec"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array(greatest" in plan and "_norm" not in plan
    assert all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-12 for r in got.collect())


def test_zero_vector_is_safe(spark):
    z = spark.createDataFrame([(1, [0.0, 0.0])], "id long, vec array<double>")
    assert R.l2_normalise(z).first()["vec"] == [0.0, 0.0]


@pytest.mark.parametrize("limit", [12, 2, 0])
def test_gain_histogram_against_all_pairs(spark, limit, monkeypatch):
    """Tag sets above the limit take the tag-join path; both must agree with brute force."""
    monkeypatch.setattr(R, "SUBSET_TAGS", limit)
    rows, c = corpus(spark, 60)
    want = {}
    for a in rows:
        for b in rows:
            g = len(set(a[2]) & set(b[2]))
            if a[0] != b[0] and g:
                want[(a[0], g)] = want.get((a[0], g), 0) + 1
    assert {(r["q"], r["shared"]): r["n_items"] for r in R.gain_histogram(c, c).collect()} == want


def test_probed_lists_without_copies(spark):
    """Several blocks a list, groups and batches: the same as one search per cell, and the plan explodes no vector for an opposite block."""
    rows, c = corpus(spark, 160)
    lists = c.select("id", "vec", "list_id")
    probes = spark.createDataFrame([(i, (i + j) % 3) for i in range(160) for j in range(i % 3 + 1)], "q long, list_id int")
    q = c.select(F.col("id").alias("q"), "vec")
    want = as_lists(blocked_topk(q.join(probes, "q"), lists, 5, cell=["list_id"]))
    for group in (1, 4000, 1 << 20):
        got = probed_topk(q, probes, lists, 5, "list_id", block=13, group_bytes=group)
        assert as_lists(got) == want
    found = R.ivf_search(c, lists, probes, 5)
    assert as_lists(found) == want
    assert "Generate explode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_histograms_of_large_sets_by_blocks_of_bits(spark):
    """Heavy sets, several blocks and groups: the added rows of bits agree with brute force, and no large set becomes subsets."""
    rnd = random.Random(8)
    sets = [sorted(rnd.sample([f"t{i:02d}" for i in range(40)], rnd.randint(1, 17))) for _ in range(300)]
    left = spark.createDataFrame(list(enumerate(sets)), "sid long, s array<string>")
    right = spark.createDataFrame([(s + ["unknown"], rnd.randint(1, 9)) for s in sets], "s array<string>, w long")
    want = {}
    for i, a in enumerate(sets):
        for s, w in right.collect():
            g = len(set(a) & set(s))
            if g:
                want[i, g] = want.get((i, g), 0) + w
    got = {(r["sid"], r["shared"]): r["n_items"] for r in tagbits.shared_histograms(left, right, block=70, group_bytes=900).collect()}
    assert got == want
    most = spark.createDataFrame([(0, [f"t{i}" for i in range(12)])], "id long, tags array<string>")
    assert R._subsets(R._tag_sets(most, "q")).count() < 64


@pytest.mark.parametrize("low,width", [(9, 5), (2, 10)])
def test_histograms_of_large_sets_by_tables(spark, low, width, monkeypatch):
    """Heavy sets, several packs and groups: tables over any part of the tags agree with brute force."""
    rnd = random.Random(8)
    tags = [f"t{i:02d}" for i in range(14)]
    sets = [sorted(rnd.sample(tags, rnd.randint(1, 10))) for _ in range(60)]
    left = spark.createDataFrame([(i << 33, s) for i, s in enumerate(sets)], "sid long, s array<string>")
    right = spark.createDataFrame([(s + ["unknown"], rnd.choice([1, 70_000, 1 << 33])) for s in sets], "s array<string>, w long")
    want = {}
    for i, a in enumerate(sets):
        for s, w in right.collect():
            g = len(set(a) & set(s))
            if g:
                want[i << 33, g] = want.get((i << 33, g), 0) + w
    got = tagbits.table_histograms(left, right, tagbits.Tables(tags, low, width), table_sets=25, queries=9, group_bytes=300).collect()
    assert len(got) == len(want) and {(r["sid"], r["shared"]): r["n_items"] for r in got} == want
    assert tagbits.table_plan(left, right) is None
    monkeypatch.setattr(tagbits, "LEAST_PAIRS", 0)
    monkeypatch.setattr(tagbits, "PAIR_S", 1.0)
    assert set(tagbits.table_plan(left, right).tags) == set(tags)


def test_many_large_sets_are_not_compared_as_pairs(spark, monkeypatch):
    """Where blocks of all pairs cost more, gain_histogram takes tables."""
    rows, c = corpus(spark, 60)
    plain = {(r["q"], r["shared"]): r["n_items"] for r in R.gain_histogram(c, c).collect()}
    monkeypatch.setattr(R, "SUBSET_TAGS", 1)
    monkeypatch.setattr(tagbits, "LEAST_PAIRS", 0)
    monkeypatch.setattr(tagbits, "PAIR_S", 1.0)
    monkeypatch.setattr(R, "shared_histograms", None)
    assert {(r["q"], r["shared"]): r["n_items"] for r in R.gain_histogram(c, c).collect()} == plain


def test_single_precision_only_leaves_out_what_cannot_rank():
    """Cosines that differ by less than single precision shows, and blocks in which every pair ties."""
    rnd = np.random.default_rng(3)
    c = rnd.normal(size=(400, 8))
    c[200:] = c[0] + rnd.normal(size=(200, 8)) * 1e-5
    q = np.concatenate([c[:1], c[200:205], rnd.normal(size=(20, 8))])
    score = blocks._scores(q, c, "cosine")
    least = np.sort(score, axis=1)[:, -10]
    for s, x, y in ((least, q, c), (np.ones(5), np.ones((5, 8)), np.ones((400, 8)))):
        row, col, value = blocks._above(x, y, s, "cosine")
        whole = blocks._scores(x, y, "cosine")
        want = set(zip(*np.nonzero(whole >= s[:, None])))
        assert want <= set(zip(row, col)) and np.allclose(value, whole[row, col], rtol=0, atol=2e-9)
    row, _, _ = blocks._above(q[6:], c[:200], least[6:], "cosine")
    assert len(row) < 16 * 20


def judged(spark, rows):
    return spark.createDataFrame(rows, "q long, item long, rank int, gain int, rel int, n_relevant long")


def test_hit_rate_is_not_recall(spark):
    j = judged(spark, [(1, 10 + r, r, 3 if r == 1 else 0, int(r == 1), 100) for r in range(1, 11)])
    r = R.hit_precision_recall(j, (10,)).first()
    assert r["hit_rate"] == 1 and r["recall"] == pytest.approx(.01) and r["precision"] == pytest.approx(.1)
    assert R.map_at_k(j, 10).first()["map"] == pytest.approx(.1)


def test_ndcg_uses_the_whole_corpus_and_depth_is_checked(spark):
    j = judged(spark, [(1, 5, 1, 2, 0, 3), (1, 6, 2, 3, 1, 3)])
    ideal = R.ideal_gains(spark.createDataFrame([(1, 5, 2), (1, 3, 1)], "q long, shared int, n_items long"), 2)
    assert [(r["rank"], r["gain"]) for r in ideal.orderBy("rank").collect()] == [(1, 5), (2, 5)]
    from math import log2

    want = (2 + 3 / log2(3)) / (5 + 5 / log2(3))
    assert R.ndcg_at_k(j, ideal, 2).first()["ndcg"] == pytest.approx(want)
    assert [r["k"] for r in R.evaluate_retrieval(j, ideal, (1, 2, 50)).orderBy("k").collect()] == [1, 2]
    with pytest.raises(ValueError):
        R.evaluate_retrieval(j, ideal, (50,))


def test_probing_every_list_is_exact(spark):
    rows, c = corpus(spark)
    lists = R.l2_normalise(c).select("id", "vec", "list_id")
    cent = R.list_centroids(lists)
    exact = R.exact_topk(c, c, 5)
    probes = R.ivf_probes(c, cent, 3)
    assert R.index_recall(R.ivf_search(c, lists, probes, 5), exact, 5).first()["index_recall"] == 1
    assert R.n_compared(probes, lists).first()[0] == 120 * 119
    one = R.index_recall(R.ivf_search(c, lists, R.ivf_probes(c, cent, 1), 5), exact, 5).first()["index_recall"]
    assert 0 < one < 1


def test_built_lists_cover_the_corpus(spark):
    _, c = corpus(spark, 30)
    lists, cent = R.ivf_build(c, 64)
    assert lists.count() == 30 and cent.count() <= 15


def test_random_ranking_is_distinct(spark):
    _, c = corpus(spark, 37)
    r = R.random_topk(c, c, 10, 3)
    assert r.groupBy("q").agg(F.countDistinct("item").alias("n")).filter("n <> 10").count() == 0
    assert R.random_topk(c, c, 10, 3).collect() == r.collect()
    assert R.random_topk(c, c, 50, 3).filter("q = 0").count() == 37


def test_jaccard_of_empty_sets_is_zero(spark):
    e = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, [])], "id long, tags array<string>")
    ranked = spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "q long, item long, rank int")
    assert R.jaccard_at_k(ranked, e, e, 1).first()["jaccard"] == 0


def test_distances_do_not_depend_on_block_size(spark):
    rng = np.random.default_rng(5)
    close = 1000.0 + rng.normal(size=(120, 8)) * 1e-6
    far = rng.normal(size=(90, 8)) * 1e4
    table = lambda v: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<double>")
    few, all_ = table(close), table(np.vstack([close, far]))
    near = lambda c, b: [tuple(r) for r in blocked_topk(few.withColumnRenamed("id", "q"), c, 3, metric="euclid", block=b).orderBy("q", "rank").collect()]
    want = near(few, 2048)
    assert near(all_, 2048) == want and near(all_, 37) == want
    assert min(-r[2] for r in want) > 0


def test_block_search_needs_no_package_on_workers(tmp_path):
    """The driver alone knows where the package lies."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    script = tmp_path / "run.py"
    script.write_text(f"""import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from cadenza.core.session import get_session
from cadenza.operators import retrieval as R
s = get_session("away", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}})
c = s.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, vec array<double>")
print("rows", R.exact_topk(c, c, 2).count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 12" in out.stdout, out.stderr[-2000:]


def test_search_may_include_the_query(spark):
    c = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, vec array<double>")
    assert {r["item"] for r in R.exact_topk(c, c, 1, exclude_self=False).filter("q = item").collect()} == set(range(6))


@pytest.mark.parametrize("n_queries", [700, 40])
def test_search_leaves_k_rows_per_query_whatever_the_tasks(spark, n_queries, monkeypatch):
    """As many queries as rows: what is merged does not grow with the tasks, and both directions are exact."""
    import numpy as np

    from cadenza.core import blocks

    rnd = np.random.default_rng(3)
    v = np.round(rnd.normal(size=(700, 4)), 1)
    e = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<double>")
    merged = []
    monkeypatch.setattr(blocks, "MIN_ROWS", 50)
    monkeypatch.setattr(blocks, "top_per_group", lambda df, *a: merged.append(df.count()) or top_per_group(df, *a))
    from cadenza.core.ordered import top_per_group
    got = blocks.streamed_topk(e.filter(F.col("id") < n_queries).withColumnRenamed("id", "q"), e, 3, block=64)
    got = sorted((r["q"], r["rank"], r["item"]) for r in got.collect())
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    s = np.round(u @ u.T, 9)
    want = [(q, k + 1, int(i)) for q in range(n_queries) for k, i in enumerate([i for i in np.lexsort((np.arange(700), -s[q])) if i != q][:3])]
    assert got == want
    if n_queries == 700:
        assert merged == [3 * 700]
