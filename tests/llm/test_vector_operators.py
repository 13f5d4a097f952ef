"""Centroids on bit planes, the conversation trie and MaxScore search against brute force."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import bit_planes, max_score, prefix_trie, tree_contraction
from cadenza.llm import queries as Q

key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
same = lambda got, want: sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.fixture
def vectors(spark):
    """Function (rows of (vec_id, vector)) -> embeddings table with columns of clashing names."""
    Q.prepare(spark)

    def make(rows, parts=3):
        more = "label int, v string, row int, planes string, norm int, n int, part string, ids string, score int, cluster string, rank string"
        return spark.createDataFrame([(*r, None, "x", 1, "x", 2, 3, "p", "i", 4, "c", "r") for r in rows], "vec_id long, embedding array<float>, " + more).repartition(parts)

    return make


def some_vectors(n=150, d=64):
    r = np.random.default_rng(7)
    centres = r.normal(size=(5, d))
    rows = [(i, [float(x) for x in (centres[i % 5] + r.normal(size=d) * 0.6).astype(np.float32) / 8]) for i in range(n)]
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(60)]                                         # a third of all rows are one vector
    rows += [(40, rows[40][1]), (40, rows[40][1]), (60, rows[61][1])]                    # repeated rows, one id for two vectors
    return rows + [(None, rows[9][1]), (2000, [0.0] * d), (2020, [-0.001] * d), (2040, [1.5, -2.25] * (d // 2))]


def odd_vectors(d=64):
    return [(3000, None), (3020, []), (3040, [1.0] * (d - 1)), (3060, [0.5] * (d + 1)), (3080, [None] + [1.0] * (d - 1)), (3100, [float("nan")] * d),
            (3120, [float("inf")] + [1.0] * (d - 1)), (None, None)]


def test_planes_give_exact_dot_products():
    r = np.random.default_rng(1)
    v, c = r.integers(0, 1 << 11, (200, 64)), r.integers(0, 1 << 11, (6, 64))
    rows, planes = bit_planes.pack_planes(v, 11), bit_planes.pack_planes(c, 11)
    for k in range(6):
        assert (bit_planes.plane_dots(rows, planes[k]) == v @ c[k]).all()
    assert (bit_planes.component_sums(rows) == v.sum(axis=0)).all()
    best, far = bit_planes.nearest(rows, (v ** 2).sum(axis=1), c, 11)
    want = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (far == want.min(axis=1)).all() and (best == want.argmin(axis=1)).all()


@pytest.mark.parametrize("n", [150, 4, 1])
def test_centroids(vectors, n):
    rows = (some_vectors() if n == 150 else some_vectors()[:n]) + odd_vectors()
    got = bit_planes.cluster_report(vectors(rows)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert same(got.collect(), brute.nearest_centroids(rows))


def test_centroids_of_nothing_and_of_too_much(vectors):
    assert bit_planes.cluster_report(vectors(odd_vectors())).count() == 0
    assert bit_planes.cluster_report(vectors(odd_vectors()).limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        bit_planes.cluster_report(vectors([(1, [1e6] * 64)])).collect()


@pytest.mark.parametrize("shard_rows,query_rows,group_bytes", [(4096, 1024, 32 << 20), (16, 4, 32 << 20), (16, 3, 2000)])
def test_max_score(vectors, monkeypatch, shard_rows, query_rows, group_bytes):
    """Ties, vectors of other lengths, repeated rows and a hot vector; small shards, blocks and groups change nothing."""
    monkeypatch.setattr(max_score, "HEAD", 1024 if shard_rows > 16 else 8)
    rows = some_vectors() + odd_vectors() + [(4000, [0.0] * 20), (4001, [2.0])]
    got = max_score.max_score(vectors(rows), shard_rows=shard_rows, query_rows=query_rows, group_bytes=group_bytes)
    assert same(got.select("query_id", "rank", "vec_id", "score").collect(), brute.best_products(rows))


def test_max_score_of_few_and_none(vectors):
    for rows in ([(20, [1.0, 2.0])], [(20, [1.0]), (21, [])], odd_vectors(), [(1, [1.0]), (2, [2.0])]):
        assert same(max_score.max_score(vectors(rows)).select("query_id", "rank", "vec_id", "score").collect(), brute.best_products(rows))
    assert max_score.max_score(vectors([(20, [1.0])]).limit(0)).count() == 0
    with pytest.raises(Exception, match="too long"):
        max_score.max_score(vectors([(20, [1e7]), (21, [1.0])])).collect()


@pytest.mark.parametrize("share", [0.9, 0.1])
def test_reachable_vectors_and_sparse_lists(share):
    """Whatever the threshold, exactly the vectors at or above it come back with their scores, on columns and on pairs."""
    r = np.random.default_rng(int(share * 10))
    x = np.where(r.random((300, 40)) < share, r.integers(-20, 21, (300, 40)), 0)
    owner, dims = np.nonzero(x)
    shard = max_score.Shard(300, owner, dims, x[owner, dims].astype(float))
    assert (len(shard.pairs) > 0) == (share < 0.5)
    for _ in range(30):
        q = np.where(r.random(40) < 0.6, r.integers(-9, 10, 40), 0)
        score = x @ q
        for threshold in (-np.inf, -50, 0, np.sort(score)[-20], np.sort(score)[-1], 10_000):
            lo, hi = sorted(r.integers(0, 301, 2))
            who, got = max_score.reachable(shard, np.flatnonzero(q), q[q != 0].astype(float), threshold, lo, hi)
            want = np.flatnonzero(score[lo:hi] >= threshold) + lo
            assert who.tolist() == want.tolist() and got.tolist() == score[want].tolist()


def test_search_does_less_than_all(monkeypatch):
    """With a threshold most vectors drop out before all terms are probed."""
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(4000, 64)) * (1 + 9 * (np.arange(64) < 6)) * 4)
    owner, dims = np.nonzero(x)
    shard = max_score.Shard(4000, owner, dims, x[owner, dims])
    q = np.round(r.normal(size=64) * (1 + 9 * (np.arange(64) < 6)) * 4)
    probed = []
    plain = max_score.Shard.probe
    monkeypatch.setattr(max_score.Shard, "probe", lambda self, t, w, who: probed.append(len(who)) or plain(self, t, w, who))
    max_score.reachable(shard, np.flatnonzero(q), q[q != 0], np.sort(x @ q)[-20], 0, 4000)
    assert probed[0] < 2000 and probed[-1] < 200 and probed == sorted(probed, reverse=True)


# ---------------------------------------------------------------- conversations

def conversations(spark, rows, parts=3):
    Q.prepare(spark)
    more = "pos int, depth string, length string, node string, parent string, n int, base int, own int, h int"
    return spark.createDataFrame([(*r, 1, "d", "l", "n", "p", 2, 3, 4, 5) for r in rows], "conv_id long, turn long, role string, text string, " + more).repartition(parts)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def some_conversations():
    r = random.Random(3)
    text = lambda: r.choice(["hi", "héllo 漢", "", None, "again", "x" * 50])
    role = lambda: r.choice(["user", "assistant", None, ""])
    rows = [(c, t, role(), text()) for c in range(0, 60) if c % 7 for t in range(r.randrange(1, 12))]
    rows += [(c, t, "user", f"same {t}") for c in range(500, 620) for t in range(6)]                     # many copies of one conversation
    rows += [(1000, t, "user", f"long {t}") for t in range(400)] + [(1004, t, "user", f"long {t}") for t in range(390)]
    rows += [(2001, None, "system", "first"), (2001, 0, "user", "b"), (2001, 0, "user", "a"), (2001, 0, "user", "a"), (2001, -3, None, None)]   # ties, repeats, null turn
    return rows + [(None, 1, "user", "nobody"), (2003, None, None, None), (-5, 0, "u", "negative"), (-4, 0, "u", "negative")]


@pytest.mark.parametrize("limit", [None, 20])
def test_conversation_trie(spark, limit):
    """A limit of 20 rows a group cuts long conversations into slices."""
    rows = some_conversations()
    if limit:
        spark.conf.set("spark.cadenza.groupRows", str(limit))
    try:
        got = prefix_trie.conversation_trie(conversations(spark, rows)).select(*COLUMNS).collect()
    finally:
        spark.conf.unset("spark.cadenza.groupRows")
    want = brute.trie(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_of_little(spark):
    for rows in ([(7, 0, "user", "only")], [(5, 0, None, None)], [(None, 0, "user", "nobody")], [(11, t, "u", "t") for t in range(3)]):
        assert {tuple(r) for r in prefix_trie.conversation_trie(conversations(spark, rows)).select(*COLUMNS).collect()} == brute.trie(rows)
    assert prefix_trie.conversation_trie(conversations(spark, [(7, 0, "user", "only")]).limit(0)).count() == 0


def test_ends_are_hashed_in_chunks(spark):
    rows = [(1, 5, c) for c in range(1, 4000, 3)] + [(2, 9, 10**12), (2, 9, 9), (2, 9, 100)]
    ends = spark.createDataFrame(rows, "d long, c long, conv_id long").select(F.struct(F.col("d").alias("depth"), F.col("c").alias("conv_id")).alias("node"), "conv_id")
    got = {r["node"]["depth"]: r["ends_sha256"] for r in prefix_trie.ends_digest(ends, chunk=64).collect()}
    assert got == {d: brute.sha(",".join(str(c) for c in sorted(c for k, _, c in rows if k == d))) for d in (1, 2)}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest"])
def test_subtree_totals(spark, shape):
    r = random.Random(4)
    n = 400
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: r.randrange(max(0, i - 30), i), "forest": lambda i: None if i % 50 == 0 else r.randrange(i - i % 50, i)}[shape]
    rows = [(0, None, 1, 5)] + [(i, up(i), 1, i % 7) for i in range(1, n)]
    got = {x["node"]: (x["size"], x["sum"]) for x in tree_contraction.subtree_totals(spark.createDataFrame(rows, "node long, parent long, size long, sum long"), ["size", "sum"]).collect()}
    want = {i: [a, b] for i, _, a, b in rows}
    for i, p, _, _ in reversed(rows):
        if p is not None:
            want[p] = [x + y for x, y in zip(want[p], want[i])]
    assert got == {i: tuple(v) for i, v in want.items()}
    assert tree_contraction.subtree_totals(spark.createDataFrame([], "node long, parent long, size long"), ["size"]).count() == 0
