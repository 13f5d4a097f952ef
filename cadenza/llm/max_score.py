"""Exact top-k inner products by MaxScore over shards of posting lists.

Components become integers ``floor(SCALE * x)``. A term is a dimension, its posting list in a shard holds the vectors whose
component there is not 0. The bound of a term is the most that it can add to a score in the shard: the query's weight times
the list's largest or smallest component, 0 at least. With the terms in falling order of their bounds and the k-th best score so
far as threshold:

1. the essential terms are the first ones, up to where the bounds of all others together stay below the threshold. A vector
   that no essential list lifts above that rest cannot enter the result.
2. the essential lists are traversed and their contributions added up.
3. the other terms are probed, a few at a time, only for vectors that can still reach the threshold; the rest of the bounds
   shrinks with every step, and the vectors that drop out are not looked at again.
4. the survivors have exact scores and raise the threshold for what follows; the k best of all shards are merged.

A shard is traversed in two parts, a short head that sets the threshold when there is none yet, and the rest. Lists that most vectors
of a shard are on are kept as columns, the others as pairs of vector and value.

Vectors are cut once into shards of at most SHARD_ROWS rows and SHARD_CELLS components, a row of the shard table each. The queries
are packed the same way, in blocks. A group of query blocks of at most GROUP_BYTES is broadcast and the shard table streams past it once
a group, so no vector is copied per opposite block, and a task holds one shard and the k best of the queries of one group.

Null vectors and those that hold a null or not finite component take no part, neither as queries nor as candidates. Vectors may
differ in length; a component that one of them lacks adds nothing, and an empty vector scores 0 with all. Every row is a
candidate of its own and a query if its id is a multiple of ``every``: of repeated rows each is a query, and the others are its
candidates. Candidates without an id come last among equal scores, equal ids by row. Vectors of squared length 2^52 or more are an
error, as their products would not be exact.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import finite, require, union_all
from cadenza.core.ordered import top_per_group
from cadenza.core.session import materialise, parallelism

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 64
SHARD_ROWS, SHARD_CELLS = 4096, 1 << 19
QUERY_ROWS = 1024
HEAD = 1024                  # vectors of a shard that are scored first where no threshold exists
PROBE = 8                    # terms probed at a time
GROUP_BYTES = 32 << 20       # of query blocks broadcast at once
FIELDS = "part int, rows binary, ids binary, named binary, sizes binary, dims binary, vals binary"


# ---------------------------------------------------------------- shards

class Shard:
    """Vectors with their posting lists: ``column`` for lists that at least half of the vectors are on, ``pairs`` for others."""

    def __init__(self, n: int, owner: np.ndarray, dims: np.ndarray, vals: np.ndarray):
        order = np.argsort(dims, kind="stable")
        owner, vals = owner[order], vals[order]
        self.n = n
        self.dims, first, count = np.unique(dims[order], return_index=True, return_counts=True)
        dense = 2 * count >= n
        self.columns = np.zeros((int(dense.sum()), n))
        self.slot = np.full(len(self.dims), -1)
        self.slot[dense] = np.arange(int(dense.sum()))
        self.pairs = {}
        for t, (a, c) in enumerate(zip(first, count)):
            if dense[t]:
                self.columns[self.slot[t], owner[a:a + c]] = vals[a:a + c]
            else:
                self.pairs[t] = owner[a:a + c], vals[a:a + c]
        self.high = np.maximum.reduceat(vals, first) if len(first) else np.empty(0)
        self.low = np.minimum.reduceat(vals, first) if len(first) else np.empty(0)

    def terms(self, dims: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The query's terms that have a list here in falling order of bound: list numbers, weights, and the rest of the
        bounds from each place on (one entry more)."""
        at = np.searchsorted(self.dims, dims)
        here = at < len(self.dims)
        here[here] = self.dims[at[here]] == dims[here]
        at, w = at[here], weights[here]
        bound = np.maximum(np.maximum(w * self.high[at], w * self.low[at]), 0)
        order = np.argsort(-bound, kind="stable")
        rest = np.zeros(len(order) + 1)
        rest[:-1] = np.cumsum(bound[order][::-1])[::-1]
        return at[order], w[order], rest

    def traverse(self, terms: np.ndarray, weights: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Contributions of whole lists to the vectors lo..hi."""
        slot = self.slot[terms]
        full = slot >= 0
        score = weights[full] @ self.columns[slot[full], lo:hi]
        for t, w in zip(terms[~full], weights[~full]):
            who, v = self.pairs[t]
            a, b = np.searchsorted(who, (lo, hi))
            score[who[a:b] - lo] += w * v[a:b]
        return score

    def probe(self, terms: np.ndarray, weights: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Contributions of lists to the vectors ``who`` (ascending) alone."""
        slot = self.slot[terms]
        full = slot >= 0
        score = weights[full] @ self.columns[slot[full][:, None], who[None, :]]
        for t, w in zip(terms[~full], weights[~full]):
            listed, v = self.pairs[t]
            at = np.searchsorted(listed, who)
            hit = at < len(listed)
            hit[hit] = listed[at[hit]] == who[hit]
            score[hit] += w * v[at[hit]]
        return score


def reachable(shard: Shard, dims: np.ndarray, weights: np.ndarray, threshold: float, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors lo..hi of the shard whose score is at least the threshold, their exact scores)."""
    terms, w, rest = shard.terms(dims, weights)
    # The essential terms; all of them where even a vector on no list could enter.
    below = np.flatnonzero(rest < threshold)
    e = int(below[0]) if len(below) else len(terms)
    score = shard.traverse(terms[:e], w[:e], lo, hi)
    who = np.flatnonzero(score + rest[e] >= threshold)
    score = score[who]
    for a in range(e, len(terms), PROBE):
        b = min(a + PROBE, len(terms))
        score = score + shard.probe(terms[a:b], w[a:b], who + lo)
        still = score + rest[b] >= threshold
        who, score = who[still], score[still]
    return who + lo, score


class Best:
    """The k best (score, id, row) of one query so far."""

    def __init__(self, k: int):
        self.k, self.threshold = k, -np.inf
        self.score, self.named, self.id, self.row = np.empty(0), np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, named: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score, named = np.concatenate([self.score, score]), np.concatenate([self.named, named])
        ids, rows = np.concatenate([self.id, ids]), np.concatenate([self.row, rows])
        if len(score) > self.k:
            cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
            above = score >= cut
            score, named, ids, rows = score[above], named[above], ids[above], rows[above]
        order = np.lexsort((rows, ids, ~named, -score))[:self.k]
        self.score, self.named, self.id, self.row = score[order], named[order], ids[order], rows[order]
        if len(order) == self.k:
            self.threshold = self.score[-1]


def search_shard(shard: Shard, rows: np.ndarray, ids: np.ndarray, named: np.ndarray, dims: np.ndarray, weights: np.ndarray, own: int, best: Best) -> None:
    """Bring one query's best up to date with one shard."""
    head = HEAD if best.threshold == -np.inf else 0
    for lo, hi in ((0, min(head, shard.n)), (min(head, shard.n), shard.n)):
        if lo < hi:
            who, score = reachable(shard, dims, weights, best.threshold, lo, hi)
            other = rows[who] != own
            if other.any():
                who, score = who[other], score[other]
                best.add(score, named[who], ids[who], rows[who])


# ---------------------------------------------------------------- Spark

def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v: vectors that take part, as integers."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = rows.filter(v.isNotNull() & F.forall(v, finite))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    length = F.aggregate(whole, F.lit(0.0), lambda s, x: s + F.when(F.isnan(x), F.lit(0.0)).otherwise(x * x))
    rows = require(rows.select("vec_id", whole.alias("v"), length.alias("length")), F.coalesce(F.col("length") < 2.0 ** 52, F.lit(True)), "a vector is too long for exact scores")
    return rows.select("vec_id", "v")


def packed(ints: DataFrame, most_rows: int, most_cells: int) -> DataFrame:
    """Rows (row, vec_id, v) of each partition, in blocks of bounded size, as rows of FIELDS."""

    def block(part, held):
        rows, ids, named, sizes, flat = (np.concatenate([h[i] for h in held]) for i in range(5))
        dims = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        some = flat != 0
        sizes = np.bincount(np.repeat(np.arange(len(rows)), sizes)[some], minlength=len(rows))
        blobs = rows, ids, named, sizes.astype("<i4"), dims[some].astype("<i4"), flat[some]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)],
                                          [f.split()[0] for f in FIELDS.split(", ")])

    def run(batches):
        from pyspark import TaskContext

        part, held, n, cells = TaskContext.get().partitionId(), [], 0, 0
        for b in batches:
            rows, ids, v = b.column("row").to_numpy(), b.column("vec_id"), b.column("v")
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            flat = v.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            i = 0
            while i < len(b):
                j = min(len(b), i + most_rows - n, int(np.searchsorted(ends, ends[i] + most_cells - cells, side="right")) - 1)
                if j <= i and n:
                    yield block(part, held)
                    held, n, cells = [], 0, 0
                    continue
                j = max(j, i + 1)                   # a vector of more cells is a block of its own
                held.append((rows[i:j], ids[i:j], named[i:j], np.diff(ends[i:j + 1]), flat[ends[i]:ends[j]]))
                n, cells, i = n + j - i, cells + int(ends[j] - ends[i]), j
        if n:
            yield block(part, held)

    return ints.mapInArrow(run, FIELDS)


def _opened(b: pa.RecordBatch, i: int, prefix: str):
    get = lambda name, kind: np.frombuffer(b.column(prefix + name)[i].as_py(), kind)
    return get("rows", np.int64), get("ids", np.int64), get("named", bool), get("sizes", "<i4"), get("dims", "<i4"), get("vals", np.float64)


def _search(k: int):
    def run(batches):
        best: dict[int, Best] = {}
        asked: dict[int, int] = {}
        held = None
        for b in batches:
            for i in range(len(b)):
                rows, ids, named, sizes, dims, vals = _opened(b, i, "")
                key = (len(rows), rows[0])
                if held is None or held[0] != key:
                    held = key, Shard(len(rows), np.repeat(np.arange(len(rows)), sizes), dims, vals)
                q_rows, q_ids, _, q_sizes, q_dims, q_vals = _opened(b, i, "q_")
                ends = np.concatenate([[0], np.cumsum(q_sizes)])
                for j, own in enumerate(q_rows.tolist()):
                    found = best.setdefault(own, Best(k))
                    asked[own] = int(q_ids[j])
                    cut = slice(ends[j], ends[j + 1])
                    search_shard(held[1], rows, ids, named, q_dims[cut], q_vals[cut], own, found)
        some = [(own, x) for own, x in best.items() if len(x.score)]
        for lo in range(0, len(some), 1000):
            part = some[lo:lo + 1000]
            n = [len(x.score) for _, x in part]
            cat = lambda f: np.concatenate([f(x) for _, x in part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([own for own, _ in part], n)), pa.array(np.repeat([asked[own] for own, _ in part], n)), pa.array(cat(lambda x: x.row)),
                 pa.array(cat(lambda x: x.id), mask=~cat(lambda x: x.named)), pa.array(cat(lambda x: x.score).astype(np.int64))],
                ["query_row", "query_id", "row", "vec_id", "score"])

    return run


def max_score(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
              shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest scores of every query, all if there are fewer."""
    spark = vectors.sparkSession
    ints = integer_vectors(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id())
    ints = materialise(ints, "integers")                        # the row numbers hold from here on
    total = ints.count()
    shards = packed(ints.repartition(max(-(-total // shard_rows), min(parallelism(spark), total // HEAD), 1)), shard_rows, SHARD_CELLS)
    queries = ints.filter(F.col("vec_id") % every == 0)
    n = max(-(-queries.count() // query_rows), 1)
    q = packed(queries.repartition(n), query_rows, SHARD_CELLS)
    q = materialise(q.withColumnsRenamed({c: f"q_{c}" for c in q.columns if c != "part"}), "queries")
    size = sum((F.length(c).cast("long") for c in q.columns if c != "part"), F.lit(0).cast("long"))
    # Partitions of query blocks, dealt evenly; as many in a group as keep it within its bytes.
    share = max(int(group_bytes * n // max(q.agg(F.sum(size)).first()[0] or 1, 1)), 1)
    found = []
    for lo in range(0, n, share):
        hi = min(lo + share, n)
        some = q.filter(F.col("part").between(lo, hi - 1))
        small = (some.agg(F.sum(size)).first()[0] or 0) <= 2 * group_bytes
        pairs = shards.drop("part").withColumn("part", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))).join(F.broadcast(some) if small else some.hint("merge"), "part").drop("part")
        found.append(materialise(pairs.mapInArrow(_search(k), "query_row long, query_id long, row long, vec_id long, score long"), "best"))
    merged = top_per_group(union_all(found), ["query_row"], [F.desc("score"), F.asc_nulls_last("vec_id"), F.col("row")], k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
