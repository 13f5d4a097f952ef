"""Exact nearest neighbours by blocks: no pair of rows is ever shuffled.

``streamed_topk`` searches a whole corpus: its partitions stream past broadcast blocks of queries. ``nearest_of_table`` scores a small
table, such as centroids, without any shuffle. ``probed_topk`` searches the cells that each query names. ``blocked_topk`` searches inside cells: both sides of a cell are hashed into blocks of
bounded size, and a task multiplies one query block by one corpus block and returns only its best k per query. Memory is bounded
by the block size everywhere.
"""

from __future__ import annotations

import sys
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import union_all
from cadenza.core.ordered import top_per_group
from cadenza.core.session import materialise, parallelism

# Block functions travel inside the task, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 2048
MIN_ROWS = 256              # corpus rows a task should have at least
GROUP_BYTES = 64 << 20      # of query blocks, or of a small table, that are broadcast at once
STRIP = 4_000_000  # differences held at once
DIGITS = 9  # similarities are rounded before ranking so that ties fall to the smaller id


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _distance(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances from exact differences, a strip of rows at a time so that memory stays bounded."""
    out = np.empty((len(q), len(c)))
    step = max(1, STRIP // max(c.size, 1))
    for i in range(0, len(q), step):
        out[i:i + step] = np.sqrt(((q[i:i + step, None, :] - c[None, :, :]) ** 2).sum(axis=2))
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best scores per row, ids ascending within ties."""
    k = min(k, score.shape[1])
    cut = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    row, col = np.nonzero((score >= cut[:, None]) & (score > -np.inf))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    start = np.searchsorted(row, np.arange(score.shape[0]))
    keep = np.arange(len(row)) - start[row] < k
    return row[keep], col[keep]


def _packed(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """(part, ids, width, values): the rows (id, vec) of each partition in blocks of at most ``most``, one row a block."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for b in batches:
            for lo in range(0, len(b), most):
                cut = b.slice(lo, most)
                flat = cut.column("vec").flatten()
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), one(cut.column(id_col)), pa.array([len(flat) // len(cut)], pa.int32()), one(flat)],
                                                 ["part", "ids", "width", "vals"])

    return rows.select(id_col, F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, f"part int, ids array<{id_type}>, width int, vals array<double>")


def _matrix(batch: pa.RecordBatch, i: int, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(prefix + "ids")[i].values.to_numpy(zero_copy_only=False)
    return ids, batch.column(prefix + "vals")[i].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _exact(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    return _unit(q) @ _unit(c).T if metric == "cosine" else -_distance(q, c)


def _above(q: np.ndarray, c: np.ndarray, least: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of all pairs that may reach ``least`` of their row, and a few more.

    Cosines are first made in single precision, whose error is bounded; only what may reach the limit is made again in double precision.
    """
    if metric == "cosine":
        u, v = _unit(q), _unit(c)
        slack = 10.0 ** -DIGITS + (q.shape[1] + 8) * 2.0 ** -23
        row, col = np.nonzero(u.astype(np.float32) @ v.astype(np.float32).T >= np.nextafter((least - slack).astype(np.float32), np.float32(-np.inf))[:, None])
        if len(row) * 16 <= len(q) * len(c):
            return row, col, np.round(np.einsum("ij,ij->i", u[row], v[col]), DIGITS) + 0.0
    score = _exact(q, c, metric)
    row, col = np.nonzero(score >= (least - 10.0 ** -DIGITS)[:, None])
    return row, col, np.round(score[row, col], DIGITS) + 0.0


def _scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    return np.round(_exact(q, c, metric), DIGITS) + 0.0


def streamed_topk(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = True, block: int = BLOCK,
                  group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(q, item, score, rank): best ``k`` of ``corpus(id, vec)`` per row of ``queries(q, vec)``.

    Both sides are packed into blocks. Groups of blocks of the smaller side, of bounded size, are broadcast, and every partition of
    the other side streams past them where it lies, keeping the k best of each query, so no vector is copied for an opposite block.
    A query meets the whole of a broadcast group in one task: as many queries as rows, or more, leave k rows per query and
    group, however many tasks there are. Few queries are broadcast themselves and leave k rows per query and task.
    """
    spark = queries.sparkSession
    types = queries.schema["q"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()
    n_q, n_c = queries.count(), corpus.count()
    wide = n_q >= n_c
    n_sent, n_streamed = (n_c, n_q) if wide else (n_q, n_c)
    parts = max(-(-n_sent // block), 1)
    tasks = max(min(parallelism(spark), -(-n_streamed // MIN_ROWS)), 1)
    named = lambda d: d.withColumnsRenamed({c: f"q_{c}" for c in d.columns if c != "part"})
    qs, cs = queries.select("q", "vec"), corpus.select("id", "vec")
    if wide:
        q, c = materialise(_packed(cs.repartition(parts), "id", block), "corpus-blocks"), named(_packed(qs.repartition(tasks), "q", block)).drop("part")
    else:
        q, c = materialise(named(_packed(qs.repartition(parts), "q", block)), "query-blocks"), _packed(cs.repartition(tasks), "id", block).drop("part")
    size = (F.size("vals" if wide else "q_vals") * 8).cast("long")
    share = max(int(group_bytes * parts // max(q.agg(F.sum(size)).first()[0] or 1, 1)), 1)

    def run(batches):
        state: dict = {}
        for b in batches:
            for i in range(len(b)):
                cid, cv = _matrix(b, i, "")
                qid, qv = _matrix(b, i, "q_")
                # The best so far of this block of queries, and those of this block of the corpus.
                held = state.get((qid[0], len(qid)))
                if held is not None and len(held[1]) == k * len(qid):
                    # Only scores that may reach a query's k-th best are rounded and ranked.
                    row, col, value = _above(qv, cv, held[3][k - 1::k], metric)
                    if exclude_self:
                        row, col, value = (x[qid[row] != cid[col]] for x in (row, col, value))
                else:
                    score = _scores(qv, cv, metric)
                    if exclude_self:
                        score[qid[:, None] == cid[None, :]] = -np.inf
                    row, col = _best(score, cid, k)
                    value = score[row, col]
                r, ids, s = (row, cid[col], value) if held is None else (np.concatenate([held[1], row]), np.concatenate([held[2], cid[col]]), np.concatenate([held[3], value]))
                order = np.lexsort((ids, -s, r))
                r, ids, s = r[order], ids[order], s[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                state[qid[0], len(qid)] = qid, r[keep], ids[keep], s[keep]
        for qid, r, ids, s in state.values():
            yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(ids), pa.array(s)], ["q", "item", "score"])

    found = []
    for lo in range(0, parts, share):
        hi = min(lo + share, parts)
        some = q.filter(F.col("part").between(lo, hi - 1))
        pairs = c.withColumn("part", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))).join(F.broadcast(some), "part").drop("part")
        best = pairs.mapInArrow(run, f"q {types[0]}, item {types[1]}, score double")
        found.append(best if share >= parts else materialise(best, "best"))
    return top_per_group(union_all(found), ["q"], [F.desc("score"), F.col("item")], k)


def nearest_of_table(queries: DataFrame, table: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(q, item, score, rank): best ``k`` of a small ``table(id, vec)`` per row of ``queries(q, vec)``, scored where the queries lie.

    The table is counted: up to GROUP_BYTES it is one broadcast row, beyond that the search is a streamed one.
    """
    n = table.count()
    width = table.select(F.max(F.size("vec"))).first()[0] or 1
    if n * width * 8 > GROUP_BYTES:
        return streamed_topk(queries, table, k, metric, exclude_self=False)
    types = queries.schema["q"].dataType.simpleString(), table.schema["id"].dataType.simpleString()
    one = table.select(F.struct("id", F.col("vec").cast("array<double>").alias("vec")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("r"))   # bounded above
    one = one.select(F.col("r.id").alias("ids"), F.flatten("r.vec").alias("vals"), F.lit(0).alias("_k"))
    q = _packed(queries, "q", BLOCK).select(F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals"), F.lit(0).alias("_k"))

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                cid, cv = _matrix(b, i, "")
                qid, qv = _matrix(b, i, "q_")
                if len(cid) == 0:
                    continue
                score = _scores(qv, cv, metric)
                row, col = _best(score, cid, k)
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(cid[col]), pa.array(score[row, col]), pa.array(rank, pa.int32())], ["q", "item", "score", "rank"])

    return q.join(F.broadcast(one), "_k").mapInArrow(run, f"q {types[0]}, item {types[1]}, score double, rank int")


def probed_topk(queries: DataFrame, probes: DataFrame, corpus: DataFrame, k: int, cell: str, metric: str = "cosine", exclude_self: bool = True,
                block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(q, item, score, rank): best ``k`` of the rows of ``corpus(id, vec, cell)`` in the cells that ``probes(q, cell)`` names, per row of ``queries(q, vec)``.

    Blocks of a cell are broadcast in groups of bounded size, cell by cell, and the queries stream past them with the list of their cells. So
    no vector is copied for a cell or an opposite block, and a query leaves k rows only where a group holds one of its cells.
    """
    spark = queries.sparkSession
    types = queries.schema["q"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()
    n_q = queries.count()
    place, parts = [], 0
    for r in corpus.groupBy(cell).agg(F.count("*").alias("n")).orderBy(cell).collect():      # one row a cell
        place.append((r[cell], parts, -(-r["n"] // block)))
        parts += place[-1][2]
    cells = spark.createDataFrame(place, f"_cell {corpus.schema[cell].dataType.simpleString()}, _first int, _n int")
    c = corpus.join(F.broadcast(cells), F.col(cell) == F.col("_cell"))
    c = c.withColumn("part", (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_n"))).cast("int")).groupBy("part", "_first").agg(
        F.collect_list(F.struct("id", F.col("vec").cast("array<double>").alias("vec"))).alias("r"))      # about ``block`` rows
    c = materialise(c.select("part", F.col("_first").alias("cell"), F.col("r.id").alias("ids"), F.flatten("r.vec").alias("vals")), "cell-blocks")
    wanted = probes.join(F.broadcast(cells), F.col(cell) == F.col("_cell")).groupBy("q").agg(F.collect_list("_first").alias("_cells"))
    tasks = max(min(parallelism(spark), -(-n_q // MIN_ROWS)), 1)
    q = materialise(queries.select("q", F.col("vec").cast("array<double>").alias("vec")).join(wanted, "q").repartition(tasks), "probing")

    def packed(batches):
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        for b in batches:
            for lo in range(0, len(b), block):
                cut = b.slice(lo, block)
                at = cut.column("_cells")
                yield pa.RecordBatch.from_arrays([one(cut.column("q")), one(cut.column("vec").flatten()), one(at.flatten()), one(at.value_lengths())], ["q_ids", "q_vals", "q_cells", "q_sizes"])

    blocks = q.mapInArrow(packed, f"q_ids array<{types[0]}>, q_vals array<double>, q_cells array<int>, q_sizes array<int>")
    size = c.agg(F.sum((F.size("vals") * 8).cast("long"))).first()[0] or 1
    share = max(int(group_bytes * parts // size), 1)

    def run(batches):
        state = None

        def done():
            qid, ids, s = state
            row, col = np.nonzero(s > -np.inf)
            return pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(ids[row, col]), pa.array(s[row, col])], ["q", "item", "score"])

        for b in batches:
            for i in range(len(b)):
                cid, cv = _matrix(b, i, "")
                qid, qv = _matrix(b, i, "q_")
                if state is None or len(state[0]) != len(qid) or (state[0] != qid).any():
                    if state is not None:
                        yield done()
                    state = qid.copy(), np.zeros((len(qid), k), cid.dtype), np.full((len(qid), k), -np.inf)
                get = lambda x: b.column(x)[i].values.to_numpy()  # noqa: B023, E731
                mine = np.repeat(np.arange(len(qid)), get("q_sizes"))[get("q_cells") == b.column("cell")[i].as_py()]
                if len(mine) == 0:
                    continue
                _, ids, best = state
                least = best[mine, k - 1]
                if np.isinf(least).any():
                    score = _scores(qv[mine], cv, metric)
                    if exclude_self:
                        score[qid[mine][:, None] == cid[None, :]] = -np.inf
                    row, col = _best(score, cid, k)
                    value = score[row, col]
                else:
                    # Only scores that may reach a query's k-th best are rounded and ranked.
                    row, col, value = _above(qv[mine], cv, least, metric)
                    if exclude_self:
                        row, col, value = (x[qid[mine][row] != cid[col]] for x in (row, col, value))
                r, at = np.nonzero(best[mine] > -np.inf)
                r, x, s = np.concatenate([r, row]), np.concatenate([ids[mine][r, at], cid[col]]), np.concatenate([best[mine][r, at], value])
                order = np.lexsort((x, -s, r))
                r, x, s = r[order], x[order], s[order]
                at = np.arange(len(r)) - np.searchsorted(r, r)
                keep = at < k
                ids[mine[r[keep]], at[keep]], best[mine[r[keep]], at[keep]] = x[keep], s[keep]
        if state is not None:
            yield done()

    found = []
    for lo in range(0, max(parts, 1), share):
        some = c.filter(F.col("part").between(lo, min(lo + share, parts) - 1)).drop("part")
        best = blocks.crossJoin(F.broadcast(some)).mapInArrow(run, f"q {types[0]}, item {types[1]}, score double")
        found.append(best if share >= parts else materialise(best, "best"))
    return top_per_group(union_all(found), ["q"], [F.desc("score"), F.col("item")], k)


def blocked_topk(queries: DataFrame, corpus: DataFrame, k: int, cell: list[str] | None = None,
                 merge_on: list[str] | None = None, metric: str = "cosine", exclude_self: bool = True,
                 block: int = BLOCK) -> DataFrame:
    """(merge_on..., q, item, score, rank): best ``k`` of ``corpus(id, vec)`` per row of ``queries(q, vec)``.

    ``cell`` columns restrict comparison to equal cells. ``cosine`` scales both sides to
    unit length inside the task; ``euclid`` scores by negative distance.
    """
    if not cell:
        return streamed_topk(queries, corpus, k, metric, exclude_self, block)
    queries = queries.select(*[F.col(x).alias(x) for x in queries.columns])  # both sides may be one table
    merge_on = [*(merge_on or []), "q"]
    nq = queries.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("_nq"))
    nc = corpus.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("_nc"))
    cells = materialise(nq.join(nc, cell), "cells")
    q, c = queries.join(cells, cell), corpus.join(cells, cell)
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.select(*cell, "q", "vec", mine("q", "_nq").alias("_qb"), every("_nc").alias("_cb"))
    c = c.select(*cell, "id", "vec", mine("id", "_nc").alias("_cb"), every("_nq").alias("_qb"))
    types = {f.name: f.dataType.simpleString() for f in [*q.schema, *c.schema]}
    schema = ", ".join([f"{x} {types[x]}" for x in cell] + [f"q {types['q']}", f"item {types['id']}", "score double"])

    def best_of_blocks(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [*cell, "q", "item", "score"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        qv, cv = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
        score = _scores(qv, cv, metric)
        qid, cid = left["q"].to_numpy(), right["id"].to_numpy()
        if exclude_self:
            score[qid[:, None] == cid[None, :]] = -np.inf
        row, col = _best(score, cid, k)
        out = {x: np.repeat(left[x].iloc[0], len(row)) for x in cell}
        return pd.DataFrame({**out, "q": qid[row], "item": cid[col], "score": score[row, col]})[names]

    keys = [*cell, "_qb", "_cb"]
    n = parallelism(queries.sparkSession)
    q, c = q.repartition(n, *keys), c.repartition(n, *keys)
    partial = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(best_of_blocks, schema)
    return top_per_group(partial, merge_on, [F.desc("score"), F.col("item")], k)
