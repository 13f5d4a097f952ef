"""Centroid clustering on bit planes: exact integer k-means whose dot products are popcounts.

Components become integers ``floor(SCALE * x)`` and are shifted by the smallest of them, so all are at least 0. Plane p of a
vector packs bit p of its 64 components into one 64-bit word, and with the planes of a centroid

    vector . centroid = sum over p, q of 2^(p + q) * popcount(vector[p] AND centroid[q])

is exact, as are the squared distances built from it, which the shift does not change. The planes are written once and read
in each round: about as many words as the integers have bits, in place of 64 numbers. A round sends the centroids to all
tasks (``k`` rows of 64 numbers, whatever the input) and gets back, from Spark's aggregate, ``k * 64`` sums.

Vectors take part that have exactly 64 components, none of them null or not finite; the others are left out. Integers beyond
2^26 in size are an error, as their distances might not fit a long. Repeated rows are vectors of their own. The first centroids
are the k vectors whose ids have the smallest digests; among rows of one id those with smaller components go first, and rows
without an id come last. With fewer than k vectors there are fewer centroids, without any the result is empty. Ties in distance
go to the smaller cluster number; a cluster without vectors keeps its centroid.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import finite, require
from cadenza.core.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = 64
SCALE = 1024
LARGEST = 1 << 26


# ---------------------------------------------------------------- planes

def pack_planes(values: np.ndarray, n_planes: int) -> np.ndarray:
    """(rows, 64) integers in [0, 2^n_planes) -> (rows, n_planes) words; component i is bit i of a word."""
    out = np.empty((len(values), n_planes), np.uint64)
    for p in range(n_planes):
        bits = ((values >> p) & 1).astype(np.uint8)
        out[:, p] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def plane_dots(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact dot products of every row of planes with the planes of one centroid."""
    total = np.zeros(len(rows), np.int64)
    for p in range(rows.shape[1]):
        for q in np.flatnonzero(centroid):
            total += np.bitwise_count(rows[:, p] & centroid[q]).astype(np.int64) << (p + int(q))
    return total


def nearest(rows: np.ndarray, norms: np.ndarray, centroids: np.ndarray, n_planes: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance to it); ``centroids`` holds shifted integers."""
    planes = pack_planes(centroids, n_planes)
    own = (centroids.astype(np.int64) ** 2).sum(axis=1)
    far = np.stack([norms + own[k] - 2 * plane_dots(rows, planes[k]) for k in range(len(centroids))], axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(rows)), best]


def component_sums(rows: np.ndarray) -> np.ndarray:
    """Sum of each of the 64 components over all rows, from the bits of the planes."""
    out = np.zeros(DIMENSIONS, np.int64)
    for p in range(rows.shape[1]):
        bits = np.unpackbits(np.ascontiguousarray(rows[:, p]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += bits.sum(axis=0, dtype=np.int64) << p
    return out


def _planes(batch: pa.RecordBatch, n_planes: int) -> np.ndarray:
    flat = batch.column("planes").flatten()
    return flat.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, n_planes)


# ---------------------------------------------------------------- Spark

def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, v: vectors with 64 finite components, as integers."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = rows.filter((F.size(v) == DIMENSIONS) & F.forall(v, finite))
    scaled = lambda x: F.floor(x.cast("double") * scale)
    too_large = F.exists(v, lambda x: finite(x) & (F.abs(x.cast("double") * scale) > LARGEST))
    rows = require(rows, ~F.coalesce(too_large, F.lit(False)), "a component is too large for exact distances")
    return rows.select("vec_id", F.transform(v, scaled).alias("v"))


def plane_table(ints: DataFrame) -> tuple[DataFrame, int, int]:
    """(vec_id, norm, planes; the shift; the number of planes)."""
    low, high = ints.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    low, high = low or 0, high or 0
    n_planes = max(int(high - low).bit_length(), 1)

    def run(batches):
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS).astype(np.int64) - low
            planes = pack_planes(v, n_planes)
            flat = pa.array(planes.view(np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n_planes), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array((v ** 2).sum(axis=1)), lists], ["vec_id", "norm", "planes"])

    return materialise(ints.mapInArrow(run, "vec_id long, norm long, planes array<long>"), "planes"), low, n_planes


def first_centroids(ints: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest digest of ``seed:id``. Each task sends its k best at most."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = ints.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, DIMENSIONS)


def moved(table: DataFrame, centroids: np.ndarray, n_planes: int) -> np.ndarray:
    """Centroids after one round. Tasks return sums, which Spark adds up exactly."""

    def run(batches):
        k = len(centroids)
        count, sums = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), np.int64)
        for b in batches:
            rows = _planes(b, n_planes)
            best, _ = nearest(rows, b.column("norm").to_numpy(), centroids, n_planes)
            for c in range(k):
                count[c] += int((best == c).sum())
                sums[c] += component_sums(rows[best == c])
        some = np.repeat(np.flatnonzero(count), DIMENSIONS)
        at = np.tile(np.arange(DIMENSIONS), len(some) // DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(at, pa.int32()), pa.array(count[some]), pa.array(sums[some, at])],
                                         ["cluster", "i", "n", "total"])

    parts = table.mapInArrow(run, "cluster int, i int, n long, total long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "i").agg(exact("n").alias("n"), exact("total").alias("total")).collect():   # k * 64 rows
        out[r["cluster"], r["i"]] = int(r["total"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding",
            scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every vector that takes part; the k centroids as integers)."""
    ints = integer_vectors(vectors, id_col, vector_col, scale)
    table, low, n_planes = plane_table(ints)
    centroids = first_centroids(ints, k, seed) - low
    if len(centroids) == 0:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        now = moved(table, centroids, n_planes)
        if (now == centroids).all():
            break                                   # every further round would repeat this one
        centroids = now

    def run(batches):
        for b in batches:
            best, far = nearest(_planes(b, n_planes), b.column("norm").to_numpy(), centroids, n_planes)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    return materialise(table.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters"), centroids + low


def cluster_report(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding",
                   scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    assigned, centroids = cluster(vectors, k, rounds, seed, id_col, vector_col, scale)
    own = {r["cluster"]: int(r["own"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}   # k rows
    digest = lambda v: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()
    names = [(c, own[c], sum(own.values()), digest(v)) for c, v in enumerate(centroids.tolist()) if c in own]
    names = vectors.sparkSession.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
