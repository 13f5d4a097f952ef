"""Logistic probes for many feature sets and tags at once.

All (set, tag) problems are solved together: a pass over the feature table multiplies each Arrow batch with the weights of all
tags of its set and returns one gradient matrix per set and task. Tasks' matrices are added up in groups before they reach the
driver, which holds weights only (components x tags per set). The number of passes is that of the slowest problem and
does not grow with tags or sets.

The objective of a problem is the mean logistic loss plus ``|w|^2 / 2n`` without the intercept, on features standardised by the
training rows of their set. It is minimised by limited-memory BFGS. Its start is the inverse of a bound of the Hessian that all
tags of a set share, a quarter of their Gram matrix, so few passes are needed also where features are alike.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import lookup, never_broadcast
from cadenza.core.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN = 32                    # matrices of a set that reach the driver at once
MODEL_BYTES = 32 << 20      # weights sent to the tasks in one pass
MEMORY = 8                  # steps remembered by the solver
GRAM_DIMENSIONS = 1024      # beyond it the start is the diagonal of the bound


@dataclass
class Problem:
    """Fitted weights of one set and tag on standardised features; the last one is the intercept."""

    name: object
    tag: str
    n: int
    n_pos: int
    weights: np.ndarray
    gradient: float = float("inf")


@dataclass
class FeatureSet:
    name: object
    n: int
    mean: np.ndarray
    std: np.ndarray
    gram: np.ndarray | None = None
    tags: list[tuple[str, int]] = field(default_factory=list)


def _design(vec: pa.Array, s: FeatureSet) -> np.ndarray:
    x = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
    return np.hstack([(x - s.mean) / s.std, np.ones((len(x), 1))])


def _labels(tags: pa.Array, columns: dict[int, int]) -> np.ndarray:
    y = np.zeros((len(tags), len(columns)))
    flat = tags.flatten().to_pylist()
    row = np.repeat(np.arange(len(tags)), tags.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    hit = [(r, columns[t]) for r, t in zip(row, flat) if t in columns]
    if hit:
        y[tuple(np.array(hit).T)] = 1
    return y


def _by_set(batch: pa.RecordBatch):
    """(number of the set, its rows) of a batch."""
    k = batch.column("k").to_numpy()
    for v in np.unique(k):
        yield int(v), batch.filter(pa.array(k == v))


def _added_up(rows: DataFrame, run, wide: bool) -> dict[int, np.ndarray]:
    """Sum over all tasks of the matrices that ``run`` yields as (set, matrix)."""

    def tasks(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, m in run(b):
                total[k] = total[k] + m if k in total else m
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([m.astype("<f8").tobytes()], pa.binary())], ["k", "m"])

    def add(table: pa.Table) -> pa.Table:
        m = sum(np.frombuffer(x.as_py(), "<f8") for x in table.column("m"))
        return pa.table({"k": table.column("k").slice(0, 1), "m": pa.array([m.tobytes()], pa.binary())})

    parts = rows.mapInArrow(tasks, "k int, m binary")
    if wide:
        parts = parts.withColumn("slot", F.spark_partition_id() % FAN).groupBy("k", "slot").applyInArrow(add, "k int, m binary")
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():
        m = np.frombuffer(r["m"], "<f8")
        out[r["k"]] = out[r["k"]] + m if r["k"] in out else m
    return out


def _prepared(features: DataFrame, key: str, labels: DataFrame) -> tuple[DataFrame, list[FeatureSet], list[str]]:
    """(k, split, track_id, vec, tags as numbers), the feature sets with their statistics and usable tags, the vocabulary."""
    lab = materialise(labels.select("track_id", "tag").distinct(), "probe-labels")
    feats = materialise(features.select(F.col(key).alias("_name"), "split", "track_id", F.col("vec").cast("array<double>").alias("vec")), "probe")
    train = feats.filter("split = 'train'")
    dims = train.select("_name", F.posexplode("vec").alias("i", "v")).groupBy("_name", "i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    n = {r["_name"]: r["count"] for r in train.groupBy("_name").count().collect()}
    stats: dict = {}
    for r in dims.orderBy("_name", "i").collect():                     # components x sets
        stats.setdefault(r["_name"], []).append((r["mean"], r["std"] if r["std"] else 1.0))
    sets = [FeatureSet(s, n[s], *np.array(stats[s]).T) for s in sorted(stats)]
    counts = train.join(never_broadcast(lab), "track_id").groupBy("_name", "tag").count().collect()     # sets x tags
    usable = {(r["_name"], r["tag"]): r["count"] for r in counts if 0 < r["count"] < n[r["_name"]]}
    vocabulary = sorted({t for _, t in usable})
    for s in sets:
        s.tags = [(t, usable[s.name, t]) for t in vocabulary if (s.name, t) in usable]
    spark = feats.sparkSession
    names = spark.createDataFrame([(s.name, i) for i, s in enumerate(sets)], f"_name {feats.schema['_name'].dataType.simpleString()}, k int") if sets else None
    if not vocabulary:
        raise ValueError("no tag has both classes in training")
    numbers = spark.createDataFrame([(t, i) for i, t in enumerate(vocabulary)], "tag string, t int")
    mine = lab.join(lookup(numbers, len(vocabulary)), "tag").groupBy("track_id").agg(F.collect_list("t").alias("tags"))     # vocabulary-sized
    rows = feats.join(F.broadcast(names), "_name").join(mine, "track_id", "left")
    return materialise(rows.select("k", "split", "track_id", "vec", "tags"), "probe-rows"), sets, vocabulary


def _start(s: FeatureSet) -> np.ndarray:
    """Inverse of the bound of the Hessian, a matrix or its diagonal."""
    ridge = np.full(len(s.mean) + 1, 1.0 / s.n)
    ridge[-1] = 1e-6
    return np.linalg.inv(s.gram / (4 * s.n) + np.diag(ridge)) if s.gram.ndim == 2 else 1 / (s.gram / (4 * s.n) + ridge)


class _Solver:
    """Limited-memory BFGS of one problem; ``trial`` is the point to be evaluated next."""

    def __init__(self, start: np.ndarray):
        size = len(start)
        self.start, self.w, self.trial = start, np.zeros(size), np.zeros(size)
        self.f, self.g, self.step, self.pairs = np.inf, None, 1.0, []

    def _direction(self) -> np.ndarray:
        q, held = self.g.copy(), []
        for s, y, rho in reversed(self.pairs):
            a = rho * (s @ q)
            q -= a * y
            held.append(a)
        r = self.start @ q if self.start.ndim == 2 else self.start * q
        for (s, y, rho), a in zip(self.pairs, reversed(held)):
            r += (a - rho * (y @ r)) * s
        return -r

    def tell(self, f: float, g: np.ndarray) -> None:
        if self.g is not None:
            slope = self.step * (self.g @ self.way)
            flat = f <= self.f + 1e-12 * max(1.0, abs(self.f)) and np.abs(g).max() < np.abs(self.g).max()
            if not (f <= self.f + 1e-4 * slope or flat) and self.step > 1e-10:
                self.step /= 2
                self.trial = self.w + self.step * self.way
                return
            s, y = self.trial - self.w, g - self.g
            if s @ y > 1e-16:
                self.pairs = [*self.pairs, (s, y, 1 / (s @ y))][-MEMORY:]
        self.w, self.f, self.g, self.step = self.trial, f, g, 1.0
        self.way = self._direction()
        self.trial = self.w + self.way


def fit_probes(features: DataFrame, key: str, labels: DataFrame, max_passes: int = 200, tol: float = 1e-8) -> tuple[DataFrame, list[FeatureSet], list[Problem]]:
    """(validation rows, sets, fitted problems) of ``features(key, split, track_id, vec)``; ``labels(track_id, tag)`` are positives.

    A tag without both classes in the training rows of a set is skipped there.
    """
    rows, sets, vocabulary = _prepared(features, key, labels)
    train = rows.filter("split = 'train'")
    wide = train.select(F.spark_partition_id()).distinct().count() > FAN

    def gram(b):
        for k, part in _by_set(b):
            x = _design(part.column("vec"), sets[k])
            yield k, (x.T @ x if x.shape[1] <= GRAM_DIMENSIONS else (x ** 2).sum(axis=0))

    for k, m in _added_up(train, gram, wide).items():
        size = len(sets[k].mean) + 1
        sets[k].gram = m.reshape(size, size) if len(m) > size else m
    starts = [_start(s) for s in sets]
    number = {t: i for i, t in enumerate(vocabulary)}
    chunk = max(MODEL_BYTES // (8 * sum(len(s.mean) + 1 for s in sets)), 1)
    solved = []
    for lo in range(0, len(vocabulary), chunk):
        some = set(vocabulary[lo:lo + chunk])
        open_ = {(k, t): (_Solver(starts[k]), n_pos) for k, s in enumerate(sets) for t, n_pos in s.tags if t in some}
        for _ in range(max_passes):
            todo = {p: v[0] for p, v in open_.items() if v[0].g is None or np.abs(v[0].g).max() > tol}
            if not todo:
                break
            columns: dict[int, dict[int, int]] = {}
            for k, t in todo:
                columns.setdefault(k, {})[number[t]] = len(columns.get(k, {}))
            weights = {k: np.stack([todo[k, vocabulary[t]].trial for t in c], axis=1) for k, c in columns.items()}

            def gradient(b):
                for k, part in _by_set(b):
                    if k in weights:
                        x, y = _design(part.column("vec"), sets[k]), _labels(part.column("tags"), columns[k])
                        z = x @ weights[k]
                        p = 0.5 * (1 + np.tanh(z / 2))
                        yield k, np.vstack([x.T @ (p - y), (np.logaddexp(0, z) - y * z).sum(axis=0)])

            for k, m in _added_up(train, gradient, wide).items():
                w, n = weights[k], sets[k].n
                m = m.reshape(w.shape[0] + 1, -1) / n
                free = w.copy()
                free[-1] = 0                        # the intercept is not held down
                m[:-1] += free / n
                m[-1] += (free ** 2).sum(axis=0) / (2 * n)
                for t, j in columns[k].items():
                    todo[k, vocabulary[t]].tell(float(m[-1, j]), m[:-1, j].copy())
        solved += [Problem(sets[k].name, t, sets[k].n, n_pos, s.w, float(np.abs(s.g).max())) for (k, t), (s, n_pos) in open_.items()]
    return rows.filter("split = 'validation'"), sets, solved


def probe_scores(features: DataFrame, key: str, labels: DataFrame, max_passes: int = 200) -> DataFrame:
    """(key, track_id, tag, y, score): probability of every usable tag for the validation rows of every feature set."""
    rows, sets, solved = fit_probes(features, key, labels, max_passes)
    of: dict = {}
    for p in solved:
        of.setdefault(p.name, []).append((p.tag, p.weights))
    vocabulary = sorted({p.tag for p in solved})
    number = {t: i for i, t in enumerate(vocabulary)}
    types = features.schema

    def run(batches):
        for b in batches:
            for k, part in _by_set(b):
                mine = of.get(sets[k].name)
                if not mine:
                    continue
                z = _design(part.column("vec"), sets[k]) @ np.stack([w for _, w in mine], axis=1)
                y = _labels(part.column("tags"), {number[t]: j for j, (t, _) in enumerate(mine)})
                at = np.repeat(np.arange(len(part)), len(mine))
                tags = pa.array([t for t, _ in mine]).take(pa.array(np.tile(np.arange(len(mine)), len(part))))
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(at)), part.column("track_id").take(pa.array(at)), tags,
                                                  pa.array(y.reshape(-1), pa.int32()), pa.array(0.5 * (1 + np.tanh(z / 2)).reshape(-1))], ["k", "track_id", "tag", "y", "score"])

    # Numbers of tags are those of the rows, which hold the usable tags in the same order.
    scored = rows.mapInArrow(run, f"k int, track_id {types['track_id'].dataType.simpleString()}, tag string, y int, score double")
    names = rows.sparkSession.createDataFrame([(i, s.name) for i, s in enumerate(sets)], f"k int, {key} {types[key].dataType.simpleString()}")
    return scored.join(F.broadcast(names), "k").drop("k")
