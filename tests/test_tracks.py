"""Derived tracks and scores: one row per order with lines, dense scores are never stored."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cadenza.operators import tagbits
from cadenza.operators import tagging as T

SF = "/root/testdata/sf0.001"


def test_tags_of_tracks_are_the_label_rows(spark, tmp_path):
    entry.queries()
    from cadenza.plans import canonical as C

    tables = {"orders": ([(1, 7, "5-LOW"), (2, 8, None), (3, 9, "2-HIGH"), (4, 9, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderpriority string"),
              "lineitem": ([(1, 1), (1, 2), (1, 1), (2, 2), (3, 99)], "l_orderkey long, l_partkey long"),
              "part": ([(1, "STEEL", "B1"), (2, "STEEL", "B2")], "p_partkey long, p_type string, p_brand string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["track_id"]: r["tags"] for r in C.tracks(spark, str(tmp_path)).collect()}
    assert got == {"1": ["brand---B1", "brand---B2", "priority---5-LOW", "type---STEEL"], "2": ["brand---B2", "type---STEEL"], "3": ["priority---2-HIGH"]}


def test_dense_scores_are_not_written(spark):
    entry.queries()
    from cadenza.plans import canonical as C

    C.scores(spark, SF, "a", "test").count()
    T.macro_ap(C.scores(spark, SF, "b", "test")).collect()
    assert not [k for k in C._STORED if k[2].startswith("scores")]


@pytest.mark.parametrize("held", [2048, 1])
def test_pair_counts(monkeypatch, held):
    rnd = np.random.default_rng(held)
    monkeypatch.setattr(tagbits, "CELLS", 20)
    monkeypatch.setattr(tagbits, "HELD_TAGS", held)
    rows = [{int(t): (int(rnd.integers(2)), int(rnd.integers(2))) for t in rnd.choice(5, rnd.integers(0, 6), replace=False)} for _ in range(40)]
    want = {}
    for r in rows:
        for i in (t for t in r if r[t][0]):
            for j, (y, p) in r.items():
                w = want.setdefault((i, j), [0, 0, 0, 0])
                want[i, j] = [w[0] + 1, w[1] + (not y), w[2] + (not y and p), w[3] + y]
    batch = pa.record_batch({"c": pa.array([[4 * t + 2 * y + p for t, (y, p) in r.items()] for r in rows], pa.list_(pa.int32()))})
    got = {}
    for b in tagbits.pair_counts(5)([batch]):
        for x in b.to_pylist():
            got[x["i"], x["j"]] = [a + c for a, c in zip(got.get((x["i"], x["j"]), [0] * 4), list(x.values())[2:])]
    assert got == want
