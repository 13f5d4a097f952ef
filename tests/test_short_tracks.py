"""Tracks that end early: the last ten vectors of a table need not be ten."""

import pytest

import __spark_entry__ as entry
from cadenza.operators import features as E
from cadenza.operators import signal as G
from check_queries import table_rows


def frames(spark, n):
    return spark.createDataFrame([("a", i, [float(i)]) for i in range(n)], "track_id string, frame int, vec array<double>")


def test_fixed_length_keeps_what_a_short_track_has(spark):
    f = frames(spark, 7)
    assert [(r["frame"], r["vec"][0]) for r in E.stride_pool(f, 3, length=10).orderBy("frame").collect()] == [(0, 1), (1, 4), (2, 6)]
    m = E.segment_means(f, 5, length=10).orderBy("segment").collect()
    assert [(r["segment"], r["vec"][0]) for r in m] == [(0, .5), (1, 2.5), (2, 4.5), (3, 6)]
    u = G.use_segments(f, 5, (3, 0), length=10).orderBy("frame").collect()
    assert [(r["frame"], r["vec"][0]) for r in u] == [(0, 6), (2, 0), (3, 1)]
    for bad in (E.segment_means, lambda *a, **k: G.use_segments(*a, (0,), **k)):
        with pytest.raises(ValueError, match="do not divide"):
            bad(f, 4, length=10)


def test_left_over_frames(spark):
    m = E.segment_means(frames(spark, 7), 3, strict=False).orderBy("segment").collect()
    assert [(r["segment"], r["vec"][0]) for r in m] == [(0, .5), (1, 2.5), (2, 4.5)]
    assert E.segment_means(frames(spark, 2), 3, strict=False).count() == 0


@pytest.mark.parametrize("key", ["E01", "E04", "E09", "P11"])
def test_queries_on_a_table_that_ends_in_a_short_track(spark, tmp_path, key):
    duckdb = pytest.importorskip("duckdb")
    import random

    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 2) for _ in range(64)], rnd.randrange(12)) for i in range(157 if key.startswith("E09") else 797)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    df = entry.queries()[key](spark, str(tmp_path))
    cur = con.execute(entry.oracle_sql()[key])
    want = table_rows([c[0] for c in cur.description], cur.fetchall())
    assert table_rows(df.columns, df.collect()) == want
