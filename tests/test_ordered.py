"""The sliced plan must give the same rows as the plain window plan."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.core.ordered import Ordered, quantiles


def rows(spark):
    rnd = random.Random(3)
    data = [("hot", i, rnd.randint(0, 50), None if rnd.random() < .5 else i) for i in range(400)]
    data += [(f"g{k}", i, rnd.randint(0, 9), i if k % 2 else None) for k in range(20) for i in range(k % 5 + 1)]
    return spark.createDataFrame(data, "g string, i long, v long, m long")


@pytest.mark.parametrize("order", ["up", "down"])
@pytest.mark.parametrize("group", [["g"], []])
def test_sliced_equals_plain(spark, group, order):
    order = [F.col("i") if order == "up" else F.desc("i")] + ([] if group else [F.col("g")])
    ops = dict(a=("row", None), b=("sum", F.col("v")), c=("sum_before", F.col("v")), d=("max_before", F.col("v")),
               e=("lag", F.col("m")), f=("lead", F.col("m")), h=("last", F.col("m")), j=("last_before", F.col("m")),
               k=("first_after", F.col("m")))
    plain = Ordered(rows(spark), group, order, 10**6).add(**ops)
    cut = Ordered(rows(spark), group, order, 30).add(**ops)
    assert cut.sliced and not plain.sliced
    key = lambda r: (r.g, r.i)
    assert sorted(plain.result().collect(), key=key) == sorted(cut.result().collect(), key=key)
    # chained on derived columns
    again = lambda o: sorted(o.add(z=("sum", F.col("a") * 2)).result().collect(), key=key)
    assert again(plain) == again(cut)


@pytest.mark.parametrize("group", [["g"], []])
def test_quantiles_both_ways(spark, group):
    qs = {"q25": .25, "q50": .5, "q9": .9}
    a = sorted(map(tuple, quantiles(rows(spark), group, "v", qs, 10**6).collect()))
    b = sorted(map(tuple, quantiles(rows(spark), group, "v", qs, 20).collect()))
    assert [x[:-3] for x in a] == [x[:-3] for x in b]
    for x, y in zip(a, b, strict=True):
        assert x[-3:] == pytest.approx(y[-3:])


def test_null_group_survives_slicing(spark):
    """A NULL group gives the same row numbers and quantiles whether or not the plan is sliced."""
    from pyspark.sql import functions as F

    from cadenza.core.ordered import Ordered, quantiles

    df = spark.createDataFrame([(None if i % 2 else "a", i, float(i % 17)) for i in range(300)], "g string, i int, v double")
    rows = lambda limit: sorted(map(str, Ordered(df, ["g"], ["i"], limit).add(k=("row", F.lit(1))).result().select("g", "i", "k").collect()))
    assert rows(40) == rows(10_000)
    cuts = lambda limit: sorted(map(str, quantiles(df, ["g"], "v", {"m": 0.5}, limit).select("g", "m").collect()))
    assert cuts(40) == cuts(10_000) and len(cuts(40)) == 2
