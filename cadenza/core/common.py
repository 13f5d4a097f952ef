"""Small shared column helpers and contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dimension tables (vocabulary, stems, variants) may be sent to every task up to this size.
DIMENSION_ROWS = 50_000
# Narrow lookup tables whose row count is known may be broadcast up to this size.
LOOKUP_ROWS = 1_000_000


def finite(c: Column) -> Column:
    """True for values that are neither NULL, NaN nor infinite."""
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def lookup(df: DataFrame, rows: int) -> DataFrame:
    """Join side with a counted number of rows: broadcast when small, else never."""
    return F.broadcast(df) if rows <= LOOKUP_ROWS else never_broadcast(df)


def never_broadcast(df: DataFrame) -> DataFrame:
    """For sides that an explode makes larger than the optimizer's estimate."""
    return df.hint("merge")


def md5_int(*parts: Column | str | int) -> Column:
    """32-bit integer drawn from an MD5 digest: reproducible on any engine that has MD5."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def md5_uniform(*parts: Column | str | int) -> Column:
    return md5_int(*parts) / F.lit(4294967296.0)


def require(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """Fail the job on the first row that breaks ``ok``; rows pass through unchanged."""
    msg = message if isinstance(message, Column) else F.lit(message)
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(msg).cast("boolean")))


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys meet; the key columns of ``left`` are kept."""
    named = right.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    match = reduce(lambda x, y: x & y, [left[k].eqNullSafe(named[f"_j_{k}"]) for k in keys])
    return left.join(named, match, how).drop(*[f"_j_{k}" for k in keys])


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# Array elements that one row of a split document may hold.
PART = 50_000


def explode_range(df: DataFrame, stop, name: str, start=0, chunk: int = 8192) -> DataFrame:
    """Repeat each row for ``name`` in [start, stop). Long ranges are built in two steps, never as one long array."""
    start = start if isinstance(start, Column) else F.lit(start)
    stop = stop if isinstance(stop, Column) else F.lit(stop)
    keep = df.columns
    r = df.select("*", start.cast("long").alias("_a"), stop.cast("long").alias("_b")).filter("_b > _a")
    r = r.select("*", F.explode(F.expr(f"sequence(0L, (_b - _a - 1) div {chunk})")).alias("_c"))
    lo = F.col("_a") + F.col("_c") * chunk
    return r.select(*keep, F.explode(F.sequence(lo, F.least(lo + chunk, F.col("_b")) - 1)).alias(name))
