"""Registry of queries and of the SQL that states their expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.core.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Named SQL fragments: name -> (names it reads, SELECT text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, text: str, *needs: str) -> None:
    VIEWS[name] = (needs, text)


def sql(body: str, *needs: str) -> str:
    """Prefix ``body`` (a SELECT, or ``name AS (...), ... SELECT``) with the views it needs."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in VIEWS[n][0]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in needs:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in ordered]
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
    return "WITH RECURSIVE " + ",\n".join([*parts, body])


def query(key: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), str(sf_dir).rstrip("/"))

        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register
