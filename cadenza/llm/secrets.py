"""Secrets in every version of every file, each content read once per rule version. DataFrame functions only.

Versions are content-addressed by the SHA-256 of their text. A ledger in the shared folder lists the (blob, rule, rule
version) pairs that were read before, with their findings. A run hashes the versions, drops the pairs that the ledger
knows, reads one copy of each remaining blob, appends findings and pairs, and joins findings back to all paths.

Positions: the pieces between matches and the matches themselves alternate, so running sums of their lengths are the
spans in code points. Rules match in Java regular expressions; ``keep`` drops matches whose part is too short, without
another try, as the match is consumed first.

A null text is empty. Repeated rows are versions like any other. Ledger entries are only ever appended; findings come
before pairs, so a run that dies in between is repeated, and repeated findings are merged when read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cadenza.core.session import scratch_path


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    group: int          # the part whose length counts; 0 is the whole match
    least: int
    version: int = 1
    hint: str | None = None         # a cheaper pattern that every match contains


# Fixed patterns.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
         hint=r"(?i)passw|secret|token|api_?key"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Runs are maximal, so asking for 32 at once finds the same ones as filtering all runs by length.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

RUN = 512           # matches folded at a time
PAIRS = "blob string, rule string, version int"
FINDINGS = PAIRS + ", span_start long, span_end long"


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<span_start, span_end>> of the rule's matches, ends exclusive, in code points."""
    pattern = F.lit(rule.pattern)
    parts, whole, part = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    rows = F.arrays_zip(F.slice(parts, 1, F.size(whole)).alias("gap"), whole.alias("whole"), part.alias("part"))
    empty = F.expr("cast(array() as array<struct<span_start: bigint, span_end: bigint>>)")

    # Long lists are folded in runs, each from the place that the lengths before it give, so no array grows hit by hit.
    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        hit = F.array(F.struct(start.cast("long").alias("span_start"), end.cast("long").alias("span_end")))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    def fold(some, at):
        return F.aggregate(some, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / RUN).cast("int")), lambda k: F.slice(rows, k * RUN + 1, F.lit(RUN)))
    length = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda n, x: n + F.length(x["gap"]) + F.length(x["whole"]))
    starts = F.aggregate(runs, F.array(F.lit(0).cast("long")), lambda acc, some: F.concat(acc, F.array(F.element_at(acc, -1) + length(some))))
    many = F.flatten(F.zip_with(runs, F.slice(starts, 1, F.size(starts) - 1), fold))
    found = F.when(F.size(whole) <= RUN, fold(rows, F.lit(0).cast("long"))).otherwise(many)
    return F.when(F.rlike(text, F.lit(rule.hint or rule.pattern)), found).otherwise(empty)


def _named(rule: Rule) -> Column:
    """The spans in the column of a rule as ledger rows; null where the pair was read before."""
    none = F.expr("cast(array() as array<struct<span_start: bigint, span_end: bigint>>)")
    return F.transform(F.coalesce(F.col(rule.name), none), lambda s: F.struct(
        F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), s["span_start"].alias("span_start"), s["span_end"].alias("span_end")))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def addresses(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    return versions.select(F.col(path_col).alias("path"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))


def scan_new(versions: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``versions`` and return path, blob of every version."""
    spark = versions.sparkSession
    paths = scratch_path(spark, "paths")
    addresses(versions, path_col, text_col).write.parquet(paths)
    paths = spark.read.parquet(paths)
    wanted = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    pairs = blobs.select("blob", "path", F.inline(wanted)).join(_read(spark, f"{ledger}/pairs", PAIRS), ["blob", "rule", "version"], "left_anti")
    todo_path = scratch_path(spark, "todo")
    pairs.groupBy("blob", "path").agg(F.collect_set(F.struct("rule", "version")).alias("todo")).write.parquet(todo_path)
    todo = spark.read.parquet(todo_path)
    # One copy of a blob is read: the one at its smallest path. Spark broadcasts the list by itself while it is small, as
    # in later runs that bring few new blobs.
    text = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    copies = text.join(todo, text["path"].eqNullSafe(todo["path"])).filter(
        F.sha2("text", 256) == F.col("blob"))
    hits = copies.select("blob", *(F.when(F.array_contains("todo.rule", r.name), spans(F.col("text"), r)).alias(r.name) for r in rules))
    flat = F.flatten(F.array(*(_named(r) for r in rules)))
    hits.select("blob", F.inline(flat)).write.mode("append").parquet(f"{ledger}/findings")
    todo.select("blob", F.inline("todo")).write.mode("append").parquet(f"{ledger}/pairs")
    return paths


def findings_of(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, found: sorted array of (span_start, rank of the rule, rule, span_end) for the current rule versions."""
    wanted = spark.createDataFrame([(r.name, r.version, i) for i, r in enumerate(rules)], "rule string, version int, rank int")
    rows = _read(spark, f"{ledger}/findings", FINDINGS).join(F.broadcast(wanted), ["rule", "version"])
    return rows.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("span_start", "rank", "rule", "span_end"))).alias("found"))


def scan_versions(versions: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob, found for every version; ``found`` is empty for clean ones."""
    paths = scan_new(versions, ledger, path_col, text_col, rules)
    found = findings_of(versions.sparkSession, ledger, rules)
    empty = F.expr("cast(array() as array<struct<span_start: bigint, rank: int, rule: string, span_end: bigint>>)")
    return paths.join(found, "blob", "left").withColumn("found", F.coalesce("found", empty))
