"""Result scans and sinks: metric CSV, run JSON, analysis documents, predictions, history, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.core.common import PART, require_columns

SCORES = ["roc_auc", "map", "macro_f1_default", "macro_f1_tuned", "micro_f1_default", "micro_f1_tuned"]
_scores = [T.StructField(c, T.DoubleType()) for c in SCORES] + [T.StructField(c, T.LongType()) for c in ("n_tags", "n_valid_tags")]
GROUP_SCORES = T.StructType(_scores)
TEST_SCORES = T.StructType([*_scores, T.StructField("groups", T.MapType(T.StringType(), GROUP_SCORES))])
RUN = T.StructType([
    T.StructField("level", T.StringType()), T.StructField("config", T.MapType(T.StringType(), T.StringType())), T.StructField("n_params", T.LongType()),
    T.StructField("best_epoch", T.IntegerType()), T.StructField("train_seconds", T.DoubleType()),
    T.StructField("history", T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))),
    T.StructField("val", TEST_SCORES), T.StructField("test", TEST_SCORES),
    T.StructField("thresholds", T.StructType([T.StructField("median", T.DoubleType()), T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()),
                                              T.StructField("per_tag", T.MapType(T.StringType(), T.DoubleType()))]))])
_span = [T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("label", T.StringType())]
ANALYSIS = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("ground_truth", T.BooleanType()),
    T.StructField("duration", T.DoubleType()), T.StructField("bpm", T.DoubleType()), T.StructField("time_signature", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("beats", T.ArrayType(T.DoubleType())), T.StructField("downbeats", T.ArrayType(T.DoubleType())), T.StructField("tempo_candidates", T.ArrayType(T.DoubleType())),
    T.StructField("chords", T.ArrayType(T.StructType([*_span, T.StructField("confidence", T.DoubleType())]))),
    T.StructField("segments", T.ArrayType(T.StructType([*_span, T.StructField("cluster", T.IntegerType())])))])


def read_metrics_csv(spark: SparkSession, path, required: list[str], key: str = "track") -> DataFrame:
    """Per-track metrics; all columns but the key become double. Fails when a required column is missing."""
    df = require_columns(spark.read.option("header", True).csv(path), [key, *required])
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in df.columns if c != key])


def read_runs(spark: SparkSession, path) -> DataFrame:
    """Run documents named ``<config>_s<seed>``, the name being the file's or its directory's; runs without test scores are dropped."""
    where = F.col("_metadata.file_path")
    name = r"([^/=]+)_s(\d+)(?:\.json|/[^/]+)$"
    d = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(RUN).json(path)
    d = d.select("*", F.regexp_extract(where, name, 1).alias("run_config"), F.regexp_extract(where, name, 2).alias("_s"))
    return d.filter((F.col("_s") != "") & F.col("test").isNotNull()).withColumn("seed", F.col("_s").cast("int")).drop("_s")


def flatten_runs(runs: DataFrame) -> DataFrame:
    """Long rows (config, seed, metric, grp, value): overall scores have grp '', groups carry mAP and tuned macro F1."""
    pair = lambda s, names: F.array(*[F.struct(F.lit(n).alias("metric"), s[n].alias("value")) for n in names])
    head = [F.col("run_config").alias("config"), "seed"]
    whole = runs.select(*head, F.lit("").alias("grp"), F.explode(pair(F.col("test"), SCORES)).alias("m"))
    groups = runs.select(*head, F.explode("test.groups").alias("grp", "g")).select("config", "seed", "grp", F.explode(pair(F.col("g"), ["map", "macro_f1_tuned"])).alias("m"))
    return whole.unionByName(groups).select("config", "seed", "m.metric", "grp", "m.value")


def read_analysis(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(ANALYSIS).json(path)


def _elements(docs: DataFrame, field: str, name: str) -> DataFrame:
    """One row per array element; ``pos`` continues over the parts of a split document."""
    rows = docs.select("source", "part", F.posexplode(field).alias("_i", name))
    return rows.withColumn("pos", F.coalesce("part", F.lit(0)).cast("long") * PART + F.col("_i")).drop("_i")


def analysis_beats(docs: DataFrame, field: str = "beats") -> DataFrame:
    return _elements(docs, field, "t").select("source", "part", "pos", "t")


def analysis_spans(docs: DataFrame, field: str = "chords") -> DataFrame:
    return _elements(docs, field, "x").select("source", "part", "pos", "x.*")


# ---------------------------------------------------------------- sinks

def write_results(df: DataFrame, path: str) -> None:
    """The same rows as CSV for people and JSON lines for programs."""
    df.write.option("header", True).csv(f"{path}/csv")
    df.write.json(f"{path}/json")


def run_document(report: DataFrame, groups: DataFrame, thresholds: DataFrame, **meta: str) -> DataFrame:
    """One run document: report row, groups and per-tag thresholds as maps (both bounded by the vocabulary)."""
    g = groups.agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct(*[c for c in groups.columns if c != "category"]).alias("s")))).alias("groups"))
    t = thresholds.agg(F.struct(F.median("threshold").alias("median"), F.min("threshold").alias("min"), F.max("threshold").alias("max"),
                                F.map_from_entries(F.collect_list(F.struct("tag", F.round("threshold", 3).alias("th")))).alias("per_tag")).alias("thresholds"))
    k = lambda d: d.withColumn("_k", F.lit(1))
    one = k(report).join(k(g), "_k").join(k(t), "_k")
    test = F.struct(*report.columns, "groups").alias("test")
    return one.select(*[F.lit(v).alias(n) for n, v in meta.items()], test, "thresholds")


def write_run(document: DataFrame, path: str, name: str) -> None:
    document.coalesce(1).write.json(f"{path}/{name}")


def write_predictions(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").partitionBy("split").parquet(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert_manifest(old: DataFrame, new: DataFrame, key: str = "id", ts: str = "ts") -> DataFrame:
    """The newest row per key; a new row beats an old one. Aggregated map-side, so repeated keys are harmless."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (key, "_new")]
    best = both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("_new", ts)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def newest_first(manifest: DataFrame, key: str = "id", ts: str = "ts") -> DataFrame:
    return manifest.orderBy(F.desc(ts), key)


def patch_manifest(manifest: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Overwrite fields of existing rows; patches for unknown keys are ignored."""
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in patch.columns if c != key])
    out = [F.coalesce(f"_p_{c}", c).alias(c) if f"_p_{c}" in p.columns else F.col(c) for c in manifest.columns]
    fresh = [F.col(c).alias(c[3:]) for c in p.columns if c.startswith("_p_") and c[3:] not in manifest.columns]
    return manifest.join(p, key, "left").select(*out, *fresh)
