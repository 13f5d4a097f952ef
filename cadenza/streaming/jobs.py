"""Job state and uploads, for tables and for streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.core.common import union_all
from cadenza.sources.audit import content_hash
from cadenza.sources.uploads import admit_uploads


# Batches after which their deltas are merged.
COMPACT = 16


def _numbers(spark, path: str, prefix: str) -> list[int]:
    """Numbers of the completely written folders ``path/prefix<number>``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and done(n))


def job_state(events: DataFrame) -> DataFrame:
    """Current state per job from ``events(job_id, ts, status, stage, warning, error, elapsed)``.

    The latest event decides status and stage. A warning is kept but never turns success into
    an error; error text is shown only for failed jobs. Works on tables and, in update or
    complete mode, on streams: the state holds one row per job.
    """
    latest = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    said = lambda c: F.max_by(c, F.when(F.col(c) != "", F.struct("ts", "event_id")))
    s = events.groupBy("job_id").agg(
        F.min("ts").alias("created"), F.max("ts").alias("updated"), latest("status").alias("status"), latest("stage").alias("stage"),
        F.coalesce(said("warning"), F.lit("")).alias("warning"), F.coalesce(said("error"), F.lit("")).alias("_error"), F.max("elapsed").alias("elapsed"))
    return s.withColumn("error", F.when(F.col("status") == "error", F.col("_error")).otherwise("")).drop("_error")


def recent_jobs(state: DataFrame, n: int = 10) -> DataFrame:
    return state.orderBy(F.desc("created"), F.desc("job_id")).limit(n)


def start_job_state(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write every change of job state; ``read_job_state`` folds the changes to the current table.

    Every COMPACT batches the changes so far become a base with one row per job, so a reader meets one base and
    fewer than COMPACT folders of changes. A repeated batch rewrites the same folders.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % COMPACT == COMPACT - 1:
            read_job_state(batch.sparkSession, path, number).write.mode("overwrite").parquet(f"{path}/base={number}")

    return job_state(events).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_job_state(spark, path: str, upto: int | None = None) -> DataFrame:
    """Current state of every job, or that after batch ``upto``: the newest base before it and the changes since."""
    inside = lambda n: upto is None or n <= upto
    base = max((b for b in _numbers(spark, path, "base=") if upto is None or b < upto), default=-1)
    parts = [spark.read.parquet(f"{path}/base={base}").withColumn("batch", F.lit(base))] if base >= 0 else []
    changes = [f"{path}/batch={b}" for b in _numbers(spark, path, "batch=") if b > base and inside(b)]
    if changes:
        parts.append(spark.read.option("basePath", path).parquet(*changes))
    if not parts:
        raise FileNotFoundError(f"no batch in {path}")
    rows = union_all(parts)
    cols = [c for c in rows.columns if c not in ("job_id", "batch")]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("job_id", "r.*")


def upload_stream(uploads: DataFrame) -> DataFrame:
    """Admitted rows of ``(path, filename, bytes, model, content, ts)``, a table or a stream, with the digest of their content."""
    return admit_uploads(uploads).withColumn("sha256", content_hash("content")).drop("content").filter("reason = ''")


def first_copies(uploads: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The earliest upload (ts, then path) of each content that ``known`` does not hold yet."""
    if known is not None:
        uploads = uploads.join(known.select("sha256"), "sha256", "left_anti")
    cols = [c for c in uploads.columns if c != "sha256"]
    return uploads.groupBy("sha256").agg(F.min_by(F.struct(*cols), F.struct("ts", "path")).alias("r")).select("sha256", "r.*")


def start_uploads(uploads: DataFrame, manifest: str, checkpoint: str, process=None, **trigger) -> StreamingQuery:
    """Hand each batch of new uploads to ``process`` (a DataFrame function) and add its rows to the manifest.

    A batch writes only its own rows. Which contents are new is told by an index of digests: every COMPACT batches their
    rows become a segment with a folder for each leading byte of the digest, and a batch reads only the folders its own
    digests fall into, and the batches since the last segment. A repeated batch rewrites the same folders.
    """
    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        buckets = [r["b"] for r in batch.select(_bucket().alias("b")).distinct().collect()]      # 256 at most
        rows = first_copies(batch, _deltas(spark, manifest, number, buckets))
        (process(rows) if process else rows).write.mode("overwrite").parquet(f"{manifest}/v={number}")
        batch.unpersist()
        if number % COMPACT == COMPACT - 1:
            since = max((s for s in _numbers(spark, manifest, "seg=") if s < number), default=-1)
            merged = _read_versions(spark, manifest, [v for v in list_versions(spark, manifest) if since < v <= number])
            merged.withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{manifest}/seg={number}")

    return upload_stream(uploads).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _bucket():
    # A letter in front, or Spark would take some of the folder names for numbers.
    return F.concat(F.lit("x"), F.substring("sha256", 1, 2))


def list_versions(spark, manifest: str) -> list[int]:
    return _numbers(spark, manifest, "v=")


def _read_versions(spark, manifest: str, versions: list[int]) -> DataFrame:
    paths = [f"{manifest}/v={v}" for v in versions]
    return spark.read.option("basePath", manifest).option("mergeSchema", True).parquet(*paths)


def _deltas(spark, manifest: str, before: int | None = None, buckets: list[str] | None = None) -> DataFrame | None:
    """Rows of all batches, or of those before one, with their batch number ``v``; ``buckets`` limits the segments that are read."""
    inside = lambda n: before is None or n < before
    segments = [n for n in _numbers(spark, manifest, "seg=") if inside(n)]
    later = [v for v in list_versions(spark, manifest) if v > max(segments, default=-1) and inside(v)]
    parts = []
    if segments:
        rows = spark.read.option("basePath", manifest).option("mergeSchema", True).parquet(*[f"{manifest}/seg={n}" for n in segments])
        parts.append((rows.filter(F.col("bucket").isin(buckets)) if buckets is not None else rows).drop("bucket", "seg"))
    if later:
        parts.append(_read_versions(spark, manifest, later))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts) if parts else None


def read_uploads(spark, manifest: str) -> DataFrame:
    """Manifest of uploads: the newest row per id, by batch, then ts, then path."""
    rows = _deltas(spark, manifest)
    if rows is None:
        raise FileNotFoundError(f"no batch in {manifest}")
    cols = [c for c in rows.columns if c not in ("id", "v")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("v", "ts", "path")).alias("r")).select("id", "r.*")
