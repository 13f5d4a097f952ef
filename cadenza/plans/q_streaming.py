"""Queries W01-W03: the streams read the driver's files and run until they are consumed."""

from pyspark.sql import functions as F

from cadenza.core.session import scratch_path
from cadenza.plans import canonical as C
from cadenza.plans.q_sources import ADMIT_SQL, upload_rows
from cadenza.plans.registry import query, sql, view
from cadenza.streaming import jobs as J


def job_events(e):
    t = F.col("event_type")
    status = F.when(t == "click", "queued").when(t.isin("view", "signup"), "running").when(t == "purchase", "done").otherwise("error")
    return e.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", status.alias("status"), t.alias("stage"),
                    F.when(t == "signup", F.concat(F.lit("slow "), "event_id")).otherwise("").alias("warning"),
                    F.when(t == "error", F.concat(F.lit("failed "), "event_id")).otherwise("").alias("error"), F.col("value").alias("elapsed"))


view("jobs", """SELECT user_id AS job_id, arg_max(CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'error' END, (ts, event_id)) AS status,
  arg_max(event_type, (ts, event_id)) AS stage, coalesce('slow ' || max(event_id) FILTER (event_type = 'signup'), '') AS warning,
  CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'failed ' || arg_max(event_id, (ts, event_id)) ELSE '' END AS error, max(value) AS elapsed, min(ts) AS created FROM events GROUP BY 1""")


@query("W01", sql("SELECT job_id, status, stage, warning, error, elapsed FROM jobs", "jobs"))
def w01(spark, d):
    out = scratch_path(spark, "job-state")
    J.start_job_state(job_events(C.stream_table(spark, d, "events")), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return J.read_job_state(spark, f"{out}/table").select("job_id", "status", "stage", "warning", "error", "elapsed")


# Every page is uploaded, and later on once more under another name.
view("twice", """SELECT * FROM uploads UNION ALL SELECT page_id + 1000000000, path || '#again', CASE WHEN filename = '' THEN '' ELSE filename || '.again.mp3' END,
  bytes, model, html FROM uploads""", "uploads")


@query("W02", sql(f"""a AS ({ADMIT_SQL.replace("FROM uploads", "FROM twice")}), c AS (SELECT page_id, id, sha256(html) AS sha256 FROM a JOIN twice USING (page_id) WHERE reason = ''),
f AS (SELECT sha256, min(page_id) AS page_id, arg_min(id, page_id) AS id FROM c GROUP BY sha256)
SELECT id, max(page_id) AS page_id, arg_max(sha256, page_id) AS sha256 FROM f GROUP BY id""", "twice"))
def w02(spark, d):
    rows = upload_rows(C.stream_table(spark, d, "pages")).withColumn("again", F.explode(F.lit([False, True])))
    late = lambda c, mark: F.when(F.col("again") & (F.col(c) != ""), F.concat(c, F.lit(mark))).otherwise(F.col(c))
    rows = rows.withColumns({"page_id": F.col("page_id") + F.when(F.col("again"), 1_000_000_000).otherwise(0), "path": late("path", "#again"), "filename": late("filename", ".again.mp3")})
    rows = rows.drop("again").withColumn("ts", F.timestamp_seconds(F.col("page_id") + 1_700_000_000))
    out = scratch_path(spark, "uploads")
    J.start_uploads(rows, f"{out}/manifest", f"{out}/checkpoint").awaitTermination()
    return J.read_uploads(spark, f"{out}/manifest").select("id", "page_id", "sha256")


@query("W03", sql("SELECT job_id, status FROM jobs ORDER BY created DESC, job_id DESC LIMIT 10", "jobs"))
def w03(spark, d):
    return J.recent_jobs(J.job_state(job_events(C.table(spark, d, "events"))), 10).select("job_id", "status")
