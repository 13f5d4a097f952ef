from pyspark.sql import functions as F

from cadenza.streaming import jobs as J

EVENT = "job_id string, ts timestamp, event_id long, status string, stage string, warning string, error string, elapsed double"


def events(spark, rows):
    d = spark.createDataFrame(rows, "job_id string, s long, event_id long, status string, stage string, warning string, error string, elapsed double")
    return d.withColumn("ts", F.timestamp_seconds(F.col("s"))).select(*[c.split()[0] for c in EVENT.split(", ")])


ROWS = [("a", 1, 1, "queued", "q", "", "", 0.0), ("a", 2, 2, "running", "r", "analysis failed", "", 1.0), ("a", 3, 3, "done", "d", "", "", 2.0),
        ("b", 1, 4, "queued", "q", "", "", 0.0), ("b", 9, 5, "error", "e", "", "boom", 4.0), ("c", 4, 6, "queued", "q", "", "", 0.0)]


def test_warning_never_fails_a_job(spark):
    s = {r["job_id"]: r for r in J.job_state(events(spark, ROWS)).collect()}
    assert (s["a"]["status"], s["a"]["warning"], s["a"]["error"], s["a"]["elapsed"]) == ("done", "analysis failed", "", 2.0)
    assert (s["b"]["status"], s["b"]["error"]) == ("error", "boom") and s["c"]["status"] == "queued"
    assert [r["job_id"] for r in J.recent_jobs(J.job_state(events(spark, ROWS)), 2).collect()] == ["c", "b"]


def test_state_is_compacted_every_few_batches(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(J, "COMPACT", 2)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    cols = ["job_id", "status", "stage", "warning", "error", "elapsed"]
    for k in range(1, len(ROWS) + 1):
        events(spark, ROWS[k - 1:k]).coalesce(1).write.mode("append").parquet(src)
        J.start_job_state(spark.readStream.schema(EVENT).parquet(src), out, ck).awaitTermination()
        got = sorted(tuple(r) for r in J.read_job_state(spark, out).select(*cols).collect())
        assert got == sorted(tuple(r) for r in J.job_state(events(spark, ROWS[:k])).select(*cols).collect())
    assert [n for n in sorted(os.listdir(out)) if n.startswith("base=")] == ["base=1", "base=3", "base=5"]
    read = J.read_job_state(spark, out)
    assert all("batch=" not in f for f in read.inputFiles())                   # the base holds everything


def test_uploads_are_indexed_by_digest(spark, tmp_path, monkeypatch):
    """Over many batches: each content once, and a batch reads only the folders of its own digests."""
    import os

    monkeypatch.setattr(J, "COMPACT", 3)
    src, man, ck = (str(tmp_path / x) for x in ("in", "manifest", "ck"))
    schema = "path string, filename string, bytes long, model string, content binary, ts timestamp"
    contents = [f"c{i % 5}".encode() for i in range(14)]
    for i, c in enumerate(contents):
        d = spark.createDataFrame([(str(i), f"S{i}.mp3", 3, "", c, i)], "path string, filename string, bytes long, model string, content binary, s long")
        d.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(src)
        J.start_uploads(spark.readStream.schema(schema).parquet(src), man, ck).awaitTermination()
    assert sorted(r["path"] for r in J.read_uploads(spark, man).collect()) == ["0", "1", "2", "3", "4"]
    assert sorted(n for n in os.listdir(man) if n.startswith("seg=")) == ["seg=11", "seg=2", "seg=5", "seg=8"]
    one = J._deltas(spark, man, 12, ["x" + J.first_copies(J.upload_stream(spark.read.schema(schema).parquet(src))).first()["sha256"][:2]])
    assert one.count() == 1


def test_state_stream_over_two_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    stream = lambda: spark.readStream.schema(EVENT).parquet(src)
    for part in (ROWS[:4], ROWS[4:]):
        events(spark, part).coalesce(1).write.mode("append").parquet(src)
        J.start_job_state(stream(), out, ck).awaitTermination()
    got = sorted(tuple(r) for r in J.read_job_state(spark, out).select("job_id", "status", "stage", "warning", "error", "elapsed").collect())
    want = sorted(tuple(r) for r in J.job_state(events(spark, ROWS)).select("job_id", "status", "stage", "warning", "error", "elapsed").collect())
    assert got == want


def test_upload_stream_drops_copies_and_upserts(spark, tmp_path):
    src, man, ck = (str(tmp_path / x) for x in ("in", "manifest", "ck"))
    schema = "path string, filename string, bytes long, model string, content binary, ts timestamp"

    def put(rows):
        d = spark.createDataFrame(rows, "path string, filename string, bytes long, model string, content binary, s long")
        d.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(src)
        J.start_uploads(spark.readStream.schema(schema).parquet(src), man, ck, process=lambda b: b.withColumn("bpm", F.lit(96.0))).awaitTermination()

    put([("1", "Song.mp3", 3, "", b"abc", 100), ("2", "Copy.mp3", 3, "", b"abc", 101), ("3", "Bad.mp3", 3, "nope", b"zzz", 102)])
    first = J.read_uploads(spark, man)
    assert [(r["path"], r["bpm"]) for r in first.collect()] == [("1", 96.0)]
    put([("4", "Other.mp3", 3, "", b"new", 110), ("5", "Song.mp3", 4, "", b"abcd", 111), ("6", "Late.mp3", 3, "", b"abc", 112)])
    rows = [(r["slug"], r["path"]) for r in J.read_uploads(spark, man).orderBy("slug").collect()]
    assert rows == [("Other", "4"), ("Song", "5")]
    # A content whose row was replaced is still known.
    put([("7", "Again.mp3", 3, "", b"abc", 120)])
    assert J.read_uploads(spark, man).count() == 2
