import pytest
from pyspark.sql import functions as F

from cadenza.sources import audit as A
from cadenza.sources import manifest as M
from cadenza.sources import results as R
from cadenza.sources import uploads as U

LINES = [M.HEADER_LINE, "t1\ta1\tb1\t00/1.mp3\t120\tgenre---rock\tinstrument---guitar", "t2\ta1\tb1\t01/2.mp3\t120\tgenre---rock\t\tmood---calm",
         "t3\ta2\tb2\t02/3.mp3\t120\tgenre---pop", "short\tline"]


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_ragged_manifest(spark, tmp_path):
    m = M.read_manifest(spark, put(tmp_path / "m.tsv", "\n".join(LINES) + "\n"))
    got = {r["track_id"]: (r["tags"], r["chunk"], r["duration"]) for r in m.collect()}
    assert got == {"t1": (["genre---rock", "instrument---guitar"], 0, 120.0), "t2": (["genre---rock", "mood---calm"], 1, 120.0), "t3": (["genre---pop"], 2, 120.0)}
    M.write_manifest(m, str(tmp_path / "copy"))
    again = M.read_manifest(spark, str(tmp_path / "copy"))
    assert sorted(again.collect()) == sorted(m.collect())


def test_pointer_is_rejected_and_resolved(spark, tmp_path):
    p = put(tmp_path / "autotagging.tsv", "raw_30s.tsv\n")
    with pytest.raises(ValueError, match="pointer"):
        M.read_manifest(spark, p)
    assert M.resolve_pointer(spark, p) == "raw_30s.tsv"
    assert M.resolve_pointer(spark, put(tmp_path / "real.tsv", "\n".join(LINES * 5))) is None


def test_chunks_and_splits(spark, tmp_path):
    for f in ("audio/00/1.mp3", "audio/01/2.mp3", "audio/zz/3.mp3", "audio/123/4.mp3", "audio/readme.txt"):
        put(tmp_path / f, "x")
    (tmp_path / "audio/02").mkdir()
    files = M.list_files(spark, str(tmp_path / "audio"))
    assert {r["path"] for r in files.collect()} >= {"00/1.mp3", "01/2.mp3"}
    chunks = M.available_chunks(files)
    assert {r["chunk"] for r in chunks.collect()} == {0, 1}
    m = M.read_manifest(spark, put(tmp_path / "m.tsv", "\n".join(LINES)))
    t, voc = M.load_split({"train": m.filter("track_id <> 't2'"), "validation": m.filter("track_id = 't2'"), "test": m.limit(0)}, chunks, 1)
    assert {(r["track_id"], r["split"]) for r in t.collect()} == {("t1", "train"), ("t2", "validation")}
    assert [(r["tag"], r["idx"]) for r in voc.orderBy("idx").collect()] == [("genre---rock", 0), ("instrument---guitar", 1)]
    with pytest.raises(FileNotFoundError):
        M.load_subset(m, chunks.limit(0))
    with pytest.raises(ValueError):
        M.load_split({"train": m})


def test_paths_change_with_parameters():
    base = {"model": "m", "layer": 6, "stride": 5, "seconds": 30.0}
    assert M.partition_path("frame", base) == "kind=frame/model=m/layer=6/stride=5/seconds=30"
    paths = {M.partition_path("frame", {**base, **x}) for x in ({}, {"segments": 4}, {"layer": 7}, {"seconds": 7.5}, {"model": "org/m"})}
    assert len(paths) == 5 and all(p.count("/") <= 6 for p in paths)


def stems(spark, rows):
    return spark.createDataFrame(rows, "path string, sample_rate int, channels int")


def test_dataset_verification(spark):
    full = [(f"train/Leaf - Summerghost/{s}.wav", 44100, 2) for s in ("mixture", *A.STEMS)]
    f = A.track_files(stems(spark, full + [("train/X/mixture.wav", 48000, 2), ("train/X/vocals.wav", 44100, 1), ("train/no-mix/bass.wav", 1, 1), ("loose.wav", 1, 1)]))
    p = {(r["track"], r["stem"], r["problem"]) for r in A.verify_dataset(f, {"train": 3, "test": 0}).collect()}
    assert p == {(None, None, "expected 3 tracks, found 2"), ("X", "drums", "missing file"), ("X", "bass", "missing file"), ("X", "other", "missing file"),
                 ("X", "mixture", "sample rate 48000"), ("X", "vocals", "channels 1")}
    names = lambda mode: {r["track"] for r in A.list_tracks(f, "train", mode).collect()}
    assert names("validation") == {"Leaf - Summerghost"} and names("train") == {"X"} and len(names("all")) == 2


def test_pending_needs_every_output(spark):
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "track_id string")
    done = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "track_id string, output string")
    assert {r[0] for r in A.pending(todo, done, ("x", "y")).collect()} == {"b", "c"}


def test_chunk_tolerance(spark):
    man = spark.createDataFrame([(f"00/{i}.mp3",) for i in range(100)] + [(f"01/{i}.mp3",) for i in range(100)] + [("02/1.mp3",), ("bad",)], "path string")
    files = spark.createDataFrame([(f"00/{i}.mp3",) for i in range(98)] + [(f"01/{i}.mp3",) for i in range(97)], "path string")
    assert {(r["chunk"], r["expected"], r["have"]) for r in A.incomplete_chunks(man, files).collect()} == {(1, 100, 97), (2, 1, 0)}


def test_archive_audit(spark):
    arch = spark.createDataFrame([("a", 1024, "h"), ("b", 1000, "h"), ("c", 512, "new")], "archive string, bytes long, sha256 string")
    mem = spark.createDataFrame([("a", "./1.mp3", 0, 10), ("a", "2.mp3", 1020, 10), ("a", "3.mp3", 0, 0)], "archive string, member string, offset long, size long")
    man = spark.createDataFrame([("a", "1.mp3"), ("a", "9.mp3"), ("zzz", "1.mp3")], "archive string, member string")
    rec = spark.createDataFrame([("a", 2048, "h"), ("c", 512, "old")], "archive string, bytes long, sha256 string")
    got = {(r["archive"], r["member"], r["problem"]) for r in A.audit_archives(arch, mem, man, rec).collect()}
    assert got == {("b", None, "truncated archive"), ("a", "9.mp3", "missing member"), ("a", "2.mp3", "invalid extent"), ("a", "3.mp3", "invalid extent"),
                   ("a", None, "size changed"), ("c", None, "checksum changed")}


def test_signature_ignores_order_only(spark):
    d = spark.range(100).withColumn("v", F.col("id") * 2)
    s = A.signature(d, "cfg").first()["signature"]
    assert A.signature(d.orderBy(F.desc("id")).repartition(7), "cfg").first()["signature"] == s
    assert A.signature(d, "other").first()["signature"] != s
    assert A.signature(d.union(d.limit(1)), "cfg").first()["signature"] != s
    A.assert_same_signature(s, d, "cfg")
    with pytest.raises(ValueError):
        A.assert_same_signature(s, d.filter("id > 0"), "cfg")


def test_upsert_and_patch(spark):
    cols = "id string, ts long, bpm double"
    old, new = spark.createDataFrame([("a", 5, 1.0), ("b", 2, 2.0)], cols), spark.createDataFrame([("a", 1, 9.0), ("c", 3, 3.0)], cols)
    m = R.upsert_manifest(old, new)
    assert [(r["id"], r["bpm"]) for r in R.newest_first(m).collect()] == [("c", 3.0), ("b", 2.0), ("a", 9.0)]
    p = R.patch_manifest(m, spark.createDataFrame([("a", 7.0, "x"), ("zz", 0.0, "y")], "id string, bpm double, key string"))
    assert {r["id"]: (r["bpm"], r["key"]) for r in p.collect()} == {"a": (7.0, "x"), "b": (2.0, None), "c": (3.0, None)}


def test_metric_csv_needs_its_columns(spark, tmp_path):
    p = put(tmp_path / "m.csv", "track,cSDR_vocals\nA,8.5\nB,\n")
    assert [r["cSDR_vocals"] for r in R.read_metrics_csv(spark, p, ["cSDR_vocals"]).orderBy("track").collect()] == [8.5, None]
    with pytest.raises(ValueError):
        R.read_metrics_csv(spark, p, ["cSDR_drums"])


def test_runs_are_named_by_config_and_seed(spark, tmp_path):
    put(tmp_path / "runs/L2_mean_s3.json", '{\n "level": "L2",\n "test": {"map": 0.5, "groups": {"genre": {"map": 0.25}}}\n}')
    put(tmp_path / "runs/L2_mean_s4.json", '{"level": "L2"}')
    put(tmp_path / "runs/notes.json", '{"test": {"map": 1}}')
    r = R.read_runs(spark, str(tmp_path / "runs"))
    flat = {(x["config"], x["seed"], x["metric"], x["grp"]): x["value"] for x in R.flatten_runs(r).filter("value IS NOT NULL").collect()}
    assert flat == {("L2_mean", 3, "map", ""): .5, ("L2_mean", 3, "map", "genre"): .25}


def test_analysis_documents(spark, tmp_path):
    p = put(tmp_path / "a.json", '{"source": "s", "bpm": 96.0, "beats": [0.0, 0.625], "chords": [{"start": 0, "end": 2.5, "label": "Am", "confidence": 0.9}], "segments": []}')
    d = R.read_analysis(spark, p)
    assert [(r["pos"], r["t"]) for r in R.analysis_beats(d).orderBy("pos").collect()] == [(0, 0.0), (1, 0.625)]
    assert R.analysis_spans(d).first()["label"] == "Am" and R.analysis_spans(d, "segments").count() == 0


def test_upload_admission(spark):
    rows = [("../../x/My%20Song.v2.mp3", 10, "htdemucs"), ("a.mp3", 0, None), ("b.mp3", U.MAX_UPLOAD_BYTES + 1, ""), ("c.mp3", 5, "evil"),
            (None, 5, None), ("  .. ", 5, None), ("e" * 80 + ".wav", 5, None), (".hidden", 5, None), ('q:"1".mp3', 5, None)]
    got = U.admit_uploads(spark.createDataFrame(rows, "filename string, bytes long, model string")).collect()
    assert [r["reason"] for r in got] == ["", "empty", "too large", "unsupported model", "", "", "", "", ""]
    assert [r["slug"] for r in got][:1] + [r["slug"] for r in got][4:] == ["My Song.v2", "upload", "untitled", "e" * 60, "hidden", "q_1"]
    assert len({r["id"] for r in got if r["reason"] == ""}) == 6
    assert got[0]["name"] == "My Song.v2.mp3" and got[4]["model"] == "htdemucs"


def test_long_names_keep_separate_keys(spark):
    rows = [("e" * 70 + x + ".mp3", 5, None) for x in ("1", "2")] + [("a:b.mp3", 5, None), ("a?b.mp3", 5, None)]
    got = U.admit_uploads(spark.createDataFrame(rows, "filename string, bytes long, model string")).collect()
    assert len({r["slug"] for r in got}) == 2 and len({r["id"] for r in got}) == 4


def test_beats_of_split_documents_keep_their_positions(spark):
    from cadenza.core.common import PART
    from cadenza.operators import sequence as Q

    n = 2 * PART + 1
    b = spark.range(n).select(F.lit(1).alias("track_id"), F.col("id").alias("pos"), (F.col("id") * 0.5).alias("t"))
    span = b.limit(0).select("track_id", "pos", F.col("t").alias("start"), F.col("t").alias("end"), F.lit("A").alias("label"), F.lit(0.5).alias("confidence"), F.lit(0).alias("cluster"))
    head = spark.createDataFrame([(1, 96.0, "C major", 10.0)], "track_id int, bpm double, key string, duration double")
    doc = Q.analysis_document(head, b, b.limit(0), span, span).withColumn("source", F.col("track_id").cast("string"))
    got = R.analysis_beats(doc)
    assert doc.count() == 3 and got.select("pos").distinct().count() == n and got.filter("t <> round(pos * 0.5, 4)").count() == 0


def test_content_copies(spark):
    d = A.dedupe_content(spark.createDataFrame([("p2", b"x"), ("p1", b"x"), ("p3", b"y")], "path string, content binary"))
    assert {(r["path"], r["n_copies"]) for r in d.collect()} == {("p1", 2), ("p3", 1)}
