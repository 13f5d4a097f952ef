"""Queries S01-S21. Files are first written by Spark from the driver tables, then read back."""

from pyspark.sql import functions as F

from cadenza.operators import tagging as T
from cadenza.plans import canonical as C
from cadenza.plans.q_separation import TYPES
from cadenza.plans.q_sequence import chord_sets
from cadenza.plans.q_stats import metric, runs
from cadenza.plans.q_tagging import REPORT, REPORT_COLS, rounded, test_scores, thresholds
from cadenza.plans.registry import query, sql, view
from cadenza.sources import audit as A
from cadenza.sources import manifest as M
from cadenza.sources import results as R
from cadenza.sources import uploads as U


def manifest_path(spark, d):
    """The catalogue as TSV, tags doubled by an empty one for every seventh track; a text file of short lines beside it."""
    def write(path):
        t = C.tracks(spark, d)
        gap = F.when(F.col("track_id").cast("long") % 7 == 0, F.concat(F.array(F.lit("")), "tags")).otherwise(F.col("tags"))
        M.write_manifest(t.withColumn("tags", gap), f"{path}/good")
        short = t.filter("cast(track_id as long) % 11 = 0").select(F.concat_ws("\t", "track_id", "artist_id", "path").alias(M.HEADER_LINE))
        short.write.options(header=True, sep="\u0001", quote="\u0000").csv(f"{path}/short")
        t.filter("cast(track_id as long) = 1").select(F.concat(F.lit("raw_"), "track_id", F.lit(".tsv"))).coalesce(1).write.text(f"{path}/pointer")
    return C.stored_files(spark, d, "manifest", write)


@query("S01", sql("""SELECT t.track_id, artist_id, album_id, path, duration, CAST(g.n AS INTEGER) AS n_tags, first_tag, last_tag, chunk FROM tracks t JOIN (
  SELECT track_id, count(*) AS n, min(tag) AS first_tag, max(tag) AS last_tag FROM labels_l GROUP BY 1) g ON g.track_id = t.track_id""", "tracks", "labels_l"))
def s01(spark, d):
    p = manifest_path(spark, d)
    m = M.read_manifest(spark, [f"{p}/good", f"{p}/short"])
    return m.select("track_id", "artist_id", "album_id", "path", "duration", F.size("tags").alias("n_tags"), F.col("tags")[0].alias("first_tag"),
                    F.element_at("tags", -1).alias("last_tag"), "chunk")


@query("S02", "SELECT 1 AS n_files, count(*) AS n_lines, min('raw_' || o_orderkey || '.tsv') AS sample, min('raw_' || o_orderkey || '.tsv') AS resolved FROM orders WHERE o_orderkey = 1")
def s02(spark, d):
    p = manifest_path(spark, d)
    bad = M.manifest_problems(M._lines(spark, [f"{p}/good", f"{p}/short", f"{p}/pointer"]))
    name = M.resolve_pointer(spark, f"{p}/pointer/*.txt")
    return bad.agg(F.count("*").cast("int").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.min("sample").alias("sample")).withColumn("resolved", F.lit(name))


view("files", """SELECT CASE WHEN track_id::BIGINT % 100 = 98 THEN 'x' || path WHEN track_id::BIGINT % 100 = 97 THEN 'cover.jpg' ELSE path END AS path
  FROM tracks WHERE NOT (track_id::BIGINT % 100 >= 40 AND track_id::BIGINT % 100 < 60) AND NOT (track_id::BIGINT % 100 < 5 AND track_id::BIGINT % 3 = 0)""", "tracks")


def files(spark, d):
    """A listing without chunks 40 to 59, with holes in chunks 0 to 4 and misnamed entries."""
    t = C.track_rows(spark, d).withColumn("k", F.col("track_id").cast("long"))
    t = t.filter("NOT (k % 100 >= 40 AND k % 100 < 60) AND NOT (k % 100 < 5 AND k % 3 = 0)")
    return t.select(F.when(F.col("k") % 100 == 98, F.concat(F.lit("x"), "path")).when(F.col("k") % 100 == 97, "cover.jpg").otherwise(F.col("path")).alias("path"))


view("chunks", "SELECT DISTINCT CAST(substr(path, 1, 2) AS INTEGER) AS chunk FROM files WHERE regexp_full_match(path, '[0-9][0-9]/.*')", "files")


@query("S03", sql("SELECT chunk FROM chunks", "chunks"))
def s03(spark, d):
    return M.available_chunks(files(spark, d))


@query("S04", sql("SELECT track_id, chunk FROM tracks WHERE chunk IN (SELECT chunk FROM chunks)", "tracks", "chunks"))
def s04(spark, d):
    return M.load_subset(C.track_rows(spark, d), M.available_chunks(files(spark, d))).select("track_id", "chunk")


@query("S05", sql("""t AS (SELECT * FROM tracks WHERE chunk IN (SELECT chunk FROM chunks)),
v AS (SELECT tag, count(*) AS n FROM labels_l JOIN t USING (track_id) WHERE split = 'train' GROUP BY tag HAVING count(*) >= 50)
SELECT t.split, l.tag, count(*) AS n FROM t JOIN labels_l l USING (track_id) WHERE l.tag IN (SELECT tag FROM v) GROUP BY ALL""", "tracks", "chunks", "labels_l"))
def s05(spark, d):
    rows, voc = M.load_split(C.tracks(spark, d), M.available_chunks(files(spark, d)), 50)
    long = rows.select("split", F.explode("tags").alias("tag"))
    return long.join(voc.select("tag"), "tag", "left_semi").groupBy("split", "tag").agg(F.count("*").alias("n"))


@query("S06", sql("""f AS (SELECT track_id, path, replace(path, '.mp3', '.npy') AS npy, 'model=base/layer=6/stride=5/seconds=30/segments=4/' AS cfg FROM tracks)
SELECT track_id, 'data/audio/' || path AS audio_path, 'data/audio-low/' || replace(path, '.mp3', '.low.mp3') AS audio_low_path,
  'data/features/kind=mel/n_mels=96/sr=16000/hop=256/seconds=30/' || npy AS mel_path, 'data/features/kind=frame/' || cfg || npy AS frame_path,
  'data/features/kind=layer/model=base/seconds=30/segments=4/' || npy AS layer_path, 'data/features/kind=frame/' || cfg || 'stem=vocals/' || npy AS vocals_path FROM f""", "tracks"))
def s06(spark, d):
    t = C.track_rows(spark, d).select("track_id", "path")
    mel = {"n_mels": 96, "sr": 16000, "hop": 256, "seconds": 30.0}
    probe = {"model": "base", "layer": 6, "stride": 5, "seconds": 30.0, "segments": 4}
    return M.with_paths(t, "data", mel, probe, ("vocals",)).drop("path")


STEM_SQL = "(['mixture','vocals','drums','bass','other'])[CAST(l_linenumber % 5 + 1 AS INTEGER)]"
view("stems", f"""SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS subset, 'Track ' || l_orderkey AS track, {STEM_SQL} AS stem,
  max(CASE WHEN l_quantity > 49 THEN 48000 ELSE 44100 END) AS sample_rate, min(CASE WHEN l_tax = 0 AND l_discount = 0 THEN 1 ELSE 2 END) AS channels FROM lineitem GROUP BY ALL""")


def stem_files(spark, d):
    """subset/track/stem.wav listings with header facts: an order is a recording, its lines are stems, few are complete."""
    stem = F.element_at(F.lit(["mixture", "vocals", "drums", "bass", "other"]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    path = F.concat_ws("/", F.when(F.col("l_orderkey") % 3 == 0, "test").otherwise("train"), F.concat(F.lit("Track "), "l_orderkey"), F.concat(stem, F.lit(".wav")))
    f = C.table(spark, d, "lineitem").groupBy(path.alias("path")).agg(
        F.max(F.when(F.col("l_quantity") > 49, 48000).otherwise(44100)).alias("sample_rate"),
        F.min(F.when((F.col("l_tax") == 0) & (F.col("l_discount") == 0), 1).otherwise(2)).alias("channels"))
    return A.track_files(f)


VALIDATION = ("Track 1", "Track 10", "Track 40", "Track 73")


@query("S07", sql(f"""x AS (SELECT subset, track FROM stems WHERE subset = 'train' AND stem = 'mixture')
SELECT 'validation' AS mode, * FROM x WHERE track IN {VALIDATION} UNION ALL SELECT 'train', * FROM x WHERE track NOT IN {VALIDATION}
UNION ALL SELECT 'all', subset, track FROM stems WHERE subset = 'test' AND stem = 'mixture'""", "stems"))
def s07(spark, d):
    f = stem_files(spark, d)
    one = lambda subset, mode: A.list_tracks(f, subset, mode, VALIDATION).select(F.lit(mode).alias("mode"), "subset", "track")
    return one("train", "validation").unionByName(one("train", "train")).unionByName(one("test", "all"))


@query("S08", sql("""c AS (SELECT subset, track FROM stems WHERE stem = 'mixture'), n AS (SELECT subset, count(*) AS n FROM c GROUP BY 1),
k AS (SELECT s.* FROM stems s JOIN c USING (subset, track))
SELECT e.subset, NULL AS track, NULL AS stem, 'expected ' || want || ' tracks, found ' || coalesce(n, 0) AS problem FROM (VALUES ('train', 100), ('test', 50)) e(subset, want) LEFT JOIN n USING (subset) WHERE coalesce(n, 0) <> want
UNION ALL SELECT c.subset, c.track, s.stem, 'missing file' FROM c, (VALUES ('mixture'), ('vocals'), ('drums'), ('bass'), ('other')) s(stem) WHERE NOT EXISTS (SELECT 1 FROM stems x WHERE x.subset = c.subset AND x.track = c.track AND x.stem = s.stem)
UNION ALL SELECT subset, track, stem, 'sample rate ' || sample_rate FROM k WHERE sample_rate <> 44100
UNION ALL SELECT subset, track, stem, 'channels ' || channels FROM k WHERE channels <> 2""", "stems"))
def s08(spark, d):
    return A.verify_dataset(stem_files(spark, d), {"train": 100, "test": 50})


@query("S09", sql(f"""SELECT track, {", ".join(f"round({t}, 5) AS {t}" for t in TYPES)} FROM (SELECT CAST(track_id AS VARCHAR) AS track, {", ".join(f"max(value) FILTER (stem = '{t}') AS {t}" for t in TYPES)}
  FROM track_metric WHERE model = 'base' GROUP BY 1)""", "track_metric"))
def s09(spark, d):
    def write(path):
        wide = metric(spark, d, "base").groupBy(F.col("track_id").cast("string").alias("track")).pivot("stem", list(TYPES)).agg(F.first("value"))
        wide.write.option("header", True).csv(path)
    m = R.read_metrics_csv(spark, C.stored_files(spark, d, "metrics-csv", write), ["click", "view"])
    return m.select("track", *[F.round(t, 5).alias(t) for t in TYPES])


def run_files(spark, d):
    """One run document per (config, seed); configuration 5-LOW has no test block for seed 0."""
    def write(path):
        r = runs(spark, d).groupBy("config", "seed").agg(F.map_from_entries(F.collect_list(F.struct("grp", F.struct(F.col("value").alias("map"), (F.col("value") / 2).alias("macro_f1_tuned"))))).alias("groups"),
                                                         F.max("value").alias("map"))
        name = F.concat_ws("_s", F.replace(F.col("config"), F.lit(" "), F.lit("-")), "seed").alias("run")
        tested = F.when(~((F.col("config") == "5-LOW") & (F.col("seed") == 0)), F.struct("map", (F.col("map") / 3).alias("macro_f1_tuned"), "groups"))
        r.select(name, F.lit("L2").alias("level"), F.lit(7).alias("best_epoch"), tested.alias("test")).repartition("run").write.partitionBy("run").json(path)
    return C.stored_files(spark, d, "runs", write)


@query("S10", sql("""g AS (SELECT replace(config, ' ', '-') AS config, seed, grp, value FROM runs WHERE NOT (config = '5-LOW' AND seed = 0)),
w AS (SELECT config, seed, max(value) AS v FROM g GROUP BY ALL)
SELECT config, seed, 'map' AS metric, grp, round(value, 4) AS value FROM g UNION ALL SELECT config, seed, 'macro_f1_tuned', grp, round(value / 2, 4) FROM g
UNION ALL SELECT config, seed, 'map', '', round(v, 4) FROM w UNION ALL SELECT config, seed, 'macro_f1_tuned', '', round(v / 3, 4) FROM w""", "runs"))
def s10(spark, d):
    flat = R.flatten_runs(R.read_runs(spark, run_files(spark, d))).filter("value IS NOT NULL")
    return flat.withColumn("value", F.round("value", 4))


@query("S11", sql("""SELECT CAST(track_id AS VARCHAR) AS source, row_number() OVER (PARTITION BY track_id ORDER BY start) - 1 AS pos, round(start, 3) AS start, round("end", 3) AS "end", label,
  (SELECT count(*) FROM beats b WHERE b.track_id = c.track_id) AS n_beats FROM chord_ref c""", "chord_ref", "beats"))
def s11(spark, d):
    def write(path):
        from cadenza.core.ordered import Ordered
        from cadenza.operators import sequence as Q

        ref, _ = chord_sets(spark, d)
        o = Ordered(ref, ["track_id"], ["start"]).add(_r=("row", None)).result()
        b = C.beats(spark, d)
        none = b.limit(0).select("track_id", "pos", F.col("t").alias("start"), F.col("t").alias("end"), "label", F.lit(0).alias("cluster"))
        head = b.groupBy("track_id").agg(F.max("t").alias("duration")).select("track_id", F.lit(96.0).alias("bpm"), F.lit("A minor").alias("key"), "duration")
        chords = o.select("track_id", (F.col("_r") - 1).alias("pos"), "start", "end", "label", F.lit(0.9).alias("confidence"))
        doc = Q.analysis_document(head, b, b.filter("pos % 4 = 0").withColumn("pos", F.floor(F.col("pos") / 4).cast("long")), chords, none)
        doc.withColumn("source", F.col("track_id").cast("string")).drop("track_id").write.json(path)
    docs = R.read_analysis(spark, C.stored_files(spark, d, "analysis-json", write))
    n = R.analysis_beats(docs).groupBy("source").agg(F.count("*").alias("n_beats"))
    spans = R.analysis_spans(docs).select("source", "pos", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "label")
    return spans.join(n, "source")


@query("S12", sql(f"""r AS (SELECT {REPORT_COLS} FROM report)
SELECT (SELECT count(*) FROM report) AS csv_rows, (SELECT count(*) FROM report) AS json_rows, map, macro_f1_tuned, (SELECT count(*) FROM thresholds) AS n_thresholds,
  (SELECT round(sum(threshold), 3) FROM thresholds) AS threshold_sum, 3 AS n_groups FROM r""", "report", "thresholds"))
def s12(spark, d):
    """Write per-tag results and one run document, then read both back."""
    th, sc = thresholds(spark, d), test_scores(spark, d)
    report = rounded(T.evaluate_tagging(sc, th), *REPORT)
    groups = rounded(T.evaluate_groups(sc, th), *REPORT).filter("category <> 'all'")

    def write(path):
        R.write_results(T.per_tag_ap(sc), f"{path}/per-tag")
        R.write_run(R.run_document(report, groups, th, level="L2"), path, "base_s0")

    p = C.stored_files(spark, d, "results", write)
    n = lambda df, c: df.agg(F.count("*").alias(c), F.lit(1).alias("_k"))
    run = R.read_runs(spark, f"{p}/base_s0").select(
        "test.map", "test.macro_f1_tuned", F.size("thresholds.per_tag").alias("n_thresholds"),
        F.round(F.aggregate(F.map_values("thresholds.per_tag"), F.lit(0.0), lambda a, x: a + x), 3).alias("threshold_sum"), F.size("test.groups").alias("n_groups"), F.lit(1).alias("_k"))
    csv = n(spark.read.option("header", True).csv(f"{p}/per-tag/csv"), "csv_rows")
    js = n(spark.read.schema("tag string, ap double").json(f"{p}/per-tag/json"), "json_rows")
    return csv.join(js, "_k").join(run, "_k").drop("_k")


@query("S13", sql("SELECT split, count(*) AS n, sum(y) AS positives, round(sum(score), 3) AS total FROM scores_b GROUP BY split", "scores_b"))
def s13(spark, d):
    p = C.stored_files(spark, d, "predictions", lambda path: R.write_predictions(C.scores(spark, d, "b"), path))
    return spark.read.parquet(p).groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.round(F.sum("score"), 3).alias("total"))


@query("S14", sql("SELECT track_id AS run, count(*) AS n, max(pos) + 1 AS last_epoch FROM beats GROUP BY 1", "beats"))
def s14(spark, d):
    h = C.beats(spark, d).select(F.col("track_id").alias("run"), (F.col("pos") + 1).alias("epoch"), F.col("strength").alias("val_map"))

    def write(path):
        R.append_history(h.filter("epoch <= 10"), path)
        R.append_history(h.filter("epoch > 10"), path)

    r = spark.read.schema("run long, epoch long, val_map double").json(C.stored_files(spark, d, "history", write))
    return r.groupBy("run").agg(F.count("*").alias("n"), F.max("epoch").alias("last_epoch"))


view("upserted", """SELECT id, ts, tag FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY new DESC, ts DESC) AS r FROM (
  SELECT user_id AS id, event_id AS ts, event_type AS tag, 0 AS new FROM events WHERE NOT (event_id % 2 = 1 AND user_id % 3 = 0)
  UNION ALL SELECT user_id, event_id, 'new-' || event_type, 1 FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0)) WHERE r = 1""")


@query("S15", sql("SELECT id, ts, tag FROM upserted", "upserted"))
def s15(spark, d):
    """Odd events of every third user arrive as new rows; all others are there before."""
    e = C.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ts"), F.col("event_type").alias("tag"))
    fresh = F.expr("ts % 2 = 1 AND id % 3 = 0")
    return R.upsert_manifest(e.filter(~fresh), e.filter(fresh).withColumn("tag", F.concat(F.lit("new-"), "tag")))


@query("S15_patch", sql("""p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS tag, s_nationkey AS nation FROM supplier)
SELECT u.id, u.ts, coalesce(p.tag, u.tag) AS tag, p.nation FROM upserted u LEFT JOIN p USING (id)""", "upserted"))
def s15_patch(spark, d):
    """One field overwritten where the patch has a value, one field added."""
    k = F.col("s_suppkey")
    patch = C.table(spark, d, "supplier").select(k.alias("id"), F.when(k % 4 != 0, F.col("s_name")).alias("tag"), F.col("s_nationkey").alias("nation"))
    return R.patch_manifest(s15(spark, d), patch)


@query("S16", sql("""o AS (SELECT DISTINCT l_orderkey::VARCHAR AS track_id, l_returnflag AS output FROM lineitem),
s AS (SELECT track_id, CASE WHEN (SELECT count(*) FROM o WHERE o.track_id = t.track_id) = 3 THEN 'cached' WHEN track_id::BIGINT % 13 = 0 THEN 'failed' ELSE 'ok' END AS status FROM tracks t)
SELECT count(*) FILTER (status = 'ok') AS n_new, count(*) FILTER (status = 'cached') AS n_cached, count(*) FILTER (status = 'failed') AS n_failed FROM s""", "tracks"))
def s16(spark, d):
    todo = C.track_rows(spark, d).select("track_id")
    done = C.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("track_id"), F.col("l_returnflag").alias("output"))
    open_ = A.pending(todo, done, ("A", "N", "R")).withColumn("open", F.lit(True))
    status = F.when(F.col("open").isNull(), "cached").when(F.col("track_id").cast("long") % 13 == 0, "failed").otherwise("ok")
    return A.tally(todo.join(open_, "track_id", "left").withColumn("status", status))


@query("S17", sql("""w AS (SELECT chunk, count(*) AS expected FROM tracks GROUP BY 1), h AS (SELECT TRY_CAST(split_part(path, '/', 1) AS INTEGER) AS chunk, count(*) AS have FROM files GROUP BY 1)
SELECT chunk, expected, coalesce(have, 0) AS have FROM w LEFT JOIN h USING (chunk) WHERE coalesce(have, 0) < expected * 0.98::DOUBLE""", "tracks", "files"))
def s17(spark, d):
    bad = C.track_rows(spark, d).limit(1).select(F.lit("no-chunk/x.mp3").alias("path"))
    return A.incomplete_chunks(C.track_rows(spark, d).select("path").unionByName(bad), files(spark, d))


view("members", """SELECT l_suppkey AS archive, l_orderkey || '-' || l_linenumber AS member, min(l_partkey * 512) AS "offset", min(CASE WHEN l_quantity = 1 THEN 0 ELSE l_quantity * 1000 END)::BIGINT AS size FROM lineitem GROUP BY ALL""")
view("archives", """SELECT s_suppkey AS archive, 512 * (1500 + s_suppkey * 7 % 500) + CASE WHEN s_suppkey % 31 = 0 THEN 1 ELSE 0 END AS bytes, sha256(CAST(s_suppkey % 50 AS VARCHAR)) AS sha256 FROM supplier""")


@query("S18", sql("""m AS (SELECT DISTINCT o_orderkey % (SELECT count(*) FROM supplier) AS archive, o_orderkey || '-1' AS member FROM orders),
r AS (SELECT archive, CASE WHEN archive % 17 = 0 THEN bytes - 512 ELSE bytes END AS b, CASE WHEN archive % 19 = 0 THEN 'old' ELSE sha256 END AS h FROM archives)
SELECT archive, NULL AS member, 'truncated archive' AS problem FROM archives WHERE bytes % 512 <> 0
UNION ALL SELECT archive, member, 'missing member' FROM m WHERE archive IN (SELECT archive FROM archives) AND (archive, member) NOT IN (SELECT archive, member FROM members)
UNION ALL SELECT archive, member, 'invalid extent' FROM members JOIN archives USING (archive) WHERE size <= 0 OR "offset" + size > bytes
UNION ALL SELECT archive, NULL, 'size changed' FROM archives JOIN r USING (archive) WHERE bytes <> b
UNION ALL SELECT archive, NULL, 'checksum changed' FROM archives JOIN r USING (archive) WHERE bytes = b AND sha256 <> h""", "members", "archives"))
def s18(spark, d):
    li = C.table(spark, d, "lineitem")
    member = F.concat_ws("-", "l_orderkey", "l_linenumber")
    members = li.groupBy(F.col("l_suppkey").alias("archive"), member.alias("member")).agg(
        F.min(F.col("l_partkey") * 512).alias("offset"), F.min(F.when(F.col("l_quantity") == 1, 0.0).otherwise(F.col("l_quantity") * 1000)).cast("long").alias("size"))
    s = C.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    archives = s.select(k.alias("archive"), (512 * (1500 + k * 7 % 500) + F.when(k % 31 == 0, 1).otherwise(0)).alias("bytes"), F.sha2((k % 50).cast("string"), 256).alias("sha256"))
    receipts = archives.select("archive", F.when(F.col("archive") % 17 == 0, F.col("bytes") - 512).otherwise(F.col("bytes")).alias("bytes"),
                               F.when(F.col("archive") % 19 == 0, "old").otherwise(F.col("sha256")).alias("sha256"))
    want = C.table(spark, d, "orders").select((F.col("o_orderkey") % s.count()).alias("archive"), F.concat("o_orderkey", F.lit("-1")).alias("member"))
    return A.audit_archives(archives, members.withColumn("member", F.concat(F.lit("./"), "member")), want, receipts)


@query("S19", "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1")
def s19(spark, d):
    return A.dedupe_content(C.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query("S20", sql("""h AS (SELECT sha256('{"artist_id":"' || artist_id || '","path":"' || path || '","split":"' || split || '","track_id":"' || track_id || '"}') AS h FROM tracks),
w AS (SELECT count(*) AS n, """ + ", ".join(f"CAST(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) % 4294967296 AS BIGINT) AS w{i}" for i in range(8)) + """ FROM h)
SELECT n, sha256('layer=6:' || n || ':' || """ + " || ':' || ".join(f"w{i}" for i in range(8)) + ") AS signature FROM w", "tracks"))
def s20(spark, d):
    return A.signature(C.track_rows(spark, d).select("track_id", "artist_id", "path", "split"), "layer=6")


view("uploads", """SELECT page_id, url AS path, CASE WHEN page_id % 29 = 0 THEN '' ELSE replace(replace(url, '?', '%3F'), '#', '/') END AS filename,
  CASE WHEN page_id % 37 = 0 THEN 0 WHEN page_id % 41 = 0 THEN 300000000 ELSE strlen(html) END AS bytes,
  CASE WHEN page_id % 7 = 0 THEN 'unknown' WHEN page_id % 7 = 1 THEN '' ELSE 'htdemucs_ft' END AS model, html FROM pages""")
ADMIT_SQL = """SELECT page_id, name, slug, slug || '-' || substr(sha256(stem), 1, 16) AS id, model, reason FROM (SELECT *, CASE WHEN cut = '' THEN 'untitled' ELSE cut END AS slug FROM (
  SELECT *, substr(regexp_replace(regexp_replace(stem, '[^\\p{L}\\p{N} .-]+', '_', 'g'), '^[ ._-]+|[ ._-]+$', '', 'g'), 1, 60) AS cut,
    CASE WHEN bytes <= 0 THEN 'empty' WHEN bytes > 209715200 THEN 'too large' WHEN model NOT IN ('htdemucs', 'htdemucs_ft', 'mdx_extra') THEN 'unsupported model' ELSE '' END AS reason FROM (
  SELECT *, CASE WHEN length(name) > 1 AND regexp_matches(name, '.\\.[^.]+$') THEN regexp_replace(name, '\\.[^.]+$', '') ELSE name END AS stem FROM (
  SELECT page_id, bytes, html, CASE WHEN model = '' THEN 'htdemucs' ELSE model END AS model, regexp_extract(replace(CASE WHEN filename = '' THEN 'upload.mp3' ELSE filename END, '%3F', '?'), '([^/]*)/*$', 1) AS name FROM uploads))))"""


def upload_rows(p):
    """Uploads from pages: the url is the file name, some rows are empty, too large or ask for another model."""
    k = F.col("page_id")
    return p.select("page_id", F.col("url").alias("path"),
                    F.when(k % 29 == 0, "").otherwise(F.replace(F.replace(F.col("url"), F.lit("?"), F.lit("%3F")), F.lit("#"), F.lit("/"))).alias("filename"),
                    F.when(k % 37 == 0, 0).when(k % 41 == 0, 300000000).otherwise(F.octet_length("html")).alias("bytes"),
                    F.when(k % 7 == 0, "unknown").when(k % 7 == 1, "").otherwise("htdemucs_ft").alias("model"), F.col("html").alias("content"))


@query("S21", sql(ADMIT_SQL, "uploads"))
def s21(spark, d):
    return U.admit_uploads(upload_rows(C.table(spark, d, "pages"))).select("page_id", "name", "slug", "id", "model", "reason")
