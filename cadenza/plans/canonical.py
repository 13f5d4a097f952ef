"""The engine's input tables derived from the driver tables, in Spark and as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.core.ordered import Ordered
from cadenza.core.session import scratch_path
from cadenza.functions.music import PITCHES
from cadenza.operators import labels as L
from cadenza.plans.registry import view

MIN_POSITIVES = 20


def stream_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The same table as a file stream. The pattern form accepts a single file as well as a folder."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")


_STORED: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stored_files(spark: SparkSession, d: str, name: str, write) -> str:
    """Path of files written once per application by ``write(path)``."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def stored(name: str, partition: str | None = None):
    """Write a derived input table once per application; later queries scan it like any table."""

    def wrap(build):
        def read(spark: SparkSession, d: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, d, name)
            if key not in _STORED:
                path = scratch_path(spark, name)
                writer = build(spark, d).write
                (writer.partitionBy(partition) if partition else writer).parquet(path)
                _STORED[key] = path
            return spark.read.parquet(_STORED[key])

        return read

    return wrap


# ---------------------------------------------------------------- catalogue

def label_rows(spark, d) -> DataFrame:
    """labels(track_id, tag): distinct positives. track = order, tags from its parts."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    per_line = li.join(part, li.l_partkey == part.p_partkey).select(
        "l_orderkey", F.explode(F.array(F.concat(F.lit("type---"), "p_type"),
                                        F.concat(F.lit("brand---"), "p_brand"))).alias("tag")).distinct()
    prio = orders.join(li, orders.o_orderkey == li.l_orderkey, "left_semi").select(
        F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("priority---"), "o_orderpriority").alias("tag"))
    return per_line.unionByName(prio).select(F.col("l_orderkey").cast("string").alias("track_id"), "tag")


def _track_columns() -> list:
    k, s = F.col("o_orderkey"), F.col("o_custkey") % 10
    return [k.cast("string").alias("track_id"), F.col("o_custkey").cast("string").alias("artist_id"),
            (k % 500).cast("string").alias("album_id"),
            F.concat(F.lpad((k % 100).cast("string"), 2, "0"), F.lit("/"), k.cast("string"), F.lit(".mp3")).alias("path"),
            (F.lit(60.0) + k % 240).alias("duration"),
            F.when(s < 6, "train").when(s < 8, "validation").otherwise("test").alias("split"),
            (k % 100).cast("int").alias("chunk")]


def track_rows(spark, d) -> DataFrame:
    """tracks without tags: one row per order that has lines."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(*_track_columns())


@stored("tracks")
def tracks(spark, d) -> DataFrame:
    """track_rows with their sorted tags, those of label_rows: the lines of an order meet once and already bring their tags."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    # A track's tag list is bounded by the vocabulary because the values are distinct.
    own = li.join(part, li.l_partkey == part.p_partkey, "left").groupBy("l_orderkey").agg(F.collect_set("p_type").alias("_types"), F.collect_set("p_brand").alias("_brands"))
    prio = F.array_compact(F.array(F.concat(F.lit("priority---"), "o_orderpriority")))
    named = lambda prefix, c: F.transform(c, lambda x: F.concat(F.lit(prefix), x))
    o = table(spark, d, "orders").join(own, F.col("o_orderkey") == F.col("l_orderkey"))
    tags = F.sort_array(F.concat(named("type---", "_types"), named("brand---", "_brands"), prio))
    return o.select(*_track_columns(), tags.alias("tags"))


@stored("vocab")
def vocab(spark, d) -> DataFrame:
    return L.vocab(tracks(spark, d).filter("split = 'train'"), MIN_POSITIVES)


MODELS = {"a": (7919, 104729, 200), "b": (104729, 7919, 150)}


def scores(spark, d, model: str = "a", split: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """scores(split, track_id, tag, category, y, score): arithmetic score blended with y.

    Tracks times tags are expanded where they are read and never stored. The number of a track in ``ids(track_id, ord)`` is joined before that.
    """
    a, b, w = MODELS[model]
    t = tracks(spark, d)
    t = t.filter(F.col("split") == split) if split else t
    own = ["ord"] if ids is not None else []
    dense = L.encode(t.join(ids, "track_id") if own else t, vocab(spark, d), keep=["split", *own])
    t, j = F.col("track_id").cast("long"), F.col("idx").cast("long")
    s = ((t * a + j * b) % 1000 + F.col("y") * w) / F.lit(1000.0 + w)
    return dense.select("split", "track_id", "tag", "category", "y", s.alias("score"), *own)


def doc_scores(spark, d) -> DataFrame:
    """scores over labels x documents: tags quality and toxic, score from the text length."""
    lab, doc = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select(
        F.col("doc_id").alias("id"), (F.col("n_chars") % 997 / F.lit(997.0)).alias("s"),
        F.explode(F.array(F.struct(F.lit("content---quality").alias("tag"), F.col("quality").alias("y")),
                          F.struct(F.lit("content---toxic").alias("tag"), F.col("toxic").alias("y")))).alias("t")
    ).select("id", "t.tag", "t.y", ((F.col("s") + F.col("t.y") * 0.25) / 1.25).alias("score"))


view("labels_l", """SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS track_id, tag FROM (
  SELECT l_orderkey, 'type---' || p_type AS tag FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT l_orderkey, 'brand---' || p_brand FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT l_orderkey, 'priority---' || o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
view("tracks", """SELECT CAST(o_orderkey AS VARCHAR) AS track_id, CAST(o_custkey AS VARCHAR) AS artist_id,
  CAST(o_orderkey % 500 AS VARCHAR) AS album_id,
  lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '/' || CAST(o_orderkey AS VARCHAR) || '.mp3' AS path,
  60.0::DOUBLE + o_orderkey % 240 AS duration,
  CASE WHEN o_custkey % 10 < 6 THEN 'train' WHEN o_custkey % 10 < 8 THEN 'validation' ELSE 'test' END AS split,
  CAST(o_orderkey % 100 AS INTEGER) AS chunk
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
view("vocab", f"""SELECT tag, CAST(row_number() OVER (ORDER BY tag) - 1 AS INTEGER) AS idx, split_part(tag, '---', 1) AS category,
  n AS n_train FROM (SELECT tag, count(*) AS n FROM labels_l JOIN tracks USING (track_id) WHERE split = 'train'
  GROUP BY tag HAVING count(*) >= {MIN_POSITIVES})""", "labels_l", "tracks")
view("dense", """SELECT t.split, t.track_id, v.tag, v.idx, v.category, CASE WHEN l.tag IS NULL THEN 0 ELSE 1 END AS y
  FROM tracks t CROSS JOIN vocab v LEFT JOIN labels_l l ON l.track_id = t.track_id AND l.tag = v.tag""",
     "tracks", "vocab", "labels_l")
view("scores_a", """SELECT split, track_id, tag, category, y,
  ((CAST(track_id AS BIGINT) * 7919 + idx * 104729) % 1000 + y * 200) / 1200.0::DOUBLE AS score FROM dense""", "dense")
view("scores_b", """SELECT split, track_id, tag, category, y,
  ((CAST(track_id AS BIGINT) * 104729 + idx * 7919) % 1000 + y * 150) / 1150.0::DOUBLE AS score FROM dense""", "dense")
view("doc_scores", """SELECT doc_id AS id, tag, y, (s + y * 0.25::DOUBLE) / 1.25::DOUBLE AS score FROM (
  SELECT doc_id, 'content---quality' AS tag, quality AS y, (n_chars % 997) / 997.0::DOUBLE AS s FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, 'content---toxic', toxic, (n_chars % 997) / 997.0::DOUBLE FROM labels JOIN documents USING (doc_id))""")


# ---------------------------------------------------------------- embeddings

TAG_COUNT = 4


def embeddings(spark, d) -> DataFrame:
    """embeddings(id, vec, tags): tags from label and vec_id residues."""
    e = table(spark, d, "embeddings")
    v = F.col("vec_id")
    tag = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return e.select(v.alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
                    F.array(tag("label---", F.col("label")), tag("m3---", v % 3), tag("m5---", v % 5),
                            tag("m7---", v % 7)).alias("tags"), "label")


TRACK_FRAMES = 10


def frames(spark, d) -> DataFrame:
    """frames(track_id, frame, vec): ten consecutive vectors form a track; the last one may have fewer."""
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 10).cast("long").alias("track_id"),
                    (F.col("vec_id") % 10).cast("int").alias("frame"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


view("emb", """SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label,
  ['label---' || label, 'm3---' || (vec_id % 3), 'm5---' || (vec_id % 5), 'm7---' || (vec_id % 7)] AS tags FROM embeddings""")
view("frames", """SELECT vec_id // 10 AS track_id, CAST(vec_id % 10 AS INTEGER) AS frame, embedding::DOUBLE[] AS vec, label
  FROM embeddings""")
# one row per vector component
view("frame_dims", """SELECT track_id, frame, label, i, vec[i] AS v FROM (
  SELECT track_id, frame, label, vec, unnest(range(1, 65)) AS i FROM frames)""", "frames")


# ---------------------------------------------------------------- samples and metrics

LINE_KEY = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate"]


@stored("samples")
def sample_rows(spark, d) -> DataFrame:
    """samples(track_id, stem, i, ref, est): lines of a supplier per return flag."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_discount", *LINE_KEY)
    o = Ordered(li, ["l_suppkey", "l_returnflag"], LINE_KEY).add(rn=("row", None)).result()
    p = F.col("l_extendedprice") / 997
    return o.select(F.col("l_suppkey").alias("track_id"), F.col("l_returnflag").alias("stem"),
                    (F.col("rn") - 1).alias("i"), p.alias("ref"), (p * (1 - F.col("l_discount"))).alias("est"))


view("samples", """SELECT l_suppkey AS track_id, l_returnflag AS stem,
  row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate) - 1 AS i,
  l_extendedprice / 997 AS ref, l_extendedprice / 997 * (1 - l_discount) AS est FROM lineitem""")


def _both_models(spark, d) -> DataFrame:
    """One row per block with the value of either model."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("track_id"), F.col("event_type").alias("stem"),
                    F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("block"),
                    F.col("value").alias("base"), (F.col("value") + (F.col("event_id") % 21 - 9) / 10.0).alias("variant"))


def _per_model(rows: DataFrame, *keys: str) -> DataFrame:
    both = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("value")) for m in ("base", "variant")])
    return rows.select(*keys, F.explode(both).alias("b")).select("b.model", *keys, "b.value")


def block_metric(spark, d) -> DataFrame:
    """block_metric(model, track_id, stem, block, value): events per user, type and day."""
    return _per_model(_both_models(spark, d), "track_id", "stem", "block")


@stored("track_metric")
def track_metric(spark, d) -> DataFrame:
    """track_metric(model, track_id, stem, value): scaled mean over blocks (the scale avoids decimal ties when rounding)."""
    means = _both_models(spark, d).groupBy("track_id", "stem").agg(*[(F.avg(m) / 0.997).alias(m) for m in ("base", "variant")])
    return _per_model(means, "track_id", "stem")


view("block_metric", """SELECT m.model, user_id AS track_id, event_type AS stem,
  date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS block,
  CASE WHEN m.model = 'base' THEN value ELSE value + (event_id % 21 - 9) / 10.0::DOUBLE END AS value
  FROM events, (VALUES ('base'), ('variant')) m(model)""")
view("track_metric", """SELECT model, track_id, stem, avg(value) / 0.997::DOUBLE AS value FROM block_metric GROUP BY ALL""", "block_metric")


# ---------------------------------------------------------------- sequences

def event_seconds(spark, d) -> DataFrame:
    """events with t = seconds since the user's first event (microsecond exact)."""
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first = e.groupBy("user_id").agg(F.min("us").alias("us0"))
    return e.join(first, "user_id").select(
        F.col("user_id").alias("track_id"), "event_id", ((F.col("us") - F.col("us0")) / 1e6).alias("t"),
        F.col("value").alias("strength"), F.col("event_type").alias("label"))


@stored("beats")
def beats(spark, d) -> DataFrame:
    """beats(track_id, pos, t, strength, label)."""
    o = Ordered(event_seconds(spark, d), ["track_id"], ["t", "event_id"]).add(rn=("row", None)).result()
    return o.select("track_id", (F.col("rn") - 1).alias("pos"), "t", "strength", "label", "event_id")


def analysis(spark, d) -> DataFrame:
    """analysis(track_id, bpm, key, duration, n_bars): one supplier is one analysed track."""
    k = F.col("s_suppkey")
    names = F.array(*[F.lit(n) for n in PITCHES])
    return table(spark, d, "supplier").select(
        k.alias("track_id"), (F.lit(60.0) + (k * 37) % 120 + (k % 13) / 10.0).alias("bpm"),
        F.concat(F.element_at(names, ((k % 24) % 12 + 1).cast("int")),
                 F.when(k % 24 < 12, " major").otherwise(" minor")).alias("key"),
        (F.lit(120.0) + k % 90).alias("duration"), ((k % 10) * 4).cast("int").alias("n_bars"))


def downbeats(spark, d) -> DataFrame:
    """downbeats(track_id, pos, t): n_bars lines every 240/bpm seconds, with a small drift."""
    return analysis(spark, d).filter("n_bars > 0").select(
        "track_id", "bpm", F.explode(F.sequence(F.lit(0), F.col("n_bars") - 1)).alias("pos")).select(
        "track_id", "pos", (F.lit(240.0) / F.col("bpm") * F.col("pos") + (F.col("pos") % 3) / 100.0).alias("t"))


view("ev", """SELECT user_id AS track_id, event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS t,
  value AS strength, event_type AS label FROM events""")
view("beats", """SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) - 1 AS pos, t, strength, label, event_id
  FROM ev""", "ev")
view("analysis", """SELECT s_suppkey AS track_id, 60.0::DOUBLE + (s_suppkey * 37) % 120 + (s_suppkey % 13) / 10.0::DOUBLE AS bpm,
  (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[CAST(s_suppkey % 24 % 12 + 1 AS INTEGER)] ||
    CASE WHEN s_suppkey % 24 < 12 THEN ' major' ELSE ' minor' END AS key,
  120.0::DOUBLE + s_suppkey % 90 AS duration, CAST((s_suppkey % 10) * 4 AS INTEGER) AS n_bars FROM supplier""")
view("downbeats", """SELECT track_id, pos, 240.0::DOUBLE / bpm * pos + (pos % 3) / 100.0::DOUBLE AS t FROM (
  SELECT track_id, bpm, unnest(range(0, n_bars)) AS pos FROM analysis WHERE n_bars > 0)""", "analysis")
