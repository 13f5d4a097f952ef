"""Tag vocabulary, multi-hot encoding, catalogue statistics and label rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.core.common import DIMENSION_ROWS, md5_int
from cadenza.core.ordered import Ordered, median
from cadenza.core.session import materialise

# Genres that are electronic by definition (child, parent).
SEMANTIC_RULES = (
    ("genre---house", "genre---electronic"),
    ("genre---techno", "genre---electronic"),
    ("genre---trance", "genre---electronic"),
    ("genre---triphop", "genre---electronic"),
    ("genre---downtempo", "genre---electronic"),
)


def category(tag="tag"):
    return F.split(tag, "---", 2)[0]


def with_category(df: DataFrame) -> DataFrame:
    """Split ``category---tag`` into its two parts."""
    parts = F.split("tag", "---", 2)
    return df.withColumn("category", parts[0]).withColumn("name", F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def long_labels(tracks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return tracks.select("track_id", *keep, F.explode("tags").alias("tag"))


def tag_counts(tracks: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """counts(tag, n), written once because every statistic below reads it again."""
    counts = tracks.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    if vocab is not None:
        counts = counts.join(vocab.select("tag"), "tag", "left_semi")
    return materialise(counts, "counts")


def vocab(tracks: DataFrame, min_positives: int = 0) -> DataFrame:
    """vocab(tag, idx, category, n_train) sorted by tag. Pass the training split only."""
    counts = materialise(
        tracks.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_positives), "vocab")
    return Ordered(counts, [], ["tag"]).add(r=("row", None)).result().select(
        "tag", (F.col("r") - 1).cast("int").alias("idx"), category().alias("category"), F.col("n").alias("n_train"))


def encode(tracks: DataFrame, voc: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Dense (track_id, tag, idx, category, y). A map-side expansion: nothing is shuffled.

    Tags outside the vocabulary are ignored and duplicates collapse to 1.
    """
    n = voc.count()
    if n == 0:
        spine = tracks.limit(0).select("track_id", *(keep or []), "tags", F.lit(0).alias("idx"))
    else:
        spine = tracks.select("track_id", *(keep or []), "tags", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
    names = voc.select("tag", "idx", "category")
    if n <= DIMENSION_ROWS:
        names = F.broadcast(names)
    return spine.join(names, "idx").select(
        *(keep or []), "track_id", "tag", "idx", "category", F.array_contains("tags", F.col("tag")).cast("int").alias("y"))


def head_share(counts: DataFrame) -> DataFrame:
    """Share of positives held by the top max(1, n // 10) tags."""
    top = max(1, counts.count() // 10)
    ranked = Ordered(counts, [], [F.desc("n"), F.col("tag")]).add(r=("row", None)).result()
    return ranked.agg(F.coalesce(F.sum(F.when(F.col("r") <= top, F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("head_share"))


def tag_statistics(tracks: DataFrame, voc: DataFrame | None = None) -> DataFrame:
    """One row of catalogue statistics. Tags per track counts all tags, the rest the vocabulary's."""
    counts = tag_counts(tracks, voc)
    per_track = tracks.agg(F.count("*").alias("n_tracks"), (F.sum("duration") / 3600).alias("total_hours"),
                           F.avg(F.size("tags")).alias("tags_per_track"))
    freq = counts.agg(F.count("*").alias("n_tags"), F.sum("n").alias("_sum"), F.max("n").alias("freq_max"),
                      F.min("n").alias("freq_min"), F.count_if(F.col("n") < 50).alias("n_below_50"))
    mid = median(counts, [], "n", "freq_median").withColumn("freq_median", F.col("freq_median").cast("int"))
    one = lambda df: df.withColumn("_k", F.lit(1))  # noqa: E731  four one-row frames
    out = one(per_track).join(one(freq), "_k").join(one(mid), "_k").join(one(head_share(counts)), "_k")
    return out.select("n_tracks", "n_tags", "total_hours", "tags_per_track",
                      F.coalesce(F.try_divide(F.col("_sum"), F.col("n_tracks") * F.col("n_tags")), F.lit(0.0)).alias("label_density"),
                      "freq_max", "freq_median", "freq_min", F.col("head_share").alias("head10pct_share"), "n_below_50")


def category_stats(counts: DataFrame) -> DataFrame:
    c = counts.withColumn("category", category())
    basic = c.groupBy("category").agg(F.count("*").alias("n_tags"), F.min("n").alias("min"), F.max("n").alias("max"))
    return basic.join(median(c, ["category"], "n"), "category").withColumn("median", F.col("median").cast("int"))


def split_stats(tracks: DataFrame, voc: DataFrame, thin: int = 10) -> DataFrame:
    """Per split: tracks, hours, vocabulary tags seen and how many of them are thin."""
    per_tag = long_labels(tracks, ("split",)).join(voc.select("tag"), "tag", "left_semi").groupBy("split", "tag").agg(F.count("*").alias("n"))
    tags = per_tag.groupBy("split").agg(F.count("*").alias("n_tags"), F.count_if(F.col("n") < thin).alias("n_thin"))
    size = tracks.groupBy("split").agg(F.count("*").alias("n_tracks"), (F.sum("duration") / 3600).alias("hours"))
    return size.join(tags, "split", "left").na.fill(0, ["n_tags", "n_thin"])


def thin_tags(tracks: DataFrame, voc: DataFrame, split: str = "validation", thin: int = 10) -> DataFrame:
    rows = tracks.filter(F.col("split") == split)
    return tag_counts(rows, voc).filter(F.col("n") < thin)


def cumulative_share(counts: DataFrame) -> DataFrame:
    """Long-tail curve: rank by frequency, running share of all positives."""
    total = counts.agg(F.count("*"), F.sum("n")).first()
    o = Ordered(counts, [], [F.desc("n"), F.col("tag")]).add(rank=("row", None), cum=("sum", F.col("n"))).result()
    return o.select("rank", "tag", "n", (F.col("rank") / F.lit(total[0])).alias("tag_share"),
                    (F.col("cum") / F.lit(total[1])).alias("cum_share"))


def top_bottom(counts: DataFrame, n_tracks: int, k: int = 15) -> DataFrame:
    pct = (F.col("n") / F.lit(n_tracks) * 100).alias("percent")
    top = counts.orderBy(F.desc("n"), "tag").limit(k).select(F.lit("top").alias("side"), "tag", "n", pct)
    bottom = counts.orderBy("n", F.desc("tag")).limit(k).select(F.lit("bottom").alias("side"), "tag", "n", pct)
    return top.unionByName(bottom)


def norm_stats(frames: DataFrame, max_tracks: int | None = None, seed: int = 0) -> DataFrame:
    """Mean and population standard deviation (+1e-8) over all training tracks, or over a hashed sample of them if asked for."""
    if max_tracks is not None:
        ids = frames.select("track_id").distinct().orderBy(md5_int(seed, F.col("track_id")), "track_id").limit(max_tracks)
        frames = frames.join(ids, "track_id", "left_semi")
    values = frames.select(F.explode("vec").alias("v"))
    return values.agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + 1e-8).alias("std"))


def standardise(df: DataFrame, mean: float, std: float, vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, F.transform(vec, lambda v: (v - F.lit(mean)) / F.lit(std)))


def dimension_stats(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(i, mean, std) per vector component; a constant component gets std 1."""
    s = df.select(F.posexplode(vec).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return s.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)))


def standardise_by_dimension(df: DataFrame, stats: DataFrame, vec: str = "vec") -> DataFrame:
    """Apply per-component statistics fitted elsewhere. They are as long as one vector, so they travel as literals."""
    rows = sorted(stats.collect())
    mean, std = F.lit([float(r["mean"]) for r in rows]), F.lit([float(r["std"]) for r in rows])
    centred = F.zip_with(vec, mean, lambda v, m: v - m)
    return df.withColumn(vec, F.zip_with(centred, std, lambda v, s: v / s))


def vocab_contract(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Rows where the stored tag order differs from the current vocabulary."""
    a = stored.select("idx", F.col("tag").alias("stored_tag"))
    b = current.select("idx", F.col("tag").alias("current_tag"))
    return a.join(b, "idx", "full_outer").filter(~F.col("stored_tag").eqNullSafe(F.col("current_tag")))


def assert_vocab(stored: DataFrame, current: DataFrame) -> None:
    bad = vocab_contract(stored, current).limit(3).collect()
    if bad:
        raise ValueError(f"tag order differs from the current vocabulary: {bad}")


def assert_frame_count(frames: DataFrame, expected: int, dim: int) -> None:
    """Every track must have ``expected`` frames of ``dim`` components."""
    bad = frames.groupBy("track_id").agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")) \
        .filter((F.col("n") != expected) | (F.col("lo") != dim) | (F.col("hi") != dim)).limit(3).collect()
    if bad:
        raise ValueError(f"feature shape differs from ({expected}, {dim}): {bad}")


# ---------------------------------------------------------------- label rules

def semantic_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEMANTIC_RULES, "a string, b string")


def cooccurrence(labels: DataFrame) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, p_b_given_a, p_a_given_b) for tag pairs, including a = b.

    A track's distinct tags are bounded by the vocabulary; pairs are expanded inside the
    row and counted map-side, so no join on a popular tag is needed.
    """
    sets = labels.groupBy("track_id").agg(F.collect_set("tag").alias("tags"))
    pairs = sets.select("tags", F.explode("tags").alias("a")).select("a", F.explode("tags").alias("b"))
    n = materialise(pairs.groupBy("a", "b").agg(F.count("*").alias("n_ab")), "cooccurrence")
    single = n.filter("a = b")
    return n.join(single.select("a", F.col("n_ab").alias("n_a")), "a").join(single.select("b", F.col("n_ab").alias("n_b")), "b").select(
        "a", "b", "n_ab", "n_a", "n_b", (F.col("n_ab") / F.col("n_a")).alias("p_b_given_a"),
        (F.col("n_ab") / F.col("n_b")).alias("p_a_given_b"))


def mine_rules(labels: DataFrame, min_conf: float = 0.5, max_reverse: float = 0.3, min_support: int = 20) -> DataFrame:
    """Asymmetric implications a => b. Pass the training labels only."""
    c = cooccurrence(labels)
    return c.filter((F.col("a") != F.col("b")) & (F.col("n_a") >= min_support)
                    & (F.col("p_b_given_a") >= min_conf) & (F.col("p_a_given_b") < max_reverse))


def closure(rules: DataFrame) -> DataFrame:
    """Transitive closure of a rule table; path lengths double each round, cycles end by themselves."""
    known = materialise(rules.select("a", "b").distinct(), "rules")
    size = known.count()
    while True:
        step = known.alias("l").join(known.alias("r"), F.col("l.b") == F.col("r.a")).select(F.col("l.a"), F.col("r.b"))
        known = materialise(known.union(step).distinct(), "rules")
        grown = known.count()
        if grown == size:
            return known
        size = grown


def propagate(labels: DataFrame, rules: DataFrame, voc: DataFrame, split: str = "train") -> DataFrame:
    """Add implied positives to the training rows; other splits stay as they are."""
    names = rules.select(F.explode(F.array("a", "b")).alias("tag")).distinct()
    unknown = names.join(voc, "tag", "left_anti").orderBy("tag").limit(10).collect()
    if unknown:
        raise ValueError(f"rules name tags outside the vocabulary: {[r['tag'] for r in unknown]}")
    full = closure(rules)
    added = labels.filter(F.col("split") == split).join(full, labels["tag"] == full["a"]).select("split", "track_id", F.col("b").alias("tag"))
    return labels.select("split", "track_id", "tag").unionByName(added).distinct()


# ---------------------------------------------------------------- split contracts

def leakage(tracks: DataFrame, attrs: tuple[str, ...] = ("track_id", "artist_id")) -> DataFrame:
    """(attr, split_a, split_b, n_shared): identifiers present in two splits."""
    ids = tracks.select("split", F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("id")) for a in attrs])).alias("x"))
    where = ids.groupBy("x.attr", "x.id").agg(F.sort_array(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    pairs = where.select("attr", "s", F.explode("s").alias("split_a")).select("attr", "split_a", F.explode("s").alias("split_b"))
    return pairs.filter("split_a < split_b").groupBy("attr", "split_a", "split_b").agg(F.count("*").alias("n_shared"))


def assert_no_leakage(tracks: DataFrame, attrs: tuple[str, ...] = ("track_id", "artist_id")) -> None:
    found = leakage(tracks, attrs).limit(5).collect()
    if found:
        raise ValueError(f"identifiers shared between splits: {found}")


def complete_cases(features: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Rows of tracks that have every required source."""
    need = F.when(F.col("source").isin(*sources), F.col("source"))
    whole = features.groupBy("track_id").agg(F.size(F.collect_set(need)).alias("n")).filter(F.col("n") == len(set(sources)))
    return features.join(whole, "track_id", "left_semi")
