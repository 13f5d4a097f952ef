"""Completeness and integrity checks over file listings. Every check returns problem rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import union_all
from cadenza.sources.manifest import chunk_of

MIXTURE = "mixture"
# Stems of a complete recording and the validation recordings of the benchmark.
STEMS = ("vocals", "drums", "bass", "other")
VALIDATION_TRACKS = (
    "A Classic Education - NightOwl",
    "ANiMAL - Clinic A",
    "Actions - Devil's Words",
    "Alexander Ross - Velvet Curtain",
    "Aimee Norwich - Child",
    "Ben Carrigan - We'll Talk About It All Tonight",
    "Bill Chudziak - Children Of No-one",
    "Clara Berry And Wooldog - Air Traffic",
    "Fergessen - Back From The Start",
    "James May - On The Line",
    "Leaf - Summerghost",
    "Meaxic - You Listen",
    "Patrick Talbot - A Reason To Leave",
    "Triviul - Angelsaint",
)
COMPLETE = 0.98  # published file counts differ from the metadata by a few


def track_files(files: DataFrame) -> DataFrame:
    """Split ``subset/track/stem.wav`` paths."""
    m = lambda i: F.regexp_extract("path", r"^([^/]+)/([^/]+)/([^/]+)\.wav$", i)
    rest = [c for c in files.columns if c != "path"]
    return files.select(m(1).alias("subset"), m(2).alias("track"), m(3).alias("stem"), *rest).filter("subset <> ''")


def list_tracks(files: DataFrame, subset: str, mode: str = "all", validation: tuple[str, ...] = VALIDATION_TRACKS) -> DataFrame:
    """Recordings of a subset that have a mixture; mode 'validation' keeps, 'train' drops the fixed list."""
    t = files.filter((F.col("subset") == subset) & (F.col("stem") == MIXTURE)).select("subset", "track").distinct()
    if mode == "validation":
        return t.filter(F.col("track").isin(*validation))
    if mode == "train":
        return t.filter(~F.col("track").isin(*validation))
    return t


def verify_dataset(files: DataFrame, expected: dict[str, int], sample_rate: int = 44100, channels: int = 2) -> DataFrame:
    """(subset, track, stem, problem) for wrong counts, missing stems and wrong formats."""
    none = F.lit(None).cast("string")
    complete = files.filter(F.col("stem") == MIXTURE).select("subset", "track").distinct().filter(F.col("subset").isin(*expected))
    want = files.sparkSession.createDataFrame(list(expected.items()), "subset string, want long")
    counts = want.join(complete.groupBy("subset").agg(F.count("*").alias("n")), "subset", "left").na.fill(0, ["n"]).filter("n <> want")
    counts = counts.select("subset", none.alias("track"), none.alias("stem"), F.format_string("expected %d tracks, found %d", "want", "n").alias("problem"))
    names = [MIXTURE, *STEMS]
    grid = complete.withColumn("stem", F.explode(F.lit(names)))
    missing = grid.join(files.select("subset", "track", "stem"), ["subset", "track", "stem"], "left_anti").withColumn("problem", F.lit("missing file"))
    known = files.filter(F.col("stem").isin(*names)).join(complete, ["subset", "track"], "left_semi")
    wrong = lambda c, ok, text: known.filter(F.col(c) != ok).select("subset", "track", "stem", F.concat(F.lit(text), F.col(c).cast("string")).alias("problem"))
    return union_all([counts, missing, wrong("sample_rate", sample_rate, "sample rate "), wrong("channels", channels, "channels ")])


# ---------------------------------------------------------------- incremental work

def pending(todo: DataFrame, done: DataFrame, required: tuple[str, ...], key: str = "track_id") -> DataFrame:
    """Rows of todo for which at least one required output is missing in ``done(key, output)``."""
    need = todo.select(key, F.explode(F.lit(list(required))).alias("output"))
    open_ = need.join(done.select(key, "output"), [key, "output"], "left_anti").select(key).distinct()
    return todo.join(open_, key, "left_semi")


def tally(results: DataFrame) -> DataFrame:
    """One row (n_new, n_cached, n_failed) from rows with a status."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(n("ok").alias("n_new"), n("cached").alias("n_cached"), n("failed").alias("n_failed"))


def incomplete_chunks(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(chunk, expected, have): chunks below 98 % of the files the manifest names; unreadable paths are skipped."""
    want = manifest.select(chunk_of().alias("chunk")).filter("chunk IS NOT NULL").groupBy("chunk").agg(F.count("*").alias("expected"))
    have = files.select(chunk_of().alias("chunk")).filter("chunk IS NOT NULL").groupBy("chunk").agg(F.count("*").alias("have"))
    j = want.join(have, "chunk", "left").na.fill(0, ["have"])
    return j.filter((F.col("have") == 0) | (F.col("have") < F.col("expected") * COMPLETE))


def audit_archives(archives: DataFrame, members: DataFrame, manifest: DataFrame, receipts: DataFrame) -> DataFrame:
    """(archive, member, problem) from archives(archive, bytes, sha256), members(archive, member, offset, size),
    manifest(archive, member) and earlier receipts(archive, bytes, sha256)."""
    none = F.lit(None).cast("string").alias("member")
    clean = members.withColumn("member", F.regexp_replace("member", r"^\./", ""))
    rows = lambda d, m, text: d.select("archive", m, F.lit(text).alias("problem"))
    lost = manifest.join(archives, "archive", "left_semi").join(clean, ["archive", "member"], "left_anti")
    extent = clean.join(archives.select("archive", "bytes"), "archive").filter((F.col("size") <= 0) | (F.col("offset") + F.col("size") > F.col("bytes")))
    r = archives.join(receipts.select("archive", F.col("bytes").alias("_b"), F.col("sha256").alias("_h")), "archive")
    return union_all([
        rows(archives.filter(F.col("bytes") % 512 != 0), none, "truncated archive"), rows(lost, F.col("member"), "missing member"),
        rows(extent, F.col("member"), "invalid extent"), rows(r.filter("bytes <> _b"), none, "size changed"),
        rows(r.filter("bytes = _b AND sha256 <> _h"), none, "checksum changed")])


# ---------------------------------------------------------------- content identity

def content_hash(content="content") -> Column:
    return F.sha2(content, 256)


def dedupe_content(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(sha256, key, n_copies): the first key of every distinct content. Only digests are shuffled."""
    return files.select(key, content_hash(content).alias("sha256")).groupBy("sha256").agg(F.min(key).alias(key), F.count("*").alias("n_copies"))


def signature(df: DataFrame, *config: str) -> DataFrame:
    """One digest of a table as a multiset of rows, plus configuration text.

    Row digests are added word by word, so the result does not depend on order or
    partitioning and no task sees more than partial sums.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    word = lambda i: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    s = df.select(*[word(i).alias(f"w{i}") for i in range(8)]).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"w{i}") for i in range(8)])
    words = [F.format_string("%d", (F.col(f"w{i}") % 4294967296).cast("long")) for i in range(8)]
    return s.select("n", F.sha2(F.concat_ws(":", *[F.lit(c) for c in config], F.col("n").cast("string"), *words), 256).alias("signature"))


def assert_same_signature(stored: str, df: DataFrame, *config: str) -> None:
    if signature(df, *config).first()["signature"] != stored:
        raise ValueError("configuration or rows changed since the run began")
