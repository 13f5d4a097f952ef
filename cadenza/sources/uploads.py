"""Admission of uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size limit in bytes and the models that may be requested.
MAX_UPLOAD_BYTES = 200 * 1024 * 1024
MODELS = ("htdemucs", "htdemucs_ft", "mdx_extra")
NAME_LENGTH = 60


def base_name(filename: Column) -> Column:
    """Decoded last path component; anything a client puts before it is ignored."""
    plain = F.coalesce(F.try_url_decode(filename), filename)
    return F.regexp_extract(plain, r"([^/]*)/*$", 1)


def stem(name: Column) -> Column:
    """File name without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def slugify(name: Column) -> Column:
    """Name to show: letters, digits, blanks, dots, dashes; each other run becomes one underscore. Not unique."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{N} .-]+", "_")
    cut = F.substring(F.regexp_replace(kept, r"^[ ._-]+|[ ._-]+$", ""), 1, NAME_LENGTH)
    return F.when(cut == "", "untitled").otherwise(cut)


def upload_key(name: Column) -> Column:
    """Key of a file name: equal only for equal names, however long they are."""
    return F.concat_ws("-", slugify(name), F.substring(F.sha2(name, 256), 1, 16))


def admit_uploads(df: DataFrame) -> DataFrame:
    """Add name, slug, id, model and the reason of a rejection ('' when admitted)."""
    name = base_name(F.coalesce(F.when(F.col("filename") != "", F.col("filename")), F.lit("upload.mp3")))
    model = F.coalesce(F.when(F.col("model") != "", F.col("model")), F.lit(MODELS[0]))
    reason = (F.when(F.col("bytes").isNull() | (F.col("bytes") <= 0), "empty").when(F.col("bytes") > MAX_UPLOAD_BYTES, "too large")
              .when(~model.isin(*MODELS), "unsupported model").otherwise(""))
    d = df.select("*", name.alias("name")).withColumn("_stem", stem(F.col("name"))).withColumn("model", model)
    return d.withColumn("slug", slugify(F.col("_stem"))).withColumn("id", upload_key(F.col("_stem"))).withColumn("reason", reason).drop("_stem")
