"""Exact copies by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so: after the first sentence end or line end that follows MIN_CHUNK
characters, or at MAX_CHUNK characters where none comes. Chunks are deduplicated on (digest, content), so one digest
naming two contents is seen, and fails the job, before the digest serves as a verified identifier. Documents are then
compared by their ordered lists of identifiers; after the chunk pass only lists and ids move, long documents do not.

A null text is empty; empty texts are equal. Of equal texts the largest id stays (a null id only if all are null).
Repeated rows with the same id and text cannot be told apart: ``exact_groups`` counts each and calls all of them kept, and
``keep_last`` lets one of them stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import lookup
from cadenza.core.session import materialise

MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunks_of(text: Column, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> Column:
    """Array of chunks whose concatenation is the text."""
    pattern = f"(?s).{{{low - 1},{high - 2}}}?[.!?\\n]|.{{1,{high}}}"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def verify_chunks(docs: DataFrame, text_col: str, digest=lambda c: F.sha2(c, 256)) -> int:
    """Number of distinct chunks; raises if two contents share an identifier."""
    chunks = docs.select(F.explode(chunks_of(F.col(text_col))).alias("chunk")).select(digest(F.col("chunk")).alias("id"), "chunk")
    distinct = chunks.groupBy("id", "chunk").agg(F.count("*").alias("times"))
    per_id = distinct.groupBy("id").agg(F.count("*").alias("contents"))
    row = per_id.agg(F.count("*").alias("n"), F.max("contents").alias("most")).first()
    if (row["most"] or 1) > 1:
        raise ValueError("two different chunks share a digest")
    return row["n"]


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, recipe (ordered chunk identifiers) and text_sha256."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select(
        "doc_id", F.transform(chunks_of(F.col("t")), lambda c: F.unhex(F.sha2(c, 256))).alias("recipe"), F.sha2("t", 256).alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row."""
    verify_chunks(docs, text_col)
    # Recipes are compared whole; their digest only routes them, so that long lists move once.
    rows = materialise(recipes(docs, id_col, text_col).withColumn("route", F.sha2(F.array_join(F.transform("recipe", F.hex), ""), 256)), "recipes")
    groups = rows.groupBy("route", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Groups of one need no join; the rest is the part of the corpus that has copies.
    many = materialise(groups.filter("group_size > 1").select("route", "keep_id", "group_size"), "groups")
    out = rows.select("doc_id", "route", "text_sha256").join(many, "route", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _matched(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    keys = keys.select(F.col("doc_id").alias("_key_id"), F.col("text_sha256").alias("_key_sha"))
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.join(lookup(keys, keys.count()), F.col("_key_id").eqNullSafe(docs[id_col].cast("long")) & (F.col("_key_sha") == F.sha2(text, 256)), how)


def without(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows named in ``rows(doc_id, text_sha256, gone, n)`` as gone; of n equal ones that stay, one stays.

    A row is named by its id and the digest of its text, so another text under the same id is not touched. All columns
    are unchanged; rows that agree in id and text count as one, whatever else they hold.
    """
    rows = materialise(rows.filter("gone OR n > 1"), "named")
    out = _matched(docs, rows.filter("gone"), id_col, text_col, "left_anti")
    twice = rows.filter("NOT gone")
    if twice.isEmpty():
        return out
    names = docs.columns
    many = _matched(out, twice, id_col, text_col, "left_semi").withColumn("_sha", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return _matched(out, twice, id_col, text_col, "left_anti").unionByName(many.dropDuplicates([id_col, "_sha"]).select(*names))


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, all columns unchanged: of equal texts the one with the largest id, once."""
    rows = exact_groups(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg((~F.bool_and("kept")).alias("gone"), F.count("*").alias("n"))
    return without(docs, rows, id_col, text_col)
