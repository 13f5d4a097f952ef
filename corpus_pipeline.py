"""Corpus pipeline: quality rules, exact copies, near copies, mixing to weights, packing.

Each stage takes the rows that the stage before kept, written and read again as Parquet. The first four return the
columns of ``documents``; the last returns one boundary record per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.core.session import materialise
from cadenza.llm import exact_dedup, jaccard_join, line_rules, mixing, packing
from cadenza.llm import queries as Q


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines leave the documents that stay."""
    Q.prepare(spark)
    return line_rules.keep_clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    Q.prepare(spark)
    return exact_dedup.keep_last(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    Q.prepare(spark)
    return jaccard_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document taken for several epochs is repeated."""
    Q.prepare(spark)
    taken = mixing.mix(docs, Q.levels(), mixing.word_count(F.col("text")), Q.WEIGHTS, Q.SEED, Q.EPOCHS, budget_share=Q.SHARE)
    return taken.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    Q.prepare(spark)
    return packing.pack(docs, Q.tokenizer_path("word_bpe_49k.json"), Q.PACK_END, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("mixing", mixture), ("packing", packed)]

# Packing needs the tokenizer, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
