"""Concatenate and cut: token streams of all documents in fixed windows.

Pass one encodes each document once, writes its ids beside its offset within the partition, and totals the partitions.
A prefix sum over those totals (one row per partition) gives every document its global offset. Pass two cuts at the
multiples of the window and writes one boundary record per piece. Only the last window is ever short.

The order of documents is the order in which the scan deals them; a partition is a file range, so a lost executor's
task reads the same rows again, and pass two reads committed files only.

Nulls: a null text is empty and yields the end id alone; null or repeated ids are carried along. Very long texts are
cut like others. An empty table gives no piece.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.core.common import lookup
from cadenza.core.session import materialise
from cadenza.llm.arrow_text import release, slices
from cadenza.llm.tokens import encode_with_end

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 2048


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """part, local_start, doc_id, n, width, ids: little-endian ids of ``width`` bytes, the end id included."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in slices(batches, 1):
            ids, n = encode_with_end(b.column(1), tokenizer, end_id)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(b), part, np.int32)), pa.array(starts), b.column(0), pa.array(n),
                 pa.array(np.full(len(b), ids[0].dtype.itemsize, np.int32)), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["part", "local_start", "doc_id", "n", "width", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "part int, local_start long, doc_id long, n long, width int, ids binary")


def partition_bases(encoded: DataFrame) -> DataFrame:
    """part, base: tokens of all partitions before it. One row per partition of the scan."""
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0).cast("long")).alias("base"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One boundary record per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids."""
    encoded = materialise(encode_documents(docs, tokenizer, end_id, id_col, text_col), "tokens")
    bases = materialise(partition_bases(encoded), "bases")
    placed = encoded.join(lookup(bases, bases.count()), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("at"), "width", "ids")

    def cut(batches):
        for b in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc, at, width, raw in zip(*(b.column(k).to_pylist() for k in range(4))):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                start = 0
                while start < len(ids):
                    seq, off = divmod(at + start, window)
                    stop = min(len(ids), start + window - off)
                    piece = ids[start:stop].tobytes()
                    for column, v in zip(rows, (doc, start, stop - start, zlib.crc32(piece), len(ids), seq, off, piece if with_ids else None)):
                        column.append(v)
                    start = stop
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)][:8 if with_ids else 7], names[:8 if with_ids else 7])
        release()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = ", ".join(f"`{c}` long" for c in names[:7]) + (", ids binary" if with_ids else "")
    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequence_id, tokens, padding. A sequence whose length is a power of two stays as it is, others fill the window."""
    s = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return s.withColumn("padding", F.when(power, 0).otherwise(F.lit(window) - F.col("tokens")).cast("long"))
