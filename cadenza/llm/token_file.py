"""Token ids in a compressed binary file: static range asymmetric numeral system (rANS).

A file is a Parquet folder of segments. A segment holds consecutive documents in ascending id order, about
SEGMENT_TOKENS tokens, under one shared frequency table, cut into blocks that decode independently. A block runs LANES
interleaved coders in lockstep: step t codes tokens t*LANES .. t*LANES+LANES-1. Its payload lists 32-bit words in the
order in which the decoder needs them. Every CHECKPOINT steps the coder states and the word position are kept, so a
reader may start there; each block carries a checksum of its payload and one of its ids.

Segments end at document borders; a document longer than a segment is one segment. Documents are sorted by id within
shards that follow each other in id order; equal ids are ordered by their token ids, null ids come first.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.core.session import parallelism
from cadenza.llm.arrow_text import slices
from cadenza.llm.tokens import encode_with_end

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEGMENT_TOKENS = 1 << 21
BLOCK_TOKENS = 1 << 18
LANES = 512
CHECKPOINT = 256
SHARD_ROWS = 4_000          # documents of a shard; more where MAX_SHARDS would be passed
MAX_SHARDS = 10_000
LOW = 31                    # states stay in [2**31, 2**63)
_U = np.uint64


# ---------------------------------------------------------------- coder

def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, frequencies that sum to 2**bits, bits); every symbol keeps at least one slot."""
    symbols, counts = np.unique(ids, return_counts=True)
    bits = max(18, int(np.ceil(np.log2(max(1, len(symbols))))) + 2)
    room = (1 << bits) - len(symbols)
    freq = 1 + counts.astype(np.int64) * room // int(counts.sum())
    freq[np.argmax(counts)] += (1 << bits) - int(freq.sum())
    return symbols.astype("<u4"), freq.astype("<u4"), bits


def encode_blocks(ids: np.ndarray, symbols: np.ndarray, freq: np.ndarray, bits: int) -> list[dict]:
    """Blocks of up to BLOCK_TOKENS ids, coded side by side."""
    n_blocks = -(-len(ids) // BLOCK_TOKENS)
    steps = -(-min(len(ids), BLOCK_TOKENS) // LANES)
    # Padding has the whole range as its slot: coding it changes nothing and emits nothing.
    f_of = np.concatenate([freq.astype(_U), [_U(1) << _U(bits)]])
    c_of = np.concatenate([np.cumsum(freq, dtype=_U) - freq, [_U(0)]])
    grid = np.full(n_blocks * BLOCK_TOKENS, len(symbols), np.int64)
    grid[:len(ids)] = np.searchsorted(symbols, ids)
    grid = grid.reshape(n_blocks, BLOCK_TOKENS)[:, :steps * LANES].reshape(n_blocks, steps, LANES)
    x = np.full((n_blocks, LANES), 1 << LOW, _U)
    words = np.zeros((n_blocks, steps, LANES), np.uint32)
    sent = np.zeros((n_blocks, steps, LANES), bool)
    states: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        s = grid[:, t]
        f = f_of[s]
        full = x >= f << _U(LOW - bits + 32)
        words[:, t] = x.astype(np.uint32)
        sent[:, t] = full
        x = np.where(full, x >> _U(32), x)
        q = x // f
        x = (q << _U(bits)) + (x - q * f) + c_of[s]
        if t % CHECKPOINT == 0:
            states[t] = x
    blocks = []
    for b in range(n_blocks):
        own = ids[b * BLOCK_TOKENS:(b + 1) * BLOCK_TOKENS]
        used = -(-len(own) // LANES)
        marks = list(range(0, used, CHECKPOINT))
        per_step = sent[b].sum(axis=1)
        position = np.cumsum(per_step) - per_step
        payload = words[b][sent[b]].astype("<u4").tobytes()
        blocks.append({
            "n_tokens": len(own), "payload": payload, "payload_crc32": zlib.crc32(payload),
            "ids_crc32": zlib.crc32(own.astype("<u4").tobytes()),
            "checkpoint_steps": marks, "checkpoint_words": [int(position[t]) for t in marks],
            "checkpoint_states": np.stack([states[t][b] for t in marks]).astype("<u8").tobytes()})
    return blocks


class Table:
    def __init__(self, symbols: bytes, freq: bytes):
        self.symbols = np.frombuffer(symbols, "<u4")
        self.freq = np.frombuffer(freq, "<u4").astype(_U)
        self.start = np.cumsum(self.freq) - self.freq
        self.bits = int(self.freq.sum()).bit_length() - 1
        self.slots = np.repeat(np.arange(len(self.symbols)), self.freq.astype(np.int64))


def decode_block(table: Table, block: dict, checkpoint: int = 0, check: bool = True) -> np.ndarray:
    """Ids from the given checkpoint to the end of the block. A damaged payload or wrong ids raise ValueError."""
    if check and zlib.crc32(block["payload"]) != block["payload_crc32"]:
        raise ValueError("payload checksum differs")
    words = np.frombuffer(block["payload"], "<u4").astype(_U)
    states = np.frombuffer(block["checkpoint_states"], "<u8").reshape(-1, LANES)
    first, at = block["checkpoint_steps"][checkpoint], block["checkpoint_words"][checkpoint]
    x, n = states[checkpoint].astype(_U), block["n_tokens"]
    steps = -(-n // LANES)
    out = np.zeros((steps - first, LANES), np.uint32)
    mask, bits = _U((1 << table.bits) - 1), _U(table.bits)
    for t in range(first, steps):
        live = min(LANES, n - t * LANES)
        slot = x[:live] & mask
        s = table.slots[slot]
        y = table.freq[s] * (x[:live] >> bits) + slot - table.start[s]
        short = np.flatnonzero(y < _U(1 << LOW))
        y[short] = (y[short] << _U(32)) | words[at:at + len(short)]
        at += len(short)
        x[:live] = y
        out[t - first, :live] = table.symbols[s]
    ids = out.reshape(-1)[:n - first * LANES]
    if check and checkpoint == 0 and zlib.crc32(ids.astype("<u4").tobytes()) != block["ids_crc32"]:
        raise ValueError("id checksum differs")
    return ids


# ---------------------------------------------------------------- Spark side

BLOCK = ("struct<n_tokens:long, payload:binary, payload_crc32:long, ids_crc32:long, checkpoint_steps:array<int>, "
         "checkpoint_words:array<long>, checkpoint_states:binary>")
SEGMENT = f"shard int, segment int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, symbols binary, freq binary, blocks array<{BLOCK}>"


def _shard_bounds(ids: DataFrame, rows: int, shards: int) -> np.ndarray:
    if shards <= 1 or rows == 0:
        return np.empty(0)
    probs = [i / shards for i in range(1, shards)]
    return np.unique(np.array(ids.approxQuantile(ids.columns[0], probs, 0.1 / shards), float))


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                     text_col: str = "text", shard_rows: int = SHARD_ROWS, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every document (null text: empty), append ``end_id`` and write segments in ascending id order."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    count = rows.count()
    shards = max(1, min(MAX_SHARDS, max(-(-count // shard_rows), min(parallelism(spark), count))))
    bounds = _shard_bounds(rows.select("doc_id").filter("doc_id IS NOT NULL"), count, shards)

    def to_ids(batches):
        for b in slices(batches, 1):
            ids, n = encode_with_end(b.column(1), tokenizer, end_id)
            keys = b.column(0).fill_null(-(1 << 63)).to_numpy()
            shard = np.searchsorted(bounds, keys.astype(float), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), b.column(0), pa.array(n), pa.array(np.full(len(b), ids[0].dtype.itemsize, np.int32)),
                 pa.array([x.tobytes() for x in ids], pa.binary())], ["shard", "doc_id", "n", "width", "ids"])

    def to_segments(batches):
        shard, segment, held, docs_of, n_of = None, 0, [], [], []

        def flush():
            ids = np.concatenate(held)
            symbols, freq, bits = frequency_table(ids)
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "segment": segment, "n_tokens": len(ids), "doc_ids": list(docs_of), "doc_tokens": list(n_of),
                "symbols": symbols.tobytes(), "freq": freq.tobytes(), "blocks": encode_blocks(ids, symbols, freq, bits)}],
                schema=schema)

        size = 0
        for b in batches:
            for s, doc, n, width, raw in zip(*(b.column(k).to_pylist() for k in range(5))):
                if held and (s != shard or size + n > segment_tokens):
                    yield flush()
                    segment = segment + 1 if s == shard else 0
                    held, docs_of, n_of, size = [], [], [], 0
                elif s != shard:
                    segment = 0
                shard = s
                held.append(np.frombuffer(raw, f"<u{width}"))
                docs_of.append(doc)
                n_of.append(n)
                size += n
        if held:
            yield flush()

    block = pa.struct([("n_tokens", pa.int64()), ("payload", pa.binary()), ("payload_crc32", pa.int64()), ("ids_crc32", pa.int64()),
                       ("checkpoint_steps", pa.list_(pa.int32())), ("checkpoint_words", pa.list_(pa.int64())), ("checkpoint_states", pa.binary())])
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("doc_tokens", pa.list_(pa.int64())), ("symbols", pa.binary()), ("freq", pa.binary()), ("blocks", pa.list_(block))])
    (rows.mapInArrow(to_ids, "shard int, doc_id long, n long, width int, ids binary")
         .repartitionById(shards, F.col("shard"))
         .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n", "ids")
         .mapInArrow(to_segments, SEGMENT).write.parquet(path))


def read_token_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 and, if wanted, the ids.

    Blocks are decoded and checked one by one; a segment's place follows from the totals of shards and segments."""

    def decode(batches):
        for b in batches:
            for seg in b.to_pylist():
                table = Table(seg["symbols"], seg["freq"])
                ids = np.concatenate([decode_block(table, k) for k in seg["blocks"]]).astype("<u4")
                n = np.array(seg["doc_tokens"], np.int64)
                if int(n.sum()) != len(ids):
                    raise ValueError("document index and blocks differ")
                start = np.cumsum(n) - n
                raw = [ids[a:a + k].tobytes() for a, k in zip(start, n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), seg["shard"], np.int32)), pa.array(np.full(len(n), seg["segment"], np.int32)), pa.array(start),
                     pa.array(seg["doc_ids"], pa.int64()), pa.array(n), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                    + ([pa.array(raw, pa.binary())] if with_ids else []), names)

    names = ["shard", "segment", "local_start", "doc_id", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])
    file = spark.read.schema(SEGMENT).parquet(path)
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    shards = file.groupBy("shard").agg(F.sum("n_tokens").alias("total"))         # at most MAX_SHARDS rows
    shards = shards.select("shard", F.coalesce(F.sum("total").over(before("shard")), zero).alias("shard_base"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = file.select("shard", "segment", F.coalesce(F.sum("n_tokens").over(inside), zero).alias("segment_base")).join(shards, "shard")
    rows = file.mapInArrow(decode, "shard int, segment int, local_start long, doc_id long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    return rows.join(base, ["shard", "segment"]).select(
        "doc_id", (F.col("shard_base") + F.col("segment_base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))
