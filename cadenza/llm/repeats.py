"""Remove every byte that lies in a string of LENGTH bytes occurring more than once anywhere.

Suffixes cannot be sorted in one place, so the corpus is first cut into groups within which every repeat must lie:

1. Anchors. The anchor of a window of LENGTH bytes is its K-byte piece with the smallest hash, leftmost on ties. Equal
   windows have equal anchors at equal offsets. Neighbouring windows with the same anchor form a segment, one per about
   185 bytes; a segment travels as hashes and positions, not as text. Anchors seen once are done, and segments that
   occur twice are repeated as a whole.
2. Cores. Only where one anchor has different segments do bytes matter. Windows are grouped by the anchor's offset in
   bands of BAND; all windows of a band share a core of LENGTH - BAND + 1 bytes, so equal windows have equal cores.
   What is left of a segment is the core's digest and at most BAND - 1 bytes on either side.
3. Interval expansion. The core is one symbol, so a window is exactly BAND symbols. The strings of a batch of complete
   core groups are joined, their Burrows-Wheeler transform is built, and intervals are extended backwards breadth
   first: level d yields the places whose common prefix with their neighbour is d, and the search stops at BAND.
   Places without a value by then have a common prefix of at least BAND symbols: those windows are repeated. A core with
   more than HOT_CORE different contexts is counted window by window in a grouped aggregate instead.

Digests of segments, cores and windows have 128 bits. Null texts are empty; matches never cross documents. A document
is known by its id and a hash of its text, so null and repeated ids do no harm; rows that repeat both are the same
document twice and repeat each other.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.core.session import materialise
from cadenza.llm.arrow_text import Texts, mix, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 400
K = 32
BAND = 93
HOT_CORE = 4_096
BATCH_SYMBOLS = 1_000_000
_U = np.uint64


# ---------------------------------------------------------------- anchors

def _piece_hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """64-bit hash of the k bytes from each position on (k a power of two)."""
    h = mix(data.astype(_U) + _U(0xA0761D6478BD642F))
    width, base = 1, 0x9E3779B97F4A7C15 | 1
    while width < k:
        h = h[:-width] * _U(base) + h[width:]
        base = base * base % (1 << 64)
        width *= 2
    return mix(h)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of v[i:i + width] for each i."""
    n, span = len(v) - width + 1, 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[:n], v[width - span:width - span + n])


def segments(texts: Texts, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, first window start, last window start, anchor position, anchor hash), positions within the slice."""
    none = np.empty(0, np.int64)
    if len(texts.data) < length:
        return none, none, none, none, none
    h = _piece_hashes(texts.data)
    packed = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
    anchor = (_sliding_min(packed, length - K + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    ok = np.zeros(len(anchor) + 1, np.int32)                # windows inside one text
    first, last = texts.ends[:-1], texts.ends[1:] - length + 1
    fits = last > first
    np.add.at(ok, first[fits], 1)
    np.add.at(ok, last[fits], -1)
    start = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    if len(start) == 0:
        return none, none, none, none, none
    owner = np.searchsorted(texts.ends, start, "right") - 1
    at = anchor[start]
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    stop = np.append(edge[1:], len(start)) - 1
    return owner[edge], start[edge], start[stop], at[edge], h[at[edge]].view(np.int64)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def segment_table(rows: DataFrame, length: int) -> DataFrame:
    """anchor, seg_a, seg_b (digest), doc_id, th, first, last, place: byte positions in the document."""

    def run(batches):
        for b in slices(batches, 2):
            texts = Texts.of(b.column(2))
            owner, first, last, place, anchor = segments(texts, length)
            view = memoryview(texts.data)
            shift = (place - first).tolist()
            digest = [xxhash.xxh3_128_digest(view[s:e], seed=k) for s, e, k in zip(first.tolist(), (last + length).tolist(), shift)]
            pair = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            base = texts.ends[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(pair[:, 0]), pa.array(pair[:, 1]), b.column(0).take(pa.array(owner)), b.column(1).take(pa.array(owner)),
                 pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.array((place - base).astype(np.int32))], names)

    names = ["anchor", "seg_a", "seg_b", "doc_id", "th", "first", "last", "place"]
    return rows.mapInArrow(run, "anchor long, seg_a long, seg_b long, doc_id long, th long, first int, last int, place int")


# ---------------------------------------------------------------- cores

def band_table(rows: DataFrame, wanted: DataFrame, length: int, band: int) -> DataFrame:
    """One row per segment and band: core digest, the bytes around it, and where its windows are.

    ``lo`` and ``hi`` bound the windows by the bytes that they reach left of the core; ``own`` marks segments whose
    verdict is still open, others only serve for comparison.
    """
    per_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "first", "last", "place", "own")).alias("parts"))
    same = rows["doc_id"].eqNullSafe(per_doc["doc_id"]) & (rows["th"] == per_doc["th"])
    # Repeated rows are one document here.
    joined = rows.join(per_doc, same).select(rows["doc_id"], rows["th"], "text", "parts")

    def run(batches):
        for b in slices(batches, 2, 500_000):
            out: list[list] = [[] for _ in names]
            for doc, th, text, parts in zip(*(b.column(k) for k in range(4))):
                raw = text.as_buffer().to_pybytes()
                doc, th = doc.as_py(), th.as_py()
                for p in parts.as_py():
                    place, low, high = p["place"], p["place"] - p["last"], p["place"] - p["first"]      # bytes of a window before its anchor
                    for k in range(low // band, high // band + 1):
                        core = place - k * band                                 # the core starts here
                        lo, hi = max(low, k * band) - k * band, min(high, k * band + band - 1) - k * band
                        end = core + length - band + 1
                        digest = xxhash.xxh3_128_digest(raw[core:end], seed=(p["anchor"] ^ k) & 0xFFFFFFFFFFFFFFFF)
                        left, right = raw[core - hi:core], raw[end:end + band - 1 - lo]
                        for column, v in zip(out, (digest, left, right, lo, hi, doc, th, core, p["own"])):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    names = ["core", "left", "right", "lo", "hi", "doc_id", "th", "at", "own"]
    kinds = [pa.binary()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.int32(), pa.bool_()]
    return joined.mapInArrow(run, "core binary, left binary, right binary, lo int, hi int, doc_id long, th long, at int, own boolean")


# ---------------------------------------------------------------- interval expansion

def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; all suffixes differ once unique separators are reached."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[:n - width] = rank[width:]
        key = rank * (n + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2
        if new[-1] == n - 1 or width >= n:
            return order


def bounded_prefixes(symbols: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, cut at ``limit``.

    The interval of a string w is the range of suffixes that start with it. Putting a symbol in front of the intervals
    found at one depth gives those of the next; a right border met for the first time at depth d has common prefix d,
    and borders met before need no further extension.
    """
    n = len(symbols)
    bwt = symbols[order - 1]                                   # order 0 wraps to the last symbol
    # LF mapping: the suffix that starts one symbol earlier.
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lf = place[order - 1]
    value = np.full(n + 1, -1, np.int32)
    value[0] = value[n] = 0
    lb, rb = np.array([0]), np.array([n - 1])
    for depth in range(limit):
        width = rb - lb + 1
        before = np.cumsum(width) - width
        which = np.repeat(np.arange(len(lb)), width)
        at = np.repeat(lb - before, width) + np.arange(int(width.sum()))
        back = lf[at]
        char = bwt[at]
        # Inside an interval, LF sorts by the symbol put in front; a change of symbol ends the extended interval.
        o = np.argsort(which * np.int64(n) + back)
        which, back, char = which[o], back[o], char[o]
        head = np.concatenate([[True], (which[1:] != which[:-1]) | (char[1:] != char[:-1])])
        first = np.flatnonzero(head)
        lo, hi = back[first], back[np.append(first[1:], len(back)) - 1]
        fresh = value[hi + 1] < 0
        value[hi[fresh] + 1] = depth
        lb, rb = lo[fresh], hi[fresh]
        if len(lb) == 0:
            break
    value = value[:n]
    value[value < 0] = limit
    return value


def repeated_windows(strings: list[tuple[bytes, bytes, bytes, int, int]], band: int) -> list[np.ndarray]:
    """For each (core, left, right, lo, hi): the k in [lo, hi] whose window, k bytes before the core to band - 1 - k after
    it, is also a window of another string with the same core."""
    cores = {c: i for i, c in enumerate(dict.fromkeys(s[0] for s in strings))}
    m = len(strings)
    # Symbols: one separator per string, then bytes, then cores.
    size = np.array([len(s[1]) + len(s[2]) + 2 for s in strings])
    base = np.cumsum(size) - size
    symbols = np.empty(int(size.sum()), np.int64)
    for i, (core, left, right, _, _) in enumerate(strings):
        a, b = base[i], base[i] + len(left)
        symbols[a:b] = np.frombuffer(left, np.uint8)
        symbols[b] = 256 + cores[core]
        symbols[b + 1:b + 1 + len(right)] = np.frombuffer(right, np.uint8)
    symbols += m
    symbols[base + size - 1] = np.arange(m)
    order = suffix_order(symbols)
    lcp = bounded_prefixes(symbols, order, band)
    long = np.zeros(len(symbols), bool)
    hit = lcp >= band
    long[order[hit]] = True
    long[order[np.flatnonzero(hit) - 1]] = True
    out = []
    for i, (_, left, _, lo, hi) in enumerate(strings):
        k = np.arange(lo, hi + 1)
        out.append(k[long[base[i] + len(left) - k]])
    return out


def _ranges(k: np.ndarray) -> list[tuple[int, int]]:
    if len(k) == 0:
        return []
    edge = np.flatnonzero(np.concatenate([[True], np.diff(k) != 1]))
    return [(int(k[a]), int(k[b - 1])) for a, b in zip(edge, np.append(edge[1:], len(k)))]


def expand(bands: DataFrame, length: int, band: int) -> DataFrame:
    """bands with different contexts per core -> doc_id, th, start, end of repeated bytes."""

    def solve(held):
        found = repeated_windows([(r[0], r[1], r[2], r[3], r[4]) for r in held], band)
        rows = [(r[5], r[6], r[7] - hi, r[7] - lo + length) for r, k in zip(held, found) if r[8] for lo, hi in _ranges(k)]
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], pa.int64()) for j in range(4)], ["doc_id", "th", "start", "end"])

    def run(batches):
        held, symbols = [], 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(9))):
                if symbols > BATCH_SYMBOLS and row[0] != held[-1][0]:
                    yield solve(held)
                    held, symbols = [], 0
                held.append(row)
                symbols += len(row[1]) + len(row[2]) + 2
        if held:
            yield solve(held)

    cols = bands.select("core", "left", "right", "lo", "hi", "doc_id", "th", "at", "own")
    return cols.repartition("core").sortWithinPartitions("core").mapInArrow(run, "doc_id long, th long, start long, end long")


def count_windows(bands: DataFrame, length: int, band: int) -> DataFrame:
    """The same for cores with very many contexts: each window's digest is counted."""
    w = bands.withColumn("k", F.explode(F.sequence("lo", "hi")))
    window = F.sha2(F.concat(F.expr("substring(left, length(left) - k + 1, k)"), F.lit(bytearray(b"\x00")), F.expr(f"substring(right, 1, {band - 1} - k)")), 256)
    w = w.select("core", "k", window.alias("w"), "doc_id", "th", "at", "own")
    twice = w.groupBy("core", "k", "w").agg(F.count("*").alias("n")).filter("n > 1").select("core", "k", "w")
    return w.filter("own").join(twice, ["core", "k", "w"], "left_semi").select(
        "doc_id", "th", (F.col("at") - F.col("k")).cast("long").alias("start"), (F.col("at") - F.col("k") + length).cast("long").alias("end"))


# ---------------------------------------------------------------- whole operator

def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot_core: int = HOT_CORE) -> DataFrame:
    """doc_id, th, start, end: byte ranges whose union is all that repeats."""
    band = min(BAND, (length - K + 1 + 3) // 4)
    rows = _documents(docs, id_col, text_col)
    segs = materialise(segment_table(rows.filter(F.octet_length("text") >= length), length), "segments")
    # Anchors that occur again; the others leave here.
    again = segs.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("seg_a") != F.max("seg_a")).alias("mixed")).filter("n > 1")
    # Written first: with plain exchanges on both sides, Spark can split the join on a hot anchor.
    again = materialise(again.select("anchor", "mixed"), "again")
    live = materialise(segs.join(again, "anchor"), "live")
    kinds = live.groupBy("anchor", "seg_a", "seg_b").agg(F.count("*").alias("times"), F.max("mixed").alias("mixed"),
                                                         F.min(F.struct("doc_id", "th", "first", "last", "place")).alias("one"))
    kinds = materialise(kinds, "kinds")
    same = kinds.filter("times > 1").select("anchor", "seg_a", "seg_b")
    whole = live.join(same, ["anchor", "seg_a", "seg_b"], "left_semi").select(
        "doc_id", "th", F.col("first").cast("long").alias("start"), (F.col("last") + length).cast("long").alias("end"))
    wanted = kinds.filter("mixed").select("anchor", "one.*", (F.col("times") == 1).alias("own"))
    bands = materialise(band_table(rows, wanted, length, band), "bands")
    cores = bands.groupBy("core").agg(F.count("*").alias("n"), F.max("own").alias("open")).filter("n > 1 AND open")
    hot = materialise(cores.select("core", (F.col("n") > hot_core).alias("hot")), "cores")
    open_ = bands.join(hot, "core")
    return whole.unionByName(expand(open_.filter("NOT hot"), length, band)).unionByName(count_windows(open_.filter("hot"), length, band))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of start, end) and the kept bytes."""
    rows = _documents(docs, id_col, text_col)
    spans = materialise(repeated_spans(docs, id_col, text_col, length), "spans")
    per_doc = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["doc_id"]) & (rows["th"] == per_doc["th"]), "left").select(rows["doc_id"], "text", "spans")

    def run(batches):
        for b in slices(batches, 1):
            out = []
            for doc, text, spans_ in zip(*(b.column(k) for k in range(3))):
                raw = text.as_buffer().to_pybytes() if len(text.as_py()) else b""
                merged: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in spans_.as_py() or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                kept, at = [], 0
                for s, e in merged:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                out.append((doc.as_py(), len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(),
                            [{"start": s, "end": e} for s, e in merged], kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names)

    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] + ([pa.binary()] if with_bytes else [])
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"] + (["kept"] if with_bytes else [])
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                  "removed array<struct<start:long, end:long>>" + (", kept binary" if with_bytes else ""))
