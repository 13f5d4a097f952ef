"""Documents whose sets of word shingles overlap: a blocked sparse product with bounds from the set sizes.

The incidence matrix has a row per distinct shingle set and a column per shingle. All 64-bit hashes.

1. ``shingle_sets``: size and 128-bit identity of each document's set; copies share a row from here on.
2. ``survivors``: the matrix in blocks of columns. A block task counts, for each row, the columns that another row has
   too. A row needs at least ``threshold`` of its size in shared columns, so most rows leave before any pair is formed.
   Column hashes are cut to 32 bits inside a block here; a clash can only keep a row too many.
3. ``loose_clusters``: rows that can meet share one of the ``size - ceil(threshold * size) + 1`` shingles of theirs that
   are rarest in what is left of the matrix, and their sizes differ little. Each such shingle hangs its rows of one size
   band on one of them, and neighbouring bands on each other; the components are the diagonal blocks of the product.
   Rare columns first keeps passages that many documents quote from tying all of them together.
4. ``block_links``: the product of a cluster with itself in blocks of at most BLOCK_ROWS rows and BLOCK_CELLS entries. Overlap counts
   accumulate along the postings of a pivot row. A pair inside one component cannot change the result, so rows already
   joined need no pivot of their own and a group of n near copies costs about n overlaps, not n * n. Larger clusters
   first join within blocks, then through representatives, and at last every row outside its cluster's largest
   component meets all rows of the cluster: these rows are cut into blocks too, and a task holds one pair of blocks, each
   about half full. Only spanning links leave a task.

Texts: null counts as empty; empty sets link with nothing and keep their own id. Rows are documents of their own, so an id
that names two texts may lie in two components; a null id never names a component. ``keep_one`` lets one row of each component
stay, however often it is repeated.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.core.common import LOOKUP_ROWS, lookup
from cadenza.core.session import materialise, parallelism
from cadenza.llm.arrow_text import Texts, mix, release, slices, window_hashes
from cadenza.llm.components import components
from cadenza.llm.exact_dedup import without

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
THRESHOLD = 80              # per cent
BLOCK_ENTRIES = 2_000_000   # matrix entries of a block of columns
BUCKET_SETS = 500_000       # rows whose counts one task adds up
BLOCK_ROWS = 2_048          # rows of a block of the product
BLOCK_CELLS = 2_000_000     # and its entries, unless a single row has more
_U = np.uint64


# ---------------------------------------------------------------- shingles

def distinct_shingles(col: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted by text and hash."""
    texts = Texts.of(col)
    owner, start, end = texts.words()
    words = texts.hasher(lower=True)(start, end)
    first, h = window_hashes(words, owner, width)
    own = owner[first]
    count = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        at = np.searchsorted(owner, short)
        acc = np.full(len(short), 0x51ED270B, _U) + count[short].astype(_U)
        for k in range(width - 1):
            live = count[short] > k
            acc[live] = mix(acc[live] + words[at[live] + k])
        h, own = np.concatenate([h, acc]), np.concatenate([own, short])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return own[new], h[new]


def _identities(own: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.bincount(own, minlength=n)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for salt in (0x5bd1e995, 0x2545F4914F6CDD1D):
        total = np.zeros(len(h) + 1, _U)
        np.cumsum(mix(h ^ _U(salt)), out=total[1:])
        out.append(mix(total[ends[1:]] - total[ends[:-1]] + sizes.astype(_U)).view(np.int64))
    return sizes, out[0], out[1]


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, with_digest: bool = False) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b: equal sets have equal (set_a, set_b). ``with_digest`` adds text_sha256."""
    more = ["text_sha256"] if with_digest else []

    def run(batches):
        for b in slices(batches, 1):
            own, h = distinct_shingles(b.column(1))
            n, a, c = _identities(own, h, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(a), pa.array(c), *b.columns[2:]],
                                             ["doc_id", "n_shingles", "set_a", "set_b", *more])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       *(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias(c) for c in more))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long" + "".join(f", {c} string" for c in more))


# ---------------------------------------------------------------- bound by shared columns

def shared_columns(docs: DataFrame, text_col: str, blocks: int, buckets: int) -> DataFrame:
    """set_a, shared: an upper bound of the columns that the row shares with any other row."""

    def entries(batches):
        for b in slices(batches, 0):
            own, h = distinct_shingles(b.column(0))
            _, a, _ = _identities(own, h, len(b))
            block = (h % _U(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            block, own, cut = block[order], own[order], (h[order] >> _U(32)).astype("<u4")
            edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.empty(0, np.int64)
            rows = []
            for lo, hi in zip(edge, np.append(edge[1:], len(block))):
                who = own[lo:hi]
                new = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                rows.append((int(block[lo]), a[who[new]].tobytes(), np.diff(np.append(new, hi - lo)).astype("<u4").tobytes(), cut[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))],
                                             ["block", "sets", "counts", "hashes"])

    def count(batches):
        sets, hashes, blocks_of = [], [], []
        for b in batches:
            for block, s, c, h in zip(*(b.column(k).to_pylist() for k in range(4))):
                sets.append(np.repeat(np.frombuffer(s, np.int64), np.frombuffer(c, "<u4")))
                hashes.append(np.frombuffer(h, "<u4"))
                blocks_of.append(np.full(len(hashes[-1]), block, np.int32))
        if not sets:
            return
        sets, hashes, blocks_of = np.concatenate(sets), np.concatenate(hashes), np.concatenate(blocks_of)
        key = hashes.astype(_U) | (blocks_of.astype(_U) << _U(32))
        del hashes, blocks_of
        order = np.lexsort((sets, key))
        key, sets = key[order], sets[order]
        del order
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sets[1:] != sets[:-1])        # copies of a set count once
        key, sets = key[new], sets[new]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        who, n = np.unique(sets[same], return_counts=True)
        # Partial counts travel in one row per bucket of sets.
        bucket = (who.view(_U) % _U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, who, n = bucket[order], who[order], n[order].astype("<u4")
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
        stop = np.append(edge[1:], len(bucket)) if len(edge) else edge
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.array([who[i:j].tobytes() for i, j in zip(edge, stop)], pa.binary()),
                                          pa.array([n[i:j].tobytes() for i, j in zip(edge, stop)], pa.binary())], ["bucket", "sets", "counts"])
        del key, sets, same, order, bucket, who, n
        release()

    def total(batches):
        who, n, held, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged():
            keys, at = np.unique(np.concatenate([who, *(np.frombuffer(s, np.int64) for s, _ in held)]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([n, *(np.frombuffer(c, "<u4") for _, c in held)]), minlength=len(keys)).astype(np.int64)

        for b in batches:
            for s, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                held.append((s, c))
                size += len(c) // 4
                if size > 2_000_000:
                    (who, n), held, size = merged(), [], 0
        who, n = merged()
        for lo in range(0, len(who), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(who[lo:lo + 100_000]), pa.array(n[lo:lo + 100_000])], ["set_a", "shared"])
        del who, n
        release()

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(entries, "block int, sets binary, counts binary, hashes binary")
    counted = parts.repartitionById(blocks, F.col("block")).mapInArrow(count, "bucket int, sets binary, counts binary")
    return counted.repartitionById(buckets, F.col("bucket")).mapInArrow(total, "set_a long, shared long")


def survivors(docs: DataFrame, sets: DataFrame, text_col: str, threshold: int) -> DataFrame:
    """One row per distinct set that may have a partner: set_a, rep (a document that has it)."""
    spark = docs.sparkSession
    entries, documents = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    blocks = max(-(-entries // BLOCK_ENTRIES), min(parallelism(spark), 1 + entries // 10_000))
    rows = sets.filter("n_shingles > 0").groupBy("set_a").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    bound = shared_columns(docs, text_col, int(blocks), max(-(-documents // BUCKET_SETS), min(parallelism(spark), 1 + documents // 1000)))
    return materialise(rows.join(bound, "set_a").filter(F.col("shared") * 100 >= F.col("n") * threshold).select("set_a", "rep"), "survivors")


def matrix_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """set_a, hashes (sorted): the rows of the matrix that are left."""
    n = kept.count()
    ids = kept.select(F.col("rep").alias("doc_id")).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # A null id is the only name of its row, so such rows are looked at by their set below.
    rows = rows.join(F.broadcast(ids) if n <= LOOKUP_ROWS else ids, "doc_id", "left_semi").unionByName(
        rows.filter("doc_id IS NULL"))

    def run(batches):
        for b in slices(batches, 0):
            own, h = distinct_shingles(b.column(0))
            n, a, _ = _identities(own, h, len(b))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))],
                ["set_a", "hashes"])

    found = rows.select("text").mapInArrow(run, "set_a long, hashes array<long>")
    return found.join(lookup(kept.select("set_a"), n), "set_a", "left_semi").dropDuplicates(["set_a"])


# ---------------------------------------------------------------- product

def rare_columns(matrix: DataFrame, threshold: int) -> DataFrame:
    """set_a, n, h: the rarest n - ceil(threshold * n / 100) + 1 columns of each row, ties by hash, without columns of one row."""
    cells = matrix.select("set_a", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    shared = cells.groupBy("h").agg(F.count("*").alias("rows")).filter("rows > 1")
    own = Window.partitionBy("set_a")
    ranked = cells.join(shared, "h").select("set_a", "n", "h", F.count("*").over(own).alias("shared"), F.row_number().over(own.orderBy("rows", "h")).alias("k"))
    # The columns that no other row has come first of all.
    return ranked.filter(F.col("k") + F.col("n") - F.col("shared") <= F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1).select("set_a", "n", "h")


def loose_clusters(matrix: DataFrame, threshold: int) -> DataFrame:
    """set_a, n, cluster. Rows of different clusters cannot be linked; rows alone in a cluster are left out."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / threshold)) - 1e-9)
    lists = materialise(rare_columns(matrix, threshold).withColumn("band", band), "rare")
    head = lists.groupBy("h", "band").agg(F.min("set_a").alias("head"))
    head = materialise(head, "heads")
    inside = lists.join(head, ["h", "band"]).select(F.col("set_a").alias("a"), F.col("head").alias("b"))
    up = head.select("h", (F.col("band") + 1).alias("band"), F.col("head").alias("a"))
    # Sizes within the threshold lie at most one band apart, or two where rounding puts them on a border.
    far = head.select("h", (F.col("band") + 2).alias("band"), F.col("head").alias("a"))
    across = up.unionByName(far).join(head, ["h", "band"]).select("a", F.col("head").alias("b"))
    member = components(inside.unionByName(across)).select(F.col("node").alias("set_a"), F.col("component").alias("cluster"))
    return member.join(lists.select("set_a", "n").distinct(), "set_a")


def block_links(keys: np.ndarray, sets: list[np.ndarray], known: np.ndarray, threshold: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of the rows of one block of the product.

    ``known`` holds a component number per row; pairs inside a component are not looked at. With ``side`` (0 or 1 per row)
    only pairs of different sides are.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    columns, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(column, kind="stable")
    postings = row[order]
    if side is not None:
        order = order[side[postings] == 1]      # the other side's rows are pivots only
        postings = row[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(column[order], minlength=len(columns)))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    comp = np.unique(known, return_inverse=True)[1]
    waiting = np.ones(m, bool) if side is None else side == 0
    links = []
    while True:
        rest = np.flatnonzero(waiting)
        if side is None:
            if len(rest) < 2:
                return links
            counts = np.bincount(comp[rest])
            if len(rest) == counts.max():
                return links                        # all that is left is one component
            small = rest[comp[rest] != counts.argmax()] if counts.max() > 1 else rest
        else:
            facing = np.unique(comp[side == 1])
            small = rest[comp[rest] != facing[0]] if len(facing) == 1 else rest
            if len(small) == 0:
                return links
        pivot = small[0]
        waiting[pivot] = False
        cols = column[at[pivot]:at[pivot + 1]]
        width = first[cols + 1] - first[cols]
        before = np.cumsum(width) - width
        met = postings[np.repeat(first[cols] - before, width) + np.arange(int(width.sum()))]
        overlap = np.bincount(met, minlength=m)
        # overlap / union >= threshold; sizes that differ too much fail it by themselves
        hit = (overlap * (100 + threshold) >= threshold * (sizes + sizes[pivot])) & (overlap > 0)
        for other in np.unique(comp[hit]):
            if other != comp[pivot]:
                j = np.flatnonzero(hit & (comp == other))[0]
                links.append((int(keys[pivot]), int(keys[j])))
                comp[comp == other] = comp[pivot]


def _links(blocks: DataFrame, threshold: int) -> DataFrame:
    """blocks(cluster, block, against, side, set_a, known, hashes) -> links a, b found inside each block, or between two (side 0 and 1)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        side = None if pdf["block"].iloc[0] == pdf["against"].iloc[0] else side
        found = block_links(pdf["set_a"].to_numpy(), [np.asarray(x) for x in pdf["hashes"]], pdf["known"].to_numpy(), threshold, side) if len(pdf) > 1 else []
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return blocks.groupBy("cluster", "block", "against").applyInPandas(run, "a long, b long")


def _joined(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows(set_a, ...) with known := component under the links found so far."""
    comp = components(links)
    return rows.drop("known").join(comp.select(F.col("node").alias("set_a"), F.col("component").alias("_c")), "set_a", "left").withColumn(
        "known", F.coalesce("_c", "set_a")).drop("_c")


def block_pairs(rows: DataFrame) -> DataFrame:
    """Repeat ``rows`` (guest, block, blocks, numbered within cluster and guest) for all pairs of blocks that hold a guest.

    A guest is a row outside its cluster's largest component. Guest blocks are numbered from 0, the others -1, -2, ... A
    pair is (block, against), block being a guest block and side 0, and no pair of guest blocks comes in both orders.
    """
    span = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    wide = rows.groupBy("cluster").agg(F.max(F.when(F.col("guest"), F.col("blocks"))).alias("_g"), F.max(F.when(~F.col("guest"), F.col("blocks"))).alias("_t"))
    d = rows.join(wide, "cluster")
    keep = [c for c in rows.columns if c != "block"]
    guests, top = d.filter("guest"), d.filter("NOT guest")
    ahead = guests.withColumn("against", F.explode(F.concat(span(-F.col("_t"), -one), span(F.col("block"), F.col("_g") - 1)))).select(
        *keep, "block", "against", F.lit(0).alias("side"))
    behind = guests.withColumnRenamed("block", "against").withColumn("block", F.explode(span(zero, F.col("against") - 1))).select(
        *keep, "block", "against", F.lit(1).alias("side"))
    rest = top.withColumn("against", -one - F.col("block")).withColumn("block", F.explode(span(zero, F.col("_g") - 1))).select(
        *keep, "block", "against", F.lit(1).alias("side"))
    return ahead.unionByName(behind).unionByName(rest)


def set_links(matrix: DataFrame, threshold: int, block_rows: int = BLOCK_ROWS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Links a, b between sets whose components are those of all pairs at or above the threshold."""
    member = materialise(loose_clusters(matrix, threshold).withColumn("known", F.col("set_a")), "clusters")
    columns = ["set_a", "cluster", "block", "against", "side", "known"]

    def blocked(rows: DataFrame, by: tuple[str, ...] = ("cluster",)) -> DataFrame:
        """Rows of a cluster fall to blocks by a digest of their own; a block is about half full."""
        size = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum("n").alias("cells"))
        need = F.greatest(F.col("rows") / block_rows, F.col("cells") / block_cells)
        size = materialise(size.select(*by, F.when(need <= 1, 1).otherwise(F.ceil(need * 2)).cast("long").alias("blocks")), "sizes")
        return rows.join(size, list(by)).withColumn("block", F.pmod(F.xxhash64("set_a"), "blocks"))

    def products(rows: DataFrame) -> DataFrame:
        return materialise(_links(rows.select(*columns).join(matrix, "set_a"), threshold), "links")

    def alone(rows: DataFrame) -> DataFrame:
        return products(rows.withColumns({"against": F.col("block"), "side": F.lit(0)}))

    first = materialise(blocked(member), "blocks")
    found = alone(first)
    large = first.filter("blocks > 1").select("set_a", "n", "cluster", "known")
    n_large = left = large.count()
    while left:
        # One representative per component; blocks of representatives until they stop shrinking.
        now = _joined(large, found)
        heads = materialise(now.groupBy("cluster", "known").agg(F.min_by(F.struct("set_a", "n"), "set_a").alias("_h")).select("cluster", "known", "_h.*"), "heads")
        several = heads.groupBy("cluster").agg(F.count("*").alias("heads")).filter("heads > 1").select("cluster")
        open_ = heads.join(several, "cluster", "left_semi")
        count = open_.count()
        if count == 0 or count > 0.9 * left:
            break
        left = count
        found = materialise(found.unionByName(alone(blocked(open_))), "links")
    if n_large:
        now = materialise(_joined(large, found), "joined")
        comps = now.groupBy("cluster", "known").agg(F.count("*").alias("rows"))
        top = comps.groupBy("cluster").agg(F.max_by("known", F.struct("rows", "known")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
        now = now.join(top.select("cluster", "top"), "cluster").withColumn("guest", F.col("known") != F.col("top"))
        found = found.unionByName(products(block_pairs(materialise(blocked(now, ("cluster", "guest")), "sides"))))
    return found


def _components_of_sets(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, threshold: int, block_rows: int) -> DataFrame:
    """set_a, set_b, rep (smallest id that has the set), component (null without a link) of every set that is not empty."""
    kept = survivors(docs, sets, text_col, threshold)
    matrix = materialise(matrix_rows(docs, kept, id_col, text_col), "matrix")
    links = set_links(matrix, threshold, block_rows)
    reps = sets.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    linked = components(links).select(F.col("node").alias("set_a"), "component")
    return reps.join(linked, "set_a", "left")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD,
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links); one row per input row."""
    sets = materialise(shingle_sets(docs, id_col, text_col), "sets")
    named = _components_of_sets(docs, sets, id_col, text_col, threshold, block_rows)
    lowest = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("lowest"))
    names = named.join(lowest, "component", "left").select("set_a", "set_b", F.coalesce("lowest", "rep").alias("component_id"))
    return sets.join(names, ["set_a", "set_b"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each component, all columns unchanged: the one with the smallest id, and of several texts under
    it the one with the smallest digest. A component without any id keeps one row as well. Rows without words link with
    nothing, so of them only repeated rows go."""
    sets = materialise(shingle_sets(docs, id_col, text_col, with_digest=True), "sets")
    named = _components_of_sets(docs, sets, id_col, text_col, threshold, BLOCK_ROWS)
    named = named.select("set_a", "set_b", F.coalesce("component", "set_a").alias("g"), F.when(F.col("component").isNull(), F.col("set_b")).alias("alone"))
    rows = sets.groupBy("doc_id", "text_sha256", "set_a", "set_b", "n_shingles").agg(F.count("*").alias("n"))
    rows = materialise(rows.join(named.withColumnsRenamed({"set_a": "_a", "set_b": "_b"}), (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b"))
                                 & (F.col("n_shingles") > 0), "left").select("doc_id", "text_sha256", "g", "alone", "n"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_sha256")).alias("first")
    stays = rows.filter("g IS NOT NULL").groupBy("g", "alone").agg(first, F.count("*").alias("size")).filter("size > 1")
    stays = stays.select(F.col("g").alias("_g"), F.col("alone").alias("_alone"), "first")
    met = rows.join(stays, (F.col("g") == F.col("_g")) & F.col("alone").eqNullSafe(F.col("_alone")), "left")
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_sha256") == F.col("first.text_sha256")))
    return without(docs, met.select("doc_id", "text_sha256", (F.col("first").isNotNull() & other).alias("gone"), "n"), id_col, text_col)
