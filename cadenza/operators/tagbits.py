"""Counts over tag sets: shared tags by adding rows of bits or from tables of superset sums, pairs of tags by matrix products.

A block of sets is one row of bits a tag. Blocks are broadcast in groups of bounded size, and the other side streams past them; for
each of its sets the rows of its tags are added digit by digit, 64 sets a word, and the digits are counted. Only these short
histograms move on, never a pair.

Blocks are quadratic in the distinct sets. Of few tags, many sets meet in tables instead, which are linear in the sets: see ``table_histograms``.
"""

from __future__ import annotations

import sys
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import DIMENSION_ROWS, union_all
from cadenza.core.session import materialise, parallelism

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 19             # sets of a block at most
BLOCK_BYTES = 16 << 20      # of the bits of a block, a row of bits a tag
GROUP_BYTES = 64 << 20      # of blocks broadcast at once
QUERIES = 1 << 17           # sets that meet the blocks in one row


def _codes(sets: DataFrame, tags: list[str], keep: str) -> DataFrame:
    """(keep, c): the sets as lists of tag numbers; unknown tags are left out."""
    def run(batches):
        known = pa.array(tags, pa.string())
        for b in batches:
            s = b.column("s")
            at = pc.fill_null(pc.index_in(s.flatten(), value_set=known), -1).to_numpy().astype(np.int32)
            row = np.repeat(np.arange(len(s)), s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            row, at = row[at >= 0], at[at >= 0]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(s)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.ListArray.from_arrays(pa.array(ends), pa.array(at))], [keep, "c"])

    return sets.select(F.col(keep).cast("long").alias(keep), "s").mapInArrow(run, f"{keep} long, c array<int>").filter(F.size("c") > 0)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)


def tag_planes(bits: list[np.ndarray]) -> list[np.ndarray]:
    """Binary digits, lowest first, of how many of the bits are set at each place: full adders over whole rows of bits."""
    planes = []
    while bits:
        p, carried, i = bits[0], [], 1
        while i < len(bits):
            if i + 1 < len(bits):
                u = p ^ bits[i]
                carried.append((p & bits[i]) | (u & bits[i + 1]))
                p = u ^ bits[i + 1]
                i += 2
            else:
                carried.append(p & bits[i])
                p = p ^ bits[i]
                i += 1
        planes.append(p)
        bits = carried
    return planes


def _joint(planes: list[np.ndarray], at: int, out: np.ndarray) -> None:
    """out[at + m]: places where all planes of the mask m are set; sparse planes are followed only where they have bits."""
    for i, p in enumerate(planes):
        n = int(np.bitwise_count(p).sum())
        out[at + (1 << i)] = n
        if n and i:
            if n * 8 < len(p):
                nz = np.flatnonzero(p)
                some = p[nz]
                _joint([x[nz] & some for x in planes[:i]], at + (1 << i), out)
            else:
                _joint([x & p for x in planes[:i]], at + (1 << i), out)


def shared_histograms(left: DataFrame, right: DataFrame, block: int | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(sid, shared, n_items): how much weight of ``right(s, w)`` shares exactly ``shared`` >= 1 tags with each ``left(sid, s)``."""
    spark = left.sparkSession
    tags = sorted(r["tag"] for r in left.select(F.explode("s").alias("tag")).distinct().limit(DIMENSION_ROWS + 1).collect())
    if len(tags) > DIMENSION_ROWS:
        raise ValueError(f"more than {DIMENSION_ROWS} tags")
    n_tags = max(len(tags), 1)
    block = block or max(min(BLOCK, 8 * BLOCK_BYTES // n_tags), 64)

    # A set of weight w lies in a block of every binary digit of w.
    digits = F.expr("explode(filter(sequence(0, 62), k -> (w & shiftleft(1L, k)) <> 0)) AS k")
    entries = materialise(_codes(right, tags, "w").select("c", "w", digits).drop("w"), "coded-sets")
    blocks, first = 0, {}
    for r in entries.groupBy("k").agg(F.count("*").alias("n")).orderBy("k").collect():
        first[r["k"]] = blocks, -(-r["n"] // block)
        blocks += first[r["k"]][1]
    if not blocks:
        return spark.createDataFrame([], "sid long, shared int, n_items long")
    of_digit = lambda i: F.element_at(F.lit([first.get(k, (0, 1))[i] for k in range(63)]), F.col("k") + 1)
    entries = entries.withColumn("part", (of_digit(0) + F.pmod(F.xxhash64("c"), of_digit(1))).cast("int"))

    def vertical(table: pa.Table) -> pa.Table:
        flat, size = _flat(table.column("c").combine_chunks())
        order = np.argsort(flat, kind="stable")
        row, ends = np.repeat(np.arange(len(size)), size)[order], np.searchsorted(flat[order], np.arange(n_tags + 1))
        bits = np.zeros((n_tags, -(-len(size) // 64) * 8), np.uint8)
        for t in range(n_tags):
            one = np.zeros(bits.shape[1] * 8, bool)
            one[row[ends[t]:ends[t + 1]]] = True
            bits[t] = np.packbits(one, bitorder="little")
        return pa.table([pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([table.column("k")[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())],
                        names=["part", "k", "bits"])

    stored = materialise(entries.groupBy("part", "k").applyInArrow(vertical, "part int, k int, bits binary"), "tag-blocks")

    def packed(batches):
        def row(held):
            cut = pa.Table.from_batches(held).combine_chunks()
            flat, size = _flat(cut.column("c").combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (cut.column("sid").to_numpy().astype("<i8"), flat.astype("<i4"), size.astype("<i4"))],
                                              ["sids", "codes", "sizes"])

        held = []
        for b in batches:
            if sum(map(len, held)) + len(b) > QUERIES:
                yield row(held)
                held = []
            if len(b):
                held.append(b)
        if held:
            yield row(held)

    q = _codes(left, tags, "sid")
    parts = max(min(4 * parallelism(spark), left.count() // 256), 1)
    q = materialise(q.repartition(parts), "coded-queries").repartition(parts).mapInArrow(packed, "sids binary, codes binary, sizes binary")
    share = max(int(group_bytes * 8 // (n_tags * block)), 1)

    def run(batches):
        mine, total, cuts = None, None, None

        def done():
            row, shared = np.nonzero(total[:, 1:])
            return pa.RecordBatch.from_arrays([pa.array(mine[row]), pa.array(shared + 1, pa.int32()), pa.array(total[row, shared + 1])], ["sid", "shared", "n_items"])

        for b in batches:
            for i in range(len(b)):
                get = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)  # noqa: E731, B023
                sids, size, k = get("sids", "<i8"), get("sizes", "<i4"), b.column("k")[i].as_py()
                depth = int(size.max()).bit_length()
                if mine is None or len(mine) != len(sids) or (mine != sids).any():
                    if mine is not None:
                        yield done()
                    mine, total, cuts = sids.copy(), np.zeros((len(sids), 1 << depth), np.int64), np.split(get("codes", "<i4"), np.cumsum(size)[:-1])
                bits = get("bits", np.uint64).reshape(n_tags, -1)
                found = np.zeros((len(sids), 1 << depth), np.int64)
                for j, c in enumerate(cuts):
                    _joint(tag_planes([bits[t] for t in c]), 0, found[j])
                # From "at least these digits are set" to "exactly these".
                for d in range(depth):
                    view = found.reshape(len(sids), -1, 2, 1 << d)
                    view[:, :, 0] -= view[:, :, 1]
                total[:, 1:] += found[:, 1:] << k
        if mine is not None:
            yield done()

    found = []
    for lo in range(0, blocks, share):
        some = stored.filter(F.col("part").between(lo, min(lo + share, blocks) - 1)).drop("part")
        part = q.crossJoin(F.broadcast(some)).mapInArrow(run, "sid long, shared int, n_items long")
        found.append(part if share >= blocks else materialise(part, "tag-histograms"))
    return union_all(found).groupBy("sid", "shared").agg(F.sum("n_items").alias("n_items"))


MASK_TAGS = 62              # tags of a vocabulary whose sets are whole numbers
TABLE_TAGS = 25             # tags of a table at most
TABLE_QUERIES = 1 << 18     # sets that are looked up in one table
TABLE_SETS = 1 << 20        # sets of a packed row
LOOKUPS = 1 << 20           # places of a table read at once
LEAST_PAIRS = 1 << 34       # of sets, below which blocks are not compared with tables
# Measured seconds of a core: a pair of sets in blocks; a place of a table, a set added to it, a place looked up.
PAIR_S, PLACE_S, ADD_S, LOOKUP_S = 1.1e-8, 1.2e-8, 3e-8, 1e-8


class Tables(NamedTuple):
    """Tags in the order of their bits. A table is over ``width`` of them from ``low`` on, and there is one for every subset of the others that a set holds."""

    tags: list[str]
    low: int
    width: int

    def parts(self, m: str) -> tuple[Column, Column]:
        """(the other bits, the table's place) of a mask."""
        core = F.expr(f"cast(shiftright({m}, {self.low}) & {(1 << self.width) - 1}L as int)")
        return F.expr(f"{m} & {~(((1 << self.width) - 1) << self.low)}L"), core


def _masks(sets: DataFrame, tags: list[str], keep: str) -> DataFrame:
    """(keep, m): the sets as masks of tag numbers; unknown tags are left out."""
    def run(batches):
        for b in batches:
            flat, size = _flat(b.column("c"))
            m = np.bitwise_or.reduceat(np.int64(1) << flat.astype(np.int64), np.cumsum(size) - size) if len(b) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(m)], [keep, "m"])

    return _codes(sets, tags, keep).mapInArrow(run, f"{keep} long, m long")


def table_plan(left: DataFrame, right: DataFrame) -> Tables | None:
    """The tables that cost least for ``table_histograms``, or None where blocks cost less or there are too many tags."""
    n_q, n_c = left.count(), right.count()
    if n_q * n_c < LEAST_PAIRS:
        return None
    rows = left.select(F.explode("s").alias("tag")).groupBy("tag").count().limit(MASK_TAGS + 1).collect()
    if len(rows) > MASK_TAGS:
        return None
    tags = [r["tag"] for r in sorted(rows, key=lambda r: (r["count"], r["tag"]))]
    plans = [Tables(tags, low, w) for w in range(min(8, len(tags)), min(TABLE_TAGS, len(tags)) + 1) for low in sorted({0, len(tags) - w})]
    costs = []
    for i, t in enumerate(plans):
        rest, core = t.parts("m")
        layers = F.bit_count(rest) + 1
        costs += [F.approx_count_distinct(rest, 0.02).alias(f"n{i}"), F.avg(layers).alias(f"l{i}"), F.sum(layers * F.pow(F.lit(2.0), F.bit_count(core))).alias(f"r{i}")]
    found = _masks(left, tags, "sid").agg(*costs).first()
    cost = [found[f"n{i}"] * ((found[f"l{i}"] or 1) * (1 << t.width) * PLACE_S + n_c * ADD_S) + (found[f"r{i}"] or 0) * LOOKUP_S for i, t in enumerate(plans)]
    best = min(range(len(plans)), key=cost.__getitem__, default=None)
    return plans[best] if best is not None and cost[best] < n_q * n_c * PAIR_S else None


def superset_sums(table: np.ndarray) -> None:
    """In place, table[a]: the sum over all places that hold the bits of a. Low bits are summed in pieces that stay in the cache."""
    width = len(table).bit_length() - 1
    low = min(width, 15)
    for at in range(0, len(table), 1 << low):
        x = table[at:at + (1 << low)]
        for d in range(low):
            if d < 4:
                for r in range(1 << d):
                    x[r::2 << d] += x[r + (1 << d)::2 << d]
            else:
                v = x.reshape(-1, 2, 1 << d)
                v[:, 0] += v[:, 1]
    for d in range(low, width):
        for v in table.reshape(-1, 2, 1 << d):
            v[0] += v[1]


def subset_histograms(sums: np.ndarray, sets: np.ndarray, most: int) -> np.ndarray:
    """(sets, 0 .. most): how much of the table shares exactly so many bits with each set, from its superset sums by inclusion and exclusion."""
    out = np.zeros((len(sets), most + 1), np.int64)
    size = np.bitwise_count(sets)
    for m in np.unique(size).tolist():
        mine = np.flatnonzero(size == m)
        bits, x = [], sets[mine].copy()
        for _ in range(m):
            bits.append(x & -x)
            x ^= bits[-1]
        wide = min(m, 16)
        held = np.bitwise_count(np.arange(1 << wide))
        order = np.argsort(held, kind="stable")
        starts = np.searchsorted(held[order], np.arange(wide + 1))
        exact = np.array([[comb(j, g) * (-1) ** (j - g) if j >= g else 0 for g in range(m + 1)] for j in range(m + 1)], np.int64)
        step = max(LOOKUPS >> wide, 1)
        for lo in range(0, len(mine), step):
            some = slice(lo, lo + step)
            at = np.zeros((len(mine[some]), 1), sets.dtype)
            for b in bits[:wide]:
                at = np.concatenate([at, at | b[some, None]], axis=1)
            at = at[:, order]
            found = np.zeros((len(at), m + 1), np.int64)
            for high in range(1 << (m - wide)):
                up = [b[some, None] for i, b in enumerate(bits[wide:]) if high >> i & 1]
                here = at
                for b in up:
                    here = here | b
                found[:, len(up):len(up) + wide + 1] += np.add.reduceat(sums.take(here), starts, axis=1, dtype=np.int64)
            out[mine[some], :m + 1] = found @ exact
    return out


def table_histograms(left: DataFrame, right: DataFrame, plan: Tables, table_sets: int = TABLE_SETS, queries: int = TABLE_QUERIES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``shared_histograms`` by tables of superset sums, linear in the sets.

    Sets that hold the same of the tags outside a table meet it together. For them the sets of ``right`` fall into layers by how many of those tags they
    share; a layer is one table, and each set reads the subsets of its own tags there. Packed sets are broadcast in groups of bounded size.
    """
    spark = left.sparkSession
    rest, core = plan.parts("m")
    merged = materialise(_masks(right, plan.tags, "w").groupBy("m").agg(F.sum("w").alias("w")), "masked-sets")
    n_c, total = merged.agg(F.count("*"), F.sum("w")).first()
    if not n_c:
        return spark.createDataFrame([], "sid long, shared int, n_items long")
    n_packs = -(-n_c // table_sets)
    kind = np.int32 if total < 1 << 31 else np.int64

    def held(table: pa.Table) -> pa.Table:
        r, c, w = (table.column(x).to_numpy() for x in ("rest", "core", "w"))
        order = np.lexsort((c, r))
        rests, sizes = np.unique(r, return_counts=True)
        w = w[order].astype(next(t for t in ("<u1", "<u2", "<u4", "<i8") if int(w.max()) <= np.iinfo(t).max))
        cells = [rests.astype("<i8"), sizes.astype("<i8"), c[order].astype("<i4"), w]
        return pa.table([table.column("pack").slice(0, 1)] + [pa.array([x.tobytes()], pa.binary()) for x in cells], names=["pack", "rests", "sizes", "places", "weights"])

    packs = merged.select(F.pmod(F.xxhash64("m"), F.lit(n_packs)).cast("int").alias("pack"), rest.alias("rest"), core.alias("core"), "w")
    packs = materialise(packs.groupBy("pack").applyInArrow(held, "pack int, rests binary, sizes binary, places binary, weights binary"), "packed-sets")
    size = packs.agg(F.sum((F.length("places") + F.length("weights")).cast("long"))).first()[0]
    share = max(int(group_bytes * n_packs // max(size, 1)), 1)

    def asking(table: pa.Table) -> pa.Table:
        sid, c = table.column("sid").to_numpy(), table.column("core").to_numpy()
        return pa.table([table.column("rest").slice(0, 1)] + [pa.array([x.tobytes()], pa.binary()) for x in (sid.astype("<i8"), c.astype("<i4"))], names=["rest", "sids", "cores"])

    q = materialise(_masks(left, plan.tags, "sid").select("sid", rest.alias("rest"), core.alias("core")), "masked-queries")
    cuts = q.groupBy("rest").agg(F.ceil(F.count("*") / queries).alias("_n"))
    q = q.join(cuts, "rest").withColumn("_cut", F.pmod(F.xxhash64("sid"), F.col("_n")))
    q = materialise(q.groupBy("rest", "_cut").applyInArrow(asking, "rest long, sids binary, cores binary").withColumn("no", F.monotonically_increasing_id()), "asking")
    q = q.repartition(max(min(q.count(), 8 * parallelism(spark)), 1))
    width = plan.width

    def run(batches):
        def done(rest, sids, cores, sets):
            own = int(rest).bit_count()
            most = int(np.bitwise_count(cores).max())
            out = np.zeros((len(sids), own + most + 1), np.int64)
            shared = [np.bitwise_count(rests & rest) for rests, _, _, _ in sets]
            for layer in range(own + 1):
                if not any((x == layer).any() for x in shared):
                    continue
                table.fill(0)
                for x, (_, sizes, places, weights) in zip(shared, sets):
                    ends = np.cumsum(sizes)
                    for k in np.flatnonzero(x == layer):            # the places of such a run are distinct
                        run = slice(ends[k] - sizes[k], ends[k])
                        table[places[run]] += weights[run].astype(kind)
                superset_sums(table)
                out[:, layer:layer + most + 1] += subset_histograms(table, cores, most)
            for lo in range(0, len(sids), TABLE_QUERIES // 4):
                row, many = np.nonzero(out[lo:lo + TABLE_QUERIES // 4, 1:])
                yield pa.RecordBatch.from_arrays([pa.array(sids[row + lo]), pa.array(many + 1, pa.int32()), pa.array(out[row + lo, many + 1])], ["sid", "shared", "n_items"])

        no, mine, sets, table = None, None, [], np.zeros(1 << width, kind)
        for b in batches:
            for i in range(len(b)):
                get = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                if b.column("no")[i].as_py() != no:
                    if mine is not None:
                        yield from done(*mine, sets)
                    no, sets = b.column("no")[i].as_py(), []
                    mine = np.int64(b.column("rest")[i].as_py()), get("sids", "<i8"), get("cores", "<i4")
                places = get("places", "<i4")
                sets.append((get("rests", "<i8"), get("sizes", "<i8"), places, get("weights", f"<{'i' if b.column('weights')[i].as_buffer().size == 8 * len(places) else 'u'}{b.column('weights')[i].as_buffer().size // len(places)}")))
        if mine is not None:
            yield from done(*mine, sets)

    found = []
    for lo in range(0, n_packs, share):
        some = packs.filter(F.col("pack").between(lo, min(lo + share, n_packs) - 1)).drop("pack")
        part = q.crossJoin(F.broadcast(some)).mapInArrow(run, "sid long, shared int, n_items long")
        found.append(part if share >= n_packs else materialise(part, "tag-histograms"))
    return union_all(found).groupBy("sid", "shared").agg(F.sum("n_items").alias("n_items")) if len(found) > 1 else found[0]


CELLS = 1 << 20             # of a matrix tracks x tags, and of a strip of the counts tags x tags
HELD_TAGS = 2048            # up to it a task holds its counts of all pairs; beyond it those of a strip of tracks move on


def pair_counts(n_tags: int):
    """Task function over rows (c) of codes ``4 * tag + 2 * y + p``: (i, j, n_present, support, fires, positive) of the tags i present (y = 1).

    Counts are those of the pairs with any tag j of the same row, with an absent j, with an absent j that fires and with a present j.
    """
    strip = max(CELLS // max(n_tags, 1), 1)

    def counted(first, m):
        i, j = np.nonzero(m[0])
        return pa.RecordBatch.from_arrays([pa.array(i + first, pa.int32()), pa.array(j, pa.int32()), *(pa.array(x[i, j].astype(np.int64)) for x in m)],
                                          ["i", "j", "n_present", "support", "fires", "positive"])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for lo in range(0, len(b), strip):
                lists = b.column("c").slice(lo, strip)
                code = lists.flatten().to_numpy()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                at, y, p = row * n_tags + (code >> 2), (code >> 1) & 1, code & 1
                count = lambda keep: np.bincount(at[keep], minlength=len(lists) * n_tags).reshape(-1, n_tags).astype(np.float64)
                present, other = count(y == 1), (count(y >= 0), count(y == 0), count((y == 0) & (p == 1)), count(y == 1))
                for i in range(0, n_tags, strip):
                    m = np.stack([present[:, i:i + strip].T @ x for x in other])
                    if n_tags > HELD_TAGS:
                        yield counted(i, m)
                    else:
                        total[i] = total[i] + m if i in total else m
        for first, m in total.items():
            yield counted(first, m)

    return run
