"""The trie of conversation prefixes, with totals of every subtree.

Every conversation takes over the first turns of another one and goes on with its own (``rebuilt_turns``). A node is a distinct
sequence of first turns. It is found without walking down the trie, so a conversation may be of any length: each turn
gets a 128-bit digest of its position and content, a prefix is named by the running sum of its digests, and sums are scanned in
slices where a conversation is long (core.ordered). The name is verified: all rows of a node must agree in the digest of
their last turn, and since a parent's name follows from the node's, agreement on all levels is equality of the whole sequences.
From then on a node is (depth, smallest member). Subtree totals come from tree contraction.

The ids of the conversations that end in a node are put in order in chunks of at most CHUNK ids, by ranges of ids. A node
with more than one chunk streams its chunks, not its ids, through one digest.

A null role or text is empty. Turns go by number, null first, then by role and text; repeated rows are turns of their own. Rows
without a conversation id take no part. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import require
from cadenza.core.ordered import Ordered
from cadenza.core.session import materialise
from cadenza.llm.tree_contraction import subtree_totals

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAMILY = 5        # conversations c - c % FAMILY .. share a beginning
HEADS = 9         # crc32(c) % HEADS turns of it
CHUNK = 1024


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, length, turn, bytes of every rebuilt turn; conv_id, length of every conversation)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("no"), text("role").alias("role"), text("text").alias("text"))
    order = [F.asc_nulls_first("no"), F.asc("role"), F.asc("text")]
    rows = Ordered(rows.filter("conv_id IS NOT NULL"), ["conv_id"], order).add(pos=("row", None)).result()
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = materialise(rows.select("conv_id", "pos", content.alias("turn"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = convs.withColumns({"base": F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY)), "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    taken = F.least("h", F.coalesce("base_turns", F.lit(0).cast("long")))
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    convs = materialise(convs, "conversations")
    first = rows.filter((F.col("pos") < HEADS) & (F.pmod("conv_id", F.lit(FAMILY)) == 0)).select(F.col("conv_id").alias("base"), "pos", "turn", "bytes")
    heads = convs.join(first, "base").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "length", "turn", "bytes")
    tails = rows.join(convs, "conv_id").filter("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "length", "turn", "bytes")
    return heads.unionByName(tails), convs.select("conv_id", "length")


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, parent, n_convs, bytes of the last text; node, conv_id of every conversation that ends there).

    A node is a struct (depth, conv_id of its smallest member).
    """
    digest = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), "turn"))
    turns = materialise(turns.select("*", _half(digest, 1).alias("f"), _half(digest, 17).alias("g")), "rebuilt")
    wide = Ordered(turns, ["conv_id"], ["depth"]).add(a=("sum", F.col("f")), b=("sum", F.col("g"))).result()
    wide = wide.select("conv_id", "depth", "length", "turn", "bytes", "a", "b", (F.col("a") - F.col("f")).alias("up_a"), (F.col("b") - F.col("g")).alias("up_b"))
    wide = materialise(wide, "prefixes")
    nodes = wide.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"),
                                                F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    nodes = require(nodes, F.col("low") == F.col("high"), "two different sequences of turns share a digest").drop("low", "high")
    zero = F.lit(0).cast("decimal(30,0)")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"),
        F.lit(None).cast("decimal(30,0)").alias("up_a"), F.lit(None).cast("decimal(30,0)").alias("up_b"))
    keyed = materialise(nodes.unionByName(root).withColumn("node", F.struct("depth", "conv_id")), "nodes")
    above = keyed.select(F.col("depth").alias("_d"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("node").alias("parent"))
    tree = keyed.join(above, (F.col("depth") - 1 == F.col("_d")) & (F.col("up_a") == F.col("_a")) & (F.col("up_b") == F.col("_b")), "left")
    ends = wide.filter("depth = length").select("conv_id", "depth", "a", "b").unionByName(
        convs.filter("length = 0").select("conv_id", F.col("length").alias("depth"), zero.alias("a"), zero.alias("b")))
    last = keyed.select("depth", "a", "b", "node")
    return tree.select("node", "parent", "n_convs", "bytes"), ends.join(last, ["depth", "a", "b"]).select("node", "conv_id")


def ends_digest(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node, ends_sha256: digest of the comma-joined ids in ascending order."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy("node", F.floor(F.col("conv_id") / chunk).alias("part")).agg(listed.alias("ids"))
    parts = materialise(parts, "ends")
    counts = parts.groupBy("node").agg(F.count("*").alias("parts"), F.min("ids").alias("ids"))
    counts = materialise(counts.select("node", "parts", F.when(F.col("parts") == 1, F.sha2("ids", 256)).alias("ends_sha256")), "ends-digest")
    several = parts.join(counts.filter("parts > 1").select("node"), "node", "left_semi")

    def stream(batches):
        node, state = None, None
        for b in batches:
            for key, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
                if key != node:
                    if state is not None:
                        yield row(node, state)
                    node, state = key, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield row(node, state)

    def row(node, state):
        return pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": state.hexdigest()}], schema=pa.schema(
            [("node", pa.struct([("depth", pa.int64()), ("conv_id", pa.int64())])), ("ends_sha256", pa.string())]))

    long_ = several.repartition("node").sortWithinPartitions("node", "part").select("node", "ids").mapInArrow(
        stream, "node struct<depth: long, conv_id: long>, ends_sha256 string")
    return counts.filter("parts = 1").select("node", "ends_sha256").unionByName(long_)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; one row per node."""
    turns, convs = rebuilt_turns(conversations)
    tree, ends = prefix_nodes(turns, convs)
    tree = materialise(tree, "trie")
    kids = tree.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    rows = tree.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    rows = materialise(rows.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}), "trie")
    totals = subtree_totals(rows.select("node", "parent", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    out = rows.drop("n_leaves", "saved_tokens").join(totals, "node").join(ends_digest(ends), "node", "left")
    return out.select(F.col("node.conv_id").alias("conv_id"), F.col("node.depth").alias("depth"), F.col("parent.conv_id").alias("parent_conv_id"), "n_convs",
                      "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
