"""Prefix trie of conversations as preorder intervals.

A node is a distinct sequence of turns that some conversation starts with.
Its identity is the depth and the sum of hashes of (place, turn) over the
sequence, so every prefix of a conversation of any length comes from prefix
sums over blocks of turns, and a node's parent is known without a look-up.

Nodes without a branch between them form a chain.  The chain tops on a
chain's path, the only places where paths part, are its sort key; chains
sorted by it and nodes sorted by depth within their chain are in preorder.  A
subtree is then an interval of that order, and what is summed over it is
the difference of two prefix sums.

How long keys get: a path with B branches needs other conversations of B
different lengths at least, so B is below the root of twice the number of
turns, and the keys of all chains together hold at most twice as many entries
as there are turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.prefix_sums import before
from tallyloom.llm.scratch import Scratch
from tallyloom.operators.ranks import numbered

WORD = r"[^\x20\x09-\x0D]+"
LANES = ["l1", "l2", "l3", "l4"]
EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Trie:
    """block: turns that are summed together first.  ids: conversation ids that are written into one piece of text before hashing."""

    block: int = 4096
    ids: int = 8192


def rebuilt_paths(conversations: DataFrame, scratch: Scratch, every: int = 20, lent: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, turn digest, words) of the rebuilt conversations, and (conv_id, length) of all, turnless ones too.

    Conversation c takes the first crc32(c) % lent original turns of c - c % every, then its own after as many.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = numbered(turns, ["conv_id", "turn", "role", "head", "digest"], "at")
    turns = scratch.write(turns.select("conv_id", "at", "digest", "words"), "turns")
    found = scratch.write(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "found")
    convs = found.select("*", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % lent).alias("h"))
    convs = convs.join(found.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"), F.col("first").alias("first_base")), "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))
    convs = scratch.write(convs.select("conv_id", "first", "first_base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")

    lendable = turns.join(found.select("conv_id", "first"), "conv_id").where(F.col("at") - F.col("first") < lent).select("at", "digest", "words")
    borrowed = convs.where("taken > 0").select("conv_id", "first_base", F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("place"))
    borrowed = borrowed.withColumn("at", F.col("first_base") + F.col("place") - 1).join(lendable, "at").select("conv_id", "place", "digest", "words")
    own = turns.join(convs, "conv_id").where(F.col("at") - F.col("first") >= F.col("h"))
    own = own.select("conv_id", (F.col("taken") + F.col("at") - F.col("first") + 1 - F.col("h")).alias("place"), "digest", "words")
    return scratch.write(borrowed.unionByName(own), "paths"), convs.select("conv_id", "length")


def _node(depth: Column, lanes: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", *(c.cast("string") for c in (depth, *lanes))))


def _path_nodes(paths: DataFrame, p: Trie) -> DataFrame:
    """conv_id, depth, node, parent, words: the node that each conversation is at after each of its turns."""
    hashes = [F.xxhash64(F.lit(seed), "place", "digest") for seed in (1, 2)]
    low = F.lit(0xFFFFFFFF)
    lanes = [x for h in hashes for x in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))]  # sums of 32 bits stay below 2^63 for 2^31 turns
    rows = paths.select("conv_id", "place", "words", *(c.alias(n) for c, n in zip(lanes, LANES, strict=True)))
    rows = before(rows, ["conv_id"], "place", LANES, block=p.block)
    upto = [F.coalesce(f"before_{x}", F.lit(0).cast("long")) for x in LANES]
    node, parent = _node(F.col("place"), [u + F.col(x) for u, x in zip(upto, LANES, strict=True)]), _node(F.col("place") - 1, upto)
    return rows.select("conv_id", F.col("place").alias("depth"), node.alias("node"), parent.alias("parent"), "words")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each run of equal nodes over their pieces in turn; runs go on over batches, only a hash state is kept."""
    last, state, first = None, None, True
    for batch in batches:
        nodes, digests = [], []
        for node, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if node != last:
                if last is not None:
                    nodes.append(last)
                    digests.append(state.hexdigest())
                last, state, first = node, hashlib.sha256(), True
            state.update((piece if first else f",{piece}").encode())
            first = False
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.string()), "ends_sha256": pa.array(digests, pa.string())})
    if last is not None:
        yield pa.RecordBatch.from_pydict({"node": [last], "ends_sha256": [state.hexdigest()]})


def end_digests(ends: DataFrame, p: Trie = Trie()) -> DataFrame:
    """(node, ends_sha256) of the ids of ends(node, conv_id), ascending and joined by commas.

    Ids go into pieces by ranges of `ids` numbers, which the ids' being distinct
    bounds.  The digest of a node is sequential by its nature: its pieces stream
    through one task that keeps nothing but the hash's state.
    """
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = ends.groupBy("node", F.floor(F.col("conv_id") / p.ids).alias("range")).agg(F.array_join(ids, ",").alias("piece"))
    return pieces.repartition("node").sortWithinPartitions("node", "range").select("node", "piece").mapInArrow(_digests, "node string, ends_sha256 string")


def conversation_trie(conversations: DataFrame, params: Trie = Trie()) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations(conv_id, turn, role, text, ...).

    conv_id (the node's smallest member) and depth tell nodes apart.  Further:
    parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the interval preorder to subtree_end (from 1).

    Turns are ordered by turn, null first; of rows with equal turns by role, the
    text's first 64 characters and a digest, and repeated rows are turns of their
    own.  Null roles and texts are empty, rows with a null conv_id are left out,
    further columns are ignored.  No conversation gives no node, not even a root.
    """
    spark, p = conversations.sparkSession, params
    scratch = Scratch(spark, "trie")
    paths, convs = rebuilt_paths(conversations.select("conv_id", "turn", "role", "text"), scratch)
    paths = scratch.write(_path_nodes(paths, p), "path-nodes")
    root = _node(F.lit(0), [F.lit(0)] * 4)

    zero = F.lit(0).cast("long")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    nodes = paths.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("words").alias("words"))
    nodes = nodes.unionByName(top.select(root.alias("node"), "conv_id", "n_convs", zero.alias("depth"), F.lit(None).cast("string").alias("parent"), zero.alias("words")))
    nodes = scratch.write(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = scratch.write(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", zero)), "family")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    saved = (F.col("n_convs") - 1) * F.col("words")
    nodes = nodes.join(parents, "parent", "left").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"), saved.alias("saved"), (F.coalesce("siblings", F.lit(2)) > 1).alias("is_top"))
    nodes = scratch.write(nodes, "tops")

    # The tops on the paths of the conversations that stand for nodes.
    branches = nodes.where("is_top and depth > 0").select("node")
    on_path = scratch.write(paths.select("conv_id", "depth", "node").join(branches, "node", "left_semi"), "on-path")
    rest = nodes.where("not is_top").select("conv_id", "depth", "node", F.lit(None).cast("struct<depth:bigint,node:string>").alias("top"))
    marks = on_path.select("conv_id", "depth", F.lit(None).cast("string").alias("node"), F.struct("depth", "node").alias("top"))
    chains_of = before(rest.unionByName(marks), ["conv_id"], "depth", ["top"], F.max, p.block).where("node is not null")
    chains_of = chains_of.select("node", F.coalesce("before_top.node", root).alias("chain"))
    nodes = scratch.write(nodes.join(chains_of, "node", "left").withColumn("chain", F.coalesce("chain", "node")), "chained")

    tops = nodes.where("is_top and depth > 0").select(F.col("node").alias("chain"), "conv_id", F.col("depth").alias("_depth"))
    keys = tops.join(on_path, "conv_id").where("depth <= _depth").groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]).alias("key"))
    keys = keys.unionByName(nodes.where("depth = 0").select(F.col("node").alias("chain"), F.array().cast("array<string>").alias("key")))
    ranked = scratch.write(numbered(keys, ["key"], "rank"), "ranked")
    above = ranked.select(F.explode(F.concat(F.array(root), "key")).alias("chain"), "rank")
    ends = above.groupBy("chain").agg(F.max("rank").alias("end"))
    sums = nodes.groupBy("chain").agg(F.count(F.lit(1)).alias("size"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.min("depth").alias("top_depth"))
    values = ["size", "leaf", "saved"]
    chains = before(ranked.select("chain", "rank").join(ends, "chain").join(sums, "chain"), [], "rank", values, block=p.block)
    chains = scratch.write(chains.select("chain", "rank", "end", "top_depth", *(F.coalesce(f"before_{v}", zero).alias(f"from_{v}") for v in values), *(F.coalesce(f"before_{v}", zero).__add__(F.col(v)).alias(f"to_{v}") for v in values)), "chains")
    last = chains.select(F.col("rank").alias("end"), *(F.col(f"to_{v}").alias(f"end_{v}") for v in values))
    chains = chains.join(last, "end").select("chain", "top_depth", *(f"{side}_{v}" for side in ("from", "end") for v in values))

    nodes = before(nodes, ["chain"], "depth", ["leaf", "saved"], block=p.block).join(chains, "chain")
    total = lambda v: F.col(f"end_{v}") - F.col(f"from_{v}") - F.coalesce(f"before_{v}", zero)
    stops = paths.select("conv_id", "depth", "node").join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select("node", "conv_id")
    stops = stops.unionByName(convs.where("length = 0").select(root.alias("node"), "conv_id"))
    return nodes.join(end_digests(stops, p), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", total("leaf").alias("n_leaves"), total("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        (F.col("from_size") + F.col("depth") - F.col("top_depth") + 1).alias("preorder"), F.col("end_size").alias("subtree_end"))
