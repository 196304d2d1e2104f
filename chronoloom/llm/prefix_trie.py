"""The trie of all conversations' beginnings, from vertical bitmaps.

Conversations lie in the order of their turns' hashes and are cut into shards of consecutive
ones. A shard indexes each (position, turn) as a bitmap of the conversations that have it; from
the root down, a node's bitmap is intersected with the postings of its members' next turns, which
gives its children; bits are counted for members, and members without a next turn are those
that end there. Going back up adds leaves and savings.

A node between the first and the last conversation of a shard lies in no other shard, so all that
is asked of it is known there. Only nodes on the way to a shard's first or last conversation
are open: other shards may have members of them too. They are few (twice the length of a
conversation per shard) and are added up by their hash; what open nodes themselves give to the
open nodes above them goes through sums along each shard's first and last conversation. A
conversation or first turn that very many share thus adds one row per shard and node, and the
ids that end at an open node are hashed piece by piece, in the order of shards.

Defined cases: null roles and texts are empty ones; turns of null come first; turns of one
conversation with the same number are in the order of their hashes; rows without conv_id take no
part; an empty table gives no rows; a conversation may end at the root; repeated rows are turns each;
further columns are ignored. A task holds a shard (``SHARD_CONVERSATIONS`` conversations, or
fewer of some ``SHARD_TURNS`` turns in all) and whole conversations, as 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import hinted, small_batches, stash

SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 1 << 16
ROOT = bytes(16)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): array of (turn, key, words), in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    block = (F.col("conv_id") - F.col("conv_id") % 20).alias("block")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint"), F.struct(F.col("turn").cast("bigint").alias("turn"), key.alias("key"), words.alias("words")).alias("t")).select(block, "*")
    # rebuilt() needs the conversations of a block of ids together; rows are small by now
    return rows.repartition("block").groupBy("block", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation with its first crc32(conv_id) % 4 turns taken from the first of its block of twenty ids."""
    head = F.max(F.when(F.col("conv_id") == F.col("block"), F.slice("turns", 1, 3))).over(Window.partitionBy("block"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    none = F.slice("turns", 1, 0)
    own = F.filter("turns", lambda t, i: i >= F.col("h"))
    return turns.withColumn("h", h).withColumn("head", F.coalesce(head, none)).select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), own).alias("turns"))


# -- a shard --------------------------------------------------------------------------


class Node:
    """``side`` tells which of a shard's first (1) and last (2) conversations are members: 0 both, None neither."""

    __slots__ = ("children", "conv_id", "depth", "ends", "key", "leaves", "members", "parent", "saved", "side", "words")


def trie(convs: list[int], paths: list[list[bytes]], words: list[list[int]]) -> list[Node]:
    """The nodes of conversations given in order, parents before children.

    Of open nodes, ``children``, ``leaves`` and ``saved`` count what is inside the shard alone."""
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    stops: dict[int, int] = defaultdict(int)
    for i, path in enumerate(paths):
        bit = 1 << i
        stops[len(path)] |= bit
        for at in enumerate(path):
            postings[at] |= bit
    final = len(paths) - 1
    nodes: list[Node] = []
    todo: list[tuple[Node | None, int, bytes]] = [(None, (1 << len(paths)) - 1, ROOT)]
    while todo:
        parent, bits, turn = todo.pop()
        node = Node()
        node.parent, node.depth, node.members = parent, parent.depth + 1 if parent else 0, bits.bit_count()
        node.side = {(1, 1): 0, (1, 0): 1, (0, 1): 2, (0, 0): None}[bits & 1, bits >> final & 1]
        node.key = None if node.side is None else ROOT if parent is None else hashlib.blake2b(parent.key + turn, digest_size=16).digest()
        first = (bits & -bits).bit_length() - 1
        node.words = words[first][node.depth - 1] if parent else 0
        end = bits & stops[node.depth]
        node.ends = convs[first : first + end.bit_count()]  # equal ones lie together, in the order of their ids
        node.conv_id = node.ends[0] if node.ends else None
        node.children = node.leaves = node.saved = 0
        nodes.append(node)
        rest = bits ^ end
        while rest:
            next_turn = paths[(rest & -rest).bit_length() - 1][node.depth]
            child = bits & postings[node.depth, next_turn]
            todo.append((node, child, next_turn))
            rest ^= child
    for node in reversed(nodes):
        above, inside = node.parent, node.side is None
        if inside:
            node.leaves += not node.children
            node.saved += (node.members - 1) * node.words
        if above:
            above.leaves, above.saved, above.children = above.leaves + node.leaves, above.saved + node.saved, above.children + inside
            above.conv_id = node.conv_id if above.conv_id is None else min(above.conv_id, node.conv_id)
    return nodes


_NODES = "inside boolean, shard bigint, side int, key binary, parent_key binary, parent_conv_id bigint, conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, words bigint, ends binary"
_ARROW = [pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.binary()]


def _rows(shard: int, convs: list[int], paths: list[list[bytes]], words: list[list[int]]) -> pa.RecordBatch:
    rows = [
        (n.side is None, shard, n.side, n.key, n.parent.key if n.parent else None, n.parent.conv_id if n.parent and n.parent.side is None else None,
         n.conv_id, n.depth, n.members, n.children, n.leaves, n.saved, n.words, ",".join(map(str, n.ends)).encode())
        for n in trie(convs, paths, words)
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], [c.split()[0] for c in _NODES.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (conv_id, path, words) in order, dealt into shards."""
    at, held, turns = TaskContext.get().partitionId() << 32, ([], [], []), 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for to, value in zip(held, row, strict=True):
                to.append(value)
            turns += len(row[1])
            if len(held[0]) >= SHARD_CONVERSATIONS or turns >= SHARD_TURNS:
                yield _rows(at, *held)
                at, held, turns = at + 1, ([], [], []), 0
    if held[0]:
        yield _rows(at, *held)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each key's pieces, which come in order."""
    key, digest = None, None
    for b in batches:
        out = ([], [])
        for k, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k == key:
                digest.update(b"," + piece)
                continue
            if key is not None:
                out[0].append(key)
                out[1].append(digest.hexdigest())
            key, digest = k, hashlib.sha256(piece)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])


# -- Spark ---------------------------------------------------------------------------


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node,
    from (conv_id, turns) with turns as ``turns_of`` gives them."""
    small_batches(turns.sparkSession)
    paths = stash(turns.select("conv_id", F.col("turns.key").alias("path"), F.col("turns.words").alias("words")), "paths")
    nodes = stash(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_shards, _NODES), "nodes")
    open_rows = nodes.filter(~F.col("inside"))
    merged = stash(
        open_rows.groupBy("key").agg(
            F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("words").alias("words"), F.min(F.struct("shard", "side")).alias("place"),
        ),
        "open",
    )
    below = merged.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("open_children"))
    merged = merged.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    # each open node gives what is its own to the open nodes above it, in the first shard that has it
    own = merged.select("place.shard", "place.side", "depth", "key", F.lit(True).alias("gives"), ((F.col("n_convs") - 1) * F.col("words")).alias("saves"), (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    along = own.union(open_rows.select("shard", "side", "depth", "key", F.lit(False), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))
    deeper = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    under = lambda c: F.when(F.col("side") == 0, F.sum(c).over(deeper("shard"))).otherwise(F.sum(c).over(deeper("shard", "side")))
    sums = along.select("key", "gives", under("saves").alias("saves"), under("leaf").alias("leaf")).filter(~F.col("gives")).groupBy("key").agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    pieces = open_rows.filter(F.length("ends") > 0).select("key", "ends", "shard").repartition("key").sortWithinPartitions("key", "shard").select("key", "ends")
    digests = pieces.mapInArrow(_digests, "key binary, ends_sha256 string")
    full = stash(merged.join(sums, "key").join(digests, "key", "left"), "open-full")
    # rows of nodes below an open one take its smallest member; few open nodes are sent to where the rows are
    above = hinted(full.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("top")))
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    none = F.sha2(F.lit("").cast("binary"), 256)
    outer = full.join(above, "parent_key", "left").select(
        "conv_id", "depth", F.col("top").alias("parent_conv_id"), "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved") + F.col("saves")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
    inner = nodes.filter("inside").withColumn("saved_tokens", F.col("saved")).withColumn("ends_sha256", F.sha2("ends", 256))
    hung = inner.filter("parent_key is not null").drop("parent_conv_id").join(above, "parent_key").withColumnRenamed("top", "parent_conv_id")
    return outer.select(*names).union(hung.select(*names)).union(inner.filter("parent_key is null").select(*names))


def prefix_trie_digest(conversations: DataFrame) -> DataFrame:
    return prefix_trie(rebuilt(turns_of(conversations)))
