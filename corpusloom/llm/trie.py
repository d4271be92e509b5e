"""The prefix trie of conversations, built from z-fast tries, with counts for each node.

A conversation is a sequence of turns; each distinct prefix is a node. A prefix is named by a chained 128-bit digest, so a
conversation's path is 16 bytes for each turn and its texts move only to be hashed.

Equal conversations fold into one with a count. Tasks insert folded conversations, one Arrow batch after the other, into a
z-fast trie: a compacted node spans the depths (up, depth] and is hashed by the digest at its handle, the two-fattest number of
that span (the one divisible by the highest power of two). A conversation's exit node is found by fat binary search with a
number of look-ups logarithmic in its length; there the node's edge is split or a leaf added. A trie that has reached
``TRIE_BYTES`` of paths is put out and a new one begun, so memory is bounded and no order of the input matters. Putting out
expands each compacted edge to one row per depth, and partial rows of the same prefix are added up by one grouping, whatever
task they come from. A first turn that a third of all conversations share is one row in each trie.

Sums over subtrees need no descent: the nodes with the same smallest member are a chain, a piece of that member's path. A node's
subtree is the rest of its chain and all chains that leave the path below it, so each chain adds its total to the prefixes above
its first node. That makes at most one row for each turn.

Edge cases: rows without a conv_id belong to no conversation and are left out. Null turn numbers come first; rows of a
conversation with equal turn numbers are ordered by role, then by the digest of the turn. Null role or text counts as empty. A
conversation without turns ends at the root. No conversations, no nodes. Other columns are not read. One conversation's digests
lie in one row, as its texts never do.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import saved

#: Bytes of a prefix digest, paths that one trie holds, conv_ids in a piece of text.
WIDTH, TRIE_BYTES, IDS = 16, 1 << 24, 8192
ROOT = bytes(WIDTH)
#: Fixed values of the contract: conversations that share a base, and the modulus of the number of its turns they take.
FAMILY, HEAD = 5, 9


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns as array<struct<digest, size>> in order; ``size`` is the UTF-8 length of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    turn = F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    grouped = conversations.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations that share beginnings: the first h turns of the first of each family, then the own turns after the first h."""
    convs = saved(convs, "conversations")
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD - 1).alias("head"))
    own = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("int")})
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.lit(0), F.size("turns")))
    none = F.array().cast(convs.schema["turns"].dataType)
    return own.join(heads, "base", "left").select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), rest).alias("turns"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turns) to (conv_id, last, path, sizes); a path is the digests of all prefixes, the root's first."""
    for batch in batches:
        last, paths, sizes = [], [], []
        for turns in batch.column(1).to_pylist():
            at, path = ROOT, [ROOT]
            for turn in turns:
                at = hashlib.blake2b(at + turn["digest"], digest_size=WIDTH).digest()
                path.append(at)
            last.append(at)
            paths.append(b"".join(path))
            sizes.append([turn["size"] for turn in turns])
        columns = [batch.column(0), pa.array(last, pa.binary()), pa.array(paths, pa.binary()), pa.array(sizes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "last", "path", "sizes"])


def _two_fattest(low: int, high: int) -> int:
    """The number of (low, high] that is divisible by the highest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class _Node:
    __slots__ = ("up", "depth", "path", "sizes", "n", "conv", "parent", "children")

    def __init__(self, up: int, depth: int, path: bytes, sizes: list, parent: _Node | None):
        self.up, self.depth, self.path, self.sizes, self.parent = up, depth, path, sizes, parent
        self.n, self.conv, self.children = 0, None, {}

    def at(self, depth: int) -> bytes:
        return self.path[depth * WIDTH : (depth + 1) * WIDTH]

    def add(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)


class ZFastTrie:
    """A compacted trie of paths; ``handles`` finds a node by the digest of its path at its handle."""

    def __init__(self):
        self.root = _Node(0, 0, ROOT, [], None)
        self.handles: dict[bytes, _Node] = {}

    def exit_node(self, path: bytes) -> _Node:
        """The node whose edge a path leaves or ends in."""
        size = len(path) // WIDTH - 1
        low, high, node = 0, size, self.root
        while low < high:
            f = _two_fattest(low, high)
            found = self.handles.get(path[f * WIDTH : (f + 1) * WIDTH])
            if found is None:
                high = f - 1
            elif found.depth <= size and found.at(found.depth) == path[found.depth * WIDTH : (found.depth + 1) * WIDTH]:
                node, low = found, found.depth
            else:
                return found
        step = (node.depth + 1) * WIDTH
        return node.children.get(path[step : step + WIDTH], node)

    def _hang(self, node: _Node) -> None:
        node.parent.children[node.at(node.up + 1)] = node
        self.handles[node.at(_two_fattest(node.up, node.depth))] = node

    def insert(self, path: bytes, sizes: list[int], n: int, conv: int) -> None:
        size, node = len(path) // WIDTH - 1, self.exit_node(path)
        # Digests of prefixes are equal up to some depth and differ after it.
        common = bisect_left(range(node.up, min(size, node.depth)), True, key=lambda d: node.at(d + 1) != path[(d + 1) * WIDTH : (d + 2) * WIDTH]) + node.up
        if common < node.depth:
            split = _Node(node.up, common, node.path, node.sizes, node.parent)
            del self.handles[node.at(_two_fattest(node.up, node.depth))]
            node.up, node.parent = common, split
            self._hang(split)
            self._hang(node)
            node = split
        if common < size:
            leaf = _Node(common, size, path, sizes, node)
            self._hang(leaf)
            node = leaf
        node.add(n, conv)

    def compacted(self) -> list[_Node]:
        """All nodes, deepest first, with members counted upwards."""
        nodes, todo = [], [self.root]
        while todo:
            nodes.append(todo.pop())
            todo += nodes[-1].children.values()
        nodes.reverse()
        for node in nodes:
            if node.parent is not None:
                node.parent.add(node.n, node.conv)
        return nodes

    def expanded(self) -> Iterator[tuple]:
        """(node, parent, depth, n, conv_id, size) of every prefix."""
        for node in self.compacted():
            for d in range(node.up + 1, node.depth + 1):
                yield node.at(d), node.at(d - 1), d, node.n, node.conv, node.sizes[d - 1]
        yield ROOT, None, 0, self.root.n, self.root.conv, 0


_PARTIAL = "node binary, parent binary, depth long, n long, conv_id long, size long"
_PARTIAL_TYPES = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_PARTIAL_NAMES = ["node", "parent", "depth", "n", "conv_id", "size"]


def _partial_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, held = ZFastTrie(), 0
    for batch in batches:
        for path, sizes, n, conv in zip(*(c.to_pylist() for c in batch.columns)):
            trie.insert(path, sizes, n, conv)
            held += len(path)
            if held >= TRIE_BYTES:
                yield from _rows(trie)
                trie, held = ZFastTrie(), 0
    if held:
        yield from _rows(trie)


def _rows(trie: ZFastTrie, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    rows = []
    for row in trie.expanded():
        rows.append(row)
        if len(rows) == most:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PARTIAL_TYPES)], _PARTIAL_NAMES)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows to (node, first, ids): comma-joined ids, at most ``IDS`` in a piece."""
    node, ids, out = None, [], []
    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (key != node or len(ids) == IDS):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = key
            ids.append(conv)
        yield _pieces_batch(out)
        out = []
    if ids:
        yield _pieces_batch([(node, ids[0], ",".join(map(str, ids)))])


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string()))], ["node", "first", "ids"])


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id to one digest per node; a digest takes one piece after the other."""
    node, state, out = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _hash_batch(out)
        out = []
    if node is not None:
        yield _hash_batch([(node, state.hexdigest())])


def _hash_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string()))], ["node", "ends_sha256"])


def end_digests(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256): the conversations that end at a node, ascending. Ids are sorted and joined over ranges, so the one
    task that hashes a node's list, which no one can split, reads a few long pieces and holds one at a time."""
    ends = paths.select(F.col("last").alias("node"), "conv_id")
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node binary, first long, ids string")
    sorted_pieces = pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return sorted_pieces.mapInArrow(_hash_pieces, "node binary, ends_sha256 string")


def nodes(convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of (conv_id, turns) rows with unique ids: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256. ``saved_tokens`` is what sharing saves below and at the node:
    the size of each prefix's last turn times one less than its members."""
    paths = saved(convs.mapInArrow(_chain, "conv_id long, last binary, path binary, sizes array<long>"), "paths")
    folded = paths.groupBy("last").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    distinct = saved(paths.select("conv_id", "path", "sizes").join(folded.select("conv_id", "n"), "conv_id"), "distinct_paths")
    partial = distinct.select("path", "sizes", "n", "conv_id").mapInArrow(_partial_tries, _PARTIAL)
    merged = partial.groupBy("node").agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), *(F.max(c).alias(c) for c in ("parent", "depth", "size")))
    merged = saved(merged, "nodes")

    children = merged.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    merged = merged.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    chain = Window.partitionBy("conv_id")
    chained = merged.withColumns(
        {
            "saved": F.sum((F.col("n") - 1) * F.col("size")).over(down),
            "leaves": F.sum((F.col("n_children") == 0).cast("long")).over(down),
            "top": F.min("depth").over(chain),
        }
    )
    chained = saved(chained, "chains")
    heads = chained.where("depth = top AND depth > 0")
    above = heads.join(distinct.select("conv_id", "path"), "conv_id").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth") - 1)).alias("d"), "path", "saved", "leaves"
    )
    hanging = above.groupBy(F.substring("path", (F.col("d") * WIDTH + 1).cast("int"), F.lit(WIDTH)).alias("node")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    parents = heads.select("node", "parent").join(chained.select(F.col("node").alias("parent"), F.col("conv_id").alias("head_parent")), "parent").select("node", "head_parent")
    full = chained.join(hanging, "node", "left").join(parents, "node", "left").join(end_digests(paths), "node", "left")
    plus = lambda own, more: (F.col(own) + F.coalesce(more, F.lit(0))).cast("long")
    return full.select(
        "conv_id",
        F.col("depth").cast("long"),
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("head_parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        plus("leaves", "more_leaves").alias("n_leaves"),
        plus("saved", "more_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
