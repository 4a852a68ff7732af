"""Prefix trie of conversations by adaptive radix trees over fixed-width turn ids.

Every distinct turn (role and text) gets a number; a conversation is the sequence of
its turns' numbers, written as eight big-endian bytes each, so that byte order is
sequence order. Sequences are put in order by range. Each task reads its range in
blocks and builds one adaptive radix tree a block: nodes hold 4, 16, 48 or 256
children, whichever they need, and paths without branches are compressed. Trie nodes
are the byte depths that end a turn, inside compressed paths too; what branches within
an id emits nothing.

A trie node can lie in several blocks only if it begins the first or the last
sequence of a block. These few, the spine, are merged by their digest and summed up
as a stream in trie order that holds one path; all others are final in their block.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .turns import ORDER, conv_id, keyed_turns, placed

WIDTH = 8  # bytes of a turn id
NOTHING = hashlib.sha256(b"").hexdigest()
RANGE_TURNS = 32  # turns of a sequence that take part in choosing the ranges


# ---------------------------------------------------------------------------
# The tree
# ---------------------------------------------------------------------------
class Few:
    """Up to ``room`` children: sorted key bytes beside the children."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node) -> bool:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return True
        if len(self.bytes) == self.room:
            return False
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return True

    def items(self) -> list[tuple]:
        return list(zip(self.bytes, self.nodes))

    def wider(self):
        return Few(16) if self.room == 4 else Indexed()


class Indexed:
    """Up to 48 children: a table of 256 places that point into them."""

    __slots__ = ("index", "nodes")

    def __init__(self):
        self.index, self.nodes = bytearray(256), []

    def get(self, byte: int):
        at = self.index[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node) -> bool:
        at = self.index[byte]
        if at:
            self.nodes[at - 1] = node
            return True
        if len(self.nodes) == 48:
            return False
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)
        return True

    def items(self) -> list[tuple]:
        return [(b, self.nodes[at - 1]) for b, at in enumerate(self.index) if at]

    def wider(self):
        return Direct()


class Direct:
    """A child for every byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> bool:
        self.nodes[byte] = node
        return True

    def items(self) -> list[tuple]:
        return [(b, n) for b, n in enumerate(self.nodes) if n is not None]


class Node:
    """The end of a compressed path: byte depth ``end`` along ``key``, any key below it; ``value`` if a key ends here."""

    __slots__ = ("key", "end", "value", "kids")

    def __init__(self, key: bytes, end: int, value=None):
        self.key, self.end, self.value, self.kids = key, end, value, None

    def child(self, byte: int):
        return self.kids.get(byte) if self.kids else None

    def attach(self, byte: int, node: Node) -> None:
        if self.kids is None:
            self.kids = Few(4)
        while not self.kids.put(byte, node):
            wider = self.kids.wider()
            for b, n in self.kids.items():
                wider.put(b, n)
            self.kids = wider


def agreeing(a: bytes, b: bytes, at: int, end: int) -> int:
    """The first place from ``at`` on where two keys differ, ``end`` at most."""
    end = min(end, len(a), len(b))
    if a[at:end] == b[at:end]:
        return end
    x, y = (np.frombuffer(k, np.uint8)[at:end] for k in (a, b))
    return at + int(np.argmax(x != y))


def insert(root: Node | None, key: bytes, value) -> Node:
    """The tree with one more key; returns its root."""
    if root is None:
        return Node(key, len(key), value)
    above, node, at = None, root, 0
    while True:
        same = agreeing(key, node.key, at, node.end)
        if same < node.end:  # the path divides, or ends, inside this edge
            fork = Node(key, same)
            fork.attach(node.key[same], node)
            if above is None:
                root = fork
            else:
                above.attach(key[at - 1], fork)
            node = fork
        if node.end == len(key):
            node.value = value
            return root
        byte = key[node.end]
        below = node.child(byte)
        if below is None:
            node.attach(byte, Node(key, len(key), value))
            return root
        above, node, at = node, below, node.end + 1


# ---------------------------------------------------------------------------
# Trie nodes of one block
# ---------------------------------------------------------------------------
class Edge:
    """One tree node met from above, with the sums of what lies below it."""

    __slots__ = ("node", "top", "over", "first", "last", "n", "low", "kids", "leaves", "saved", "found")

    def __init__(self, node: Node, top: int, over: Edge | None, first: int, last: int):
        self.node, self.top, self.over, self.first, self.last = node, top, over, first, last
        value = node.value
        self.n, self.low = (value[0], value[1]) if value else (0, None)
        self.kids = self.leaves = self.saved = 0  # of the trie nodes right below that are no spine
        self.found: list[tuple] = []

    def depths(self) -> range:
        return range(0 if self.over is None else (self.top // WIDTH + 1) * WIDTH, self.node.end + 1, WIDTH)


def edges_of(root: Node, first: bytes, last: bytes) -> list[Edge]:
    """All edges, parents ahead of children, with how far their path agrees with the block's first and last key."""

    def agree(node: Node, other: bytes, so_far: int, top: int) -> int:
        return agreeing(node.key, other, top, node.end) if so_far == top else so_far

    out = [Edge(root, 0, None, agree(root, first, 0, 0), agree(root, last, 0, 0))]
    for edge in out:  # grows while it is read
        top = edge.node.end
        if edge.node.kids:
            for _, kid in edge.node.kids.items():
                out.append(Edge(kid, top, edge, agree(kid, first, edge.first, top), agree(kid, last, edge.last, top)))
    return out


def sum_up(edges: list[Edge], size_of: dict[bytes, int]) -> None:
    """Fill in members, children, leaves and savings from below; ``found`` gets a row per trie node, the deepest first."""
    for edge in reversed(edges):
        node = edge.node
        below = (edge.kids, edge.leaves, edge.saved)
        depths = edge.depths()
        for depth in reversed(depths):
            spine = depth <= max(edge.first, edge.last)
            size = size_of[node.key[depth - WIDTH : depth]] if depth else 0
            ends = node.value[2] if depth == node.end and node.value else None
            edge.found.append((depth, spine, size, ends, *below))
            if spine:
                below = (0, 0, 0)
            else:
                kids, leaves, saved = below
                below = (1, leaves if kids else 1, saved + (edge.n - 1) * size)
        over = edge.over
        if over is not None:
            over.kids += below[0]
            over.leaves += below[1]
            over.saved += below[2]
            over.n += edge.n
            over.low = edge.low if over.low is None else min(over.low, edge.low)


def digests_of(key: bytes) -> list[bytes]:
    """The digest of every turn-aligned beginning of a key, the empty one first."""
    digest, out = hashlib.sha256(), []
    for at in range(0, len(key) + 1, WIDTH):
        out.append(digest.copy().digest())
        digest.update(key[at : at + WIDTH])
    return out


NODE_SHAPE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
BLOCK_SHAPE = f"{NODE_SHAPE}, digest binary, above binary, block long, path int, size long"
NODE_FIELDS = [(c, pa.int64()) for c in NODE_SHAPE.replace(" long", "").split(", ")[:-1]] + [("ends_sha256", pa.string())]
BLOCK_ARROW = pa.schema(
    NODE_FIELDS + [("digest", pa.binary()), ("above", pa.binary()), ("block", pa.int64()), ("path", pa.int32()), ("size", pa.int64())]
)
NODE_ARROW = pa.schema(NODE_FIELDS + [("digest", pa.binary())])


def block_rows(keys: list[tuple[bytes, tuple]], size_of: dict[bytes, int], block: int) -> Iterator[tuple]:
    """Rows of BLOCK_SHAPE of one block of distinct sorted keys; spine nodes carry a digest, the others are final.

    A spine node counts only its children outside the spine; ``above`` names the
    spine node over a final one, whose smallest member isn't known yet.
    """
    root = None
    for key, value in keys:
        root = insert(root, key, value)
    first, last = keys[0][0], keys[-1][0]
    edges = edges_of(root, first, last)
    sum_up(edges, size_of)
    names = digests_of(first), digests_of(last)
    for edge in edges:
        over = edge.over
        while over is not None and not over.found:
            over = over.over
        parent = (over.low, over.found[0], over) if over else None
        for found in reversed(edge.found):
            depth, spine, size, ends, kids, leaves, saved = found
            if spine:
                path = 0 if depth <= edge.first else 1
                yield (edge.low, depth // WIDTH, None, edge.n, kids, leaves, saved, ends, names[path][depth // WIDTH], None, block, path, size)
            else:
                low, (at, in_spine, *_), where = parent
                above = names[0 if at <= where.first else 1][at // WIDTH] if in_spine else None
                yield (
                    edge.low, depth // WIDTH, None if in_spine else low, edge.n, kids, leaves if kids else 1,
                    saved + (edge.n - 1) * size, ends or NOTHING, None, above, None, None, None,
                )
            parent = (edge.low, found, edge)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, n: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield table_of(held, schema)
            held = []
    yield table_of(held, schema)


def blocks(batches: Iterator[pa.RecordBatch], block_keys: int, block_bytes: int) -> Iterator[tuple]:
    """Rows of all blocks of one range; rows come sorted by sequence and conversation: ``conv_id, ids, sizes``."""
    number = TaskContext.get().partitionId() << 33
    keys: list[tuple[bytes, tuple]] = []
    size_of: dict[bytes, int] = {}
    held, current, n, low, digest = 0, None, 0, None, None

    for batch in batches:
        for conv, ids, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            key = np.array(ids, f">i{WIDTH}").tobytes()
            if key != current:
                if current is not None:
                    keys.append((current, (n, low, digest.hexdigest())))
                    held += len(current)
                    if len(keys) >= block_keys or held >= block_bytes:
                        yield from block_rows(keys, size_of, number)
                        keys, size_of, held, number = [], {}, 0, number + 1
                current, n, low, digest = key, 0, conv, hashlib.sha256()
                size_of.update((key[i * WIDTH : (i + 1) * WIDTH], size) for i, size in enumerate(sizes))
            digest.update(f"{',' if n else ''}{conv}".encode())
            n += 1
    if current is not None:
        keys.append((current, (n, low, digest.hexdigest())))
        yield from block_rows(keys, size_of, number)


# ---------------------------------------------------------------------------
# The spine
# ---------------------------------------------------------------------------
def spine_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Final rows of the spine from its nodes in trie order; only the nodes of one path are open at a time.

    An open node is ``[depth, low, n, size, ends, digest, parent's low, children, leaves, saved]``.
    """
    path: list[list] = []

    def close() -> tuple:
        depth, low, n, size, ends, digest, parent, kids, leaves, saved = path.pop()
        leaves, saved = leaves if kids else 1, saved + (n - 1) * size
        if path:
            over = path[-1]
            over[7] += 1
            over[8] += leaves
            over[9] += saved
        return low, depth, parent, n, kids, leaves, saved, ends or NOTHING, digest

    for batch in batches:
        for depth, low, n, size, ends, digest, kids, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
            while path and path[-1][0] >= depth:
                yield close()
            path.append([depth, low, n, size, ends, digest, path[-1][1] if path else None, kids, leaves, saved])
    while path:
        yield close()


def sequences(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, family: int, longest: int) -> DataFrame:
    """``conv_id, ids, sizes`` of every rebuilt conversation.

    The first h turns are those of the conversation ``c - c % family``, h being the
    checksum of c modulo ``longest + 1``; its own turns after its first h follow.
    """
    turns = keyed_turns(conversations, conv_col, turn_col, role_col, text_col, "").where("conv <> 'none'")
    light = placed(turns.select(*ORDER, F.octet_length("text").cast("long").alias("size")), "trie-turns")
    numbers = light.select("digest").distinct().withColumn("id", F.monotonically_increasing_id())
    numbers = stored(numbers, "trie-numbers")
    numbered = light.join(numbers, "digest").select(conv_id().alias("conv_id"), F.struct("at", "id", "size").alias("t"))
    own = stored(numbered.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")), "trie-sequences")
    heads = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, longest).alias("head"))
    h = f"cast(crc32(cast(cast(conv_id as string) as binary)) % {longest + 1} as int)"
    rebuilt = own.withColumn("base", F.expr(f"conv_id - conv_id % {family}")).join(heads, "base", "left")
    whole = f"concat(coalesce(slice(head, 1, {h}), array()), slice(own, {h} + 1, size(own)))"
    return rebuilt.select("conv_id", F.expr(f"{whole} as t")).selectExpr("conv_id", "t.id as ids", "t.size as sizes")


def prefix_trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    family: int = 5,
    longest: int = 8,
    block_keys: int = 50_000,
    block_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per trie node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns are ordered by number, null first; those of one number by the first
    hundred characters of role and of text, then by a digest of both. Null roles and
    texts are empty; rows without a conversation belong to none and are left out.
    Turns are equal if role and text are (by SHA-256). Rows that repeat are turns like
    any other. A rebuilt conversation without turns is a member of the root. Negative
    ids follow the same arithmetic, with remainders that keep the sign. Other columns
    aren't read. An empty table gives an empty result.

    Texts never leave their first shuffle: what a task holds of a conversation is
    eight bytes a turn, and of a block its tree. Conversations that are equal end to
    end meet in one task as a stream, as the digest of their ids needs, and count as
    one key.
    """
    found = sequences(conversations, conv_col, turn_col, role_col, text_col, family, longest)
    in_order = found.repartitionByRange(F.slice("ids", 1, RANGE_TURNS)).sortWithinPartitions("ids", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(blocks(batches, block_keys, block_bytes), BLOCK_ARROW)

    rows = stored(in_order.select("conv_id", "ids", "sizes").mapInArrow(run, BLOCK_SHAPE), "trie-blocks")
    node = [c for c, _ in NODE_FIELDS]
    spine = rows.where("digest is not null").groupBy("digest").agg(
        F.min(F.struct("block", "path", "depth")).alias("at"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.max("ends_sha256").alias("ends"),
    )
    # Twice the depth of the trie for each block, read as a stream.
    spine = spine.repartition(1).sortWithinPartitions("at").select(
        "at.depth", "conv_id", "n_convs", "size", "ends", "digest", "n_children", "n_leaves", "saved_tokens"
    )
    spine = spine.mapInArrow(lambda b: in_batches(spine_sums(b), NODE_ARROW), f"{NODE_SHAPE}, digest binary")
    spine = stored(spine, "trie-spine")
    final = rows.where("digest is null")
    parents = spine.select(F.col("digest").alias("above"), F.col("conv_id").alias("parent"))
    hanging = final.where("above is not null").join(parents, "above").withColumn("parent_conv_id", F.col("parent"))
    return spine.select(*node).unionByName(hanging.select(*node)).unionByName(final.where("above is null").select(*node))
