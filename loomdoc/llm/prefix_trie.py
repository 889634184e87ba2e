"""The trie of conversation prefixes: every distinct row of first turns with its members, children, leaves and what sharing it saves.

A conversation is an array of turns, each 20 bytes: the MD5 of role and text, and the text's number of code points.  The arrays
are sorted globally by ranges, so the conversations of a node are neighbours.  Each partition is swept once with a
stack: the longest common prefix with the array before it closes the nodes beyond and opens new ones.  What is
counted is a sum over rows, so a node that lies in several partitions is a sum of parts: every partition knows the last
array before it and the first one after it, sums up what it sees of the nodes that its borders leave open, and the open stacks are
stitched by adding up their parts by node.  A node's identity is the MD5 of its parent's and its turn.

Conversations that end in one node are hashed in order of their ids.  Where such a run crosses a border its ids go on in pieces of
PIECE_IDS, which one task reads as a stream.  A task holds one stack, as deep as the longest conversation in it.

Rows: a null role or text is empty, a null turn is before all others, equal turns are in order of their hashes, repeated rows are repeated turns;
rows without a conv_id belong to no conversation; an empty table has no nodes, not even the root; other columns are not read.  An array
is one value, so a conversation has fewer than 50 million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, shared

#: Bytes of a turn: MD5, and code points in 32 bits.
TURN = 20
#: Conversation ids in a piece of a run that crosses a border.
PIECE_IDS = 1024
#: Rows in a batch of results.
BATCH_ROWS = 8192

_NODE = "id binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, whole boolean, ends_sha256 string, part int, place bigint, ids string"
_ROOT = hashlib.md5(b"root").digest()
_NOBODY = hashlib.sha256(b"").hexdigest()


def arrays(conversations: DataFrame) -> DataFrame:
    """conv_id and the array of its turns, as bytes."""
    shared.integer_ids(conversations, "conv_id")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")), F.lpad(F.hex(F.length(text)), 8, "0"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), turn.alias("code")).alias("turn"))
    turns = F.sort_array(F.collect_list("turn"))
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(turns, lambda x: x.code), "")).alias("turns"))


def rebuilt(table: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """The contract's conversations: the first h turns of conversation c - c % every, then c's own ones after its first h; h = crc32(c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = table.where(F.col("conv_id") == base).select(F.col("conv_id").alias("_base"), F.substring("turns", F.lit(1), F.lit(TURN * (most - 1))).alias("_head"))
    head, own = F.coalesce(F.substring("_head", F.lit(1), h * TURN), F.lit(b"")), F.substring("turns", h * TURN + 1, F.lit((1 << 31) - 1))
    return table.withColumn("_base", base).join(heads, "_base", "left").select("conv_id", F.concat(head, own).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two arrays share at their heads."""
    most = min(len(a), len(b)) // TURN
    if a[: most * TURN] == b[: most * TURN]:
        return most
    low, size = 0, 1  # heads of twice the size as long as they agree, then halves
    while a[low * TURN : (low + size) * TURN] == b[low * TURN : (low + size) * TURN]:
        low, size = low + size, 2 * size
    while size > 1:
        size //= 2
        if a[low * TURN : (low + size) * TURN] == b[low * TURN : (low + size) * TURN]:
            low += size
    return low


class Node:
    """A node on the stack, with what this partition has seen of it."""

    __slots__ = ("id", "length", "least", "n", "children", "leaves", "saved", "opened", "ends", "ids", "pieces")

    def __init__(self, id_: bytes, length: int, opened: bool):
        self.id, self.length, self.opened = id_, length, opened
        self.least, self.n, self.children, self.leaves, self.saved, self.pieces = None, 0, 0, 0, 0, 0
        self.ends, self.ids = None, []


class Sweep:
    """One partition's sorted arrays, between the last one before it and the first one after it (None at the ends of the table)."""

    def __init__(self, part: int, before: bytes | None, after: bytes | None):
        self.part, self.before, self.after = part, before, after
        self.stack: list[Node] = []
        self.last: bytes | None = None
        self.out: list[tuple] = []

    def _row(self, node: Node, depth: int, parent: bytes | None, whole: bool) -> tuple:
        digest = node.ends.hexdigest() if node.ends else None
        return node.id, parent, depth, node.least, node.n, node.children, node.leaves, node.saved, whole, digest, None, None, None

    def _close(self, depth: int, open_to: int) -> None:
        """Takes nodes deeper than depth from the stack; those up to open_to go on in the next partition."""
        while len(self.stack) > depth + 1:
            node, at = self.stack.pop(), len(self.stack)
            node.saved += (node.n - node.opened) * node.length
            self._piece(node)
            above = self.stack[-1] if self.stack else None
            if above:
                above.n += node.n
                above.leaves += node.leaves
                above.saved += node.saved
                above.least = node.least if above.least is None else min(above.least, node.least)
            self.out.append(self._row(node, at, above.id if above else None, node.opened and at > open_to))

    def _piece(self, node: Node) -> None:
        """Sends on the ids of a run that crosses a border."""
        if node.ids:
            self.out.append((node.id, None, None, None, None, None, None, None, None, None, self.part, node.pieces, ",".join(map(str, node.ids))))
            node.ids, node.pieces = [], node.pieces + 1

    def _leaf(self, shared_turns: int) -> None:
        """Nothing goes on below the last array if the next one does not have the whole of it."""
        if shared_turns < len(self.last) // TURN:
            self.stack[-1].leaves += 1

    def add(self, turns: bytes, conv_id: int) -> None:
        n = len(turns) // TURN
        if self.last is None:
            # Nodes that the array before this partition has too were opened there.
            known = common(self.before, turns) if self.before is not None else -1
            self.stack.append(Node(_ROOT, 0, known < 0))
            depth = 0
        else:
            known = depth = common(self.last, turns)
            self._leaf(depth)
            self._close(depth, -1)
        for d in range(depth, n):
            turn, above = turns[d * TURN : (d + 1) * TURN], self.stack[-1]
            opened = d >= known
            above.children += opened
            self.stack.append(Node(hashlib.md5(above.id + turn).digest(), int.from_bytes(turn[16:], "big"), opened))
        node = self.stack[-1]
        node.n += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if turns == self.before or turns == self.after:
            node.ids.append(conv_id)
            if len(node.ids) >= PIECE_IDS:
                self._piece(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv_id).encode())
        else:
            node.ends.update(f",{conv_id}".encode())
        self.last = turns

    def finish(self) -> None:
        if self.last is not None:
            goes_on = common(self.last, self.after) if self.after is not None else -1
            self._leaf(goes_on)  # the last array of all is a leaf, even one without turns
            self._close(-1, goes_on)

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps over rows (part, kind, turns, conv_id) in this order; kinds: 0 the array before the part, 1 the one after, 2 its own."""
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.string()]
    names = [x.split(" ")[0] for x in _NODE.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    part = before = after = sweep = None
    waiting: list[tuple] = []
    for rows in batches:
        for own, kind, turns, conv_id in zip(*(rows.column(k).to_pylist() for k in range(4)), strict=True):
            if own != part:
                if sweep:
                    sweep.finish()
                    waiting += sweep.rows()
                part, before, after, sweep = own, None, None, None
            if kind == 0:
                before = turns
            elif kind == 1:
                after = turns
            else:
                sweep = sweep or Sweep(part, before, after)
                sweep.add(turns, conv_id)
                if len(sweep.out) >= BATCH_ROWS:
                    yield batch(sweep.rows())
    if sweep:
        sweep.finish()
        waiting += sweep.rows()
    for k in range(0, len(waiting), BATCH_ROWS):
        yield batch(waiting[k : k + BATCH_ROWS])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ids) in order to (id, ends_sha256): the pieces of a run as one text."""
    at = digest = None
    found: list[tuple[bytes, str]] = []
    for batch in batches:
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node == at:
                digest.update(b",")
            else:
                if at is not None:
                    found.append((at, digest.hexdigest()))
                at, digest = node, hashlib.sha256()
            digest.update(ids.encode())
    if at is not None:
        found.append((at, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["id", "_ends"])


def trie(table: DataFrame) -> DataFrame:
    """Nodes of a table (conv_id, turns) of `arrays`, conv_ids unique.

    id and parent (bytes, null for the root's), depth, and the contract's columns.  A node stands for the first `depth` turns of its conv_id.
    """
    order = ["turns", "conv_id"]
    dealt = shared.written(table.select(*order).orderBy(*order).withColumn("part", F.spark_partition_id()), "sorted")
    spark = table.sparkSession
    bounds = shared.written(dealt.groupBy("part").agg(F.min("turns").alias("first"), F.max("turns").alias("last")), "bounds")
    # One number for each partition, not rows, comes to the driver: which partition follows which.
    parts = sorted(r.part for r in bounds.select("part").collect())
    following = spark.createDataFrame(list(zip(parts, parts[1:], strict=False)), "part int, next int")
    nobody = F.lit(None).cast("long").alias("conv_id")
    before = bounds.join(following, "part").select(F.col("next").alias("part"), F.lit(0).alias("kind"), F.col("last").alias("turns"), nobody)
    after = bounds.join(following, F.col("next") == bounds.part).select(following.part, F.lit(1).alias("kind"), F.col("first").alias("turns"), nobody)
    rows = dealt.select("part", F.lit(2).alias("kind"), "turns", "conv_id").unionByName(before).unionByName(after)
    rows = rows.repartitionById(max(parts, default=0) + 1, F.col("part")).sortWithinPartitions("part", "kind", "turns", "conv_id")
    swept = shared.written(rows.mapInArrow(_swept, _NODE), "swept")
    shared.discard(dealt, bounds)
    # Open stacks are stitched: the parts of a node are added up.
    seen = swept.where("depth is not null")
    sums = [F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    stitched = seen.where("not whole").groupBy("id").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    pieces = swept.where("depth is null").select("id", "part", "place", "ids").repartition("id").sortWithinPartitions("id", "part", "place").select("id", "ids")
    stitched = stitched.join(pieces.mapInArrow(_hashed, "id binary, _ends string"), "id", "left").withColumn("ends_sha256", F.coalesce("_ends", "ends_sha256")).drop("_ends")
    names = ["id", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = shared.written(seen.where("whole").select(*names).unionByName(stitched.select(*names)), "nodes")
    shared.discard(swept)
    hot = components.hot_keys(nodes.where(F.col("n_children") > components.HOT).select(F.col("id").alias("parent")))
    above = nodes.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = components.joined(nodes.where("parent is not null"), above, "parent", hot)
    root = nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(root).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOBODY)))


def digest(conversations: DataFrame) -> DataFrame:
    """The nodes of the contract's rebuilt conversations."""
    # The arrays are read twice, as conversations and as heads of others.
    table = shared.written(arrays(conversations.select("conv_id", "turn", "role", "text")), "arrays")
    found = trie(rebuilt(table))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
