"""The trie of conversation prefixes, by a mergesort that keeps common prefixes.

A turn is 16 bytes of the SHA-256 of its role and text, and a conversation's path the concatenation of its turns, so paths sort as
sequences of turns do. Spark deals (path, id) to partitions by range; a task sorts its rows externally:

1. Runs of a bounded number of rows are sorted, each row with the number of turns it shares with the row before it (its LCP), and spilled.
2. A loser tree merges the runs. Of two heads the one that shares more turns with the last row merged is the smaller; only
   heads that share equally many are compared, from the first turn that isn't known to be equal on. So shared turns aren't compared again.
3. The merged rows walk over a stack of open nodes: a row closes the nodes beyond its LCP and opens its own. A closed node is finished.

The first and the last path of a partition may go on in its neighbours. Nodes on them are given out as partial sums, a few for each partition, and one task
folds these over the partitions in order, with the same stack. Finished nodes come after their children; read backwards they come before
them, which tells each its parent without a join. Only the children of nodes that span partitions look their parent up, by partition.

A task holds a run, the heads of the runs, an open path, and the ids of the conversations that end on it (20 bytes each at most). A conversation's path is one row of
some 20 bytes a turn. Ids of a group of equal conversations are dealt to many partitions; only the text of their ids, which the
hash must see in order, goes through the task that folds.

Rows without an id are left out. Null turns come first; turns of equal number follow by role, then text. Null roles and texts are empty ones. Very long texts are
hashed whole. An empty table has no node. Other columns take no part.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._common import durable, table

#: Bytes of a turn in a path.
TURN = 16
#: Rows and bytes of a sorted run, rows of a batch given out, and bytes of the ids in one row.
RUN_ROWS, RUN_BYTES, BATCH, CHUNK = 50_000, 1 << 26, 8192, 1 << 20

# ---- sorted runs, and merging them


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two paths share, given that they share some."""
    at, end = known * TURN, min(len(a), len(b))
    while at < end and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


Row = tuple[bytes, int, list[int], int]  # path, id, sizes of the turns, LCP with the row before


def sorted_run(rows: list[tuple[bytes, int, list[int]]]) -> list[Row]:
    rows.sort(key=lambda r: r[:2])
    before, out = b"", []
    for path, key, sizes in rows:
        out.append((path, key, sizes, shared_turns(before, path)))
        before = path
    return out


_SPILLED = pa.schema([("path", pa.binary()), ("key", pa.int64()), ("sizes", pa.list_(pa.int32())), ("lcp", pa.int32())])


def spilled(run: list[Row]) -> Iterator[Row]:
    """The run's rows from a temporary file, which goes when they are read."""
    file = tempfile.TemporaryFile()
    with pa.ipc.new_stream(file, _SPILLED) as out:
        for i in range(0, len(run), BATCH):
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*run[i : i + BATCH], strict=True), _SPILLED.types, strict=True)], schema=_SPILLED))
    file.seek(0)

    def read() -> Iterator[Row]:
        with file:
            for batch in pa.ipc.open_stream(file):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    return read()


def merged(runs: list[Iterator[Row]]) -> Iterator[Row]:
    """All rows of sorted runs in order, each with its LCP with the row before it in this order."""
    if len(runs) == 1:
        yield from runs[0]
        return
    n = 1
    while n < len(runs):
        n *= 2
    runs = [*runs, *(iter(()) for _ in range(n - len(runs)))]
    heads: list[Row | None] = [next(r, None) for r in runs]
    lcp = [0] * n  # of each head with the last row given out
    losers = [0] * n  # of the inner nodes 1 to n - 1

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser. The loser's LCP becomes the one with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        common = shared_turns(x[0], y[0], lcp[a])
        first, second = (a, b) if (x[0][common * TURN :], x[1]) <= (y[0][common * TURN :], y[1]) else (b, a)
        lcp[second] = common
        return first, second

    winners = [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while (row := heads[top]) is not None:
        yield (*row[:3], lcp[top])
        heads[top] = following = next(runs[top], None)
        lcp[top] = following[3] if following else 0
        node = (top + n) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def merge_sorted(rows: Iterator[tuple[bytes, int, list[int]]], run_rows: int = RUN_ROWS) -> Iterator[Row]:
    """External mergesort: rows in order of path and id, with LCPs."""
    runs, held, size = [], [], 0
    for row in rows:
        if len(held) >= run_rows or size >= RUN_BYTES:
            runs.append(spilled(sorted_run(held)))
            held, size = [], 0
        held.append(row)
        size += len(row[0]) + 8 * len(row[2])
    runs.append(iter(sorted_run(held)))
    return merged(runs)


# ---- finished nodes, read backwards


class Backwards:
    """Fixed records in a temporary file beyond 16 MB, read from the last to the first."""

    #: depth, state, id, conversations, children, leaves, saved tokens, hash of the ends.
    FORM = struct.Struct("<qbqqqqq32s")

    def __init__(self):
        self.file, self.n = tempfile.SpooledTemporaryFile(max_size=1 << 24), 0

    def add(self, *record) -> None:
        self.file.write(self.FORM.pack(*record))
        self.n += 1

    def __iter__(self) -> Iterator[tuple]:
        size, last = self.FORM.size, self.n
        with self.file:
            while last:
                first = max(0, last - BATCH)
                self.file.seek(first * size)
                yield from reversed(list(self.FORM.iter_unpack(self.file.read((last - first) * size))))
                last = first


class Node:
    """A node whose last member hasn't been seen yet."""

    __slots__ = ("children", "digest", "ends", "first", "least", "leaves", "n", "parts", "saved", "size")

    def __init__(self, digest: bytes, size: int, first: bool = False):
        self.digest, self.size, self.first = digest, size, first
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends, self.parts = bytearray(), []

    def met(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)

    def close(self, above: Node | None) -> None:
        """Counts itself, and passes its sums on."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.size
        if above:
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + self.leaves, above.saved + self.saved


#: side: null of a finished node; of a partial one, whether it is on the partition's first path (0) or only on its last (1).
_ROWS = pa.schema(
    [("part", pa.int64()), ("side", pa.int32()), ("depth", pa.int64()), ("seq", pa.int32()), ("conv_id", pa.int64()), ("parent_side", pa.int32()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "size")]
    + [("digest", pa.binary()), ("ends", pa.binary())]
)
_SQL_TYPES = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}
_KINDS = ", ".join(f"{f.name} {_SQL_TYPES[f.type]}" for f in _ROWS)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ROWS.types, strict=True)], schema=_ROWS)

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield made()
            held = []
    if held:
        yield made()


_CLOSED = -1


def nodes_of_part(part: int, rows: Iterator[Row]) -> Iterator[tuple]:
    """Rows of _ROWS: partial nodes of a partition's first and last path, then its finished nodes."""
    stack: list[Node] = []
    done = Backwards()
    empty = b"\0" * 32

    def pop(last: bool) -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        above = stack[-1] if stack else None
        if above:
            above.met(node.n, node.least)
        if not (node.first or last):
            node.close(above)
            done.add(depth, _CLOSED, node.least, node.n, node.children, node.leaves, node.saved, hashlib.sha256(node.ends).digest())
            return
        side = 0 if node.first else 1
        done.add(depth, side, 0, 0, 0, 0, 0, empty)
        for seq, at in enumerate(range(0, max(1, len(node.ends)), CHUNK)):
            sums = (node.n, node.children, node.leaves, node.saved, node.size) if not seq else (0,) * 5
            yield (part, side, depth, seq, node.least, None, None, *sums, node.digest, bytes(node.ends[at : at + CHUNK]))

    for path, key, sizes, lcp in rows:
        first = not stack
        if first:
            stack.append(Node(b"", 0, True))
        while len(stack) - 1 > lcp:
            yield from pop(False)
        for d in range(len(stack) - 1, len(path) // TURN):
            stack.append(Node(path[d * TURN : (d + 1) * TURN], sizes[d], first))
        stack[-1].met(1, key)
        stack[-1].ends += b",%d" % key if stack[-1].ends else b"%d" % key
    while stack:
        yield from pop(True)
    above: dict[int, tuple[int, int]] = {}
    for depth, state, key, n, children, leaves, saved, ends in done:
        above[depth] = (state, key)
        if state == _CLOSED:
            side, parent = above[depth - 1]
            yield (part, None, depth, 0, key, None if side == _CLOSED else side, parent if side == _CLOSED else None, n, children, leaves, saved, None, None, ends)


def folded(partials: Iterator[tuple]) -> Iterator[tuple]:
    """The nodes that partial rows, by part, side, depth and seq, add up to (without part); and for each partial its node's id (with part and side)."""
    stack: list[Node] = []
    hashes: list = []
    done = Backwards()

    def pop() -> Iterator[tuple]:
        node, depth, ends = stack.pop(), len(stack), hashes.pop()
        node.close(stack[-1] if stack else None)
        done.add(depth, _CLOSED, node.least, node.n, node.children, node.leaves, node.saved, ends.digest())
        for part, side in node.parts:
            yield (part, side, depth, 0, node.least, *[None] * 9)

    for part, side, depth, seq, least, n, children, leaves, saved, size, digest, ends in partials:
        if not seq:
            if depth < len(stack) and stack[depth].digest != digest:
                while len(stack) > depth:
                    yield from pop()
            if depth == len(stack):
                stack.append(Node(digest, size))
                hashes.append(hashlib.sha256())
            node = stack[depth]
            node.met(n, least)
            node.children, node.leaves, node.saved = node.children + children, node.leaves + leaves, node.saved + saved
            node.parts.append((part, side))
            if ends:
                hashes[depth].update(b"," + ends if node.ends else ends)
                node.ends = node.ends or bytearray(b",")
        else:
            hashes[depth].update(ends)
    while stack:
        yield from pop()
    above: dict[int, int] = {}
    for depth, _, key, n, children, leaves, saved, ends in done:
        above[depth] = key
        yield (None, None, depth, 0, key, None, above.get(depth - 1), n, children, leaves, saved, None, None, ends)


# ---- as DataFrames


def turn_sequences(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key and turns: array<struct<digest: string, size: int>> in order. digest: hex digits of a turn's hash; size: its code points."""
    rows = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias(key), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    )
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text"))
    # the role's length stands before it, so that no other role and text give the same
    digest = F.substring(F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text").cast("binary"), 256), 1, 2 * TURN)
    each = rows.select(key, F.struct(at.alias("at"), digest.alias("digest"), F.length("_text").alias("size")).alias("t"))
    listed = each.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select(key, F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def with_shared_heads(sequences: DataFrame, head: Column, *, key: str = "conv_id", every: int = 100, most: int = 5) -> DataFrame:
    """Each sequence's first `head` (at most `most`) turns replaced by those of the conversation key - key % every."""
    none = F.expr("cast(array() as array<struct<digest: string, size: int>>)")
    base = F.col(key) - F.col(key) % every
    heads = sequences.where(F.col(key) % every == 0).select(F.col(key).alias("_base"), F.slice("turns", 1, most).alias("_head"))
    joined = sequences.withColumns({"_base": base, "_h": head.cast("int")}).join(heads, "_base", "left")
    first = F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h"))
    return joined.select(key, F.concat(first, F.slice("turns", F.col("_h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("_h")))).alias("turns"))


def prefix_trie(sequences: DataFrame, *, key: str = "conv_id", run_rows: int = RUN_ROWS) -> DataFrame:
    """A row for each node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    path = F.unhex(F.array_join(F.col("turns")["digest"], ""))
    rows = sequences.select(path.alias("path"), F.col(key).alias("key"), F.col("turns")["size"].alias("sizes")).repartitionByRange("path", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _batches(nodes_of_part(TaskContext.get().partitionId(), merge_sorted(given, run_rows)))

    found = durable(rows.mapInArrow(run, _KINDS), "trie-parts")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(folded(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)))

    order = ["part", "side", "depth", "seq"]
    partials = found.where("side IS NOT NULL").select(*order, "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "digest", "ends")
    spanning = durable(partials.repartition(1).sortWithinPartitions(*order).mapInArrow(fold, _KINDS), "trie-spanning")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    closed = found.where("side IS NULL")
    parents = spanning.where("part IS NOT NULL").select("part", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_parent"))
    below = closed.where("parent_side IS NOT NULL").join(parents, ["part", "parent_side", "depth"]).withColumn("parent_conv_id", F.col("_parent"))
    nodes = closed.where("parent_side IS NULL").select(columns).union(below.select(columns)).union(spanning.where("part IS NULL").select(columns))
    return nodes.withColumn("ends_sha256", F.lower(F.hex("ends"))).drop("ends")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with its first turns (0 to 5, by its id) taken from the conversation that ends its id in 00."""
    sequences = turn_sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie(with_shared_heads(sequences, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6))
