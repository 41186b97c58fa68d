"""Prefix trie of conversations: a node for each distinct sequence of first turns, with what lies below it.

A prefix of d turns is known by a polynomial of its turns' SHA-256 digests modulo 2^127 - 1. Polynomials of
parts add up, so a conversation with a third of all turns is dealt to tasks as blocks of turns, and only
the blocks' sums are put in order in one place.

Tasks build z-fast tries: compacted nodes are found by a hash of their handle, the prefix whose length is
the two-fattest number on the node's edge, and a fat binary search finds the node where a path leaves
the trie with a logarithm of its length in lookups. Paths come sorted by prefix and are inserted in
batches; a batch's trie is then expanded edge by edge to one row a depth, with sums over its paths, and
rows of equal prefixes are added up across batches. So a hot first turn costs each batch a row, not each conversation.

What needs the whole trie is again a sum over members. A node is owned by its smallest member; a conversation owns the end of
its path, and the number of nodes it owns tells where it leaves the paths of smaller ones. Leaves below a node are members that own a leaf.
Saved bytes below a node are, over its members, the bytes from the node to where the member leaves the smaller ones. A second
pass of tries adds these up.

Rows are ordered by turn (null first), then role, then digest of role and text; null role or text is empty. Rows without an
id belong to no conversation and are left out. Repeated rows are turns of their own. An empty table gives no
node. Other columns are not read. Texts leave the scan as digests and lengths only, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.support import partitions, written

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix").digest()[:15], "big")
BLOCK_TURNS = 256
BATCH_TURNS = 1 << 18  # of the paths of one trie
WIDTH = 16  # bytes of a prefix's number
ROOT = bytes(WIDTH)
MOST_KEPT, GROUP = 9, 5  # a conversation begins with up to MOST_KEPT - 1 turns of the first of its GROUP
PIECE_BYTES = 1 << 16
_INVERSE = pow(BASE, -1, PRIME)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_Batches = Iterator[pa.RecordBatch]


def _number(x: bytes) -> int:
    return int.from_bytes(x, "big")


def _raw(x: int) -> bytes:
    return x.to_bytes(WIDTH, "big")


def _shift(k: int) -> int:
    """BASE to the k-th, k of any sign."""
    return pow(BASE if k >= 0 else _INVERSE, abs(k), PRIME)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _streamed(groups: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, at_once: int = 4096) -> Callable[[_Batches], _Batches]:
    """A function of rows (tuples) as one of batches."""

    def run(batches: _Batches) -> _Batches:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        held: list[tuple] = []
        for out in groups(rows):
            held.append(out)
            if len(held) >= at_once:
                yield _table(held, schema)
                held = []
        if held:
            yield _table(held, schema)

    return run


# --- turns to blocks

_BLOCK = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("n", pa.int64()), ("sum", pa.binary()), ("size", pa.int64()), ("turns", pa.binary()), ("sizes", pa.list_(pa.int64()))])
BLOCKS = "conv_id bigint, part int, seq bigint, n bigint, sum binary, size bigint, turns binary, sizes array<bigint>"


def _blocks(rows: Iterator[tuple]) -> Iterator[tuple]:
    part, seq, conv, turns, sizes = TaskContext.get().partitionId(), 0, None, [], []

    def block() -> tuple:
        total, power = 0, 1
        for t in turns:
            power = power * BASE % PRIME
            total = (total + _number(t) * power) % PRIME
        return conv, part, seq, len(turns), _raw(total), sum(sizes), b"".join(turns), sizes

    for c, digest, size in rows:
        if turns and (c != conv or len(turns) == BLOCK_TURNS):
            yield block()
            turns, sizes, seq = [], [], seq + 1
        conv = c
        turns.append(digest)
        sizes.append(size)
    if turns:
        yield block()


def turn_blocks(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``BLOCKS``: up to BLOCK_TURNS turns in order, as digests and sizes, with their polynomial as if they came first."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 15)  # below PRIME
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.concat(F.lit(b"\0"), digest).alias("digest"), F.octet_length(text).cast("long").alias("size")).where("conv_id IS NOT NULL")
    order = ["conv_id", "turn", "role", "digest"]
    dealt = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order).select("conv_id", "digest", "size")
    return dealt.mapInArrow(_streamed(_blocks, _BLOCK, 256), BLOCKS)


# --- blocks to paths

_START = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("before", pa.int64()), ("sum_before", pa.binary()), ("size_before", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("head", pa.binary()), ("head_sizes", pa.list_(pa.int64()))])
STARTS = "conv_id bigint, part int, seq bigint, before bigint, sum_before binary, size_before bigint, n bigint, size bigint, head binary, head_sizes array<bigint>"


def _starts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """What lies before each block, and a row (part null) of each conversation's totals and first turns."""
    most = MOST_KEPT - 1
    conv, n, total, size, head, heads = None, 0, 0, 0, b"", []
    for c, part, seq, k, s, sz, turns, sizes in rows:
        if c != conv:
            if conv is not None:
                yield conv, None, None, None, None, None, n, size, head, heads
            conv, n, total, size, head, heads = c, 0, 0, 0, b"", []
        yield c, part, seq, n, _raw(total), size, None, None, None, None
        if len(heads) < most:
            head, heads = head + turns[: WIDTH * (most - len(heads))], heads + sizes[: most - len(heads)]
        total, n, size = (total + _number(s) * _shift(n)) % PRIME, n + k, size + sz
    if conv is not None:
        yield conv, None, None, None, None, None, n, size, head, heads


_PATH = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("start", pa.binary()), ("start_bytes", pa.int64()), ("path", pa.binary()), ("upto", pa.list_(pa.int64())), ("ends", pa.bool_()), ("length", pa.int64()), ("total", pa.int64())])
PATHS = "conv_id bigint, depth bigint, start binary, start_bytes bigint, path binary, upto array<bigint>, ends boolean, length bigint, total bigint"


def _paths(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A block's part of the rebuilt conversation: prefixes and bytes at each depth after ``depth``; the first block has the turns of the base too."""
    for conv, turns, sizes, before, sum_before, size_before, n, size, head, head_sizes, base, base_sizes, h in rows:
        own = sum(head_sizes[:h])  # of the turns that are replaced
        b = min(h, len(base_sizes))
        at, total, power = 0, 0, 1
        for k in range(b):
            power = power * BASE % PRIME
            total = (total + _number(base[WIDTH * k : WIDTH * (k + 1)]) * power) % PRIME
        based, base_bytes = total, sum(base_sizes[:b])
        path, upto = [], []
        if before == 0:
            depth, start, begun, run, power, cum = 0, ROOT, 0, 0, 1, 0
            for k in range(b):
                power = power * BASE % PRIME
                run = (run + _number(base[WIDTH * k : WIDTH * (k + 1)]) * power) % PRIME
                cum += base_sizes[k]
                path.append(_raw(run))
                upto.append(cum)
        skip = max(0, min(len(sizes), h - before))
        first = max(before, h)  # own turns before the ones that follow here
        if before > 0:
            replaced, p = 0, 1
            for k in range(min(h, len(head_sizes))):
                p = p * BASE % PRIME
                replaced = (replaced + _number(head[WIDTH * k : WIDTH * (k + 1)]) * p) % PRIME
            done = replaced if before <= h else _number(sum_before)
            run = (based + (done - replaced) * _shift(b - h)) % PRIME
            depth, start, cum = b + first - h, _raw(run), base_bytes + (size_before - own if before > h else 0)
            begun = cum
        power = _shift(b + first - h)
        for k in range(skip, len(sizes)):
            power = power * BASE % PRIME
            run = (run + _number(turns[WIDTH * k : WIDTH * (k + 1)]) * power) % PRIME
            cum += sizes[k]
            path.append(_raw(run))
            upto.append(cum)
        length, whole = b + max(0, n - h), base_bytes + size - own
        if path or before == 0:
            yield conv, depth, start, begun, b"".join(path), upto, depth + len(path) == length, length, whole


def rebuilt_paths(blocks: DataFrame) -> DataFrame:
    """``PATHS`` of all conversations, each begun with turns of the first of its group."""
    placed = written(
        blocks.select("conv_id", "part", "seq", "n", "sum", "size", F.substring("turns", 1, WIDTH * (MOST_KEPT - 1)).alias("turns"), F.slice("sizes", 1, MOST_KEPT - 1).alias("sizes"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_streamed(_starts, _START), STARTS),
        "trie-starts",
    )
    convs = placed.where("part IS NULL").select("conv_id", "n", "size", "head", "head_sizes")
    group = F.col("conv_id") - F.col("conv_id") % GROUP
    kept = F.crc32(F.col("conv_id").cast("string")) % MOST_KEPT
    bases = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("group"), F.col("head").alias("base"), F.col("head_sizes").alias("base_sizes"))
    plans = convs.withColumn("group", group).join(bases, "group", "left").select("conv_id", "n", "size", "head", "head_sizes", F.coalesce("base", F.lit(b"")).alias("base"), F.coalesce("base_sizes", F.array().cast("array<bigint>")).alias("base_sizes"), kept.cast("int").alias("h"))
    before = placed.where("part IS NOT NULL").select("conv_id", "part", "seq", "before", "sum_before", "size_before")
    rows = blocks.select("conv_id", "part", "seq", "turns", "sizes").join(before, ["conv_id", "part", "seq"]).join(plans, "conv_id")
    rows = rows.select("conv_id", "turns", "sizes", "before", "sum_before", "size_before", "n", "size", "head", "head_sizes", "base", "base_sizes", "h")
    return rows.mapInArrow(_streamed(_paths, _PATH, 256), PATHS)


# --- z-fast tries

def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the highest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class _Node:
    """A compacted node: its edge holds the depths in (above, depth] of the path that made it, whose ``tag`` it keeps."""

    __slots__ = ("above", "depth", "path", "first", "tag", "up", "below", "least", "sums")

    def __init__(self, up: _Node | None, above: int, depth: int, path: list[bytes], first: int, tag: object, least: int, width: int) -> None:
        self.up, self.above, self.depth, self.path, self.first, self.tag, self.least = up, above, depth, path, first, tag, least
        self.below: dict[bytes, _Node] = {}
        self.sums = [0] * width

    def prefix(self, depth: int) -> bytes:
        return self.path[depth - self.first]


class ZFastTrie:
    """Paths of prefix numbers; ``add`` puts a path's weights where it ends, ``rows`` sums them up over what is below."""

    def __init__(self, start: bytes, depth: int, width: int) -> None:
        self.width = width
        self.root = _Node(None, depth - 1, depth, [start], depth, None, 1 << 63, width)
        self.handles: dict[tuple[int, bytes], _Node] = {}

    def exit(self, path: list[bytes], stop: int) -> tuple[_Node, _Node]:
        """(the deepest node that the path passes, the node it leaves the trie in, the same if it goes on beyond it) by fat binary search; ``path`` begins at the root."""
        top = self.root.depth
        passed, a, b = self.root, top, stop
        while a < b:
            f = two_fattest(a, b)
            node = self.handles.get((f, path[f - top]))
            if node is None:
                b = f - 1
            elif node.depth <= stop and node.prefix(node.depth) == path[node.depth - top]:
                passed = node
                a = node.depth
            else:
                return node.up, node
        here = passed.depth
        return passed, passed.below.get(path[here + 1 - top], passed) if here < stop else passed

    def _hang(self, node: _Node) -> None:
        self.handles[two_fattest(node.above, node.depth), node.prefix(two_fattest(node.above, node.depth))] = node

    def locate(self, path: list[bytes], stop: int, least: int, tag: object = None) -> _Node:
        """The node that ends at depth ``stop`` of the path; made, and its edge split off, where there is none."""
        top = self.root.depth
        passed, leaves = self.exit(path, stop)
        if leaves is not passed:
            lo, hi = passed.depth, min(leaves.depth, stop)  # equal up to lo
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if leaves.prefix(mid) == path[mid - top] else (lo, mid - 1)
            if lo < leaves.depth:  # a node at depth lo between the two
                del self.handles[two_fattest(leaves.above, leaves.depth), leaves.prefix(two_fattest(leaves.above, leaves.depth))]
                middle = _Node(passed, passed.depth, lo, leaves.path, leaves.first, leaves.tag, leaves.least, self.width)
                passed.below[leaves.prefix(passed.depth + 1)] = middle
                middle.below[leaves.prefix(lo + 1)] = leaves
                leaves.above, leaves.up = lo, middle
                self._hang(middle)
                self._hang(leaves)
                passed = middle
        if passed.depth < stop:
            node = _Node(passed, passed.depth, stop, path, top, tag, least, self.width)
            passed.below[path[passed.depth + 1 - top]] = node
            self._hang(node)
            passed = node
        return passed

    def add(self, path: list[bytes], stop: int, least: int, weights: tuple, tag: object = None) -> None:
        node = self.locate(path, stop, least, tag)
        node.least = min(node.least, least)
        node.sums = [a + b for a, b in zip(node.sums, weights)]

    def rows(self, with_root: bool) -> Iterator[tuple]:
        """Edges expanded: (node with its sums over all below, depth on its edge, weights of paths that end there), from the leaves up."""
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node.below.values()
        for node in reversed(order):
            ends = node.sums
            for child in node.below.values():
                node.least = min(node.least, child.least)
                node.sums = [a + b for a, b in zip(node.sums, child.sums)]
            for d in range(node.depth, node.above, -1):
                if d > self.root.depth or with_root:
                    yield node, d, ends if d == node.depth else [0] * self.width


_PIECE = pa.schema([("depth", pa.int64()), ("prefix", pa.binary()), ("above", pa.binary()), ("last_bytes", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("n_ends", pa.int64()), ("bytes_above", pa.int64())])
PIECES = "depth bigint, prefix binary, above binary, last_bytes bigint, n_convs bigint, conv_id bigint, n_ends bigint, bytes_above bigint"
_SUM = pa.schema([("depth", pa.int64()), ("prefix", pa.binary()), ("n_saving", pa.int64()), ("bytes_saving", pa.int64()), ("n_leaves", pa.int64())])
SUMS = "depth bigint, prefix binary, n_saving bigint, bytes_saving bigint, n_leaves bigint"


def _split(start: bytes, path: bytes) -> list[bytes]:
    return [start, *(path[k : k + WIDTH] for k in range(0, len(path), WIDTH))]


def _batches_of(rows: Iterator[tuple], width: int, add: Callable[[ZFastTrie, list[bytes], tuple], None], expand: Callable[[ZFastTrie], Iterator[tuple]]) -> Iterator[tuple]:
    """One trie for each start in a batch of paths, expanded when the batch is full."""
    tries: dict[tuple[int, bytes], ZFastTrie] = {}
    held = 0
    for row in rows:
        depth, start, path = row[1], row[2], row[3]
        trie = tries.get((depth, start))
        if trie is None:
            trie = tries[depth, start] = ZFastTrie(start, depth, width)
        add(trie, _split(start, path), row)
        held += len(path) // WIDTH + 1
        if held >= BATCH_TURNS:
            for t in tries.values():
                yield from expand(t)
            tries, held = {}, 0
    for t in tries.values():
        yield from expand(t)


def _count(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes with their members, smallest member and ends, from (conv_id, depth, start, path, start_bytes, upto, ends)."""

    def add(trie: ZFastTrie, path: list[bytes], row: tuple) -> None:
        conv, depth, _, _, start_bytes, upto, ends = row
        trie.add(path, depth + len(upto), conv, (1, int(ends)), [start_bytes, *upto])

    def expand(trie: ZFastTrie) -> Iterator[tuple]:
        top = trie.root.depth
        for node, d, ends in trie.rows(top == 0):
            if d == top:
                yield d, node.prefix(d), None, 0, node.sums[0], node.least, ends[1], 0
            else:
                before, after = node.tag[d - 1 - node.first : d + 1 - node.first]
                yield d, node.prefix(d), node.prefix(d - 1), after - before, node.sums[0], node.least, ends[1], before

    yield from _batches_of(rows, 2, add, expand)


def _sum(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sums over members, from (conv_id, depth, start, path, shared, shared_bytes, owns_leaf)."""

    def add(trie: ZFastTrie, path: list[bytes], row: tuple) -> None:
        conv, depth, _, _, shared, shared_bytes, leaf = row
        stop = depth + len(path) - 1
        if shared > depth or depth == 0:
            trie.add(path, min(stop, shared), conv, (1, shared_bytes, 0))
        if leaf:
            trie.add(path, stop, conv, (0, 0, 1))

    def expand(trie: ZFastTrie) -> Iterator[tuple]:
        for node, d, _ in trie.rows(trie.root.depth == 0):
            yield d, node.prefix(d), *node.sums

    yield from _batches_of(rows, 3, add, expand)


def _alike(paths: DataFrame) -> DataFrame:
    """Paths dealt so that those with long common prefixes meet; a hot prefix is cut further down, at last by conversation."""
    at = lambda k: F.substring("path", WIDTH * (k - 1) + 1, WIDTH)
    order = [F.col("depth"), F.col("start"), at(1), at(2), at(4), at(8), F.col("conv_id")]
    return paths.repartitionByRange(partitions(paths), *order).sortWithinPartitions(*order)


# --- digests of ids that end at a node

_IDS = pa.schema([("prefix", pa.binary()), ("part", pa.int32()), ("seq", pa.int64()), ("ids", pa.string()), ("sha", pa.string())])


def _gather(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Digests of nodes whose ids all lie in this task; joined ids, in pieces, of those that may go on in another."""
    part, seq, prefix, ids, size, open_piece = TaskContext.get().partitionId(), 0, None, [], 0, True
    for p, conv in rows:
        full = size >= PIECE_BYTES
        if ids and (p != prefix or full):
            text = ",".join(ids)
            piece = open_piece or (full and p == prefix)
            yield (prefix, part, seq, text, None) if piece else (prefix, None, None, None, hashlib.sha256(text.encode()).hexdigest())
            open_piece = piece and p == prefix
            ids, size, seq = [], 0, seq + 1
        prefix = p
        ids.append(str(conv))
        size += len(ids[-1]) + 1
    if ids:
        yield prefix, part, seq, ",".join(ids), None


def _digest(rows: Iterator[tuple]) -> Iterator[tuple]:
    prefix, sha = None, None
    for p, ids in rows:
        if p != prefix:
            if sha:
                yield prefix, sha.hexdigest()
            prefix, sha = p, hashlib.sha256(ids.encode())
        else:
            sha.update(b"," + ids.encode())
    if sha:
        yield prefix, sha.hexdigest()


def end_digests(ends: DataFrame) -> DataFrame:
    """``(prefix, ends_sha256)`` of (prefix, conv_id): the ids in ascending order, comma-joined, as SHA-256."""
    dealt = ends.repartitionByRange(partitions(ends), "prefix", "conv_id").sortWithinPartitions("prefix", "conv_id")
    found = written(dealt.mapInArrow(_streamed(_gather, _IDS, 512), "prefix binary, part int, seq bigint, ids string, sha string"), "trie-ends")
    pieces = found.where("part IS NOT NULL").select("prefix", "ids", "part", "seq").repartition("prefix").sortWithinPartitions("prefix", "part", "seq").select("prefix", "ids")
    joined = pieces.mapInArrow(_streamed(_digest, pa.schema([("prefix", pa.binary()), ("ends_sha256", pa.string())])), "prefix binary, ends_sha256 string")
    return found.where("part IS NULL").select("prefix", F.col("sha").alias("ends_sha256")).unionByName(joined)


def prefix_trie(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, prefix)``, one row a node."""
    blocks = written(turn_blocks(conversations, id_col, turn_col, role_col, text_col), "trie-blocks")
    paths = written(rebuilt_paths(blocks), "trie-paths")
    pieces = _alike(paths.select("conv_id", "depth", "start", "path", "start_bytes", "upto", "ends")).mapInArrow(_streamed(_count, _PIECE), PIECES)
    firsts = [F.min(c).alias(c) for c in ("above", "last_bytes", "bytes_above")]
    nodes = written(pieces.groupBy("depth", "prefix").agg(*firsts, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_ends").alias("n_ends")), "trie-nodes")

    leaf: Column = F.col("n_ends") == F.col("n_convs")
    owners = nodes.groupBy("conv_id").agg(F.count(F.when(F.col("depth") > 0, 1)).alias("owned"), F.sum("last_bytes").alias("owned_bytes"), F.max(leaf).alias("owns_leaf"))
    none = F.lit(0).cast("bigint")
    members = paths.join(owners, "conv_id", "left").select("conv_id", "depth", "start", "path", (F.col("length") - F.coalesce("owned", none)).alias("shared"), (F.col("total") - F.coalesce("owned_bytes", none)).alias("shared_bytes"), F.coalesce("owns_leaf", F.lit(False)).alias("owns_leaf"))
    telling = members.where((F.col("shared") > F.col("depth")) | (F.col("depth") == 0) | F.col("owns_leaf"))
    sums = _alike(telling).mapInArrow(_streamed(_sum, _SUM), SUMS).groupBy("depth", "prefix").agg(*[F.sum(c).alias(c) for c in ("n_saving", "bytes_saving", "n_leaves")])

    children = nodes.where("depth > 0").groupBy(F.col("above").alias("prefix"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    last = F.when(F.length("path") > 0, F.substring("path", -WIDTH, WIDTH)).otherwise(F.col("start"))
    ends = end_digests(paths.where("ends").select(last.alias("prefix"), "conv_id"))
    parents = nodes.select(F.col("prefix").alias("above"), F.col("depth").alias("depth_above"), F.col("conv_id").alias("parent_conv_id"))
    every = nodes.join(sums, ["depth", "prefix"], "left").join(children, ["depth", "prefix"], "left").join(ends, "prefix", "left")
    every = every.withColumn("depth_above", F.col("depth") - 1).join(parents, ["above", "depth_above"], "left")
    saved = F.coalesce(F.col("bytes_saving") - F.col("n_saving") * F.col("bytes_above"), none)
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), F.coalesce("n_leaves", none).alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"), F.lower(F.hex("prefix")).alias("prefix"))
