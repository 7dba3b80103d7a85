"""Conversation prefix trie: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id has ``WIDTH`` bytes: 16 of the SHA-256 of its role and text, and the text's UTF-8
length as a big-endian number, so ids of equal width compare as numbers byte by byte and need
no dictionary.  A conversation's key is the ids of its turns in a row.

* Conversations of one key are gathered first, in chunks of ``CHUNK`` consecutive conversation
  numbers, so a sequence that a third of all conversations share arrives as a few rows of
  number lists, whose hash a task continues from row to row.
* Keys are dealt to tasks in ranges (sorted), so a common first turn spreads over tasks as its
  continuations do.  A task inserts its keys into an adaptive radix tree: nodes hold 4, 16,
  48 or 256 children in layouts that grow when full, and runs without a branch are one
  compressed prefix.  Trees branch at any byte; only byte depths that are a multiple of
  ``WIDTH`` are turns, and only those emit nodes.
* A tree that holds more than ``HELD_BYTES`` is written out and a new one begun, so memory is
  bounded whatever a task's share.
* All nodes but those on the way to a tree's first and last key are whole within the tree.  The
  others, two paths a tree, may go on in the neighbouring trees: they are written with what hangs off
  them, merged by their path's hash and summed up along the paths, in DataFrame operations.

Defined results: rows without conversation number are no conversation and are dropped; turns
are ordered by number (null first), then role and text; rows that repeat a turn are turns of
their own; null roles and texts are empty; an empty table gives no nodes.  Other columns are
not read, so names cannot clash.  The ids of one conversation (20 bytes a turn, no texts)
must fit in a row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import column, table
from lodestone.llm.exact_dedup import shared
from lodestone.operators.skew import skewed_join
from lodestone.session import settled

#: Bytes of a turn id, and of the text length at its end.
WIDTH, LENGTH = 20, 4
CHUNK = 1 << 16
#: Bytes that a tree holds before it is written out, and what a node costs beside its prefix.
HELD_BYTES, NODE_BYTES = 64 << 20, 500
NOTHING = hashlib.sha256().hexdigest()


class Sorted:
    """Up to 4 or 16 children: sorted branch bytes beside a list."""

    def __init__(self, room: int = 4, branches=(), nodes=()):
        self.room, self.branches, self.nodes = room, bytearray(branches), list(nodes)

    def find(self, branch: int):
        at = self.branches.find(branch)
        return None if at < 0 else self.nodes[at]

    def add(self, branch: int, node):
        if len(self.nodes) == self.room:
            if self.room == 4:
                return Sorted(16, self.branches, self.nodes).add(branch, node)
            return Indexed(zip(self.branches, self.nodes)).add(branch, node)
        at = bisect_left(self.branches, branch)
        self.branches.insert(at, branch)
        self.nodes.insert(at, node)
        return self

    def children(self):
        return self.nodes


class Indexed:
    """Up to 48 children: a table of places for all bytes, and a list."""

    room = 48

    def __init__(self, pairs):
        self.places, self.nodes = bytearray(256), []
        for branch, node in pairs:
            self.add(branch, node)

    def find(self, branch: int):
        place = self.places[branch]
        return self.nodes[place - 1] if place else None

    def add(self, branch: int, node):
        if len(self.nodes) == self.room:
            return Full((b, self.nodes[p - 1]) for b, p in enumerate(self.places) if p).add(branch, node)
        self.nodes.append(node)
        self.places[branch] = len(self.nodes)
        return self

    def children(self):
        return [self.nodes[p - 1] for p in self.places if p]


class Full:
    """A slot for every byte."""

    room = 256

    def __init__(self, pairs):
        self.slots = [None] * 256
        for branch, node in pairs:
            self.slots[branch] = node

    def find(self, branch: int):
        return self.slots[branch]

    def add(self, branch: int, node):
        self.slots[branch] = node
        return self

    def children(self):
        return [n for n in self.slots if n is not None]


class _Node:
    """``prefix`` starts with the branch byte; ``end`` is (conversations, smallest, hash) of a key that ends here."""

    __slots__ = ("prefix", "layout", "end", "key", "on", "start", "n", "low", "tops", "leaves", "saved", "above")

    def __init__(self, prefix: bytes, end=None, key: bytes | None = None):
        self.prefix, self.layout, self.end, self.key, self.on = prefix, None, end, key, 0

    def children(self):
        return self.layout.children() if self.layout else ()

    def add(self, branch: int, node: _Node) -> None:
        self.layout = (self.layout or Sorted()).add(branch, node)


class AdaptiveRadixTree:
    """Keys inserted in any order; nodes come out in the order of their keys."""

    def __init__(self, width: int = WIDTH):
        self.width, self.root, self.held, self.first, self.last = width, _Node(b""), 0, None, None

    def insert(self, key: bytes, end: tuple) -> None:
        self.first = key if self.first is None or key < self.first else self.first
        self.last = key if self.last is None or key > self.last else self.last
        node, at = self.root, 0
        while True:
            k = shared(node.prefix, key, at)
            if k < len(node.prefix):  # branch inside a compressed run
                lower = _Node(node.prefix[k:], node.end, node.key)
                lower.layout = node.layout
                node.prefix, node.layout, node.end, node.key = node.prefix[:k], None, None, None
                node.add(lower.prefix[0], lower)
                self.held += NODE_BYTES
            at += k
            if at == len(key):
                node.end, node.key = end, key
                return
            child = node.layout.find(key[at]) if node.layout else None
            if child is None:
                node.add(key[at], _Node(key[at:], end, key))
                self.held += 2 * len(key) + NODE_BYTES
                return
            node = child

    def _size(self, key: bytes, depth: int) -> int:
        return int.from_bytes(key[depth * self.width - LENGTH:depth * self.width], "big") if depth else 0

    def _mark(self, key: bytes, flag: int) -> None:
        node, at = self.root, 0
        while True:
            node.on |= flag
            at += len(node.prefix)
            if at == len(key):
                return
            node = node.layout.find(key[at])

    def _measure(self) -> list[_Node]:
        """Sums of every subtree, children before parents; returns the nodes in key order.

        ``tops`` counts the nodes of the next turn depth below a tree node, ``saved`` is the sum
        below it, and ``above`` adds the turns inside its own prefix.
        """
        order, stack = [], [(self.root, 0)]
        while stack:
            node, node.start = stack.pop()
            order.append(node)
            end = node.start + len(node.prefix)
            stack.extend((c, end) for c in reversed(node.children()))
        for node in reversed(order):
            node.n, node.low = node.end[:2] if node.end else (0, None)
            node.tops = node.leaves = node.saved = 0
            low, high = node.start // self.width, (node.start + len(node.prefix)) // self.width
            for c in node.children():
                node.n += c.n
                node.low = c.low if node.low is None else min(node.low, c.low)
                node.key = node.key if node.key is not None else c.key
                crosses = (c.start + len(c.prefix)) // self.width > c.start // self.width
                node.tops += 1 if crosses else c.tops
                node.leaves += c.leaves
                node.saved += c.above
            if node.layout is None:
                node.leaves = 1
            node.above = node.saved + (node.n - 1) * sum(self._size(node.key, d) for d in range(low + 1, high + 1))
        return order

    def _hanging(self, node: _Node) -> tuple[int, int, int]:
        """Children, leaves and savings below ``node`` that are off both paths."""
        tops = leaves = saved = 0
        for c in node.children():
            if not c.on:
                crosses = (c.start + len(c.prefix)) // self.width > c.start // self.width
                tops, leaves, saved = tops + (1 if crosses else c.tops), leaves + c.leaves, saved + c.above
            elif (c.start + len(c.prefix)) // self.width == c.start // self.width:
                more = self._hanging(c)
                tops, leaves, saved = tops + more[0], leaves + more[1], saved + more[2]
        return tops, leaves, saved

    def nodes(self, part: int) -> Iterator[tuple]:
        """Rows of ``NODES``: whole nodes, and those on the first and last path with what hangs off them."""
        if self.first is None:
            return
        width = self.width
        self._mark(self.first, 1)
        self._mark(self.last, 2)
        parents: dict[int, tuple] = {}
        hashes = {1: hashlib.sha256(), 2: hashlib.sha256()}
        root = hashes[1].digest()
        for node in self._measure():
            low, high = node.start // width, (node.start + len(node.prefix)) // width
            # the parent of the first turn in this prefix is where the tree node above left off
            conv, path = parents[node.start] if node.start in parents else (None, None)
            ended = node.end if node.end and node.start + len(node.prefix) == high * width else None
            saved = node.above
            for d in range(low + 1 if node is not self.root else 0, high + 1):
                size = self._size(node.key, d)
                last = d == high
                ends = ended[2] if last and ended else NOTHING
                turn = node.key[(d - 1) * width:d * width] if d else b""
                if node.on:
                    flags = [f for f in (1, 2) if node.on & f]
                    for f in flags:
                        hashes[f].update(turn)
                    mine = hashes[flags[0]].digest() if d else root
                    hang = self._hanging(node) if last else (0, 0, 0)
                    yield (d, node.low, None, node.n, *hang, ends, turn, part, node.on, mine, path, size)
                    conv, path = None, mine
                else:
                    yield (d, node.low, conv, node.n, node.tops if last else 1, node.leaves, saved, ends, turn, None, None, None, path, None)
                    conv, path = node.low, None
                saved -= (node.n - 1) * size
            parents[node.start + len(node.prefix)] = (conv, path)


NODES = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                   ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
                   ("turn_id", pa.binary()), ("part", pa.int64()), ("side", pa.int32()), ("path", pa.binary()), ("parent_path", pa.binary()),
                   ("size", pa.int64())])
_DDL = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string, turn_id binary, part long, side int, path binary, parent_path binary, size long")
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id")


def _trees(held_bytes: int):
    """Sorted (key, numbers, n, low) rows to nodes."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, digest, n, low = None, None, 0, None
        for batch in batches:
            for key, numbers, count, least in zip(*(batch.column(c).to_pylist() for c in ("key", "numbers", "n", "low"))):
                if key != held:
                    if held is not None:
                        yield held, (n, low, digest.hexdigest())
                    held, digest, n, low = key, hashlib.sha256(numbers.encode()), count, least
                else:
                    digest.update(b"," + numbers.encode())
                    n, low = n + count, min(low, least)
        if held is not None:
            yield held, (n, low, digest.hexdigest())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tree, part = AdaptiveRadixTree(), TaskContext.get().partitionId() << 32
        for key, end in keys(batches):
            tree.insert(key, end)
            if tree.held > held_bytes:
                yield from tree.nodes(part)
                tree, part = AdaptiveRadixTree(), part + 1
        yield from tree.nodes(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in rows(batches):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), NODES)], schema=NODES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), NODES)], schema=NODES)

    return run


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn as hexadecimal digits."""
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return F.concat(F.substring(F.sha2(said, 256), 1, 2 * (WIDTH - LENGTH)), F.lpad(F.lower(F.hex(F.octet_length(text).cast("bigint"))), 2 * LENGTH, "0"))


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """``(conv, turn, tie, id)``: ``tie`` orders different turns of one number by role and text."""
    rows = conversations.select(column(conv_col).cast("bigint").alias("conv"), column(turn_col).cast("bigint").alias("turn"),
                                F.coalesce(column(role_col).cast("string"), F.lit("")).alias("role"),
                                F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.where("conv IS NOT NULL").withColumn("id", turn_id(F.col("role"), F.col("text")))
    light = rows.select("conv", "turn", "id")
    tied = settled(light.groupBy("conv", "turn").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("conv", "turn"))
    if tied.isEmpty():
        return light.withColumn("tie", F.lit(0))
    same = (F.col("l.conv") == F.col("r.conv")) & F.col("l.turn").eqNullSafe(F.col("r.turn"))
    ranked = rows.alias("l").join(tied.alias("r"), same, "left_semi").distinct().select(
        "conv", "turn", "id", F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text")).alias("tie"))
    return light.alias("l").join(ranked.alias("r"), same & (F.col("l.id") == F.col("r.id")), "left").select(
        "l.conv", "l.turn", "l.id", F.coalesce("tie", F.lit(0)).alias("tie"))


def _in_order() -> Column:
    """The turns of a group, in order."""
    return F.array_sort(F.collect_list(F.struct("conv", F.col("turn").isNotNull().alias("known"), "turn", "tie", "id")))


def _key(*ids: str) -> Column:
    return F.expr("unhex(concat(" + ", ".join(f"array_join({i}, '')" for i in ids) + "))")


def keys(ordered: DataFrame) -> DataFrame:
    """``(conv, key)`` of every conversation."""
    whole = ordered.groupBy("conv").agg(_in_order().alias("t"))
    return whole.select("conv", _key("transform(t, x -> x.id)").alias("key"))


def rebuilt_keys(ordered: DataFrame) -> DataFrame:
    """As :func:`keys`, of conversations that start like the first of their five.

    Conversation c takes the first h turns of conversation c - c % 5 in place of its own first h,
    h being the unsigned CRC-32 of c's digits modulo 9.  Both sides of that meet in one grouping.
    """
    fives = ordered.groupBy((F.col("conv") - F.col("conv") % 5).alias("base")).agg(_in_order().alias("t"))
    each = fives.select("base", "t", F.explode(F.expr("array_distinct(transform(t, x -> x.conv))")).alias("conv"))
    each = each.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("int"))
    return each.select("conv", _key("slice(transform(filter(t, x -> x.conv = base), x -> x.id), 1, h)",
                                    "slice(transform(filter(t, x -> x.conv = conv), x -> x.id), h + 1, 2147483647)").alias("key"))


def prefix_nodes(members: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The trie of ``(conv, key)``: a row per node with the columns ``RESULT``.

    ``turn_id`` is the id of the node's last turn (empty at the root); :func:`turn_id` gives the same
    digits for a role and a text.
    """
    chunks = members.groupBy("key", F.expr(f"conv DIV {CHUNK} - IF(conv % {CHUNK} < 0, 1, 0)").alias("chunk")).agg(F.array_sort(F.collect_list("conv")).alias("c"))
    chunks = settled(chunks.select("key", "chunk", F.array_join(F.col("c").cast("array<string>"), ",").alias("numbers"),
                                   F.size("c").cast("bigint").alias("n"), F.col("c")[0].alias("low")))
    ranged = chunks.repartitionByRange("key").sortWithinPartitions("key", "chunk").select("key", "numbers", "n", "low")
    found = settled(ranged.mapInArrow(_trees(held_bytes), _DDL))
    paths = found.where("part IS NOT NULL")
    merged = paths.groupBy("path").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("hanging"),
        F.max(F.when(F.col("ends_sha256") != NOTHING, F.col("ends_sha256"))).alias("ends"), F.first("turn_id").alias("turn_id"),
        F.first("parent_path").alias("parent_path"), F.first("size").alias("size"), F.min("part").alias("owner"))
    merged = settled(merged)
    above = merged.where("parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("more"))
    own = merged.join(above, "path", "left").withColumn("n_children", F.col("hanging") + F.coalesce("more", F.lit(0)))
    mine = own.select("path", "owner", (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("own"))
    first = F.col("part") == F.col("owner")
    values = skewed_join(paths.select("path", "part", "side", "depth", "n_leaves", "saved_tokens"), mine, "path").select(
        "path", "part", "side", "depth", (F.col("n_leaves") + F.when(first, F.col("leaf")).otherwise(0)).alias("leaves"),
        (F.col("saved_tokens") + F.when(first, F.col("own")).otherwise(0)).alias("saved"))
    # below a node that both paths share lies all that is deeper in its tree; below another one what is deeper on its path
    deeper = Window.partitionBy("part", "side").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tree = Window.partitionBy("part")
    sums = values.select("path", *((F.sum(c).over(deeper) + F.when(F.col("side") == 3, F.sum(F.when(F.col("side") != 3, F.col(c)).otherwise(0)).over(tree))
                                    .otherwise(0)).alias(c) for c in ("leaves", "saved")))
    totals = sums.groupBy("path").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent"))
    spine = own.join(totals, "path").join(parents, "parent_path", "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"), "turn_id")
    whole = found.where("part IS NULL")
    inner = whole.where("parent_path IS NULL").select(*RESULT)
    edge = skewed_join(whole.where("parent_path IS NOT NULL"), parents, "parent_path").withColumn("parent_conv_id", F.col("parent")).select(*RESULT)
    return inner.unionByName(edge).unionByName(spine)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_nodes(rebuilt_keys(turns(table(spark, sf_dir, "conversations")))).drop("turn_id")


ORACLE = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT c, c - c % 5 AS b, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)
), r AS (
  SELECT k.c, t.i, t.id, t.size FROM k JOIN t ON t.c = k.b AND t.i <= k.h
  UNION ALL SELECT k.c, t.i, t.id, t.size FROM k JOIN t ON t.c = k.c AND t.i > k.h
), p AS (
  SELECT c, row_number() OVER w AS d, string_agg(id, '') OVER (w ROWS UNBOUNDED PRECEDING) AS path, size, count(*) OVER (PARTITION BY c) AS n
  FROM r WINDOW w AS (PARTITION BY c ORDER BY i)
), m AS (
  SELECT c, d, path, size, d = n AS ends FROM p
  UNION ALL SELECT k.c, 0, '', 0, k.c NOT IN (SELECT c FROM r) FROM k
), n AS (
  SELECT path, any_value(d) AS d, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path
), kids AS (
  SELECT path[:-33] AS path, count(*) AS n_children FROM n WHERE path <> '' GROUP BY ALL
), q AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)
), sub AS (
  SELECT substr(q.path, 1, 32 * a) AS path, sum(own) AS saved_tokens, sum((n_children = 0)::INT) AS n_leaves
  FROM q, LATERAL (SELECT unnest(range(0, q.d + 1)) AS a) GROUP BY ALL
)
SELECT q.c AS conv_id, q.d::BIGINT AS depth, up.c AS parent_conv_id, q.n_convs, q.n_children, sub.n_leaves::BIGINT AS n_leaves,
       sub.saved_tokens::BIGINT AS saved_tokens, q.ends_sha256
FROM q JOIN sub USING (path) LEFT JOIN q up ON q.path <> '' AND up.path = q.path[:-33]
"""
