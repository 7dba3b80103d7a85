"""Exact dedup with Patricia tries.

Texts are dealt by byte length and content hash, so equal texts meet in one task and
a task holds whole byte strings in a compressed radix trie.  A terminal node keeps the
owner of its text (the smallest or largest identifier), how many rows the text has, and
how many of them carry the owner's identifier.

* Before the shuffle each task inserts its own rows into a trie of bounded size and
  sends one row per distinct text, so a text that a third of all rows share arrives as
  at most a few rows per task.
* A trie that outgrows ``held_bytes`` writes its largest subtree to an anonymous
  temporary file and appends later texts of that branch there; each spilled subtree is
  then handled by itself below its common prefix.  Files vanish with the task.
* Members find their group by the SHA-256 of the text.  Only groups of two or more are
  joined; Spark splits a hot group on the side of its members.

Defined results: null text equals empty text; a null identifier is never preferred to
another; a group of null identifiers only has a null owner.  Rows that repeat identifier
and text are one document (identifiers are whole numbers; other types fail the cast to bigint): the report marks each, the filter writes one of them (the one
whose columns come first as JSON).  Other columns, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, packed, table, text_of, unpacked
from lodestone.session import settled

#: Bytes of labels and nodes that one trie holds before it spills.
HELD_BYTES = 64 << 20
#: What a node costs beside its label.
NODE_BYTES = 400


def merged(one, two, largest: bool):
    """Two terminals of one text: (owner, rows of the owner, rows)."""
    if one is None:
        return two
    a, b = one[0], two[0]
    rows = one[2] + two[2]
    if a == b:
        return a, one[1] + two[1], rows
    first = b is None or (a is not None and (a > b) == largest)
    return (a, one[1], rows) if first else (b, two[1], rows)


def shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class _Node:
    __slots__ = ("edges", "value")

    def __init__(self, value=None):
        self.edges: dict[int, list] = {}
        self.value = value


class _Spilled:
    """Texts below one edge of the root, as (rest of the key, value) records in a file."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()
        self.common: bytes | None = None

    def add(self, key: bytes, value) -> None:
        self.common = key if self.common is None else self.common[:shared(self.common, key, 0)]
        pickle.dump((key, value), self.file)

    def records(self):
        self.file.seek(0)
        try:
            while True:
                yield pickle.load(self.file)
        except EOFError:
            self.file.close()


class PatriciaTrie:
    """Compressed radix trie over byte strings whose size in memory is bounded.

    ``terminals()`` empties the trie and yields (SHA-256 state of the key, value).
    """

    def __init__(self, largest: bool, held_bytes: int = HELD_BYTES, prefix: bytes = b""):
        self.largest, self.limit, self.prefix = largest, held_bytes, prefix
        self.root, self.held, self.spilled = _Node(), 0, {}
        self.spills = 0

    def insert(self, key: bytes, value) -> None:
        if key and key[0] in self.spilled:
            self.spilled[key[0]].add(key, value)
            return
        node, at, end = self.root, 0, len(key)
        while at < end:
            edge = node.edges.get(key[at])
            if edge is None:
                leaf = _Node()
                node.edges[key[at]] = [key[at:], leaf]
                self.held += end - at + NODE_BYTES
                node = leaf
                break
            label, child = edge
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = shared(label, key, at)
            middle = _Node()
            middle.edges[label[k]] = [label[k:], child]
            edge[0], edge[1] = label[:k], middle
            self.held += NODE_BYTES
            node, at = middle, at + k
        node.value = merged(node.value, value, self.largest)
        if self.held > self.limit:
            self._spill()

    @staticmethod
    def _below(label: bytes, node: _Node):
        stack = [(label, node)]
        while stack:
            key, at = stack.pop()
            if at.value is not None:
                yield key, at.value
            for rest, child in at.edges.values():
                stack.append((key + rest, child))

    @staticmethod
    def _weight(label: bytes, node: _Node) -> int:
        total, stack = 0, [(label, node)]
        while stack:
            rest, at = stack.pop()
            total += len(rest) + NODE_BYTES
            stack.extend(at.edges.values())
        return total

    def _spill(self) -> None:
        """Write the largest subtree of the root to a file."""
        if not self.root.edges:
            return
        weights = {b: self._weight(*edge) for b, edge in self.root.edges.items()}
        byte = max(weights, key=lambda b: (weights[b], -b))
        out = _Spilled()
        for key, value in self._below(*self.root.edges.pop(byte)):
            out.add(key, value)
        self.spilled[byte] = out
        self.held -= weights[byte]
        self.spills += 1

    def terminals(self):
        stack = [(hashlib.sha256(self.prefix), b"", self.root)]
        self.root = _Node()
        while stack:
            state, label, node = stack.pop()
            if label:
                state = state.copy()
                state.update(label)
            if node.value is not None:
                yield state, node.value
            for rest, child in node.edges.values():
                stack.append((state, rest, child))
            node.edges = {}
        spilled, self.spilled, self.held = self.spilled, {}, 0
        for part in spilled.values():
            cut = len(part.common)
            inner = PatriciaTrie(self.largest, self.limit, self.prefix + part.common)
            for key, value in part.records():
                inner.insert(key[cut:], value)
            self.spills += inner.spills
            yield from inner.terminals()

    def flushed(self):
        """(key, value) of everything held, and empty the trie; for tries that never spilled."""
        held, self.root, self.held = self.root, _Node(), 0
        yield from self._below(b"", held)


SENT = pa.schema([("length", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("owner", pa.int64()),
                  ("owner_rows", pa.int64()), ("rows", pa.int64())])
OWNERS = pa.schema([("sha", pa.string()), ("owner", pa.int64()), ("owner_rows", pa.int64()), ("rows", pa.int64())])


def _rows(batch: pa.RecordBatch):
    return zip(*(batch.column(n).to_pylist() for n in ("text", "hash", "owner", "owner_rows", "rows")))


def combiner(largest: bool, held_bytes: int):
    """Within one task: one row per distinct text of each ``held_bytes`` of texts."""

    def send(trie: PatriciaTrie, hashes: dict):
        out, size = [], 0
        for key, (owner, owner_rows, rows) in trie.flushed():
            out.append((len(key), hashes[key], key, owner, owner_rows, rows))
            size += len(key)
            if size > (8 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SENT)], schema=SENT)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SENT)], schema=SENT)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, hashes = PatriciaTrie(largest, 1 << 62), {}
        for batch in batches:
            for text, digest, owner, owner_rows, rows in _rows(batch):
                hashes[text] = digest
                trie.insert(text, (owner, owner_rows, rows))
                if trie.held > held_bytes:
                    yield from send(trie, hashes)
                    hashes = {}
        yield from send(trie, hashes)

    return combine


def inserter(largest: bool, held_bytes: int):
    """Whole tries over the partition; a row per distinct text that has several rows."""

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(largest, held_bytes)
        for batch in batches:
            for text, _, owner, owner_rows, rows in _rows(batch):
                trie.insert(text, (owner, owner_rows, rows))
        out = []
        for state, value in trie.terminals():
            if value[2] > 1:
                out.append((state.hexdigest(), *value))
            if len(out) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OWNERS)], schema=OWNERS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OWNERS)], schema=OWNERS)

    return insert


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
           normal: Column | None = None, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``(sha, owner, owner_rows, rows)`` of every text that has more than one row."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is 'smallest' or 'largest', not {keep!r}")
    largest = keep == "largest"
    text = (text_of(text_col) if normal is None else normal).cast("binary")
    one = F.lit(1).cast("bigint")
    rows = docs.select(F.xxhash64(text).alias("hash"), text.alias("text"),
                       column(id_col).cast("bigint").alias("owner"), one.alias("owner_rows"), one.alias("rows"))
    sent = rows.mapInArrow(combiner(largest, held_bytes // 4),
                           "length long, hash long, text binary, owner long, owner_rows long, rows long")
    owners = sent.repartition("length", "hash").mapInArrow(
        inserter(largest, held_bytes), "sha string, owner long, owner_rows long, rows long")
    return settled(owners)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                normal: Column | None = None, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    text = text_of(text_col) if normal is None else normal
    found = groups(docs, id_col, text_col, keep, normal, held_bytes)
    own = column(id_col).cast("bigint")
    members = docs.select(own.alias("_id"), F.sha2(text.cast("binary"), 256).alias("sha"))
    keep_id = F.when(F.col("rows").isNull(), F.col("_id")).otherwise(F.col("owner"))
    return members.join(found, "sha", "left").select(
        F.col("_id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                   normal: Column | None = None, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``docs`` with one row of each text, its columns unchanged."""
    text = text_of(text_col) if normal is None else normal
    found = groups(docs, id_col, text_col, keep, normal, held_bytes)
    own = column(id_col).cast("bigint")
    members = docs.select(own.alias("_id"), F.sha2(text.cast("binary"), 256).alias("_sha"))
    marked = members.join(found.select(F.col("sha").alias("_sha"), "owner", "owner_rows"), "_sha", "left").withColumn(
        "_gone", F.col("owner_rows").isNotNull() & ~F.col("_id").eqNullSafe(F.col("owner")))
    # identifiers of which every row goes are dropped by number alone; the texts need no shuffle
    # while Spark finds that list small enough to send to all tasks
    ids = settled(marked.groupBy("_id").agg(F.min("_gone").alias("_all"), F.max("_gone").alias("_some")).where("_some"))
    plain = settled(ids.where("_all AND _id IS NOT NULL").select("_id"))
    rest = packed(docs, own.alias("_id"), F.sha2(text.cast("binary"), 256).alias("_sha")).join(plain, "_id", "left_anti")
    unclear = ids.where("NOT _all OR _id IS NULL").select("_id")
    if not unclear.isEmpty():
        pairs = marked.where("_gone").join(unclear.alias("x"), F.col("x._id").eqNullSafe(marked["_id"]), "left_semi")
        pairs = settled(pairs.select("_id", "_sha").distinct())
        same = [F.col("r._sha") == F.col("d._sha"), F.col("r._id").eqNullSafe(F.col("d._id"))]
        rest = rest.alias("r").join(pairs.alias("d"), same, "left_anti")
    again = found.where("owner_rows > 1").select(F.col("sha").alias("_sha"))
    if again.isEmpty():
        return unpacked(rest)
    once = rest.join(again, "_sha", "left_anti")
    first = (rest.join(again, "_sha", "left_semi").groupBy("_sha")
             .agg(F.min_by("_row", F.to_json("_row")).alias("_row")))
    return unpacked(once.select("_row").unionByName(first.select("_row")))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, ''))::BIGINT AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
