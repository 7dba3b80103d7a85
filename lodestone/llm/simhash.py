"""SimHash near-dedup by tiled exact comparison.

1. Fingerprints: words of the text with A-Z lowered, shingles of ``shingle`` words with
   repeats, 64 bits of XXH64 per shingle and word of the fingerprint; a bit is set when it
   is set in more than half of the shingles.  Texts of fewer words hash the whole sequence,
   texts without words have fingerprint zero.  This is the only pass over the texts; it
   needs no shuffle, and its result (identifier, fingerprint) is written.
2. Distinct fingerprints only are compared, so copies cost nothing.  They are put in tiles
   by their population counts in ``parts`` equal parts of the fingerprint; tiles of more
   than ``tile`` fingerprints are split by hash.  Two fingerprints within the radius differ
   in their population counts by no more than the radius in sum over the parts, so a tile
   meets only the tiles at such an offset; all other pairs of tiles are skipped.  Each pair
   of tiles is one row with two bounded arrays, compared whole with exclusive-or and bit
   counts.
3. From each pair of tiles comes a spanning forest of its links, never all pairs of a group
   of near copies; components of the forests are those of all links.
4. Components go back to the documents by fingerprint.

The comparison is exact and so grows with the square of the number of distinct fingerprints,
less what the population counts skip (see README for figures).

Defined results: null text equals a text without words; empty texts link with each other
(fingerprint zero); an identifier that repeats gives a row per document row; a component
takes its smallest non-null identifier.  Identifiers are whole numbers; other types fail the cast
to bigint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import jaccard
from lodestone.llm.common import column, packed, table, text_of, unpacked
from lodestone.llm.components import components
from lodestone.session import settled

#: Fingerprints per tile at most (in expectation; tiles are split by hash).
TILE = 32_768
#: Cells of a tile pair that are compared at once.
CELLS = 1 << 22
SEED = 42


def fingerprint(text: bytes, shingle: int = 3, words: int = 1) -> np.ndarray:
    """``words`` 64-bit numbers for one text."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(words, dtype=np.uint64)
    joined = b" ".join(parts)
    if len(parts) < shingle:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
        starts = np.concatenate(([0], ends[:len(parts) - shingle]))
        spans = list(zip(starts.tolist(), (ends[shingle - 1:] - 1).tolist()))
    half, out = len(spans), np.empty(words, dtype=np.uint64)
    for w in range(words):
        hashed, seed = xxhash.xxh64_intdigest, SEED + w
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, half, 1 << 16):
            h = np.array([hashed(joined[a:b], seed) for a, b in spans[at:at + (1 << 16)]], dtype="<u8")
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(counts * 2 > half, bitorder="little").view("<u8")[0]
    return out


def _fingerprints(shingle: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, words) for t in batch.column("text")]
            hexed = ["".join(f"{int(x):016x}" for x in f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(hexed, pa.string())], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(id, fp)`` per row; ``fp`` has 16 hex digits per word."""
    rows = docs.select(column(id_col).cast("bigint").alias("id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle, words), "id long, fp string")


# -- tiles

_BASE = 512


def _offsets(parts: int, radius: int) -> list[int]:
    """Keys of the tiles to meet, relative to a tile's own; one of each pair of directions."""
    found = []

    def grow(at: int, left: int, value: int) -> None:
        if at == parts:
            if value >= 0:
                found.append(value)
            return
        for d in range(-left, left + 1):
            grow(at + 1, left - abs(d), value + d * _BASE ** at)

    grow(0, radius, 0)
    return sorted(found)


def _longs(words: int) -> list:
    """The 64-bit words of the hex text as signed numbers, native."""
    half = [[F.conv(F.substring("fp", 16 * w + 8 * h + 1, 8), 16, 10).cast("bigint") for h in (0, 1)] for w in range(words)]
    return [F.shiftleft(a, 32).bitwiseOR(b) for a, b in half]


def _tile_key(words: int, parts: int):
    """Population counts of ``parts`` equal parts as one number."""
    digits = 16 * words // parts
    key = F.lit(0).cast("bigint")
    for p in range(parts):
        count = F.lit(0)
        for at in range(p * digits, (p + 1) * digits, 8):
            take = min(8, (p + 1) * digits - at)
            count = count + F.bit_count(F.conv(F.substring("fp", at + 1, take), 16, 10).cast("bigint"))
        key = key + count.cast("bigint") * F.lit(_BASE ** p)
    return key


def merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the classes of each pair of nodes; ``label`` points to the smallest node of a class."""
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


def linked(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """Class labels over the rows of ``a`` followed by those of ``b`` (of ``a`` alone if ``same``)."""
    n, m = len(a), len(b)
    label = np.arange(n if same else n + m, dtype=np.int64)
    step = max(1, CELLS // max(1, m))
    for at in range(0, n, step):
        part = a[at:at + step]
        apart = np.bitwise_count(part[:, None, 0] ^ b[None, :, 0])
        for w in range(1, a.shape[1]):
            apart += np.bitwise_count(part[:, None, w] ^ b[None, :, w])
        near = np.flatnonzero(apart <= radius)
        if len(near):
            i, j = np.divmod(near, m)
            i += at
            if same:
                upper = i < j
                merge(label, i[upper], j[upper])
            else:
                merge(label, i, j + n)
    return label


def _compare(radius: int, words: int):
    def numbers(column: pa.Array) -> list[np.ndarray]:
        flat, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
        return [flat[s:e].reshape(-1, words) for s, e in zip(ends, ends[1:])]

    def hexed(rows: np.ndarray) -> list[str]:
        return ["".join(f"{x:016x}" for x in r) for r in rows.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = numbers(batch.column("one")), numbers(batch.column("two"))
            for a, b, same in zip(one, two, batch.column("same").to_pylist()):
                label = linked(a, b, radius, same)
                member = np.flatnonzero(label != np.arange(len(label)))
                if len(member):
                    nodes = a if same else np.concatenate([a, b])
                    yield pa.RecordBatch.from_arrays([pa.array(hexed(nodes[member]), pa.string()),
                                                      pa.array(hexed(nodes[label[member]]), pa.string())], ["u", "v"])

    return run


def links(distinct: DataFrame, radius: int, words: int = 1, parts: int = 4, tile: int = TILE) -> DataFrame:
    """``(u, v)``: a forest over the distinct ``fp`` whose components are those of all links."""
    if 16 * words % parts:
        raise ValueError("parts must divide the fingerprint into whole hex digits")
    keyed = distinct.select("fp", _tile_key(words, parts).alias("key"))
    sizes = settled(keyed.groupBy("key").agg(F.count("*").alias("_n"))
                    .select("key", F.ceil(F.col("_n") / tile).cast("int").alias("blocks")))
    split = sizes.where("blocks > 1")
    dealt = keyed.join(split, "key", "left").withColumn(
        "block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("int"))
    tiles = settled(dealt.groupBy("key", "block").agg(F.flatten(F.collect_list(F.array(*_longs(words)))).alias("fps")))
    names = tiles.select("key", "block")
    near = (names.select(F.col("key").alias("key1"), F.col("block").alias("block1"),
                         F.explode(F.array(*[F.lit(x).cast("bigint") for x in _offsets(parts, radius)])).alias("_o"))
            .withColumn("key2", F.col("key1") + F.col("_o")))
    pairs = near.join(names.select(F.col("key").alias("key2"), F.col("block").alias("block2")), "key2").where(
        "key1 <> key2 OR block1 <= block2")
    one = tiles.select(F.col("key").alias("key1"), F.col("block").alias("block1"), F.col("fps").alias("one"))
    two = tiles.select(F.col("key").alias("key2"), F.col("block").alias("block2"), F.col("fps").alias("two"))
    rows = pairs.join(one, ["key1", "block1"]).join(two, ["key2", "block2"])
    same = (F.col("key1") == F.col("key2")) & (F.col("block1") == F.col("block2"))
    return rows.select("one", "two", same.alias("same")).mapInArrow(_compare(radius, words), "u string, v string")


def near_classes(docs: DataFrame, radius: int = 3, shingle: int = 3, words: int = 1, parts: int = 4,
                 id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per document: id, fingerprint, component_id (smallest identifier within reach)."""
    prints = settled(fingerprints(docs, shingle, words, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components(links(distinct.select("fp"), radius, words, parts, tile))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def _described(shingle: int, words: int, sets: bool):
    """Fingerprint and hash of the words of each text, or that hash and the set of hashed shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [t.as_py() for t in batch.column("text")[at:at + 256]]
                split = [t.lower().split() for t in texts]
                hashes = pa.array([xxhash.xxh64_intdigest(b" ".join(p)) - (1 << 63) for p in split], pa.int64())
                if sets:
                    found = [np.unique(np.array([xxhash.xxh32_intdigest(b" ".join(p[i:i + shingle])) for i in range(max(1, len(p) - shingle + 1))],
                                                dtype=np.uint32)) for p in split]
                    yield pa.RecordBatch.from_arrays([hashes, pa.array([f.tobytes() for f in found], pa.binary())], ["h", "shingles"])
                else:
                    hexed = ["".join(f"{int(x):016x}" for x in fingerprint(t, shingle, words)) for t in texts]
                    sizes = pa.array([max(1, len(p) - shingle + 1) for p in split], pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column("id")[at:at + 256], pa.array(hexed, pa.string()), hashes, sizes],
                                                     ["id", "fp", "h", "size"])

    return run


def without_near_copies(docs: DataFrame, radius: int = 32, shingle: int = 5, words: int = 2, parts: int = 1,
                        id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """``docs`` with the document of smallest identifier of each class of near copies.

    Near copies have sets of ``shingle`` words of Jaccard similarity ``similarity`` or more.  The
    fingerprints only say which texts to compare: at 0.8 they differ in acos(2 * 0.8 / 1.8) / pi
    = 15 % of 128 bits on average, 19.4 bits with deviation 4, so the radius of 32 lies three
    deviations above.  All texts in a component of fingerprints within the radius are then
    compared by their sets (``jaccard``), and classes are made of those links alone; so a text
    only goes when it is linked by real similarity.  Texts of the same words are one; texts of
    fewer words are one shingle.  Rows without an identifier stay.
    """
    rows = docs.select(column(id_col).cast("bigint").alias("id"), text_of(text_col).cast("binary").alias("text"))
    prints = settled(rows.mapInArrow(_described(shingle, words, False), "id long, fp string, h long, size int"))
    roots = components(links(prints.select("fp").distinct(), radius, words, parts)).withColumnRenamed("node", "fp")
    texts = prints.groupBy("h").agg(F.first("fp").alias("fp"), F.first("size").alias("size"))
    entries = settled(texts.join(roots, "fp", "left").select(F.xxhash64(F.coalesce("root", "fp")).alias("bucket"), "h", "size"))
    sets = rows.select("id", "text").mapInArrow(_described(shingle, words, True), "h long, shingles binary")
    near = components(jaccard.links(entries, sets, similarity)).withColumnRenamed("node", "h")
    rooted = prints.groupBy("h").agg(F.min("id").alias("low")).join(near, "h", "left").select("h", "low", F.coalesce("root", "h").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("lowest"))
    classes = rooted.join(lowest, "root").select("h", "lowest")
    dropped = settled(prints.join(classes, "h").where("id <> lowest").select(F.col("id").alias("_id")).distinct())
    rows = packed(docs, column(id_col).cast("bigint").alias("_id"))
    return unpacked(rows.join(dropped, "_id", "left_anti"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
