"""Benchmark decontamination, with DataFrame and SQL functions only.

A document leaks an item when a window of the item's number of words is similar to it.

1. Texts are lower-cased, cut at ASCII white space and turned into hashes of ``shingle``
   words.  A window that shares no shingle with an item cannot be similar to it, so only
   the windows around a shared shingle are looked at; this drops none that could count.
   The table of the items' hashes is written first, so Spark knows its size: it broadcasts
   it when that is below its threshold and shuffles the hashes otherwise.
2. Every such window gets a 64-bit SimHash of its shingles.  Counters are added four to a
   64-bit number, sixteen bits each.
3. Multi-index Hamming search: fingerprints within ``radius`` agree up to
   ``radius // 4`` bits in at least one of four 16-bit blocks.  The items' blocks are
   entered with all their variants, windows ask with theirs, so none within the radius is
   missed; the distance is then checked.
4. The exact weighted Jaccard similarity of the shingles (repeats count) decides.

At similarity 0.8 two windows differ in about 10 of 64 bits, with a deviation of 3; the
default radius lies two deviations above.

Items of fewer words than a shingle have no shingle to be similar by: a text leaks them when it
holds their words in a row, exactly.

Defined results: null and empty texts leak nothing, and no text leaks an item without words; items are at most 65,535 words; a document
shorter than an item is compared as a whole; documents of one text get the same answer,
whatever their identifiers; of several best windows the first counts.  Empty tables give
empty results.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import column, packed, table, text_of, unpacked
from lodestone.session import settled

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
_BLOCKS = 4


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _hashes(words: str, shingle: int) -> Column:
    """Hashes of all runs of ``shingle`` words; empty when there are fewer words."""
    ahead = ", ".join(f"get({words}, i + {k})" for k in range(shingle))
    return F.expr(f"IF(size({words}) < {shingle}, CAST(array() AS array<bigint>), "
                  f"transform(sequence(0, size({words}) - {shingle}), i -> xxhash64({ahead})))")


def _simhash(hashes: str) -> Column:
    """How many hashes have each bit set: number ``i`` counts bits i, i + 16, i + 32 and i + 48."""
    lanes = [f"'l{i}', aggregate({hashes}, 0L, (a, h) -> a + (shiftrightunsigned(h, {i}) & {0x0001000100010001}L))"
             for i in range(16)]
    return F.expr(f"named_struct({', '.join(lanes)})")


def _majority(lanes: str, n: str) -> Column:
    """Bits that are set in more than half of the hashes."""
    bits = [f"IF((shiftrightunsigned({lanes}.l{i}, {16 * j}) & 65535) * 2 > {n}, shiftleft(1L, {i + 16 * j}), 0L)"
            for i in range(16) for j in range(4)]
    return F.expr(" | ".join(bits))


def _fingerprinted(rows: DataFrame) -> DataFrame:
    """Add ``fp`` to rows with ``hashes``."""
    return (rows.withColumn("_lanes", _simhash("hashes")).withColumn("_n", F.size("hashes"))
            .withColumn("fp", _majority("_lanes", "_n")).drop("_lanes", "_n"))


def _block(fp: str) -> list[str]:
    return [f"CAST(shiftrightunsigned({fp}, {16 * b}) & 65535 AS INT)" for b in range(_BLOCKS)]


def _common(a: str, b: str) -> Column:
    """Size of the multiset intersection."""
    return F.expr(f"aggregate(array_distinct({a}), 0, (t, x) -> t + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))")


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY,
          radius: int = RADIUS, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, item, start, words, similarity)``: the best window of each leaked item per text.

    ``key`` is :func:`key_of` of the text; ``start`` is the number of the first word, from 0.
    """
    wanted = (items.select(column(item_col).alias("item"), _words(text_of(item_text)).alias("w"))
              .select("item", F.size("w").alias("n"), _hashes("w", shingle).alias("hashes")).where(F.size("hashes") > 0).distinct())
    wanted = settled(_fingerprinted(wanted))
    sizes = settled(wanted.select("n", F.explode("hashes").alias("h")).distinct())

    # windows around shared shingles
    read = docs.select(text_of(text_col).alias("t"))
    placed = (read.select(key_of(F.col("t")).alias("key"), _words(F.col("t")).alias("w"))
              .select("key", F.size("w").alias("len"), F.posexplode(_hashes("w", shingle)).alias("p", "h")))
    hits = placed.join(sizes, "h")
    last = F.greatest(F.lit(0), F.least(F.col("p"), F.col("len") - F.col("n")))
    first = F.least(last, F.greatest(F.lit(0), F.col("p") - (F.col("n") - shingle)))
    windows = settled(hits.select("key", "n", F.explode(F.sequence(first, last)).alias("start")).distinct())

    # their fingerprints; the texts are picked by a short key, so that the list stays small
    short = F.xxhash64(F.col("key"))
    picked = settled(windows.select(short.alias("short")).distinct())
    matched = (read.withColumn("key", key_of(F.col("t"))).withColumn("short", short).join(picked, "short", "left_semi")
               .dropDuplicates(["key"]).select("key", _words(F.col("t")).alias("w")).select("key", _hashes("w", shingle).alias("all")))
    seen = (windows.join(matched, "key")
            .select("key", "n", "start", F.expr(f"slice(all, start + 1, n - {shingle - 1})").alias("hashes")))
    seen = _fingerprinted(seen)

    # multi-index search
    variants = F.expr(f"filter(sequence(0, 65535), x -> bit_count(x) <= {radius // _BLOCKS})")
    blocks = F.array(*[F.struct(F.lit(b).alias("b"), F.expr(x).alias("v")) for b, x in enumerate(_block("fp"))])
    index = (wanted.select("item", "n", F.col("hashes").alias("own"), F.col("fp").alias("own_fp"), F.explode(blocks).alias("k"))
             .select("item", "n", "own_fp", F.col("k.b").alias("b"), F.col("k.v").alias("own_v"), F.explode(variants).alias("_x"))
             .select("item", "n", "own_fp", "b", F.col("own_v").bitwiseXOR(F.col("_x")).alias("v")))
    asked = seen.select("key", "n", "start", "hashes", "fp", F.explode(blocks).alias("k")).select(
        "key", "n", "start", "hashes", "fp", F.col("k.b").alias("b"), F.col("k.v").alias("v"))
    found = (asked.join(index, ["n", "b", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("own_fp"))) <= radius)
             # a pair that meets in several blocks counts in the first of them only
             .where(" AND ".join(f"(b <= {k} OR bit_count(({x}) ^ ({y})) > {radius // _BLOCKS})"
                                 for k, (x, y) in enumerate(zip(_block("fp"), _block("own_fp"))))))

    # exact similarity
    checked = (found.join(wanted.select("item", "n", F.col("hashes").alias("own")), ["item", "n"])
               .withColumn("_both", _common("own", "hashes"))
               .withColumn("similarity", F.col("_both") / (F.size("own") + F.size("hashes") - F.col("_both")))
               .where(F.col("similarity") >= similarity))
    best = Window.partitionBy("key", "item").orderBy(F.desc("similarity"), "start")
    similar = (checked.withColumn("_r", F.row_number().over(best)).where("_r = 1")
               .select("key", "item", "start", (F.size("hashes") + shingle - 1).alias("words"), "similarity"))
    return functools.reduce(DataFrame.unionByName, _verbatim(read, items, shingle, item_col, item_text), similar)


def _verbatim(read: DataFrame, items: DataFrame, shingle: int, item_col: str, item_text: str) -> list[DataFrame]:
    """The leaks of items below ``shingle`` words, a table for each number of words that occurs."""
    few = items.select(column(item_col).alias("item"), _words(text_of(item_text)).alias("w")).withColumn("n", F.size("w"))
    few = settled(few.where((F.col("n") > 0) & (F.col("n") < shingle)).distinct())
    found = []
    for n in sorted(r["n"] for r in few.select("n").distinct().collect()):
        wanted = few.where(F.col("n") == n).select("item", _hashes("w", n)[0].alias("h"), F.col("w").alias("own"))
        runs = (read.select(key_of(F.col("t")).alias("key"), _words(F.col("t")).alias("w"))
                .select("key", F.posexplode(F.arrays_zip(_hashes("w", n).alias("h"), F.expr(
                    f"IF(size(w) < {n}, CAST(array() AS array<array<string>>), transform(sequence(0, size(w) - {n}), i -> slice(w, i + 1, {n})))").alias("own")))
                .alias("p", "r")).select("key", "p", "r.h", "r.own"))
        found.append(runs.join(wanted, ["h", "own"]).groupBy("key", "item").agg(F.min("p").alias("start"))
                     .select("key", "item", "start", F.lit(n).alias("words"), F.lit(1.0).alias("similarity")))
    return found


def leak_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document and leaked item: id, item_id, start, words, similarity."""
    found = settled(leaks(docs, items, text_col=text_col, **how))
    rows = docs.select(column(id_col).alias(id_col), key_of(text_of(text_col)).alias("key"))
    return rows.join(found, "key").select(id_col, F.col("item").alias("item_id"), F.col("start").cast("bigint").alias("start"),
                                          F.col("words").cast("bigint").alias("words"), "similarity")


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    found = settled(leaks(docs, items, text_col=text_col, **how).select("key").distinct())
    rows = packed(docs, key_of(text_of(text_col)).alias("key"))
    return unpacked(rows.join(found, "key", "left_anti"))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
