"""Exact Jaccard links inside buckets of any size.

Entries ``(bucket, h, size)`` deal sets to buckets; all pairs of a bucket are decided, and what
goes out is a spanning forest whose components are those of all links of the bucket.

A set that is similar to none of the bucket's leaders leads from then on; any other follows one
leader it is similar to.  1 - Jaccard is a metric: with similarity s a set can only be similar to
a follower of leader l when its similarity with l is 2 s - 1 or more, so the followers of all other
leaders need no test, and those of a leader in the same class need none either.  Nothing is lost.

Buckets of more than ``TILE`` sets or ``CELLS`` set members are dealt by hash to tiles, and every
pair of tiles is one row, so no task holds more than two tiles of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import settled

#: Sets and members of sets per tile at most (in expectation).
TILE, CELLS = 4096, 1 << 20
_SLACK = 1e-9
#: Bits of the table that sifts rows before a join (8 MB).
SIFT = 1 << 26


def forest(members: Iterable[tuple[int, bytes]], similarity: float) -> list[tuple[int, int]]:
    """Links that join the classes of ``(h, sorted 32-bit numbers)``; equal ``h`` count once.

    A null or empty set is similar to nothing.  At a similarity of 0.5 and below a set can be similar to a
    follower without sharing a number with its leader, which the leaders' index would miss: ValueError.
    """
    if similarity <= 0.5:
        raise ValueError("links are exact for similarities above 0.5")
    far, out, root = 2 * similarity - 1, [], {}
    names, sizes, followers, holders = [], [], [], {}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def link(x, y):
        a, b = top(x), top(y)
        if a != b:
            root[a] = b
            out.append((x, y))

    for h, sent in members:
        if h in root:
            continue
        root[h] = h
        own = np.frombuffer(sent or b"", dtype=np.uint32).tolist()
        n, shared = len(own), {}
        for s in own:
            held = holders.get(s)
            if held is not None:
                for k in (held,) if type(held) is int else held:
                    shared[k] = shared.get(k, 0) + 1
        home, near = None, []
        for k, both in shared.items():
            union = n + sizes[k] - both
            if both >= similarity * union:
                link(h, names[k])
                home = home or (k, 1 - both / union)
            elif both >= (far - _SLACK) * union:
                near.append((k, 1 - both / union))
        whole = set(own) if near else ()
        for k, apart in near:
            if top(h) == top(names[k]):
                continue
            for off, other, sent_other in followers[k]:
                if off + _SLACK >= apart - (1 - similarity):
                    theirs = np.frombuffer(sent_other, dtype=np.uint32).tolist()
                    both = len(whole.intersection(theirs))
                    if both >= similarity * (n + len(theirs) - both):
                        link(h, other)
                        break
        if home:
            followers[home[0]].append((home[1], h, sent))
        else:
            for s in own:
                # nearly every number has one holder, and a list for each would be most of the index
                held = holders.setdefault(s, len(names))
                if held != len(names):
                    if type(held) is int:
                        holders[s] = [held, len(names)]
                    else:
                        held.append(len(names))
            names.append(h)
            sizes.append(n)
            followers.append([])
    return out


def _batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*out) if out else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _small(similarity: float):
    """Rows sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, members = None, []
        for batch in batches:
            out = []
            sets = batch.column("shingles")
            for at, (b, h) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("h").to_pylist())):
                if b != bucket:
                    out += forest(members, similarity) if len(members) > 1 else []
                    bucket, members = b, []
                members.append((h, sets[at].as_py()))  # not the whole batch at once
            yield _batch(out)
        yield _batch(forest(members, similarity))

    return run


def _tiles(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                both = [batch.column(n)[at].as_py() or [] for n in ("one", "two")]
                yield _batch(forest(((m["h"], m["shingles"]) for part in both for m in part), similarity))

    return run


def sifted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``h`` is not among ``wanted``; the join that has to follow is exact.

    A table of ``SIFT`` bits, one set for each wanted hash, goes to all tasks and keeps the other rows from being
    shuffled.  Its size does not grow with the data; with very many wanted hashes it only sifts less.
    """
    bit = F.expr(f"h & {SIFT - 1}L")
    words = wanted.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63L AS INT))")).alias("bits")).toArrow()
    table_ = np.zeros(SIFT >> 6, dtype=np.int64)
    table_[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(table_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            h = batch.column("h").to_numpy()
            at = h & (SIFT - 1)
            yield batch.filter(pa.array((bits[at >> 6] >> (h & 63)) & 1 == 1))

    return rows.mapInArrow(run, rows.schema)


def links(entries: DataFrame, sets: DataFrame, similarity: float, tile: int = TILE, cells: int = CELLS) -> DataFrame:
    """``(u, v)``: a forest over ``h`` per bucket (or pair of tiles) of ``entries``; ``sets`` has ``(h, shingles)``."""
    sizes = settled(entries.groupBy("bucket").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("n"),
                                                  F.sum(F.col("size").cast("bigint")).alias("cells")).where("low <> high")
                    .select("bucket", F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("cells") / cells)).cast("int").alias("blocks")))
    # what is alone in all of its buckets goes no further
    left = settled(entries.select("bucket", "h").join(sizes, "bucket"))
    needed = settled(left.select("h").distinct())
    sets = sifted(sets.select("h", "shingles"), needed).join(needed, "h", "left_semi").groupBy("h").agg(F.first("shingles").alias("shingles"))
    schema = "u long, v long"
    small = (left.where("blocks <= 1").join(sets, "h").select("bucket", "h", "shingles").repartition("bucket")
             .sortWithinPartitions("bucket", "h").mapInArrow(_small(similarity), schema))
    if sizes.where("blocks > 1").isEmpty():
        return small.distinct()
    dealt = left.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("h", "bucket"), F.col("blocks")).cast("int"))
    tiles = settled(dealt.join(sets, "h").groupBy("bucket", "block", "blocks").agg(F.collect_list(F.struct("h", "shingles")).alias("one")))
    others = tiles.select("bucket", F.col("block").alias("other"), F.col("one").alias("two"))
    asked = tiles.select("bucket", "block", "one", F.explode(F.expr("sequence(block, blocks - 1)")).alias("other"))
    pairs = asked.join(others, ["bucket", "other"]).select("one", F.when(F.col("other") != F.col("block"), F.col("two")).alias("two"))
    return small.union(pairs.mapInArrow(_tiles(similarity), schema)).distinct()
