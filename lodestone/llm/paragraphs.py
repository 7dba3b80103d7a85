"""Substring dedup by MinHash banding of paragraphs.

1. Paragraphs are lines; a line is cut further behind words that end with a full stop and have an
   even hash, so that a passage that was put into other lines falls into the same pieces.  Words are
   hashed once; the hashes of paragraphs, shingles and windows follow from prefix sums over them.  For
   every paragraph of ``LEAST`` or more words: its place, a hash of its lower-cased words,
   MinHash band keys, and its set of hashed shingles of five words; the last two only where a task
   meets the paragraph first.  Shorter paragraphs have place and hash only.  The result is written.
2. Equal paragraphs are one from here on, so the shingles of a line that a third of all documents
   hold are made, written and shuffled once per task.
3. Bands are tuned for recall: as few as give ``RECALL`` at the wanted similarity.  All pairs
   of a bucket are decided by the exact Jaccard similarity of the shingle sets; pairs are
   passed over only where the triangle inequality decides them (see ``jaccard``).  Buckets
   above a size are dealt to tiles and compared tile with tile.
4. Components of the links are the clusters.  A cluster is a repeat when several documents
   hold it; neighbouring repeated paragraphs of a document that have ``PASSAGE`` or more
   words together are repeated passages.  Paragraphs below ``LEAST`` words are repeated when
   another document holds the same; they count in a run but make none by themselves.
5. Verbatim passages wherever they begin, across lines and sentences: the same pass hashes
   every ``PASSAGE`` consecutive words and keeps the smallest hash of every ``GAP``
   neighbouring positions.  So two texts that share ``PASSAGE + GAP - 1`` = 41 words in a row
   share a kept hash, for certain.  Kept hashes of several documents are joined in each text
   to spans; a span can end up to ``GAP - 1`` words inside the shared passage.

Defined results: null and empty texts have no paragraphs; the first paragraph of a cluster,
by identifier and place, stays, the others are marked ``removed``; so with verbatim spans.  Rows
of spans and of paragraphs can overlap (a span inside one reported paragraph is left out unless
it alone is marked); what any row marks goes.  Rows that repeat an identifier are one document with the
paragraphs of both; rows without identifier are not reported.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import jaccard
from lodestone.llm.common import column, table, text_of
from lodestone.llm.components import components
from lodestone.operators.skew import skewed_join
from lodestone.session import settled

LEAST, SHINGLE, SIMILARITY = 8, 5, 0.8
ROWS, RECALL = 2, 0.99
PASSAGE, GAP = 30, 12
#: Paragraphs whose shingles a task has already written, and hashes that it gathers before it writes.
SEEN, GATHERED = 1 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def bands_for(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """The smallest number of bands of ``rows`` hashes that meets the recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity ** rows)))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, 1 << 14), _powers(_BACK, 1 << 14)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a text: their hashes, their places, and hashes of any run of them from prefix sums."""

    def __init__(self, text: str):
        words = text.lower().encode("utf-8", "surrogatepass").split()
        self.n = n = len(words)
        self.own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
        up = _UP[:n] if n <= len(_UP) else _powers(_BASE, n)
        self._sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self.own * up, dtype=np.uint64)))
        self._down = _DOWN[:n] if n <= len(_DOWN) else _powers(_BACK, n)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
        self._begin, self._end = edges[0::2], edges[1::2]
        self._raw, self._chars = raw, None if len(raw) == len(text) else np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))

    def runs(self, at: np.ndarray, size) -> np.ndarray:
        """Hashes of the runs of ``size`` words from each place."""
        return _mixed((self._sums[at + size] - self._sums[at]) * self._down[at] + np.asarray(size, dtype=np.uint64))

    def starts(self, at: np.ndarray) -> np.ndarray:
        return self._begin[at] if self._chars is None else self._chars[self._begin[at]]

    def ends(self, at: np.ndarray) -> np.ndarray:
        return self._end[at] if self._chars is None else self._chars[self._end[at]]

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of every paragraph."""
        if not self.n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        line = np.cumsum(self._raw == 10)[self._begin]
        stop = (self._raw[self._end - 1] == 46) & (self._end - self._begin > 1) & (self.own & np.uint64(1) == 0)
        heads = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | stop[:-1])))
        return heads, np.diff(np.append(heads, self.n))

    def windows(self, size: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of the runs of ``size`` words that are the smallest of ``gap`` neighbouring ones."""
        n = self.n - size + 1
        if n < 1:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        mixed = self.runs(np.arange(n), size)
        near = np.lib.stride_tricks.sliding_window_view(mixed, min(gap, n))
        at = near.argmin(axis=1) + np.arange(len(near))  # never falls
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        return at, mixed[at]


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


_READ = pa.schema([("doc", pa.int64()), ("t", pa.int64()), ("no", pa.int32()), ("start", pa.int32()), ("chars", pa.int32()), ("words", pa.int32()),
                   ("h", pa.int64()), ("bands", pa.list_(pa.int64())), ("shingles", pa.binary())])
_DDL = "doc long, t long, no int, start int, chars int, words int, h long, bands array<long>, shingles binary"


def _lists(kind, offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """A list (or binary) array over flat values."""
    if kind == pa.binary():
        return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes())])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind.value_type))


class _Gathered:
    """Rows of many texts; the paragraphs with shingles come first."""

    def __init__(self, multipliers, rows: int):
        (self.a, self.b), self.rows = multipliers, rows
        self.long, self.plain, self.hashes, self.counts, self.size = [], [], [], [], 0

    def add(self, into: list, doc: int, t: int | None, no, start, end, words, h) -> None:
        into.append((np.full(len(no), doc, dtype=np.int64), np.full(len(no), 0 if t is None else t, dtype=np.int64), np.full(len(no), t is None), no, start,
                     end - start, np.full(len(no), words) if np.isscalar(words) else words, h.view(np.int64)))
        self.size += len(no)

    def batch(self) -> pa.RecordBatch:
        n = sum(len(x[0]) for x in self.long)
        columns = [np.concatenate(c) for c in zip(*self.long, *self.plain)] if self.long or self.plain else [np.zeros(0, np.int64)] * 8
        total = len(columns[0])
        arrays = [pa.array(columns[0]), pa.array(columns[1], mask=columns[2].astype(bool)),
                  *(pa.array(c.astype(np.int32)) for c in columns[3:7]), pa.array(columns[7], pa.int64())]
        keys, sets, bounds = np.zeros((n, len(self.a) // self.rows), dtype=np.uint64), np.zeros(0, dtype=np.uint32), np.zeros(n + 1, dtype=np.int64)
        if n:
            h, counts = np.concatenate(self.hashes), np.concatenate(self.counts)
            heads = np.cumsum(counts) - counts
            for k in range(len(self.a)):
                mixed = h * self.a[k] + self.b[k]
                mixed ^= mixed >> np.uint64(31)
                low = np.minimum.reduceat(mixed, heads)
                keys[:, k // self.rows] = keys[:, k // self.rows] * np.uint64(_BASE) + low
            each = np.sort(np.repeat(np.arange(n, dtype=np.uint64), counts) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF)))
            each = each[np.concatenate(([True], each[1:] != each[:-1]))]
            sets, bounds = (each & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(each, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
        rest = np.zeros(total - n, dtype=np.int64)
        arrays.append(_lists(pa.list_(pa.int64()), np.concatenate((np.arange(n + 1), rest + n)) * keys.shape[1], keys.view(np.int64).ravel()))
        arrays.append(_lists(pa.binary(), np.concatenate((bounds, rest + bounds[-1])) * 4, sets))
        return pa.RecordBatch.from_arrays(arrays, schema=_READ)


def _reader(bands: int, rows: int, least: int, passage: int, gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers, seen = _multipliers(bands * rows), set()
        held = _Gathered(multipliers, rows)
        for batch in batches:
            for k in range(batch.num_rows):
                doc, text = batch.column("doc")[k].as_py(), batch.column("text")[k].as_py()
                words = Words(text)
                if not words.n:
                    continue
                heads, sizes = words.pieces()
                h = words.runs(heads, sizes)
                start, end, no = words.starts(heads), words.ends(heads + sizes - 1), np.arange(len(heads))
                # a paragraph's shingles are written where the task meets it first
                new = sizes >= least
                for i in np.flatnonzero(new).tolist():
                    name = int(h[i])
                    new[i] = name not in seen
                    seen.add(name)
                if len(seen) > SEEN:
                    seen.clear()
                for into, part in ((held.long, new), (held.plain, ~new)):
                    if part.any():
                        held.add(into, doc, None, no[part], start[part], end[part], sizes[part], h[part])
                if new.any():
                    counts = sizes[new] - SHINGLE + 1
                    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    held.hashes.append(words.runs(np.repeat(heads[new], counts) + inside, SHINGLE))
                    held.counts.append(counts)
                    held.size += len(inside)
                at, kept = words.windows(passage, gap)
                if len(at):
                    t = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                    held.add(held.plain, doc, t, at, words.starts(at), words.ends(at + passage - 1), 0, kept)
                if held.size > GATHERED:
                    yield held.batch()
                    held = _Gathered(multipliers, rows)
        yield held.batch()

    return run


def read(docs: DataFrame, similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL, least: int = LEAST, passage: int = PASSAGE,
         gap: int = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All paragraphs, and all kept windows (``t``, a hash of the text, is not null), in one pass over the texts, written to the shared folder.

    Shingles and band keys stand at the first row of each distinct paragraph of a task (and at few more).
    """
    if least < SHINGLE:
        raise ValueError("a paragraph needs the words of one shingle")
    texts = docs.where(column(id_col).isNotNull()).select(column(id_col).cast("bigint").alias("doc"), text_of(text_col).alias("text"))
    return settled(texts.mapInArrow(_reader(bands_for(similarity, rows, recall), rows, least, passage, gap), _DDL))


def links(paragraphs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(u, v)`` of distinct paragraphs, by hash, whose components are those of all similar pairs that share a bucket."""
    distinct = paragraphs.where(F.size("bands") > 0).groupBy("h").agg(F.first("bands").alias("bands"), F.first("words").alias("size"))
    entries = distinct.select("h", "size", F.posexplode("bands").alias("b", "key")).select(F.xxhash64("b", "key").alias("bucket"), "h", "size")
    return jaccard.links(entries, paragraphs.where(F.size("bands") > 0), similarity)


# -- verbatim passages

def windows(text: str, size: int = PASSAGE, gap: int = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, start and end character, hash) of the kept windows of ``size`` words."""
    words = Words(text)
    at, h = words.windows(size, gap)
    return at, words.starts(at), words.ends(at + size - 1), h


_SPANS = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("chars", pa.int64()), ("words", pa.int64()), ("cluster_doc", pa.int64()),
                    ("cluster_no", pa.int64()), ("removed", pa.bool_())])


def _joined(doc: int, held: list[tuple], size: int) -> list[tuple]:
    """Disjoint rows of one text from its repeated windows ``(at, start, end, first doc, first at, removed)``."""

    def unions(rows):
        out = []
        for at, start, end, first_doc, first_at, _ in sorted(rows):
            if out and at <= out[-1][1]:
                out[-1][1], out[-1][3] = max(out[-1][1], at + size), max(out[-1][3], end)
            else:
                out.append([at, at + size, start, end, first_doc, first_at])
        return out

    gone = unions(r for r in held if r[5])
    rows = [(*g, True) for g in gone]
    for at, till, start, end, first_doc, first_at in unions(r for r in held if not r[5]):
        for g in gone:
            if g[0] < till and g[1] > at:
                if g[0] > at:
                    rows.append((at, g[0], start, g[2], first_doc, first_at, False))
                at, start = g[1], g[3]
        if at < till:
            rows.append((at, till, start, end, first_doc, first_at, False))
    return [(doc, start, end - start, till - at, first_doc, first_at, removed) for at, till, start, end, first_doc, first_at, removed in rows]


def _spans(size: int):
    """Windows sorted by document and text."""

    def batch_of(rows):
        columns = list(zip(*rows)) if rows else [[]] * len(_SPANS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPANS)], schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, held = None, []
        for batch in batches:
            out = []
            for doc, t, *window in zip(*(batch.column(n).to_pylist() for n in ("doc", "t", "at", "start", "end", "first_doc", "first_at", "removed"))):
                if (doc, t) != text:
                    out += _joined(text[0], held, size) if held else []
                    text, held = (doc, t), []
                held.append(tuple(window))
            yield batch_of(out)
        yield batch_of(_joined(text[0], held, size) if held else [])

    return run


def verbatim(kept: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """Spans that other documents hold word for word, from the windows of :func:`read`; ``cluster_no`` is the span's first word in ``cluster_doc``."""
    kept = kept.select("doc", "t", F.col("no").alias("at"), "start", (F.col("start") + F.col("chars")).alias("end"), "h")
    repeats = settled(kept.groupBy("h").agg(F.max("doc").alias("high"), F.min(F.struct("doc", "at", "t")).alias("first"))
                      .where("first.doc <> high").select("h", "first"))
    held = skewed_join(jaccard.sifted(kept, repeats), repeats, "h").select("doc", "t", "at", "start", "end", F.col("first.doc").alias("first_doc"), F.col("first.at").alias("first_at"),
                                                  (F.struct("doc", "at", "t") != F.col("first")).alias("removed"))
    return held.repartition("doc").sortWithinPartitions("doc", "t", "at").mapInArrow(
        _spans(passage), "doc long, start long, chars long, words long, cluster_doc long, cluster_no long, removed boolean")


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY, passage: int = PASSAGE, id_col: str = "doc_id",
                      text_col: str = "text", **how) -> DataFrame:
    """One row per paragraph or verbatim span of a repeated passage: id, start, chars, words, cluster, removed.

    ``start`` and ``chars`` are characters of the text; ``cluster`` is the smallest identifier
    of a document that holds the cluster, and the number there of the paragraph or of the
    span's first word.
    """
    texts = read(docs, similarity, passage=passage, id_col=id_col, text_col=text_col, **how)
    paragraphs = texts.where("t IS NULL").drop("t")
    roots = settled(components(links(paragraphs, similarity)).select(F.col("node").alias("h"), "root"))
    sizes = paragraphs.groupBy("h").agg(F.max("doc").alias("high"), F.min(F.struct("doc", "no")).alias("first"))
    grouped = sizes.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    clusters = grouped.groupBy("root").agg(F.max("high").alias("high"), F.min("first").alias("first")).where("first.doc <> high")
    repeats = settled(skewed_join(grouped.select("h", "root"), clusters.select("root", "first"), "root").select("h", "first"))
    held = skewed_join(paragraphs.select("doc", "no", "start", "chars", "words", "h"), repeats, "h")
    # neighbours in a document: a run is where the number less the rank stays the same
    runs = held.withColumn("_run", F.col("no") - F.dense_rank().over(Window.partitionBy("doc").orderBy("no")))
    total = F.sum("words").over(Window.partitionBy("doc", "_run"))
    longest = F.max("words").over(Window.partitionBy("doc", "_run"))
    near = settled(runs.withColumn("_total", total).withColumn("_longest", longest)
                   .where((F.col("_total") >= passage) & (F.col("_longest") >= how.get("least", LEAST)))
                   .select("doc", F.col("start").cast("bigint").alias("start"), F.col("chars").cast("bigint").alias("chars"),
                           F.col("words").cast("bigint").alias("words"), F.col("first.doc").alias("cluster_doc"),
                           F.col("first.no").cast("bigint").alias("cluster_no"),
                           ((F.col("doc") != F.col("first.doc")) | (F.col("no") != F.col("first.no"))).alias("removed")))
    spans = verbatim(texts.where("t IS NOT NULL"), passage).alias("s")
    inside = (F.expr("s.doc = p.doc AND (p.removed OR NOT s.removed) AND s.start >= p.start AND s.start + s.chars <= p.start + p.chars"))
    return near.union(spans.join(near.alias("p"), inside, "left_anti")).withColumnRenamed("doc", id_col)


def op9_paragraphs(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
