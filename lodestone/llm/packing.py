"""Hierarchical packing of token sequences into windows of several context sizes.

A document is its tokenizer's identifiers and ``END``.  Every task packs the documents of
its own input split, so nothing is shuffled and a task holds a bounded buffer:

1. whole windows of the longest tier are cut off the front of a document and the rest is
   routed to the smallest tier (a power of two, ``TIERS``) that holds it;
2. tiers are packed from the longest to the shortest: each window opens with a rest of its
   own tier, its gap takes the longest rests of shorter tiers that fit, and what is left of
   the gap is cut off the next longer rest, whose remainder is routed again;
3. the last window of a buffer, for which no rests are left, is packed again with the next
   buffer; at the end of a task it is written as windows of smaller powers of two, so no
   window of any tier holds padding;
4. windows are dealt to step groups of exactly ``step`` tokens each (the last of a task may
   have fewer), the longest and costliest first, each to the group whose attention cost
   (the sum of squared piece lengths) is lowest so far.  As sizes are powers of two in
   falling order, a group that has room has room for the next window.

Identifiers are exactly those of the tokenizer file.  Its normalizer and its pattern are
applied here to texts of ASCII and Latin letters, for which they are plain, with a bounded
cache of identifiers per piece of the pattern; words with any other character (and control
strings) go through the tokenizer itself.  White space ends a piece of the pattern, so a
text is the sum of its words.

Defined results: a null text is empty and an empty text is ``END`` alone; a null identifier
is a document like any other, and so is each of several rows with one identifier; an empty
table gives no rows.  Of the columns only identifier and text are read, so names cannot
clash.  ``sequence_id`` and ``step`` hold the task's number in their upper bits: the same
table in the same splits gives the same windows again.  A document's identifiers, four bytes
each, must fit in a task.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, table

END = 1
TIERS = (2048, 1024, 512, 256, 128, 64)
#: Tokens of a step group, and tokens of rests that a task holds before it packs them.
STEP, BUFFER = 16 * 2048, 1 << 20
#: Pieces of the pattern whose identifiers a task remembers, but for those of one stretch of text.
REMEMBERED = 200_000
VOCABULARY = "word_bpe_49k.json"
#: Characters that the normalizer only lower-cases, one to one (U+0130 becomes two).
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-įı-ſ]*")
_LETTER, _DIGIT = "a-zªµºß-öø-ÿā-ſ", "0-9²³¹¼-¾"
#: The tokenizer file's pattern (contractions; letters; one digit; other characters) over lower-cased plain text.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^ \t\n\r{_LETTER}{_DIGIT}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Identifiers:
    """Texts to little-endian unsigned 32-bit identifiers."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.letters, self.merge = _byte_letters(), self.tokenizer.model.tokenize
        self.bytes = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return b"".join([self.bytes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _plain(self, text: str) -> bytes:
        found, known = PIECES.findall(text.lower()), self.known
        if len(known) > REMEMBERED:
            known.clear()
        for piece in set(found).difference(known):
            spelled = piece.encode().decode("latin-1").translate(self.letters)
            known[piece] = b"".join([self.bytes[t.id] for t in self.merge(spelled)])
        return b"".join([known[piece] for piece in found])

    def _stretch(self, text: str) -> bytes:
        if "<|" not in text and PLAIN.fullmatch(text):
            return self._plain(text)
        return b"".join(self._plain(w) if "<|" not in w and PLAIN.fullmatch(w) else self._whole(w)
                        for w in re.split(r"[ \t\n\r]+", text))

    def of(self, text: str, stretch: int = 1 << 20) -> bytes:
        """All identifiers; long texts are read in stretches that end at white space."""
        parts, at = [], 0
        while len(text) - at > stretch:
            ends = [k for k in (text.rfind(c, at, at + stretch) for c in " \n\t\r") if k >= at]
            if not ends:
                ends = [k for k in (text.find(c, at + stretch) for c in " \n\t\r") if k >= 0][:1] or [len(text) - 1]
            parts.append(self._stretch(text[at:max(ends) + 1]))
            at = max(ends) + 1
        return b"".join([*parts, self._stretch(text[at:])])


class Packer:
    """Rests of documents to full windows.  A rest is (length, arrival, id, start, doc_tokens, bytes)."""

    def __init__(self, tiers=TIERS, buffer: int = BUFFER):
        if not tiers or any(t < 1 or t & (t - 1) for t in tiers):
            raise ValueError("tiers are powers of two")
        self.tiers = tuple(sorted(set(tiers), reverse=True))
        self.buffer, self.pool, self.held, self.arrivals = buffer, [], 0, 0

    def _rest(self, length, doc_id, start, total, ids):
        self.arrivals += 1
        return length, self.arrivals, doc_id, start, total, ids

    def _cut(self, rest, n: int):
        """The first ``n`` tokens of a rest, and what follows."""
        _, _, doc_id, start, total, ids = rest
        return (self._rest(n, doc_id, start, total, ids[:4 * n]),
                self._rest(rest[0] - n, doc_id, start + n, total, ids[4 * n:]))

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        top, total = self.tiers[0], len(ids) // 4
        whole = total // top * top
        for start in range(0, whole, top):
            yield top, [self._rest(top, doc_id, start, total, ids[4 * start:4 * (start + top)])]
        if total > whole:
            self.pool.append(self._rest(total - whole, doc_id, whole, total, ids[4 * whole:]))
            self.held += total - whole
        if self.held >= self.buffer:
            yield from self.pack()

    def pack(self) -> Iterator[tuple]:
        """Windows (size, rests) of all that is held, but for a last one that cannot be filled."""
        pool = sorted(self.pool)
        self.pool, self.held = [], 0
        for k, size in enumerate(self.tiers):
            least = self.tiers[k + 1] if k + 1 < len(self.tiers) else 0
            while pool and pool[-1][0] > least:
                window = [pool.pop()]
                gap = size - window[0][0]
                while gap and pool:
                    at = bisect_right(pool, (gap, self.arrivals + 1))
                    if at:
                        window.append(pool.pop(at - 1))
                    else:
                        piece, rest = self._cut(pool.pop(0), gap)
                        window.append(piece)
                        insort(pool, rest)
                    gap -= window[-1][0]
                if gap:
                    self.pool, self.held = window, size - gap
                else:
                    yield size, window

    def end(self) -> Iterator[tuple]:
        yield from self.pack()
        left, self.pool, self.held = self.pool[::-1], [], 0
        total = sum(r[0] for r in left)
        while total:
            size, window = 1 << total.bit_length() - 1, []
            total, room = total - size, size
            while room:
                rest = left.pop()
                if rest[0] > room:
                    rest, after = self._cut(rest, room)
                    left.append(after)
                window.append(rest)
                room -= rest[0]
            yield size, window


class Steps:
    """Windows to step groups of equal tokens and near attention cost."""

    def __init__(self, step: int, groups: int = 16):
        self.step, self.groups, self.windows, self.held, self.made = step, groups, [], 0, 0

    def add(self, size: int, window: list) -> Iterator[tuple]:
        self.windows.append((size, sum(r[0] ** 2 for r in window), window))
        self.held += size
        if self.held >= self.groups * self.step:
            yield from self.deal()

    def deal(self, last: bool = False) -> Iterator[tuple]:
        n = self.held // self.step
        heap = [(0, self.made + k, self.step) for k in range(n)]
        heapify(heap)
        self.made += n
        left = []
        for size, cost, window in sorted(self.windows, key=lambda w: (-w[0], -w[1])):
            if not heap:
                left.append((size, cost, window))
                continue
            total, k, room = heappop(heap)
            if room > size:
                heappush(heap, (total + cost, k, room - size))
            yield k, size, window
        self.windows, self.held = left, sum(w[0] for w in left)
        if last:
            for size, _, window in left:
                yield self.made, size, window


def _packs(vocabulary: str, id_type: pa.DataType, tiers, step: int, buffer: int):
    piece = pa.struct([("id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])
    schema = pa.schema([("sequence_id", pa.int64()), ("size", pa.int64()), ("step", pa.int64()), ("pieces", pa.list_(piece)), ("ids", pa.binary())])
    end = END.to_bytes(4, "little")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        identifiers, packer, steps = Identifiers(vocabulary), Packer(tiers, buffer), Steps(step)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = identifiers.of(batch.column(1)[k].as_py() or "") + end
                for window in packer.add(batch.column(0)[k].as_py(), ids):
                    yield from steps.add(*window)
        for window in packer.end():
            yield from steps.add(*window)
        yield from steps.deal(last=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, held = TaskContext.get().partitionId() << 40, [], 0
        for number, (group, size, window) in enumerate(windows(batches)):
            pieces, offset = [], 0
            for length, _, doc_id, start, total, _ in window:
                pieces.append({"id": doc_id, "start": start, "length": length, "doc_tokens": total, "offset": offset})
                offset += length
            rows.append((task + number, size, task + group, pieces, b"".join(r[5] for r in window)))
            held += size
            if held >= 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def packed_windows(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   tiers=TIERS, step: int = STEP, buffer: int = BUFFER) -> DataFrame:
    """One row per window: ``sequence_id``, ``size``, ``step``, ``pieces`` in order and ``ids``.

    ``ids`` holds the window's identifiers as little-endian unsigned 32-bit numbers; a piece is
    (id, start, length, doc_tokens, offset).  ``vocabulary`` is the path of a tokenizer file.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if step % max(tiers):
        raise ValueError("a step group holds whole windows of the longest tier")
    with open(vocabulary or vocabulary_path(), encoding="utf-8") as f:
        spelled = f.read()
    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    return rows.mapInArrow(
        _packs(spelled, to_arrow_type(kind), tiers, step, buffer),
        f"sequence_id long, size long, step long, pieces array<struct<id: {kind.simpleString()}, start: bigint, length: bigint, "
        "doc_tokens: bigint, offset: bigint>>, ids binary")


def pieces(windows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per piece, with its identifiers."""
    rows = windows.select("sequence_id", "size", "step", "ids", F.explode("pieces").alias("p"))
    return rows.select(F.col("p.id").alias(id_col), "p.start", "p.length", "p.doc_tokens", "sequence_id", "p.offset", "size", "step",
                       F.expr("substring(ids, CAST(4 * p.offset + 1 AS INT), CAST(4 * p.length AS INT))").alias("ids"))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    rows = pieces(packed_windows(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "size", "step")
