"""Token counts from flat, unindexed token files by a scan for separators.

A token file is nothing but little-endian 16-bit identifiers; identifier ``EOD`` ends a
document.  There is no index, so the scan finds the documents itself:

1. files are listed with their lengths and cut into ranges of ``BLOCK`` bytes, and every task reads
   its own ranges;
2. each block is searched for separators with numpy; documents that lie inside one block
   are complete, and what hangs over either edge is summed up in a few numbers;
3. a prefix scan over the blocks of each file (running sums and the last separator before a
   block) stitches the documents that cross blocks, however many blocks they cover.

:func:`write_tokens` makes such files from texts: the identifiers of a public byte-level BPE
plus one (so that 0 is free to be ``EOD``), written by Spark's own text writer with the
separator as line end.  A document may begin with five identifiers above ``MARK`` that spell
its number in base 2^13; the scan reads them back as ``doc_id`` and does not count them.

Defined results: null and empty texts have 0 tokens; a null identifier is written without a
number and read as null; rows that repeat an identifier are documents of their own; a last
document without separator counts when it has tokens; an empty table gives no rows.  Files may
have any length; a document's edges and the separators of a block are all that leaves a task.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import column, table
from lodestone.session import settled, shared_folder

EOD, MARK, DIGIT, DIGITS = 0, 0xE000, 13, 5
BLOCK = 1 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def numbered(doc_id: int | None) -> np.ndarray:
    """The identifiers that spell a document's number."""
    if doc_id is None:
        return np.zeros(0, dtype="<u2")
    bits = doc_id & ((1 << 64) - 1)
    return np.array([MARK + (bits >> DIGIT * k & (1 << DIGIT) - 1) for k in range(DIGITS)], dtype="<u2")


def number_of(head) -> int | None:
    if head is None or len(head) < DIGITS or min(head[:DIGITS]) < MARK:
        return None
    bits = sum((int(x) - MARK) << DIGIT * k for k, x in enumerate(head[:DIGITS])) & ((1 << 64) - 1)
    return bits - (1 << 64) if bits >> 63 else bits


def _tokenizer(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks).encode_ordinary
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                tokens = np.array(encode(text or ""), dtype=np.int64) + 1
                if len(tokens) and tokens.max() >= MARK:
                    raise ValueError("the vocabulary has too many identifiers for 16 bits with numbers")
                out.append(numbered(doc_id).tobytes() + tokens.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["data"])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Flat token files of the texts, one per task."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    rows = docs.select(column(id_col).cast("bigint").alias("id"), column(text_col).cast("string").alias("text"))
    tokens = rows.mapInArrow(_tokenizer(ranks), "data binary")
    tokens.select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\0\0").option("compression", "none").text(path)
    return path


def _listed(spark, path: str) -> list[tuple[str, int]]:
    """Files below ``path`` with their lengths, from the file system alone."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = [], system.listFiles(root, True)
    while files.hasNext():
        status = files.next()
        if not status.getPath().getName().startswith(("_", ".")):
            found.append((status.getPath().toString(), status.getLen()))
    return sorted(found)


def _opened(uri: str):
    """The file for reading at any place, through Arrow's file systems."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")
    return system.open_input_file(place)


def _reachable(uri: str) -> bool:
    try:
        _opened(uri).close()
    except (OSError, ValueError):  # no such file system in Arrow, or none that it can reach
        return False
    return True


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        name, held = None, None
        for k in range(batch.num_rows):
            file, block, start, size = (batch.column(c)[k].as_py() for c in ("file", "block", "start", "size"))
            if file != name:
                name, held = file, _opened(file)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([held.read_at(size, start)], pa.binary())],
                                             ["file", "block", "data"])


def read_blocks(spark, path: str, block: int = BLOCK) -> DataFrame:
    """``(file, block, data)``: the files below ``path`` in blocks of ``block`` bytes.

    Files are listed with their lengths, and a task reads the ranges it is given and no others, so a file may have
    any length.  The blocks are dealt to tasks of about a hundred.  In a file system that Arrow does not open (it
    opens local and shared folders, hdfs, s3 and gs) a file is read whole and cut then, and has to be below 2 GB.
    """
    if block % 2 or block < 64:
        raise ValueError("a block holds whole identifiers, 32 at least")
    listed = [f for f in _listed(spark, path) if f[1]]
    if listed and not _reachable(listed[0][0]):
        cut = F.expr(f"transform(sequence(0, (length(content) - 1) DIV {block}), i -> substring(content, CAST(i * {block} + 1 AS INT), {block}))")
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.length("content") > 0)
        return whole.select(F.col("path").alias("file"), F.posexplode(cut).alias("block", "data"))
    files = spark.createDataFrame(listed, "file string, length long")
    cut = files.select("file", "length", F.explode(F.expr(f"sequence(0, (length - 1) DIV {block})")).alias("block"))
    places = cut.select("file", "block", (F.col("block") * block).alias("start"), F.least(F.lit(block), F.col("length") - F.col("block") * block).alias("size"))
    total = sum(-(-n // block) for _, n in listed)
    tasks = max(1, min(total, max(spark.sparkContext.defaultParallelism, total // 100)))
    return places.repartitionByRange(tasks, "file", "block").mapInArrow(_ranges, "file string, block long, data binary")


_SCANNED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("seps", pa.int64()), ("first", pa.int64()),
                      ("last", pa.int64()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32())),
                      ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])
_DDL = ("file string, block long, n long, seps long, first long, last long, head array<int>, tail array<int>, "
        "starts array<long>, lengths array<long>, ids array<long>")


def scan_block(data: bytes, eod: int = EOD) -> tuple:
    """What one block knows: counts, its edges, and the documents that lie inside it."""
    tokens = np.frombuffer(data, dtype="<u2")
    at = np.flatnonzero(tokens == eod)
    head = tokens[:DIGITS].tolist()
    if not len(at):
        return len(tokens), 0, None, None, head, None, [], [], []
    starts, lengths = at[:-1] + 1, np.diff(at) - 1
    ids = [number_of(tokens[s:s + min(DIGITS, n)].tolist()) for s, n in zip(starts.tolist(), lengths.tolist())]
    return (len(tokens), len(at), int(at[0]), int(at[-1]), head, tokens[at[-1] + 1:at[-1] + 1 + DIGITS].tolist(),
            starts.tolist(), lengths.tolist(), ids)


def _scanner(eod: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, data in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "data"))):
                if len(data) % 2:
                    raise ValueError(f"{file} does not hold whole 16-bit identifiers")
                row = (file, block, *scan_block(data, eod))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCANNED)], schema=_SCANNED)

    return run


def token_counts(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """``(file, ordinal, start, doc_id, n_tokens)`` of every document in the files."""
    scanned = settled(blocks.select("file", F.col("block").cast("bigint").alias("block"), "data").mapInArrow(_scanner(eod), _DDL))
    line = Window.partitionBy("file").orderBy("block")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.lead("head").over(line), F.array().cast("array<int>"))
    edges = scanned.drop("starts", "lengths", "ids").select(
        "*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("seps").over(before), F.lit(0)).alias("ordinal"),
        F.slice(F.concat("tail", ahead), 1, DIGITS).alias("whole_tail"), F.slice(F.concat("head", ahead), 1, DIGITS).alias("whole_head"),
        F.lead("block").over(line).isNull().alias("final"))
    edges = edges.withColumn("last_at", F.col("base") + F.col("last"))
    stitched = edges.select(
        "*", F.coalesce(F.last("last_at", ignorenulls=True).over(before), F.lit(-1)).alias("prior"),
        F.coalesce(F.last("whole_tail", ignorenulls=True).over(before), F.first("whole_head").over(line)).alias("opens"))
    closed = stitched.where("first IS NOT NULL").select("file", "ordinal", (F.col("prior") + 1).alias("start"),
                                                        (F.col("base") + F.col("first") - F.col("prior") - 1).alias("length"), F.col("opens").alias("opening"))
    ended = F.coalesce("last_at", "prior")
    open_ = stitched.where("final").select("file", (F.col("ordinal") + F.col("seps")).alias("ordinal"), (ended + 1).alias("start"),
                                           (F.col("base") + F.col("n") - ended - 1).alias("length"),
                                           F.when(F.col("seps") > 0, F.col("whole_tail")).otherwise(F.col("opens")).alias("opening")).where("length > 0")
    digits = " + ".join(f"shiftleft(CAST(opening[{k}] - {MARK} AS BIGINT), {DIGIT * k})" for k in range(DIGITS))
    spelled = F.expr(f"IF(size(opening) = {DIGITS} AND length >= {DIGITS} AND array_min(opening) >= {MARK}, {digits}, NULL)")
    crossing = closed.unionByName(open_).select("file", "ordinal", "start", spelled.alias("doc_id"), "length")
    places = edges.select("file", "block", "base", F.col("ordinal").alias("_before"))
    inside = (scanned.select("file", "block", F.posexplode(F.arrays_zip("starts", "lengths", "ids")).alias("_i", "d"))
              .join(places, ["file", "block"]).select("file", (F.col("_before") + F.col("_i") + 1).alias("ordinal"),
                                                      (F.col("base") + F.col("d.starts")).alias("start"), F.col("d.ids").alias("doc_id"),
                                                      F.col("d.lengths").alias("length")))
    counted = F.col("length") - F.when(F.col("doc_id").isNotNull(), DIGITS).otherwise(0)
    return crossing.unionByName(inside).select("file", "ordinal", "start", "doc_id", counted.cast("bigint").alias("n_tokens"))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents"), f"{shared_folder(spark).rstrip('/')}/tokens/{uuid.uuid4().hex}")
    return token_counts(read_blocks(spark, path)).select("doc_id", "n_tokens")
