"""Vector code compression: product codes learned by active-entry Lloyd rounds.

Components become integers, ``floor(scale * x)``; a vector is cut into equal consecutive
parts and every part position has a codebook.  A round assigns each part to its nearest
entry (squared distance, ties to the lower index) and moves each entry to the floor of its
parts' mean.  All of it is integer arithmetic, so results do not depend on task order.

Rounds after the first are active-entry rounds.  Each part is stored with its entry and the
exact distance to it:

* where the entry stayed fixed, the distance is still exact and every other fixed entry is
  still no better, so only the entries that moved are compared with it;
* where the entry moved, the part is compared with all entries again.

A round is one pass: tasks read the stored rows, write them again with new entries and
distances, and write their sums per entry beside them (at most parts x entries rows a task).
Spark adds the sums up; the driver holds nothing but the codebooks, entries x components
numbers, and stops early when no entry moves.  Rows are never shuffled, so neither a common
vector nor a common label matters; every round is a table in the shared folder, so a lost
executor repeats part of one round.

Defined results: rows whose vector is null or holds a null or a non-finite component are
dropped; codebooks start from the smallest distinct identifiers (nulls last; of rows that
share one the least vector), fewer rows than entries give fewer entries; repeated rows are
coded each for itself; an empty table gives an empty table and empty codebooks.  Vectors
must have one length that the parts divide, and scaled components below the root of 2^58 /
length, so that squares stay exact: otherwise ValueError.  Other columns pass as a struct, so no name
can clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, table
from lodestone.operators.skew import skewed_join
from lodestone.session import settled

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances to all entries a task holds at once.
SLAB = 2048


class Compressed(NamedTuple):
    """``rows``: (row, code array<int>, distance array<long>); ``codebooks``: integers by part, entry, component."""

    rows: DataFrame
    codebooks: np.ndarray


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by entries."""
    largest = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * x.shape[1] * int(largest) ** 2 < 1 << 53:  # every product and sum is a whole double
        x, entries = x.astype(np.float64), entries.astype(np.float64)
    got = (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]
    return got.astype(np.int64)


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray | None = None, code: np.ndarray | None = None,
           held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries and distances of the parts ``x``.

    With ``moved`` (a flag per entry), ``code`` and ``held`` (the entries and distances of the round
    before) parts of fixed entries are compared with moved entries only.
    """
    if code is None:
        got = distances(x, entries)
        best = got.argmin(1)
        return best, got[np.arange(len(x)), best]
    code, held = code.copy(), held.copy()
    again = moved[code]
    if again.any():
        code[again], held[again] = assign(x[again], entries)
    active = np.flatnonzero(moved)
    fixed = np.flatnonzero(~again)
    if len(active) and len(fixed):
        got = distances(x[fixed], entries[active])
        best = got.argmin(1)
        near, index = got[np.arange(len(fixed)), best], active[best]
        better = (near < held[fixed]) | ((near == held[fixed]) & (index < code[fixed]))
        code[fixed[better]], held[fixed[better]] = index[better], near[better]
    return code, held


def _round(codebooks: np.ndarray, moved: np.ndarray | None, schema: pa.Schema):
    """Rows with new codes, then the sums and counts of the task's parts per entry."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLAB):
                rows = batch.slice(at, SLAB)
                x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows.num_rows, parts, width)
                code = np.empty((rows.num_rows, parts), np.int64)
                held = np.empty((rows.num_rows, parts), np.int64)
                if moved is not None:
                    old = rows.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, parts)
                    far = rows.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
                for p in range(parts):
                    state = () if moved is None else (moved[p], old[:, p], far[:, p])
                    code[:, p], held[:, p] = assign(x[:, p], codebooks[p], *state)
                    np.add.at(sums[p], code[:, p], x[:, p])
                    counts[p] += np.bincount(code[:, p], minlength=entries)
                lists = [pa.ListArray.from_arrays(np.arange(rows.num_rows + 1, dtype=np.int32) * parts, pa.array(v.ravel(), t))
                         for v, t in ((code, pa.int32()), (held, pa.int64()))]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists] + [pa.nulls(rows.num_rows, f.type) for f in list(schema)[4:]], schema=schema)
        used = np.argwhere(counts)
        if len(used):
            p, e = used.T
            some = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64()),
                    pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(p), f.type) for f in list(schema)[:4]] + some, schema=schema)

    return run


def _means(passed: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Entries moved to the floor of their parts' mean; unused entries stay."""
    sums = passed.where("part IS NOT NULL").select("part", "entry", "n", F.posexplode("sums").alias("at", "sum"))
    totals = sums.groupBy("part", "entry", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n"))
    after = codebooks.copy()
    for r in totals.collect():  # entries x components numbers
        after[r["part"], r["entry"], r["at"]] = int(r["sum"]) // r["n"]
    return after


def _integers(vectors: DataFrame, id_col: str, vector_col: str, keep: list[str], scale: int) -> DataFrame:
    """(_row, x array<long>, id) of the rows that are kept."""
    v = f"CAST(`{vector_col}` AS array<double>)"
    kept = vectors.where(F.expr(f"`{vector_col}` IS NOT NULL AND forall({v}, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"))
    return kept.select(F.struct(*[column(c) for c in dict.fromkeys([id_col, *keep])]).alias("_row"),
                       F.expr(f"transform({v}, c -> IF(abs({scale} * c) < 1e18D, floor({scale} * c), NULL))").alias("x"), column(id_col).alias("id"))


def _seeds(rows: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the smallest identifiers: at most ``entries`` rows reach the driver."""
    ids = [r["id"] for r in rows.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    if not ids:
        return []
    chosen = F.col("id").isin([i for i in ids if i is not None])
    if None in ids:
        chosen = F.coalesce(chosen, F.lit(True))
    return [r["x"] for r in rows.where(chosen).groupBy("id").agg(F.min("x").alias("x")).orderBy(F.col("id").asc_nulls_last()).collect()]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """Codes of all vectors and the codebooks; ``row`` holds the identifier and the columns ``keep``."""
    rows = settled(_integers(vectors, id_col, vector_col, keep or [], scale))
    seeds = _seeds(rows, entries)
    kept = rows.schema["_row"].dataType.simpleString()
    ddl = f"row {kept}, x array<bigint>, code array<int>, distance array<bigint>, part int, entry int, n bigint, sums array<bigint>"
    if not seeds:
        empty = rows.sparkSession.createDataFrame([], ddl).select("row", "code", "distance")
        return Compressed(empty, np.zeros((parts, 0, 0), np.int64))
    width = len(seeds[0])
    bound = math.isqrt((1 << 58) // max(1, width))
    odd = rows.where(F.expr(f"size(x) <> {width} OR exists(x, c -> c IS NULL OR abs(c) >= {bound})"))
    if width % parts or not odd.isEmpty():
        raise ValueError(f"vectors must have one length that {parts} divides, with components whose squares stay exact")
    codebooks = np.array(seeds, np.int64).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2)
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("row", to_arrow_type(rows.schema["_row"].dataType)), ("x", pa.list_(pa.int64())), ("code", pa.list_(pa.int32())),
                        ("distance", pa.list_(pa.int64())), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
                        ("sums", pa.list_(pa.int64()))])
    none = [F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("array<bigint>").alias("distance")]
    state, moved = rows.select(F.col("_row").alias("row"), "x", *none), None
    for left in range(rounds, -1, -1):
        passed = settled(state.mapInArrow(_round(codebooks, moved, schema), ddl))
        state = passed.where("part IS NULL").select("row", "x", "code", "distance")
        if not left:
            break
        after = _means(passed, codebooks)
        moved = (after != codebooks).any(2)
        if not moved.any():  # the next rounds would change nothing
            break
        codebooks = after
    return Compressed(state.select("row", "code", "distance"), codebooks)


def decoded(code: list[int], codebooks: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([codebooks[p, e] for p, e in enumerate(code)])


def op13_codes(spark, sf_dir: str) -> DataFrame:
    got = compress(table(spark, sf_dir, "embeddings"), keep=["label"])
    digest = hashlib.sha256(",".join(map(str, got.codebooks.ravel().tolist())).encode()).hexdigest()
    code = F.lower(F.array_join(F.transform("code", lambda e: F.lpad(F.hex(e), 2, "0")), ""))
    rows = got.rows.select("row.vec_id", F.col("row.label").alias("label"), code.alias("code"),
                           F.expr("aggregate(distance, 0L, (a, d) -> a + d)").alias("error"),
                           F.to_json(F.struct("row.label")).alias("_label"))
    per = rows.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return skewed_join(rows, per, "_label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    step = ["""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS (
  SELECT vec_id, p, list_slice(x, p * len(x) // 4 + 1, (p + 1) * len(x) // 4) AS v FROM kept, range(4) AS t(p)
), c0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < 256
)"""]
    for k in range(ROUNDS + 1):
        step.append(f"""a{k} AS (
  SELECT vec_id, q.p, any_value(q.v) AS v, min({{'d': list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': c.e}}) AS b
  FROM parts q JOIN c{k} c ON c.p = q.p GROUP BY vec_id, q.p
)""")
        if k < ROUNDS:
            step.append(f"""m{k} AS (
  SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, b.e AS e, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM a{k}, range(1, len(v) + 1) AS r(i) GROUP BY ALL) GROUP BY ALL
), c{k + 1} AS (
  SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e
)""")
    return ", ".join(step) + f""", coded AS (
  SELECT vec_id, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


#: For tables without repeated identifiers.
ORACLE = _oracle()
