"""Vector codes against plain Lloyd rounds, and their defined results for odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from lodestone.llm import codes

SF = "/root/testdata/sf0.001"


def plain_lloyd(vectors, parts, entries, rounds):
    """All parts against all entries in Python integers; ``vectors`` in the order of their identifiers."""
    width = len(vectors[0]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for left in range(rounds, -1, -1):
        got = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
        if not left:
            return got, books
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, got) if g[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]


def test_query_against_plain_rounds(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    vectors = [[math.floor(1024 * x) for x in r.embedding] for r in rows]
    want, books = plain_lloyd(vectors, 4, 256, 4)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = {r.vec_id: sum(d for d, _ in w) for r, w in zip(rows, want)}
    label = {k: sum(error[r.vec_id] for r in rows if r.label == k) for k in {r.label for r in rows}}
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.op13_codes(spark, SF).collect()}
    assert got == {r.vec_id: ("".join(f"{k:02x}" for _, k in w), error[r.vec_id], label[r.label], digest) for r, w in zip(rows, want)}


@pytest.mark.parametrize("seed", range(4))
def test_ties_and_many_moves(spark, seed):
    rng = random.Random(seed)
    vectors = [[rng.randrange(4) for _ in range(6)] for _ in range(300)]
    rows = [(k, [float(x) for x in v], None if k % 3 else k % 2) for k, v in enumerate(vectors)]
    got = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5),
                         parts=3, entries=12, rounds=6, scale=1)
    want, books = plain_lloyd(vectors, 3, 12, 6)
    assert got.codebooks.tolist() == books
    assert {r["row"].vec_id: list(zip(r.distance, r.code)) for r in got.rows.collect()} == dict(enumerate(want))


def test_active_entries_equal_full_scan():
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (500, 3))
    before = rng.integers(-3, 4, (20, 3))
    code, held = codes.assign(x, before)
    for moved_entries in ([], [4], [0, 7, 19], range(20)):
        moved = np.zeros(20, bool)
        moved[list(moved_entries)] = True
        after = before + moved[:, None] * rng.integers(-2, 3, (20, 3))
        want = codes.assign(x, after)
        got = codes.assign(x, after, moved, code, held)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_large_components_stay_exact():
    x = np.array([[1 << 26, -(1 << 26)], [(1 << 26) - 1, 5]])
    got = codes.distances(x, x)
    assert got.tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in x] for u in x]


def test_codes_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label string, code string, row int, x long, part int"
    rows = [(1, [0.5, -0.5], "a", "c", 1, 1, 1), (1, [0.5, -0.5], "a", "c", 1, 1, 1), (2, None, "a", "c", 1, 1, 1),
            (3, [0.5, None], None, None, None, None, None), (4, [float("nan"), 1.0], "b", "c", 1, 1, 1),
            (5, [float("inf"), 1.0], "b", "c", 1, 1, 1), (None, [0.25, 1.0], None, "c", 1, 1, 1), (6, [-0.0001, 0.0], None, "c", 1, 1, 1)]
    table = spark.createDataFrame(rows, schema)
    got = codes.compress(table, keep=["label", "code", "row", "x", "part"], parts=2)
    assert got.rows.select("row.*").columns == ["vec_id", "label", "code", "row", "x", "part"]
    assert sorted((r["row"].vec_id is None, r["row"].vec_id or 0) for r in got.rows.collect()) == [(False, 1), (False, 1), (False, 6), (True, 0)]
    assert got.codebooks.tolist() == [[[512], [-1], [256]], [[-512], [0], [1024]]]
    assert all(r.distance == [0, 0] for r in got.rows.collect())
    assert codes.decoded([1, 2], got.codebooks).tolist() == [-1, 1024]
    empty = codes.compress(table.limit(0))
    assert empty.rows.count() == 0 and empty.codebooks.size == 0
    for bad in ([0.5, 1.0, 2.0], [1e30, 1.0]):
        with pytest.raises(ValueError):
            codes.compress(spark.createDataFrame([(1, [0.5, 1.0]), (2, bad)], "vec_id long, embedding array<float>"), parts=2)
