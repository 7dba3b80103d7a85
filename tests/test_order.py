"""Ranks and interval containment against brute force."""

import random
import time

from pyspark.sql import functions as F

from lodestone.operators import order


def test_ranks_of_a_whole_table(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = {(r.a, r.b): r.idx for r in order.ranked(df, F.col("a"), F.col("b")).collect()}
    assert got == {row: k + 1 for k, row in enumerate(sorted(rows))}
    assert order.ranked(df.where("a < 0"), F.col("a"), F.col("b")).count() == 0


def test_outside_against_brute_force(spark):
    rng = random.Random(2)

    def intervals(n):
        return [(rng.choice(["x", "y", None]), s, s + rng.choice([0, 1, 5, 60])) for s in (rng.randrange(300) for _ in range(n))]

    rows = [(*r, i) for i, r in enumerate(intervals(400))]
    held = [r for r in intervals(40) if r[0] != "y" or r[1] > 100]
    want = sorted(i for g, s, e, i in rows if not any(g == h and a <= s and b >= e for h, a, b in held))
    df = spark.createDataFrame(rows, "g string, s int, e int, i int")
    inside = spark.createDataFrame(held, "g string, s int, e int")
    for width in (1, 16, 4096):
        got = order.outside(df, inside, "g", "s", "e", width)
        assert got.columns == df.columns and sorted(r.i for r in got.collect()) == want
    assert order.outside(df, inside.limit(0), "g", "s", "e").count() == 400
    assert order.outside(df.limit(0), inside, "g", "s", "e").count() == 0


def test_one_file_of_many_intervals(spark):
    """100,000 nested containers of one group, and as many rows."""
    n = 100_000
    held = spark.range(n).select(F.lit("f").alias("g"), F.col("id").alias("s"), (2 * n - F.col("id")).alias("e"))
    rows = spark.range(n).select(F.lit("f").alias("g"), F.col("id").alias("s"),
                                 (2 * n - F.col("id") + F.col("id") % 2 * (F.col("id") + 1)).alias("e"))
    start = time.time()
    assert order.outside(rows, held, "g", "s", "e").count() == n // 2
    assert time.time() - start < 60
