"""Joins and groupings that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which :func:`counted_join` sends a side to all tasks.
BROADCAST_ROWS = 100_000
#: Rows that one range of :func:`position_in_group` holds on average.
RANGE_ROWS = 100_000


def skewed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", large: bool = False) -> DataFrame:
    """Equi-join on ``key`` where ``right`` has one row per key and ``left`` may be skewed.

    Adaptive execution measures the partitions and splits those of hot keys, but only
    where both sides were shuffled for this join alone.  A right side that an aggregate or
    a window has already dealt by the key would not be; the hash of the key, a second key
    of the same meaning, asks for that shuffle.  Nothing is repeated for keys that are not hot.

    ``large`` says that both sides grow with the corpus.  Spark reckons with the compressed length of the files below a
    side, which for lists and hashes is a small part of their rows, and would gather such a side in the driver.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"only joins that keep left rows whole are supported, not {how!r}")
    hashed = F.xxhash64(key)
    right = right.hint("merge") if large else right
    return left.withColumn("_hash", hashed).join(right.withColumn("_hash", hashed), [key, "_hash"], how).drop("_hash")


def counted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """:func:`skewed_join` with a stored ``right`` that has few rows in most corpora, whatever Spark reckons.

    The rows are counted: up to :data:`BROADCAST_ROWS` go to all tasks and ``left`` is not shuffled, more are shuffled, as
    all are in a session that turned broadcasts off.
    """
    off = left.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    if not off and right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    return skewed_join(left, right, key, how, large=True)


def position_in_group(rows: DataFrame, group: str, order: str, out: str, width: int | None = None) -> DataFrame:
    """0-based position of each row in its group by an integer column, for groups of any size.

    Rows are numbered inside ranges of ``width`` order values, and the sizes of
    the earlier ranges of the group are added; ``order`` must be unique in a group.
    Without ``width`` the ranges are as wide as holds about ``RANGE_ROWS`` rows of the
    whole table, so a sparse order (a timestamp) does not make a range of every row.
    """
    if width is None:
        low, high, n = rows.agg(F.min(order), F.max(order), F.count(order)).first()
        width = max(1, (high - low + 1) * RANGE_ROWS // n) if n else 1
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(group).orderBy("_range")
                               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(group, "_range", F.coalesce(earlier, F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)) - 1
    return (ranged.withColumn("_within", within).join(offsets, [group, "_range"])
            .withColumn(out, (F.col("_within") + F.col("_offset")).cast("bigint"))
            .drop("_range", "_within", "_offset"))
