"""Order over whole tables: ranks without a global window, and intervals that lie in others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import settled

#: Places that one range of :func:`outside` spans.
RANGE = 4096


def ranked(rows: DataFrame, *order: Column, out: str = "idx") -> DataFrame:
    """1-based rank of every row in the whole table's order (O1).

    Two passes: a range-partitioned sort numbers the rows of each partition, and the sizes of the
    partitions before it are added.  Only the sizes, a row per partition, meet in one task.  ``order`` has to
    tell all rows apart.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper bits of the id are the partition, the lower 33 the place in it
    placed = settled(placed.withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (placed.withColumn("_part", part).withColumn("_at", at).join(F.broadcast(starts), "_part")
            .withColumn(out, F.col("_before") + F.col("_at") + 1).drop("_id", "_part", "_at", "_before"))


def outside(rows: DataFrame, containers: DataFrame, group: str, start: str, end: str, width: int = RANGE) -> DataFrame:
    """Rows whose interval [start, end] lies in no interval of ``containers`` of the same group.

    Null groups are one group.

    A sweep: an interval lies in another exactly if the furthest end among the containers that start
    no later reaches its own end.  Furthest ends are kept per range of ``width`` starts and carried over
    the ranges of a group, so the work is a sort of both tables, however many intervals a group has and
    however they nest; no pairs are made.
    """
    mark = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    swept = rows.select(mark.alias("_row"), F.col(group).alias("_g"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.lit(1).alias("_k"))
    held = containers.select(F.lit(None).cast(swept.schema["_row"].dataType).alias("_row"), F.col(group).alias("_g"),
                             F.col(start).alias("_s"), F.col(end).alias("_e"), F.lit(0).alias("_k"))
    both = held.unionByName(swept).withColumn("_range", F.floor(F.col("_s") / width))
    far = F.when(F.col("_k") == 0, F.col("_e"))
    within = Window.partitionBy("_g", "_range").orderBy("_s", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_far", F.max(far).over(within))
    ranges = both.groupBy("_g", "_range").agg(F.max(far).alias("_top"))
    earlier = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("_g", "_range", F.max("_top").over(earlier).alias("_carried"))
    b, c = both.where("_k = 1").alias("b"), carried.alias("c")
    found = b.join(c, F.col("b._g").eqNullSafe(F.col("c._g")) & (F.col("b._range") == F.col("c._range")))
    reach = F.greatest(F.coalesce("_far", "_carried"), F.coalesce("_carried", "_far"))
    return found.where(F.coalesce(reach < F.col("_e"), F.lit(True))).select("_row.*")
