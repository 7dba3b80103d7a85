"""Connected components of a link table, by alternating star contractions.

Every round is a handful of groupings and joins over the links; nothing is
gathered on the driver but two sums that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import settled


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it sees."""
    both = links.union(links.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
            .where("u <> v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    low = links.groupBy("u").agg(F.min("v").alias("low"))
    moved = links.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()


def _mark(links: DataFrame):
    got = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return got[0], got[1]


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, root)`` for every node that occurs in a link of two different nodes.

    ``root`` is the smallest node of the component.  Nulls, loops and repeated links
    are ignored; an empty table gives an empty table.  Each round is written to the
    shared folder, so a lost executor repeats at most one round.
    """
    a, b = F.col(u), F.col(v)
    links = settled(links.where(a.isNotNull() & b.isNotNull() & (a != b))
                    .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = _mark(links)
    while mark[0]:
        links = settled(_small_star(_large_star(links)))
        before, mark = mark, _mark(links)
        if before == mark:
            break
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
