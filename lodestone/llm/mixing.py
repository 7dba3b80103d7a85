"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source (a partial sum in every task, so a source with a third of
all rows costs one row per task), targets are found by water filling over one row per
source, and every document is written ``floor(rate)`` times plus once more when a
uniform number drawn from a hash of its identifier is below the fraction of the rate.

``rate = target / size of the source``.  Targets are shares of all tokens by weight and
stop at ``most`` times the source's size; what is above is shared again by weight.  With
sources in the order of ``most * size / weight`` the capped ones come first, so two
running sums give the level, and no round trip per source is needed.  The table of
sources has one narrow row per source; it is written and read back, so Spark knows its
size before it decides how to join it, and it splits a hot source where it has to shuffle.

Defined results: null text has size 0; a null source is a source of its own, last in
order; a source of size 0 has target 0 and its documents are not taken; rows with a null
identifier draw from a hash of their text; rows that repeat identifier and text draw
alike.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, column, packed, table, text_of, unpacked, word_count
from lodestone.session import settled

MOST = 3
SEED = "mix-1"


def by_rank(*weights: int):
    """Weights that repeat over the sources in code point order, null last."""

    def weigh(sources: DataFrame) -> DataFrame:
        # one row per source meets here, whatever the number of documents
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        return sources.withColumn("weight", F.element_at(F.lit(list(weights)), ((rank - 1) % len(weights) + 1).cast("int"))
                                  .cast("bigint"))

    return weigh


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``target``: ``sources`` has ``source``, ``source_size`` and a whole ``weight``."""
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    after = filled.rowsBetween(0, Window.unboundedFollowing)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    rest = total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = sources.select("*", rest.alias("_rest"), F.sum("weight").over(after).alias("_weights"))
    # the first source, in this order, whose cap is not below its share of the rest
    fits = most * F.col("source_size") * F.col("_weights") >= F.col("weight") * F.col("_rest")
    level = level.withColumn("_at", F.when(fits, F.struct(F.col("source_size") / F.col("weight"), F.coalesce(F.col("source"), F.lit("")),
                                                          F.col("_rest"), F.col("_weights"))))
    first = F.min("_at").over(everything)
    level = level.withColumn("_first", first)
    capped = F.col("_first").isNull() | (most * F.col("source_size") * F.col("_first._weights")
                                         < F.col("weight") * F.col("_first._rest"))
    share = (F.col("weight") * F.col("_first._rest")).cast("double") / F.col("_first._weights").cast("double")
    target = F.when(F.col("source_size") == 0, 0.0).when(capped, (most * F.col("source_size")).cast("double")).otherwise(share)
    return level.select("source", "source_size", "weight", target.alias("target"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), key)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(uniform(key, seed) < rate - whole, 1).otherwise(0)).cast("bigint")


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Key, source and size of every document: the only pass over the texts."""
    key = F.coalesce(column(id_col).cast("string"), F.md5(text_of(text_col).cast("binary")))
    return docs.select(column(id_col).alias("_id"), key.alias("_key"), column(source_col).cast("string").alias("source"),
                       word_count(text_of(text_col)).alias("size"))


def rates(measured: DataFrame, weigh, most: int = MOST) -> DataFrame:
    sizes = measured.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    return settled(targets(weigh(sizes), most))


def mix_report(docs: DataFrame, weigh=by_rank(1, 2, 3), most: int = MOST, seed: str = SEED, id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, copies and taken tokens."""
    measured = settled(_measured(docs, id_col, text_col, source_col))
    plan = rates(measured, weigh, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    n = copies(rate, F.col("_key"), seed)
    return (measured.alias("m").join(plan.alias("p"), F.col("m.source").eqNullSafe(F.col("p.source")))
            .select(F.col("_id").alias(id_col), "size", "source_size", "target", n.alias("copies"),
                    (F.col("size") * n).alias("taken")))


def mixed(docs: DataFrame, weigh=by_rank(1, 2, 3), most: int = MOST, seed: str = SEED, id_col: str = "doc_id",
          text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: ``docs`` with every row repeated as its rate says, and ``copy`` from 1.

    Where ``docs`` has a column of that name, in whatever case, underscores before it make the counter's name free.
    """
    counter, taken_names = "copy", {c.lower() for c in docs.columns}
    while counter in taken_names:
        counter = f"_{counter}"
    measured = _measured(docs, id_col, text_col, source_col)
    plan = rates(measured, weigh, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.coalesce(column(id_col).cast("string"), F.md5(text_of(text_col).cast("binary")))
    rows = packed(docs, key.alias("_key"), column(source_col).cast("string").alias("_source"))
    taken = (rows.join(plan, F.col("_source").eqNullSafe(F.col("source")))
             .select("_row", copies(rate, F.col("_key"), seed).alias("_n")).where("_n > 0"))
    return unpacked(taken, F.explode(F.expr("sequence(1, cast(_n as int))")).alias(counter))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}/' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT / {1 << 52}::DOUBLE AS u
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sums
), running AS (
  SELECT *, (sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights
  FROM weighed
), level AS (
  SELECT rest AS r, weights AS w FROM running WHERE {MOST} * source_size * weights >= weight * rest
  ORDER BY source_size / weight, source NULLS LAST LIMIT 1
), planned AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE
         WHEN r IS NULL OR {MOST} * source_size * w < weight * r THEN ({MOST} * source_size)::DOUBLE
         ELSE (weight * r)::DOUBLE / w::DOUBLE END AS target
  FROM running LEFT JOIN level ON true
), rated AS (
  SELECT s.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
), counted AS (
  SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated
)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM counted
"""
