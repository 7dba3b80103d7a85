"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.  The same text is valid in Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(name: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def packed(docs: DataFrame, *computed: Column) -> DataFrame:
    """The whole row as struct ``_row`` beside computed columns, so that no name can clash."""
    return docs.select(F.struct("*").alias("_row"), *computed)


def unpacked(rows: DataFrame, *more: str | Column) -> DataFrame:
    return rows.select("_row.*", *more)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id's digits leaves 2 modulo 4."""
    return F.coalesce(F.crc32(column(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, kind: str, bound: int) -> list:
    """At most ``bound`` rows ``(id, kind, text)`` of each kind, by hash of the identifier, then of the whole row.

    Rows are ranked without their texts, which only the chosen rows bring along; rows that are equal count
    each.  The result does not depend on partitions.
    """
    key = F.xxhash64("id", kind, "text")
    ranked = Window.partitionBy(kind).orderBy(F.xxhash64("id"), "id", "_key")
    picked = (rows.select("id", kind, key.alias("_key")).withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= bound)
              .groupBy("_key").agg(F.count("*").alias("n")).collect())
    times = {r["_key"]: r["n"] for r in picked}
    found = (rows.where(key.isin(list(times))).groupBy(key.alias("_key")).agg(F.min(F.struct("id", kind, "text")).alias("_row")).collect()
             if times else [])
    found.sort(key=lambda r: (str(r["_row"]["id"]), str(r["_row"][kind]), r["_row"]["text"] or ""))
    return [r["_row"] for r in found for _ in range(times[r["_key"]])]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
