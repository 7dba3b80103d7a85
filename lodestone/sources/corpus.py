"""Reading source files, from folders or from tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import code_hash, is_source_file, tolerant_text, unix_lines

BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; both may carry a scheme such as ``file:``."""
    folder = "/" + re.sub(r"^[A-Za-z0-9+.-]+:", "", root).strip("/") + "/"
    plain = F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z0-9+.-]+:", ""), r"^/+", "/")
    at = F.locate(folder, plain)
    return F.when(at > 0, plain.substr(at + F.lit(len(folder)), F.length(plain))).otherwise(plain)


def scan_folder(spark: SparkSession, root: str, glob: str = "*.{c,h}", path_of: Column | None = None) -> DataFrame:
    """All ``.c`` and ``.h`` files below ``root`` (S1-S3): path, content, content_hash.

    ``path_of`` names a file (column ``path``) that is not known by its place below ``root``.
    """
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
           .option("pathGlobFilter", glob).load(root))
    return decoded(raw, root, path_of)


def decoded(raw: DataFrame, root: str, path: Column | None = None) -> DataFrame:
    """Text and hash of binary files; ``path`` names them where they are not known by their place below ``root``."""
    path = relative_path(F.col("path"), root) if path is None else path
    return with_hash(raw.select(path.alias("path"), tolerant_text("content").alias("content")))


def scan_table(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The same from any table with path and text."""
    return with_hash(df.where(is_source_file(path)).select(
        F.col(path).alias("path"), unix_lines(content).alias("content")))


def with_hash(files: DataFrame) -> DataFrame:
    return files.select(F.md5(F.col("path").cast("binary")).alias("file_key"), "path", "content",
                        code_hash("content").alias("content_hash"))


def file_dimension(known: DataFrame, paths: DataFrame) -> DataFrame:
    """Known files plus the new paths, one row per path."""
    new = paths.select("path").distinct().join(known.select("path"), "path", "left_anti")
    key = F.md5(F.col("path").cast("binary")).alias("file_key")
    return known.select("file_key", "path").unionByName(new.select(key, "path"))
