"""Session settings that the jobs in this package expect.

On a cluster the session comes from outside; :func:`build_session` is for
tests and the benchmark.  Nothing here overrides a setting that is already
present on an existing session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # A rendered or parsed file is one row; small scan splits keep the number
    # of files that one task holds low.
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(app: str = "lodestone", cores: str | int = "*", partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only when the session names none and runs in one process (tests) is a fresh
    temporary folder chosen; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    current = getattr(shared_folder, "_fallback", None)
    if current is None or not os.path.isdir(current):
        current = tempfile.mkdtemp(prefix="lodestone-")
        shared_folder._fallback = current
    return current


def settled(df):
    """Write ``df`` as a table to the shared folder and read it back.

    The stage boundary for results that several branches use: a branch reads
    only its columns, and a lost executor repeats nothing before it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lodestone/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
