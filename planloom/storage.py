"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. In one process (tests) a fresh temporary folder will do, and is kept in the session; on a cluster there must be one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.planloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-planloom-")
        spark.conf.set("spark.planloom.shared.dir", found)
    return found.rstrip("/")


def keyed(df: DataFrame) -> DataFrame:
    """``df`` as the smaller side of a join, dealt by key and hashed there. What is laid out from a small table, or lies packed in files, looks small to Spark, which would broadcast it through the driver."""
    return df.hint("shuffle_hash")


def dealt(df: DataFrame, each: int, *keys: str) -> DataFrame:
    """``df`` dealt to tasks by ``keys``, some ``each`` rows a task however many there are: what a task holds doesn't grow with the table, and what follows by these keys needs no shuffle."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each)), *keys)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join of two large ones: both are dealt and sorted by key, and neither is broadcast or held."""
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back: what reads it several times doesn't compute it again, and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/planloom-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
