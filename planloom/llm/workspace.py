"""Shared-folder helpers: where intermediate tables go, and how tasks find this package."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Bits of a filter (as a power of two): 8 MB, as 2**20 rows at most.
FILTER_BITS = 26


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the session names none and runs in one process (tests), a fresh temporary folder is made and kept in the session; on a
    cluster, where executors don't share such folders, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.planloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-planloom-")
        spark.conf.set("spark.planloom.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/planloom-{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back.

    A lost executor then costs only the tasks that it ran, not the whole history of the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.planloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` that nothing will read again: call it only when all that comes of them is written."""
    for df in tables:
        spark, path = df.sparkSession, df.planloom_path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark deletes the shuffle files of steps that are over.

    Else they stay until the driver happens to run out of memory, and a job of many steps holds the files of all.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_doubt(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``rows`` and __doubt: false where ``key`` surely is no value of the column of ``keys``; a bitmap of fixed size tells it, without a shuffle of ``rows``."""
    word = lambda c: F.shiftright(F.shiftrightunsigned(F.xxhash64(c), 64 - FILTER_BITS), 6)
    mask = F.lit((1 << FILTER_BITS) - 1).cast("long")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(F.xxhash64(c), 64 - FILTER_BITS).bitwiseAND(mask) % 64).cast("int"))
    only = F.col(f"`{keys.columns[0]}`")
    words = materialise(keys.select(word(only).alias("__word"), bit(only).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits")), "words")
    told = rows.withColumn("__own", word(key)).withColumn("__mask", bit(key))
    told = told.join(F.broadcast(words), told["__own"] == words["__word"], "left")
    return told.withColumn("__doubt", F.coalesce(F.col("__bits"), F.lit(0)).bitwiseAND(F.col("__mask")) != 0).drop("__own", "__mask", "__word", "__bits")


def ship(spark: SparkSession) -> None:
    """Puts the repository on the Python path of the workers (for clusters without a shared folder use --py-files), and bounds the bytes of a batch that goes to them.

    Batches are as small as BATCH_BYTES where the session leaves Spark's default; they bound what a task holds of long texts on both sides.
    """
    if spark.conf.get(BATCH_CONF, "64m").lower() in ("67108864", "67108864b", "64m", "64mb"):
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
