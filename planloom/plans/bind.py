"""Bindings of the measuring operators to the test tables, and the registry that collects queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows where there is some."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted points (capture_id, chunk, x, y, z, r, g, b, w) of ``lineitem``: a capture for five suppliers."""
    d = lambda c: F.col(c).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_suppkey") / 5).cast("long").alias("capture_id"), (F.col("l_partkey") % 4).alias("chunk"), (d("l_extendedprice") / 9973).alias("x"), (d("l_discount") * 25).alias("y"), (d("l_quantity") / 10).alias("z"),
        (d("l_partkey") % 256).alias("r"), (d("l_suppkey") % 256).alias("g"), (d("l_orderkey") % 256).alias("b"), d("l_linenumber").alias("w"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"),
    )


#: The same points for DuckDB, as the common table expression p.
POINTS_SQL = """p AS (SELECT l_suppkey // 5 AS capture_id, l_partkey % 4 AS chunk, l_extendedprice / 9973::DOUBLE AS x, l_discount * 25::DOUBLE AS y, l_quantity / 10::DOUBLE AS z,
  (l_partkey % 256)::DOUBLE AS r, (l_suppkey % 256)::DOUBLE AS g, (l_orderkey % 256)::DOUBLE AS b, l_linenumber::DOUBLE AS w, l_orderkey AS ord, l_linenumber AS line FROM lineitem)"""


def vectors(spark: SparkSession, sf_dir: str, n: int = 16) -> DataFrame:
    """vec_id, label and the first components e1, e2 ... of ``embeddings`` as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(n)])


VECTORS_SQL = "v AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i}]::DOUBLE AS e{i}" for i in range(1, 17)) + " FROM embeddings)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (capture_id, frame, ts, score, kind) of ``events``: users are captures, frames are numbered by time."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("capture_id"), F.col("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("value").cast("double").alias("score"), F.col("event_type").alias("kind"))
    return e.withColumn("frame", (F.row_number().over(Window.partitionBy("capture_id").orderBy("ts", "event_id")) - 1).cast("long"))


FRAMES_SQL = """f AS (SELECT user_id AS capture_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS ts, value::DOUBLE AS score, event_type AS kind,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, with negative zero as zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
