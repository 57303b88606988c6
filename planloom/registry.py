"""All queries of the library but those of its text subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import aggregates, checks, documents, findings, pictures, plan, projections, results  # noqa: F401  each registers its queries
from .plans.bind import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["scene_rooms"](spark, sf_dir)
