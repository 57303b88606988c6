"""The corpus pipeline: toxic documents go, near copies are folded, benchmark passages go, sources are mixed, rows are sharded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the columns of
``documents``; a document that the mix takes twice stands there twice. Documents with null or empty texts pass the first three stages and have no words to
be mixed; rows with null ids take part by their texts; rows that repeat are folded by the second stage; further columns pass through; empty tables
give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planloom.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from planloom.llm.workspace import materialise


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't predict to be toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that is linked by a similarity of 0.8 of 5-word shingles: that of the smallest id."""
    return jaccard_join.keep_first(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of the sources with weights 1, 2, 3 takes them."""
    return mixing.take(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slots and shards."""
    return sharding.shard(docs, 64)


STAGES = [("toxicity", toxicity_stage), ("ngram_jaccard_join", jaccard_stage), ("decontamination", decontamination_stage), ("source_mixing", mixing_stage), ("sharding", sharding_stage)]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
