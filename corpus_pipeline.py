"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Stages treat a repeated doc_id row by row, save near-duplicates, where rows of
one doc_id and text are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mapquarry.llm import common, decontam, mixing, quality, shard_tree, simhash

#: SQL can't express fingerprints, matching by edits or the estimate of the rules' accuracies.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return common.unpacked(quality.quality(docs, docs.columns).where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component stays (the first row of it)."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with their cell's calibrated probability stay."""
    return common.unpacked(mixing.mix(docs, docs.columns).where("selected"), docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return shard_tree.shard(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; what is between them lies in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
