"""The corpus pipeline: documents in, sharded training mix out.

Every stage is written as Parquet in the shared folder and read again as the next one's input. All
but the last keep the columns of ``documents``; each works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimgrid.llm import decontaminate, mixing, prefix_join, sharding, toxic_gru
from claimgrid.llm.common import importable, stored

#: Near copies in the pipeline: shingles of this many words, similar to this percentage.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject."""
    return toxic_gru.non_toxic(docs, importable(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id."""
    importable(spark)
    return prefix_join.one_of_each(docs, NEAR_PERCENT, NEAR_SHINGLE)


def leak_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item covers."""
    return decontaminate.decontaminated(docs, importable(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights: every document as often as its source's budget takes it."""
    importable(spark)
    return mixing.mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and position of every document of the mix."""
    importable(spark)
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", civil),
    ("n-gram Jaccard join", distinct_enough),
    ("benchmark decontamination", leak_free),
    ("mixing to target weights", weighted),
    ("sharding", sharded),
]

#: A trained network and a seeded subset are no SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
