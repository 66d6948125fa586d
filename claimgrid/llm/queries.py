"""Registered queries of the subpackage: thin calls with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimgrid.llm import (
    block_repeats,
    byte_cnn,
    conversation_repair,
    decontaminate,
    extract,
    feast_whitening,
    line_rules,
    mixing,
    prefix_join,
    sharding,
    suffix_dedup,
    toxic_gru,
    url_model,
)
from claimgrid.llm.common import importable
from claimgrid.llm.twins import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.rated(_table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated_pairs(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_byte_cnn(spark: SparkSession, folder: str) -> DataFrame:
    return byte_cnn.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_template_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract_main_text(_table(spark, folder, "pages"))


def op5_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, folder, "documents"))


def op6_attention_gru(spark: SparkSession, folder: str) -> DataFrame:
    return toxic_gru.toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_budget_fitting(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def op8_markov_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return url_model.judged(_table(spark, folder, "pages")).drop("score")


def op9_grouped_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_join.jaccard_components(_table(spark, folder, "documents"))


def op10_two_stage_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.without_repeats(_table(spark, folder, "documents"))


def op11_block_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return block_repeats.without_earlier(_table(spark, folder, "documents"))


def op12_suffix_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repaired(_table(spark, folder, "conversations"))


def op13_feast_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return feast_whitening.whitened(_table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_frequency,
        op2_decontamination,
        op3_byte_cnn,
        op4_template_extraction,
        op5_virtual_slots,
        op6_attention_gru,
        op7_budget_fitting,
        op8_markov_ratio,
        op9_grouped_prefix_join,
        op10_two_stage_suffixes,
        op11_block_anchors,
        op12_suffix_automaton,
        op13_feast_whitening,
    )
}
