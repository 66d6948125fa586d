"""Joins back to rows of which one key owns most."""

import pytest
from pyspark.sql import functions as F

from claimgrid.operators import classify, invoice, relational
from claimgrid.plans.skewed import frequent_keys, join_back
from claimgrid.rules.ruleset import default_ruleset

TASKS = 16


@pytest.fixture
def plain_tasks(spark):
    """Partitions as the join asks for them, neither merged nor split nor broadcast away."""
    settings = {"spark.sql.shuffle.partitions": str(TASKS), "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def hot(spark, n=200_000):
    """Rows of which one key owns 80 %, another 5 %, and the rest have keys of their own."""
    key = F.when(F.col("id") % 100 < 80, -1).when(F.col("id") % 100 < 85, -2).otherwise(F.col("id"))
    return spark.range(n).select(key.alias("key"), F.col("id"))


def largest_over_mean(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) * TASKS / sum(sizes)


def test_no_task_reads_twice_the_mean(plain_tasks):
    big = hot(plain_tasks)
    small = big.groupBy("key").agg(F.count("*").alias("n"))
    assert largest_over_mean(big.join(small, "key")) > 8
    joined = join_back(big, small, ["key"])
    assert largest_over_mean(joined) <= 2
    assert joined.columns == ["key", "id", "n"] and joined.count() == 200_000
    assert joined.filter("n <> CASE key WHEN -1 THEN 160000 WHEN -2 THEN 10000 ELSE 1 END").count() == 0


def test_only_frequent_keys_are_salted(plain_tasks):
    found = frequent_keys(hot(plain_tasks), ["key"], TASKS).collect()
    assert sorted(r["_salts"] for r in found) == [7, 103]
    spread = hot(plain_tasks).filter("key >= 0")
    assert frequent_keys(spread, ["key"], TASKS).count() == 0
    assert frequent_keys(spread.filter("false"), ["key"], TASKS).count() == 0


def test_left_join_keeps_unmatched_and_null_keys(plain_tasks):
    big = hot(plain_tasks, 2000).withColumn("key", F.when(F.col("key") != -1, F.col("key")))
    small = plain_tasks.createDataFrame([(-2, "two")], "key long, name string")
    joined = join_back(big, small, ["key"], "left")
    assert joined.count() == 2000 and joined.filter("name = 'two'").count() == 100
    assert join_back(big, small, ["key"], "left_semi").count() == 100


def test_operators_spread_a_hot_key(plain_tasks):
    """One claim with 80 % of the items, one description with 80 %, one claim with 80 % of the documents."""
    rows = hot(plain_tasks, 40_000)
    items = rows.select(
        F.col("key").alias("claim_id"),
        F.col("id").alias("line_number"),
        F.when(F.col("key") == -1, "Carpet cleaning").otherwise(F.concat(F.lit("Item "), F.col("id").cast("string"))).alias("description"),
        F.lit(20000).cast("decimal(12,2)").alias("amount"),
    )
    rules = default_ruleset()
    assert largest_over_mean(classify.classify_items(items, rules)) <= 2
    assert largest_over_mean(classify.ab_pairs(items, rules, classify.relaxed_ruleset(rules))) <= 2
    assert largest_over_mean(invoice.suspicious_items(items, "claim_id")) <= 2
    repeated = invoice.duplicate_items(items, ["claim_id"], ["line_number"])
    assert repeated.count() == 31_999 and largest_over_mean(repeated) <= 2
    docs = rows.select(
        F.col("key").alias("claim_id"),
        F.col("id").alias("document_id"),
        F.lit("invoice.pdf").alias("original_filename"),
        F.lit("application/pdf").alias("mime_type"),
        F.lit(0).alias("created_at"),
    )
    kept = relational.select_relevant_documents(docs)
    assert kept.count() == 40_000
