"""CSV files with quoted line feeds, each read by many tasks.

Spark's own reader takes a file with line feeds inside cells whole into one task. Here a file is read
as lines, split anywhere. A line begins a record where the number of quotes before it in its file is
even; the quotes of each split, one summary row, carry that parity across. Records are then put
together from their lines and parsed one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrid.plans import ordered
from claimgrid.plans.barrier import computed_once

OPTIONS = {"escape": '"'}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _at, value): lines by file and split; ``_at`` rises inside a split."""
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_at"),
            "value",
        )
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _record, value): the records of every file, numbered from 1, without blank lines.

    Line feeds and CR LF end lines; inside a cell both read as a line feed.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    counted = lines(spark, path).withColumn("_quotes", quotes.cast("long"))
    summed = ordered.running_sum(counted, ["_file"], ["_block"], ["_at"], {"_seen": "_quotes"})
    begins = (F.col("_seen") - F.col("_quotes")) % 2 == 0
    marked = summed.withColumn("_begins", begins.cast("long")).filter(~begins | (F.trim(F.rtrim("value", F.lit("\r"))) != ""))
    numbered = ordered.running_sum(marked, ["_file"], ["_block"], ["_at"], {"_record": "_begins"})
    joined = numbered.groupBy("_file", "_record").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))), lambda x: x["value"]), "\n"
        ).alias("value")
    )
    return joined.withColumn("value", F.regexp_replace("value", r"\r(?=\n|\z)", ""))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Header-named text columns of one file or folder, as the header of its first file has them.

    The first record of every file is its header. Quotes inside a cell are doubled and the cell is
    quoted; a lone quote in a bare cell would join records, here as under any quote count.
    """
    header = spark.read.options(header=True, multiLine=True, **OPTIONS).csv(path).columns
    if not header:
        return spark.createDataFrame([], "")
    names = ", ".join(f"`{name.replace('`', '``')}` string" for name in header)
    body = records(spark, path).filter("_record > 1")
    parsed = body.select(F.from_csv("value", names, OPTIONS).alias("_row"))
    return computed_once(parsed, ["_row"]).select("_row.*")
