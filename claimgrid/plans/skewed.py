"""Joining per-key results back to the rows they came from when one key may own most rows.

AQE cannot help here: the small side comes out of an aggregate on the join key, so its partitioning
is reused as it is and no partition of the join may be split. Instead the frequent keys are found
with a sketch of fixed size, their rows on the big side get one of several salts, and their one row
on the small side is repeated for every salt. All other keys have the single salt 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that the sketch tells, and counters it holds: it misses no key above 1 / COUNTERS of all rows.
KEYS, COUNTERS = 1024, 16_384
#: Pieces that one task's fair share of a frequent key is cut into, so that hashing evens them out.
PIECES = 8


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def frequent_keys(big: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """(_hash, _salts) of the keys with more rows than half a task's fair share; KEYS rows at most.

    The sketch is an aggregate of bounded size that every task fills and Spark merges.
    """
    sketch = F.call_function("approx_top_k", _hash(keys), F.lit(KEYS), F.lit(COUNTERS))
    counted = big.agg(sketch.alias("top"), F.count(F.lit(1)).alias("rows"))
    share = F.col("k.count") * tasks / F.col("rows")
    return (
        counted.select("rows", F.explode("top").alias("k"))
        .filter(share > 0.5)
        .select(F.col("k.item").alias("_hash"), F.ceil(share * PIECES).cast("int").alias("_salts"))
    )


def join_back(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """``big`` joined with one row per key of ``small``, no key in one task.

    ``spread`` names columns of ``big`` that tell the rows of a key apart (all by default). Salts
    depend on the row alone, so a task that runs again deals its rows out as before. Rows that
    agree in all those columns stay together. The broadcast holds KEYS rows at most. ``small`` has
    one row per key; ``how`` is inner, left or left_semi.
    """
    spark = big.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = F.broadcast(frequent_keys(big, keys, tasks))
    dealt = F.pmod(F.xxhash64(F.lit(1), *(spread or big.columns)), F.col("_salts"))

    def known(df: DataFrame) -> DataFrame:
        return df.withColumn("_hash", _hash(keys)).join(frequent, "_hash", "left").drop("_hash")

    salted = known(big).withColumn("_salt", F.coalesce(dealt, F.lit(0)).cast("int")).drop("_salts")
    all_salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    repeated = known(small).withColumn("_salt", F.explode(all_salts)).drop("_salts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


__all__ = ["frequent_keys", "join_back"]
