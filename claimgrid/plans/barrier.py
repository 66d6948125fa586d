"""Keeping costly expressions single and parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that one task of a sized join takes.
ROWS = 1_000_000


def computed_once(df: DataFrame, computed: Sequence[str]) -> DataFrame:
    """Put a generator between costly columns and whatever follows.

    A later filter on such a column would otherwise be pushed below the projections that build it,
    which repeats their expressions. Filters on the other columns still reach the scan.
    """
    kept = [c for c in df.columns if c not in set(computed)]
    return df.select(*kept, F.inline(F.array(F.struct(*computed))))


def tasks_for(*tables: DataFrame) -> int:
    """How many tasks take at most about ``ROWS`` rows of the tables each; a task for every core at least.

    Shuffles that are sized by their bytes are compressed: keys that follow one another shrink so far
    that a task of few bytes sorts and hashes many rows.
    """
    rows = sum(df.count() for df in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))


def spread(df: DataFrame, waves: int = 1) -> DataFrame:
    """Use all cores for CPU-bound text work on an input of few splits, in ``waves`` tasks each.

    Takes a plain scan or projection. A large input has more splits than that and passes through
    untouched, so nothing is shuffled at scale.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism * waves
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
