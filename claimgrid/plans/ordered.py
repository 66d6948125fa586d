"""Ordered per-key computation that survives hot keys.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here every key is cut
into *chunks*: deterministic buckets of the leading order columns (a day of a timestamp, a line
number). The window runs inside ``(key, chunk)``; one small summary row per chunk, built with
map-side combine, carries state from chunk to chunk and is joined back on ``(key, chunk)``. The big
side is shuffled once, because the window and the join ask for the same partitioning.

``chunk`` columns must be a non-decreasing function of the order columns. ``cut_by_quantiles`` makes
one from the data: a burst of one key is cut as finely as its rows are many, and a key has at most
PIECES + 2 summary rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

#: Chunks that the rows of a table are cut into, whatever their number.
PIECES = 1024
#: Rank error of the cuts, as a share of all rows, is one by this.
ACCURACY = 4_096


def _place(df: DataFrame, column: str) -> Column:
    """A double that never falls as the column rises, in any session time zone."""
    at, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, TimestampNTZType):
        clock = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
        return (F.unix_date(F.to_date(at)).cast("long") * 86_400 + clock).cast("double")
    if isinstance(kind, TimestampType):
        return F.unix_micros(at).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(at).cast("double")
    return at.cast("double")


def cut_by_quantiles(df: DataFrame, column: str, out: str = "_chunk", pieces: int = PIECES) -> DataFrame:
    """Add ``out``: which of about ``pieces`` ranges of ``column``, of near equal rows, holds the row.

    The cuts are approximate quantiles over the whole table: a sketch of fixed size, merged by Spark,
    of which the driver gets ``pieces`` numbers. A range that one value fills is not cut. Nulls come
    first, as range -1.
    """
    place = _place(df, column)
    shares = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(place, shares, ACCURACY)).head()[0] or []
    cuts = sorted({c for c in found if math.isfinite(c)})
    if not cuts:
        return df.withColumn(out, F.when(place.isNull(), -1).otherwise(0))
    ranges = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol="_place", outputCol="_range", handleInvalid="keep"
    )
    cut = ranges.transform(df.withColumn("_place", place))
    return cut.withColumn(
        out, F.when(F.col("_place").isNull(), -1).otherwise(F.col("_range").cast("int"))
    ).drop("_place", "_range")


def _on(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right["_c_" + name])
    return condition


def _join_carry(df: DataFrame, carry: DataFrame, names: Sequence[str]) -> DataFrame:
    renamed = carry
    for name in names:
        renamed = renamed.withColumnRenamed(name, "_c_" + name)
    joined = df.join(renamed, _on(df, renamed, names), "left")
    return joined.drop(*["_c_" + name for name in names])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, str],
) -> DataFrame:
    """Add ``out = sum(in)`` over all rows up to and including the current one, per key."""
    names = [*keys, *chunk]
    inside = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = (
        Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = df.groupBy(*names).agg(*[F.sum(c).alias("_t_" + out) for out, c in sums.items()])
    carry = totals.select(
        *names, *[F.sum("_t_" + out).over(before).alias("_b_" + out) for out in sums]
    )
    local = df.withColumns({"_l_" + out: F.sum(c).over(inside) for out, c in sums.items()})
    joined = _join_carry(local, carry, names)
    return joined.withColumns(
        {out: F.col("_l_" + out) + F.coalesce(F.col("_b_" + out), F.lit(0)) for out in sums}
    ).drop(*["_l_" + out for out in sums], *["_b_" + out for out in sums])


def row_number(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[str | Column],
    out: str = "line_no",
) -> DataFrame:
    """``row_number()`` per key, as an in-chunk number plus the sizes of the earlier chunks."""
    names = [*keys, *chunk]
    inside = Window.partitionBy(*names).orderBy(*order)
    before = (
        Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_size"))
    carry = sizes.select(*names, F.sum("_size").over(before).alias("_before"))
    local = df.withColumn("_local", F.row_number().over(inside))
    return (
        _join_carry(local, carry, names)
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_local", "_before")
    )


def shift(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[str],
    cols: dict[str, str],
    forward: bool,
) -> DataFrame:
    """``lead`` (forward) or ``lag`` of columns per key, carried across chunk borders.

    ``order`` names plain ascending columns that are unique inside a key.
    """
    names = [*keys, *chunk]
    inside = Window.partitionBy(*names).orderBy(*order)
    step = F.lead if forward else F.lag
    pick = F.min_by if forward else F.max_by
    payload = F.struct(*[F.col(src).alias(out) for out, src in cols.items()])
    edges = df.groupBy(*names).agg(pick(payload, F.struct(*order)).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy(*chunk)
    carry = edges.select(*names, step("_edge").over(across).alias("_far"))
    local = df.withColumn("_near", step(payload).over(inside))
    joined = _join_carry(local, carry, names)
    return joined.withColumns(
        {
            out: F.when(F.col("_near").isNotNull(), F.col("_near." + out)).otherwise(
                F.col("_far." + out)
            )
            for out in cols
        }
    ).drop("_near", "_far")


def next_beyond(times: DataFrame, key: str, at: str, distance: int, out: str, pieces: int = 64) -> DataFrame:
    """Add ``out``: the least ``at`` of the key that lies more than ``distance`` after the row's own.

    ``at`` is a long. A key is cut into chunks of a ``pieces``-th of the distance, so a burst of one
    key spreads; the first value of each chunk, one row, carries across.
    """
    chunk = F.floor(F.col("_pos") / F.lit(max(1, distance // pieces)))
    asked = times.withColumns({"_pos": F.col(at) + distance, "_asks": F.lit(1)})
    both = asked.unionByName(times.withColumns({"_pos": F.col(at), "_asks": F.lit(0)})).withColumn("_chunk", chunk)
    value = F.when(F.col("_asks") == 0, F.col("_pos"))
    # Downwards, a question before a value at its own place: what came so far lies beyond it.
    inside = Window.partitionBy(key, "_chunk").orderBy(F.desc("_pos"), F.desc("_asks"))
    later = Window.partitionBy(key).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy(key, "_chunk").agg(F.min(value).alias("_least"))
    carry = firsts.select(key, "_chunk", F.min("_least").over(later).alias("_far"))
    near = F.min(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    answered = _join_carry(both.withColumn("_near", near).filter("_asks = 1"), carry, [key, "_chunk"])
    return answered.withColumn(out, F.coalesce("_near", "_far")).select(*times.columns, out)


def last_marked(times: DataFrame, key: str, at: str, marked: str, width: int, out: str) -> DataFrame:
    """Add ``out``: the greatest ``at`` of the key with ``marked``, up to and including the row's own.

    ``at`` is a long, distinct in a key; chunks are ``width`` wide.
    """
    rows = times.withColumn("_chunk", F.floor(F.col(at) / F.lit(max(1, width))))
    value = F.when(F.col(marked), F.col(at))
    inside = Window.partitionBy(key, "_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    lasts = rows.groupBy(key, "_chunk").agg(F.max(value).alias("_most"))
    carry = lasts.select(key, "_chunk", F.max("_most").over(before).alias("_far"))
    joined = _join_carry(rows.withColumn("_near", F.max(value).over(inside)), carry, [key, "_chunk"])
    return joined.withColumn(out, F.coalesce("_near", "_far")).select(*times.columns, out)


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The row with the greatest ``order`` tuple per key.

    Spark's window group limit keeps one row per key and map task before the shuffle, so a hot key
    costs one row per task. Nulls in the order columns sort lowest.
    """
    return _first(df, keys, [F.desc_nulls_last(c) for c in order])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` tuple per key, cut before the shuffle as above."""
    return _first(df, keys, [F.asc_nulls_first(c) for c in order])


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


__all__ = [
    "Window", "cut_by_quantiles", "first_per_key", "last_marked", "latest_per_key", "next_beyond", "row_number", "running_sum", "shift",
]
