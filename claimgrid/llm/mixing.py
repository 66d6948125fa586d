"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a share of all words by weight, at most ``max_repeats`` times its own words.
Whole repeats of a source cover the larger part of its target; the remaining budget is met by a
subset of its documents. That subset is chosen on the histogram of exact lengths: a proportional
share of every length first, then bounded-knapsack dynamic programming over the lengths left for
the last few thousand words. Which documents of a length are meant is settled by a seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimgrid.llm.common import stored, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 17
#: Words that the proportional share leaves to the dynamic programme.
RESERVE = 16_384
#: Seeded sub-groups of the documents of one source and length; only one of them is ranked.
N_SUBGROUPS = 256


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight in code point order, null last,
    capped at ``max_repeats`` times the source, the excess reshared by weight until none is above.

    Sorted by cap over weight, capped sources come first; the first source whose cap allows the
    share per unit of weight that is left fixes that share for it and all after it. Only one row
    per source takes part.
    """
    everyone = Window.partitionBy()
    ranked = sources.withColumn(
        "__i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), F.pmod("__i", F.lit(len(weights))).cast("int") + 1))
    cap = F.lit(float(max_repeats)) * F.col("source_size")
    by_ratio = Window.orderBy("__ratio", "__i")
    before, after = (
        by_ratio.rowsBetween(Window.unboundedPreceding, -1),
        by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing),
    )
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum(
        "__w"
    ).over(after)
    return (
        ranked.withColumn("__cap", cap)
        .withColumn("__ratio", F.col("__cap") / F.col("__w"))
        .withColumn("__level", level)
        .withColumn("__share", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__i", "__level"))).over(everyone))
        .withColumn("target", F.least("__cap", F.coalesce(F.col("__share.__level") * F.col("__w"), F.col("__cap"))))
        .select("source", "source_size", "target")
    )


def subset_sum(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """Bounded knapsack: how many of each length to take so that the total is as near ``budget``
    as any subset comes (from below, or by less than the shortest length from above).

    Sets of reachable totals are the bits of an integer; counts are split into powers of two.
    """
    if budget <= 0 or not lengths:
        return {}
    most = budget + min(lengths)
    mask = (1 << (most + 1)) - 1
    reach, steps = 1, []
    for length, count in zip(lengths, counts, strict=True):
        part = 1
        while count > 0 and not reach >> budget & 1:
            part = min(part, count)
            wider = reach | (reach << length * part & mask if length * part <= most else 0)
            if wider != reach:
                steps.append((length, part, reach))
                reach = wider
            count -= part
            part *= 2
        if reach >> budget & 1:
            break
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    total = below
    if above:
        first = budget + (above & -above).bit_length()
        if first - budget < budget - below:
            total = first
    taken: dict[int, int] = {}
    for length, part, had in reversed(steps):
        if not had >> total & 1:
            total -= length * part
            taken[length] = taken.get(length, 0) + part
    return taken


def fitted(lengths: np.ndarray, counts: np.ndarray, target: float, seed: int, max_repeats: int = MAX_REPEATS):
    """(whole repeats, documents of each length that are taken once more) for one source."""
    total = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), np.int64)
    if total == 0:
        return 0, extra
    repeats = min(int(target // total), max_repeats)
    budget = int(round(target)) - repeats * total
    if repeats >= max_repeats or budget <= 0:
        return repeats, extra
    draw = np.random.Generator(np.random.PCG64(seed)).random(len(lengths))
    usable = lengths > 0
    extra = np.where(usable, np.minimum(counts, np.floor(counts * (max(0, budget - RESERVE) / total) + draw * (budget > RESERVE))), 0).astype(np.int64)
    order = [int(i) for i in np.argsort(draw, kind="stable") if usable[i]]
    rest = budget - int((lengths * extra).sum())
    for i in order:  # rounding took too much: give single lengths back
        if rest >= 0:
            break
        back = min(int(extra[i]), -(rest // int(lengths[i])))
        extra[i] -= back
        rest += back * int(lengths[i])
    for i in order:  # or too little: fill up to the reserve
        more = min(int(counts[i] - extra[i]), max(0, rest - RESERVE) // int(lengths[i]))
        extra[i] += more
        rest -= more * int(lengths[i])
    left = [i for i in order if counts[i] > extra[i]]
    found = subset_sum([int(lengths[i]) for i in left], [int(counts[i] - extra[i]) for i in left], rest)
    for i in left:
        extra[i] += found.get(int(lengths[i]), 0)
    return repeats, extra


def _fit_source(seed: int, max_repeats: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        repeats, extra = fitted(
            rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), float(rows["target"].iloc[0]), seed, max_repeats
        )
        return rows[["source", "size", "source_size", "target"]].assign(repeats=repeats, extra=extra)

    return fit


def _source_key(source: Column) -> Column:
    """Null-safe key of a source: nulls cannot meet in an equi-join."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds source key, size in words, seeded order and sub-group to every row."""
    rows = docs.withColumns(
        {
            "__src": _source_key(F.col("source")),
            "__size": word_count(F.col("text")),
            "__order": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")),
        }
    )
    return rows.withColumn("__sub", F.pmod(F.shiftrightunsigned("__order", 40), F.lit(N_SUBGROUPS)).cast("int"))


def _quotas(rows: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: int) -> DataFrame:
    """(__src, __size, __sub, source_size, target, repeats, __quota): what each sub-group gives."""
    subgroups = stored(rows.groupBy("__src", "source", "__size", "__sub").agg(F.count("*").alias("n")))
    lengths = subgroups.groupBy("__src", "source", F.col("__size").alias("size")).agg(F.sum("n").alias("n"))
    sums = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = stored(targets(sums, weights, max_repeats)).withColumn("__src", _source_key(F.col("source"))).drop("source")
    # One group per source: its distinct lengths, of which n words can hold no more than sqrt(2 n).
    picks = stored(
        lengths.join(goals, "__src")
        .groupBy("__src")
        .applyInPandas(
            _fit_source(seed, max_repeats),
            "source string, size long, source_size long, target double, repeats long, extra long",
        )
    )
    picks = picks.select(_source_key(F.col("source")).alias("__src"), F.col("size").alias("__size"), "source_size", "target", "repeats", "extra")
    upto = Window.partitionBy("__src", "__size").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    return stored(
        subgroups.drop("source")
        .withColumn("__before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        .join(picks, ["__src", "__size"])
        .withColumn("__quota", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("__before"))))
        .select("__src", "__size", "__sub", *(F.col(c).alias(f"__{c}") for c in ("source_size", "target", "repeats")), "__quota")
    )


def _decided(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """Rows with ``__times``: how often each is taken."""
    inside = Window.partitionBy("__src", "__size", "__sub").orderBy("__order", "doc_id")
    return (
        rows.join(quotas, ["__src", "__size", "__sub"])
        .withColumn("__rank", F.row_number().over(inside))
        .withColumn("__times", F.col("__repeats") + F.when(F.col("__rank") <= F.col("__quota"), 1).otherwise(0))
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """Every row of ``docs`` with size (words; 0 for null), source_size, target and taken.

    Null sources form one source, placed last. Documents without words take nothing. Repeated
    rows are ranked like any others, so each has a decision of its own. An empty table gives no
    rows. Reruns agree: the order inside a length depends on seed, id and text only.
    """
    rows = stored(_keyed(docs.select("doc_id", "source", "text"), seed).drop("text"))
    return _decided(rows, _quotas(rows, weights, max_repeats, seed)).select(
        "doc_id",
        "source",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__times")).alias("taken"),
    )


def mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken.

    Same decisions as :func:`mix`; documents without words are not in the mix.
    """
    rows = _keyed(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("__row")), seed)
    slim = stored(rows.select("__src", "source", "__size", "__sub"))
    taken = _decided(rows, _quotas(slim, weights, max_repeats, seed)).where("__times > 0 AND __size > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")
