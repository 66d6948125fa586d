"""Greedy fit of priced groups under a cap: in order, take what still fits, skip what does not.

Rows with the same claim, confidence and amount are interchangeable, so they are first combined
(on the map side) into one group with a count. Claims with few groups are folded in one array.
Claims with many groups go through *phases*: in each phase every group of at most half the
remaining room is taken for sure until the first event - the room falls below half, or a larger
group fits. One phase is a distributed running sum, and the room at least halves per phase, so
the number of phases grows with the logarithm of the cap, not with the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.plans import ordered
from claimgrid.session import cut_lineage, written_once

GROUP = ["claim_id", "confidence", "cents"]


def _take(count: Column, room: Column, cents: Column) -> Column:
    fits = F.greatest(F.floor(room / F.when(cents > 0, cents)), F.lit(0)).cast("bigint")
    return F.when(cents <= 0, count).otherwise(F.least(count, fits))


def _fold(groups: DataFrame) -> DataFrame:
    """groups(claim_id, confidence, cents, n, cap) -> one row per group with ``kept``."""
    listed = groups.groupBy("claim_id", "cap").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("confidence")).alias("c"), (-F.col("cents")).alias("a"), "n"
                )
            )
        ).alias("g")
    )
    start = F.struct(
        F.col("cap").alias("room"),
        F.array().cast("array<struct<c:double,a:bigint,n:bigint,kept:bigint>>").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        kept = _take(x["n"], acc["room"], -x["a"])
        return F.struct(
            (acc["room"] + kept * x["a"]).alias("room"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        x["c"].alias("c"), x["a"].alias("a"), x["n"].alias("n"), kept.alias("kept")
                    )
                ),
            ).alias("out"),
        )

    return listed.select(
        "claim_id", F.explode(F.reduce("g", start, step, lambda acc: acc["out"])).alias("x")
    ).select(
        "claim_id",
        (-F.col("x.c")).alias("confidence"),
        (-F.col("x.a")).alias("cents"),
        F.col("x.n").alias("n"),
        F.col("x.kept").alias("kept"),
    )


def _phases(groups: DataFrame, partitions: int, max_phases: int = 10_000) -> DataFrame:
    keyed = groups.withColumns({"_c": -F.col("confidence"), "_a": -F.col("cents")})
    # contiguous ranges of (claim, order): a claim of any size spreads over many partitions
    ranged = cut_lineage(
        keyed.repartitionByRange(partitions, "claim_id", "_c", "_a").withColumn(
            "_chunk", F.spark_partition_id()
        )
    )
    state = cut_lineage(
        ranged.groupBy("claim_id").agg(
            F.first("cap").alias("room"), F.lit(None).cast("struct<c:double,a:bigint>").alias("at")
        )
    )
    done: list[DataFrame] = []
    position = F.struct(F.col("_c").alias("c"), F.col("_a").alias("a"))
    for _ in range(max_phases):
        if state.isEmpty():
            break
        open_rows = ranged.drop("cap").join(state, "claim_id").filter(
            F.col("at").isNull() | (position > F.col("at"))
        )
        small = F.col("cents") * 2 <= F.greatest(F.col("room"), F.lit(0))
        weighted = open_rows.withColumn("_small", small | (F.col("cents") <= 0)).withColumn(
            "_w", F.when(F.col("_small"), F.col("cents") * F.col("n")).otherwise(F.lit(0))
        )
        summed = ordered.running_sum(
            weighted, ["claim_id"], ["_chunk"], ["_c", "_a"], {"_sum": "_w"}
        ).withColumn("_before", F.col("room") - F.col("_sum") + F.col("_w"))
        event = (F.col("_small") & ((F.col("room") - F.col("_sum")) * 2 < F.col("room"))) | (
            ~F.col("_small") & (F.col("cents") <= F.col("_before"))
        )
        marked = cut_lineage(
            summed.withColumn("_event", event).withColumn(
                "_fit", _take(F.col("n"), F.col("_before"), F.col("cents"))
            )
        )
        first = marked.filter("_event").groupBy("claim_id").agg(
            F.min(position).alias("_stop"),
            F.min_by(F.col("_before") - F.col("_fit") * F.col("cents"), position).alias("_left"),
        )
        joined = marked.join(first, "claim_id", "left")
        before = F.col("_stop").isNull() | (position < F.col("_stop"))
        done.append(
            joined.filter(before | (position == F.col("_stop"))).select(
                *GROUP,
                "n",
                F.when(before, F.when(F.col("_small"), F.col("n")).otherwise(F.lit(0)))
                .otherwise(F.col("_fit"))
                .cast("bigint")
                .alias("kept"),
            )
        )
        state = cut_lineage(
            first.select("claim_id", F.col("_left").alias("room"), F.col("_stop").alias("at"))
        )
    else:
        raise RuntimeError("greedy fit did not settle")
    return reduce(DataFrame.unionByName, done)


def greedy_fit(
    rows: DataFrame, caps: DataFrame, order: list[str], fold_limit: int = 1000, partitions: int | None = None
) -> DataFrame:
    """Add ``kept`` to rows(claim_id, confidence, amount, order...) under caps(claim_id, cap_amount).

    Claims whose total fits keep everything and skip the fit. The phases are as wide as the
    session's shuffle partitions unless ``partitions`` says otherwise.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    priced = rows.withColumn("cents", (F.col("amount") * 100).cast("bigint"))
    limits = caps.select("claim_id", (F.col("cap_amount") * 100).cast("bigint").alias("cap"))
    totals = priced.groupBy("claim_id").agg(F.sum("cents").alias("_total"))
    over = totals.join(limits, "claim_id").filter(F.col("_total") > F.col("cap"))
    groups = cut_lineage(
        priced.join(over.select("claim_id", "cap"), "claim_id")
        .groupBy(*GROUP)
        .agg(F.count(F.lit(1)).alias("n"), F.first("cap").alias("cap"))
    )
    sizes = groups.groupBy("claim_id").agg(F.count(F.lit(1)).alias("_groups"))
    large = sizes.filter(F.col("_groups") > fold_limit).select("claim_id")
    fitted = _fold(groups.join(large, "claim_id", "left_anti"))
    if not large.isEmpty():
        fitted = fitted.unionByName(
            _phases(groups.join(large, "claim_id", "left_semi"), partitions)
        )
    fitted = written_once(fitted)
    placed = priced.join(fitted, GROUP, "left")
    split = (F.col("kept") > 0) & (F.col("kept") < F.col("n"))
    # only groups that are taken in part need a rank among equals
    whole = placed.filter(~F.coalesce(split, F.lit(False))).withColumn(
        "kept", F.col("kept").isNull() | (F.col("kept") > 0)
    )
    part = placed.filter(split)
    ranked = ordered.row_number(part, GROUP, [order[0]], order, "_rank").withColumn(
        "kept", F.col("_rank") <= F.col("kept")
    )
    return whole.unionByName(ranked.drop("_rank")).drop("cents", "n")
