"""Service levels, error budgets, result reuse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.plans import ordered
from claimgrid.plans.skewed import join_back
from claimgrid.rules import fixed_values as fv
from claimgrid.session import cut_lineage


def _epoch(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def sla_metrics(metrics: DataFrame, window: int = fv.SLA_WINDOW) -> DataFrame:
    """Over the newest ``window`` records, per document type and overall ('ALL').

    The newest records per type come from a row-number limit that Spark applies on the map side,
    and the overall ones from a top-k; both leave at most ``window`` rows to rank.
    Percentiles are the value at index int(n * q), not interpolated.
    """
    cols = ["ts", "metric_id", "processing_time_ms"]
    newest = ordered.Window.partitionBy("document_type").orderBy(F.desc("ts"), F.desc("metric_id"))
    by_type = (
        metrics.filter(F.col("document_type").isNotNull())
        .select("document_type", *cols)
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= window)
        .drop("_rn")
    )
    overall = metrics.select(F.lit("ALL").alias("document_type"), *cols).orderBy(
        F.desc("ts"), F.desc("metric_id")
    ).limit(window)
    ranked = ordered.Window.partitionBy("document_type").orderBy("processing_time_ms", "metric_id")
    whole = ordered.Window.partitionBy("document_type")
    placed = by_type.unionByName(overall).withColumns(
        {"_i": F.row_number().over(ranked), "_n": F.count(F.lit(1)).over(whole)}
    )

    def at(q: float) -> Column:
        index = F.least(F.floor(F.col("_n") * F.lit(q)) + 1, F.col("_n"))
        return F.max(F.when(F.col("_i") == index, F.col("processing_time_ms")))

    targets = fv.SLA_TARGETS_MS
    slow = F.count_if(F.col("processing_time_ms") > targets["max"])
    total = F.count(F.lit(1))
    summary = placed.groupBy("document_type").agg(
        total.alias("total_count"),
        F.avg("processing_time_ms").alias("avg_time_ms"),
        at(0.95).alias("p95_time_ms"),
        at(0.99).alias("p99_time_ms"),
        F.max("processing_time_ms").alias("max_time_ms"),
        slow.alias("violation_count"),
        ((1 - slow / total) * 100).alias("compliance_percentage"),
    )
    checks = {
        "avg_ok": F.col("avg_time_ms") <= targets["avg"],
        "p95_ok": F.col("p95_time_ms") <= targets["p95"],
        "p99_ok": F.col("p99_time_ms") <= targets["p99"],
        "max_ok": F.col("max_time_ms") <= targets["max"],
    }
    passed = reduce(lambda a, b: a & b, checks.values())
    return summary.withColumns(
        {
            **checks,
            "compliant": passed,
            "alert": F.col("violation_count") / F.col("total_count") > fv.SLA_ALERT_RATE,
        }
    )


def error_budget(metrics: DataFrame, hours: int = fv.ERROR_BUDGET_HOURS) -> DataFrame:
    """Rolling low-confidence rate per tier at every event time.

    A record counts from its time until ``hours`` later, inclusive. It is written as +1 at its
    time and -1 right after its expiry, so the rolling count is a running sum; that sum runs in
    hourly chunks and a hot tier spreads over all its hours.
    """
    low = F.col("confidence") < fv.LOW_DOCUMENT_CONFIDENCE
    at_time = metrics.groupBy(F.substring("tier", 1, 5).alias("tier"), "ts").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(low).alias("low")
    )
    starts = at_time.select("tier", "ts", F.lit(0).alias("phase"), "n", "low")
    ends = at_time.select(
        "tier",
        (F.col("ts") + F.expr(f"INTERVAL {hours} HOUR")).alias("ts"),
        F.lit(1).alias("phase"),
        (-F.col("n")).alias("n"),
        (-F.col("low")).alias("low"),
    )
    events = starts.unionByName(ends).withColumn("_hour", F.date_trunc("hour", "ts"))
    rolled = ordered.running_sum(
        events, ["tier"], ["_hour"], ["ts", "phase"],
        {"total_documents": "n", "low_confidence_count": "low"},
    )
    rate = F.col("low_confidence_count") / F.col("total_documents")
    consumed = rate / fv.ERROR_BUDGET_RATE
    return (
        rolled.filter(F.col("phase") == 0)
        .withColumns({"error_rate": rate, "budget_consumed": consumed})
        .withColumns(
            {
                "budget_remaining": F.greatest(F.lit(0.0), 1 - F.col("budget_consumed")),
                "alert": F.col("budget_consumed") >= fv.ERROR_BUDGET_ALERT,
                "exhausted": F.col("budget_consumed") >= 1.0,
            }
        )
        .select(
            "tier", "ts", "total_documents", "low_confidence_count", "error_rate",
            "budget_consumed", "budget_remaining", "alert", "exhausted",
        )
    )


def chain_members(edges: DataFrame, key: str, at: str, after: str) -> tuple[DataFrame, int]:
    """(key, at) of all rows that the first of a key reaches along ``after``, and the rounds it took.

    Pointer doubling: a round adds what lies one jump from the rows reached so far and makes every
    jump twice as long, so rounds number the logarithm of the longest chain. Jumps past the end of a
    key drop out. Both sides of each join are plain exchanges, which AQE may split. ``edges`` is read
    more than once and should be stored.
    """
    reached = cut_lineage(edges.groupBy(key).agg(F.min(at).alias(at)))
    jumps = edges.filter(F.col(after).isNotNull()).select(key, at, after)
    rounds = 0
    while not jumps.isEmpty():
        rounds += 1
        added = reached.join(jumps, [key, at]).select(key, F.col(after).alias(at))
        reached = cut_lineage(reached.unionByName(added))
        onward = jumps.select(key, F.col(at).alias(after), F.col(after).alias("_onward"))
        jumps = cut_lineage(
            jumps.join(onward, [key, after]).select(key, at, F.col("_onward").alias(after))
        )
    return reached, rounds


def reuse_windows(
    arrivals: DataFrame, key: str = "file_hash", days: float = fv.REUSE_TTL_DAYS
) -> DataFrame:
    """Add ``anchor_ts`` and ``is_new``: an arrival reuses a result up to ``days`` after the
    anchor that made it, and the first arrival later becomes the next anchor.

    Every time of a key points at the first one past its window; the anchors are what the key's
    first time reaches. Of arrivals at one time the least ``arrival_id`` is the new one. Arrivals
    without key or time are left out.
    """
    micros = int(days * 86_400_000_000)
    timed = arrivals.withColumn("_t", _epoch("ts"))
    times = (
        timed.filter(F.col(key).isNotNull() & F.col("_t").isNotNull())
        .groupBy(key, "_t")
        .agg(F.min("arrival_id").alias("_first"))
    )
    times = cut_lineage(times)
    edges = cut_lineage(ordered.next_beyond(times.select(key, "_t"), key, "_t", micros, "_next"))
    anchors, _ = chain_members(edges, key, "_t", "_next")
    marked = times.join(anchors.withColumn("_anchor", F.lit(True)), [key, "_t"], "left")
    placed = ordered.last_marked(marked, key, "_t", "_anchor", micros // 64, "_at")
    known = placed.select(
        key, "_t", F.timestamp_micros("_at").cast(arrivals.schema["ts"].dataType).alias("anchor_ts"),
        F.when(F.col("_anchor"), F.col("_first")).alias("_new"),
    )
    return (
        join_back(timed, known, [key, "_t"])
        .withColumn("is_new", F.coalesce(F.col("arrival_id") == F.col("_new"), F.lit(False)))
        .drop("_t", "_new")
    )
