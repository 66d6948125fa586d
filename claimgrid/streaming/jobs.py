"""Streams: result reuse, service levels, error budgets, batch progress, adjudication.

Event times must be zoned timestamps; a watermark on timestamp_ntz is rejected by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from claimgrid.operators import decide
from claimgrid.plans import ordered
from claimgrid.rules import fixed_values as fv
from claimgrid.streaming.store import BUCKETS, BucketedStore, hash_bucket

#: The state store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, folder: str, file_glob: str, schema) -> DataFrame:
    """File stream over matching files; ``ts`` becomes a zoned timestamp."""
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)
    )
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def unique_arrivals(
    stream: DataFrame, key: str = "file_hash", ttl: str = f"{fv.REUSE_TTL_DAYS} days"
) -> DataFrame:
    """First arrival per content hash; state per hash expires with the watermark."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


def value_counts(
    stream: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """How often each processing time stands in each window and document type.

    Counts of values merge exactly, whatever the batches, so percentiles taken from them are exact.
    The state holds the values of windows that the watermark has not closed.
    """
    time = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = (
        stream.withWatermark("ts", delay)
        .groupBy(time.alias("w"), "document_type", "processing_time_ms")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select("w.start", "w.end", "document_type", "processing_time_ms", "n")


def sla_levels(counts: DataFrame) -> DataFrame:
    """Service levels per window and document type from counts of values.

    The 95th percentile is the value at index int(n * 0.95) of the sorted values, as in the batch form.
    """
    group = ["start", "end", "document_type"]
    upto = (
        ordered.Window.partitionBy(*group).orderBy("processing_time_ms")
        .rowsBetween(ordered.Window.unboundedPreceding, 0)
    )
    whole = ordered.Window.partitionBy(*group)
    value, n = F.col("processing_time_ms"), F.col("n")
    placed = counts.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(whole)})
    index = F.least(F.floor(F.col("_all") * F.lit(0.95)) + 1, F.col("_all"))
    return placed.groupBy(*group).agg(
        F.sum("n").alias("documents"),
        (F.sum(value * n) / F.sum(F.when(value.isNotNull(), n))).alias("avg_time_ms"),
        F.max(value).alias("max_time_ms"),
        F.min(F.when(F.col("_upto") >= index, value)).alias("p95_time_ms"),
        F.sum(F.when(value > fv.SLA_TARGETS_MS["max"], n).otherwise(0)).alias("violations"),
    )


def run_sla_windows(
    stream: DataFrame, store: str, checkpoint: str, width: str = "1 hour", slide: str | None = None,
    delay: str = "10 minutes",
) -> StreamRun:
    """Service levels of all windows, open ones included, as far as the stream has come.

    Every batch puts the counts it changed into a store cut by window; the newest count of a value
    replaces the older ones.
    """
    return _run_windows(
        value_counts(stream, width, slide, delay), store, checkpoint,
        ["start", "end", "document_type", "processing_time_ms"], sla_levels,
    )


def budget_counts(
    stream: DataFrame, width: str = "24 hours", slide: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Documents and those of low confidence per tier and sliding window."""
    low = F.col("confidence") < fv.LOW_DOCUMENT_CONFIDENCE
    counted = (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, slide).alias("w"), F.substring("tier", 1, 5).alias("tier"))
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if(low).alias("low_confidence"))
    )
    return counted.select("w.start", "w.end", "tier", "documents", "low_confidence")


def error_budgets(counts: DataFrame) -> DataFrame:
    consumed = F.col("low_confidence") / F.col("documents") / fv.ERROR_BUDGET_RATE
    return counts.withColumns(
        {
            "budget_consumed": consumed,
            "alert": consumed >= fv.ERROR_BUDGET_ALERT,
            "exhausted": consumed >= 1.0,
        }
    )


def run_error_budgets(stream: DataFrame, store: str, checkpoint: str, delay: str = "10 minutes") -> StreamRun:
    """Error budget per tier over sliding windows, open ones included."""
    counts = budget_counts(stream, delay=delay)
    return _run_windows(counts, store, checkpoint, ["start", "end", "tier"], error_budgets)


def _run_windows(counts: DataFrame, store: str, checkpoint: str, keys: list[str], rate) -> StreamRun:
    table = BucketedStore(counts.sparkSession, store, counts.schema, hash_bucket("start", "end"))
    writer = counts.writeStream.outputMode("update").foreachBatch(table.write)
    return _finish(writer, checkpoint).of(rate(table.current(keys)))


STATUS_CHANGE = "batch_id string, claim_id long, old_status string, status string"


class LatestStatus(StatefulProcessor):
    """Keyed state of one (batch, claim): its newest status by event time.

    The state lives for ``ttl_ms`` of event time after its newest event; a timer, renewed by every
    newer event, removes it. So there are as many states as claims with an event within that time.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ts_ms long, event_id long, status string, expires long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.latest.get() if self.latest.exists() else None
        best = tuple(known) if known else None
        for frame in rows:
            for ts_ms, event_id, status in zip(frame["ts_ms"], frame["event_id"], frame["status"], strict=True):
                if best is None or (ts_ms, event_id) > best[:2]:
                    best = (int(ts_ms), int(event_id), status, 0)
        expires = best[0] + self.ttl_ms
        if known and tuple(known)[:2] == best[:2]:
            return
        if known:
            self.handle.deleteTimer(known[3])
        # A state that has outlived its time already is not kept.
        watermark = timerValues.getCurrentWatermarkInMs()
        if expires > watermark:
            self.latest.update((best[0], best[1], best[2], expires))
            self.handle.registerTimer(expires)
        elif known:
            self.latest.clear()
        old = known[2] if known else None
        if old != best[2]:
            yield pd.DataFrame({"batch_id": [key[0]], "claim_id": [key[1]], "old_status": [old], "status": [best[2]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.latest.exists() and self.latest.get()[3] <= expiredTimerInfo.getExpiryTimeInMs():
            self.latest.clear()
        return iter([])

    def close(self) -> None:
        pass


def status_changes(stream: DataFrame, delay: str = "10 minutes", ttl_days: int = fv.REUSE_TTL_DAYS) -> DataFrame:
    """A row for every claim whose newest status changes; an event older than the newest changes nothing."""
    timed = stream.filter(F.col("ts").isNotNull()).withWatermark("ts", delay)
    timed = timed.withColumn("ts_ms", F.unix_millis("ts"))
    return timed.groupBy("batch_id", "claim_id").transformWithStateInPandas(
        LatestStatus(ttl_days * 86_400_000), STATUS_CHANGE, "Update", "EventTime"
    )


def run_batch_progress(
    stream: DataFrame, store: str, checkpoint: str, delay: str = "10 minutes", ttl_days: int = fv.REUSE_TTL_DAYS
) -> StreamRun:
    """Claims per batch by their newest status.

    Every epoch adds its status changes to the rollup of the epoch before, a row a batch, and stores
    the sum, so neither statuses nor older epochs are read again and a replay leaves the same rollup.
    A claim counts once while its state lives; an event later than that counts it anew.
    """
    spark = stream.sparkSession
    done = ["processed_count", "successful_count", "failed_count"]
    schema = ", ".join(["batch_id string", "claim_count long", *[f"{c} long" for c in done]])
    empty = spark.createDataFrame([], schema)
    table = BucketedStore(spark, store, empty.schema, F.lit(0))
    tests = dict(zip(done, (["completed", "failed"], ["completed"], ["failed"]), strict=True))

    def save(changes: DataFrame, epoch: int) -> None:
        before = table.read(epoch=epoch - 1)
        newest = before.agg(F.max("epoch")).head()[0]
        known = before.filter(F.col("epoch") == F.lit(newest)).drop("epoch") if newest is not None else empty

        def delta(statuses: list[str]):
            now, was = (F.coalesce(F.col(c).isin(statuses), F.lit(False)).cast("long") for c in ("status", "old_status"))
            return now - was

        added = changes.select(
            "batch_id", F.col("old_status").isNull().cast("long").alias("claim_count"),
            *[delta(statuses).alias(c) for c, statuses in tests.items()],
        )
        total = known.unionByName(added).groupBy("batch_id").agg(*[F.sum(c).alias(c) for c in ("claim_count", *done)])
        table.write(total, epoch)

    changes = status_changes(stream, delay, ttl_days)
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    run = _finish(changes.writeStream.outputMode("update").foreachBatch(save), checkpoint, settings, spark)
    rollup = table.read()
    newest = rollup.agg(F.max("epoch")).head()[0]
    return run.of(rollup.filter(F.col("epoch") == F.lit(newest)).drop("epoch") if newest is not None else empty)


def run_adjudication(
    items: DataFrame, claims: DataFrame, docs: DataFrame, store: str, checkpoint: str,
    analysis: DataFrame | None = None, buckets: int = BUCKETS,
) -> StreamRun:
    """Adjudicate claims as their items arrive; the result is the current decision per claim.

    Items lie in buckets of claims. Each batch stores its items and decides the claims it touched from
    all their items, for which it reads the touched buckets only. Both stores survive replays.
    """
    spark = items.sparkSession
    by_claim = hash_bucket("claim_id", buckets=buckets)
    arrived = BucketedStore(spark, f"{store}/items", items.schema, by_claim)
    sample = decide.evaluate_claims(claims, spark.createDataFrame([], items.schema), docs, analysis)
    decisions = BucketedStore(spark, f"{store}/decisions", sample.schema, by_claim)

    def save(batch: DataFrame, epoch: int) -> None:
        arrived.write(batch, epoch)
        touched = arrived.written(epoch)  # the batch itself is worked out once, to be stored
        known = arrived.read(touched, epoch)
        news = known.filter(F.col("epoch") == epoch).select("claim_id").distinct()
        of_news = lambda df: df.join(news, "claim_id", "left_semi")
        # The claims choose what is decided. In the first batch all stored items are news, so choosing
        # among the other tables too would only sort them once more.
        chosen = of_news if epoch else lambda df: df
        decided = decide.evaluate_claims(
            of_news(claims), chosen(known.drop("epoch")), chosen(docs),
            chosen(analysis) if analysis is not None else None,
        )
        decisions.write(decided, epoch)

    run = _finish(items.writeStream.foreachBatch(save), checkpoint)
    return run.of(decisions.current(["claim_id"]))


def run_to_table(stream: DataFrame, store: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is available into a parquet folder and read it back."""
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", store)
    _finish(writer, checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(store)


@dataclass(frozen=True)
class StreamRun:
    """What a stream has left: its result, rows that came after the watermark, rows of state at the end.

    Both counts are those of the progress reports that Spark keeps, the last hundred batches by default.
    """

    result: DataFrame | None
    late_rows: int
    state_rows: int

    def of(self, result: DataFrame) -> StreamRun:
        return replace(self, result=result)


def _finish(writer, checkpoint: str, settings: dict[str, str] | None = None, spark=None) -> StreamRun:
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        handle = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():  # a query keeps the settings it started with
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    handle.awaitTermination()
    reports = [r["stateOperators"] for r in handle.recentProgress if r["stateOperators"]]
    late = sum(int(o["numRowsDroppedByWatermark"]) for r in reports for o in r)
    return StreamRun(None, late, sum(int(o["numRowsTotal"]) for o in reports[-1]) if reports else 0)


__all__ = [
    "StreamRun", "budget_counts", "error_budgets", "read_events", "run_adjudication", "run_batch_progress",
    "run_error_budgets", "run_sla_windows", "run_to_table", "sla_levels", "status_changes",
    "unique_arrivals", "value_counts",
]
