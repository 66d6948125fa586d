"""Table rewrites: soft delete, restore, purge, retention, queue transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.rules import fixed_values as fv


def _stamp(text: str):
    return F.lit(text).cast("timestamp_ntz")


def soft_delete(
    tables: dict[str, DataFrame], keys: DataFrame, as_of: str, by: str
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Mark claims and their children deleted; also the keys that are unknown or already gone."""
    marked = keys.select("claim_id").distinct().withColumn("_hit", F.lit(True))
    live = tables["claims"].filter(F.col("deleted_at").isNull()).select("claim_id")
    missing = marked.select("claim_id").join(live, "claim_id", "left_anti")
    wanted = marked.join(live, "claim_id", "left_semi")
    result = {}
    for name, df in tables.items():
        hit = F.col("_hit").isNotNull() & F.col("deleted_at").isNull()
        changed = df.join(wanted, "claim_id", "left")
        updates = {"deleted_at": F.when(hit, _stamp(as_of)).otherwise(F.col("deleted_at"))}
        if name == "claims":
            for column, value in (("updated_at", _stamp(as_of)), ("updated_by", F.lit(by))):
                if column in df.columns:
                    updates[column] = F.when(hit, value).otherwise(F.col(column))
        result[name] = changed.withColumns(updates).drop("_hit")
    return result, missing


def restore(
    tables: dict[str, DataFrame], keys: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Undo a soft delete for claims and children; also the keys that are not deleted."""
    marked = keys.select("claim_id").distinct()
    gone = tables["claims"].filter(F.col("deleted_at").isNotNull()).select("claim_id")
    missing = marked.join(gone, "claim_id", "left_anti")
    wanted = marked.join(gone, "claim_id", "left_semi").withColumn("_hit", F.lit(True))
    result = {
        name: df.join(wanted, "claim_id", "left")
        .withColumn("deleted_at", F.when(F.col("_hit").isNull(), F.col("deleted_at")))
        .drop("_hit")
        for name, df in tables.items()
    }
    return result, missing


def purge(
    tables: dict[str, DataFrame], as_of: str, days: int = 90
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Drop claims soft-deleted before the cutoff, children first, and list the purged ids."""
    cutoff = _stamp(as_of) - F.expr(f"INTERVAL {days} DAY")
    purged = tables["claims"].filter(F.col("deleted_at") < cutoff).select("claim_id")
    names = [n for n in tables if n != "claims"] + ["claims"]
    return {n: tables[n].join(purged, "claim_id", "left_anti") for n in names}, purged


def retention_actions(
    df: DataFrame, table: str, time_column: str, as_of: str
) -> DataFrame:
    """keep / archive / purge per row, from the policy row of the table."""
    days, archive, purge_rows = next(
        (d, a, p) for name, d, a, p in fv.RETENTION_POLICY if name == table
    )
    cutoff = _stamp(as_of) - F.expr(f"INTERVAL {days} DAY")
    expired = F.coalesce(F.col(time_column) < cutoff, F.lit(False))
    action = "purge" if purge_rows or archive is None else "archive"
    return df.withColumn("retention_action", F.when(expired, action).otherwise("keep"))


def submit_batch(
    queue: DataFrame, claims: DataFrame, requested: DataFrame, batch_id: str, as_of: str,
    priority: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """New pending queue rows for known claims, and the requested ids that do not exist."""
    known = requested.join(claims.select("claim_id"), "claim_id", "left_semi")
    unknown = requested.join(claims.select("claim_id"), "claim_id", "left_anti")
    rows = known.select(
        F.lit(batch_id).alias("batch_id"),
        "claim_id",
        F.lit(priority).alias("priority"),
        F.lit("pending").alias("status"),
        _stamp(as_of).alias("scheduled_at"),
    )
    return queue.unionByName(rows, allowMissingColumns=True), unknown


def apply_status_events(queue: DataFrame, events: DataFrame) -> DataFrame:
    """Queue after status events: the latest status wins, start and end times by kind, and a stored
    error message stays until another one is given.

    Events are reduced to one row per (batch, claim) with map-side combine before the join.
    """
    keys = ["batch_id", "claim_id"]
    done = F.col("status").isin("completed", "failed")
    last = events.groupBy(*keys).agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("_status"),
        F.max(F.when(F.col("status") == "processing", F.col("ts"))).alias("_started"),
        F.max(F.when(done, F.col("ts"))).alias("_ended"),
        F.max_by(
            F.when(F.col("error_message") != "", F.col("error_message")),
            F.when(done & (F.col("error_message") != ""), F.struct("ts", "event_id")),
        ).alias("_error"),
    )
    kept = F.col("error_message") if "error_message" in queue.columns else F.lit(None).cast("string")
    return (
        queue.join(last, keys, "left")
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "started_at": F.coalesce("_started", "started_at"),
                "completed_at": F.coalesce("_ended", "completed_at"),
                "error_message": F.coalesce("_error", kept),
            }
        )
        .drop("_status", "_started", "_ended", "_error")
    )


__all__ = [
    "apply_status_events", "purge", "restore", "retention_actions",
    "soft_delete", "submit_batch",
]
