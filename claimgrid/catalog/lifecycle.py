"""Soft delete, purge, retention and queue transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrid.catalog import query
from claimgrid.operators import lifecycle

AS_OF = "2001-08-02 00:00:00"


def _tables(t):
    children = {"claim_documents": t.documents, "decisions": t.decisions, "processing_queue": t.queue}
    none = F.lit(None).cast("timestamp_ntz")
    return {
        "claims": t.claims,
        **{n: df.withColumn("deleted_at", none) for n, df in children.items()},
    }


def _report(tables, column="deleted"):
    parts = [
        df.groupBy(F.lit(n).alias("table_name"), F.col("deleted_at").isNotNull().alias(column)).agg(
            F.count(F.lit(1)).alias("row_count")
        )
        for n, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_CHILDREN = [("claim_documents", "v_documents"), ("decisions", "v_decisions"), ("processing_queue", "v_queue")]


def _report_sql(hit: str, claims_deleted: str, children_deleted: str) -> str:
    parts = [f"SELECT 'claims' AS table_name, {claims_deleted} AS deleted, count(*) AS row_count FROM v_claims c LEFT JOIN hit h USING (claim_id) GROUP BY ALL"]
    parts += [
        f"SELECT '{name}', {children_deleted}, count(*) FROM {view} c LEFT JOIN hit h USING (claim_id) GROUP BY ALL"
        for name, view in _CHILDREN
    ]
    return f"WITH hit AS ({hit}) " + " UNION ALL ".join(parts)


_WANTED = "SELECT DISTINCT l_orderkey AS claim_id, TRUE AS hit FROM lineitem WHERE l_quantity >= 45"


def _keys(t):
    return t.lineitem.filter("l_quantity >= 45").select(F.col("l_orderkey").alias("claim_id"))


@query(
    "L1",
    _report_sql(
        f"SELECT w.* FROM ({_WANTED}) w JOIN v_claims k USING (claim_id) WHERE k.deleted_at IS NULL",
        "c.deleted_at IS NOT NULL OR h.hit IS NOT NULL", "h.hit IS NOT NULL",
    ),
)
def soft_deleted_tables(t):
    tables, _ = lifecycle.soft_delete(_tables(t), _keys(t), AS_OF, "reviewer")
    return _report(tables)


@query(
    "L1",
    f"SELECT claim_id FROM ({_WANTED}) WHERE claim_id NOT IN (SELECT claim_id FROM v_claims WHERE deleted_at IS NULL)",
)
def soft_delete_misses(t):
    _, missing = lifecycle.soft_delete(_tables(t), _keys(t), AS_OF, "reviewer")
    return missing


@query(
    "L1",
    f"""WITH hit AS ({_WANTED}) SELECT 'claims' AS table_name, c.deleted_at IS NOT NULL AND h.hit IS NULL AS deleted, count(*) AS row_count
FROM v_claims c LEFT JOIN hit h USING (claim_id) GROUP BY ALL""",
)
def restored_claims(t):
    tables, _ = lifecycle.restore({"claims": t.claims}, _keys(t))
    return _report(tables)


@query(
    "L2 X3",
    f"""WITH gone AS (SELECT claim_id FROM v_claims WHERE deleted_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY)
SELECT 'claims' AS table_name, count(*) AS row_count FROM v_claims WHERE claim_id NOT IN (SELECT claim_id FROM gone)
{" ".join(f"UNION ALL SELECT '{n}', count(*) FROM {v} WHERE claim_id NOT IN (SELECT claim_id FROM gone)" for n, v in _CHILDREN)}
UNION ALL SELECT 'purged', count(*) FROM gone""",
)
def purged_tables(t):
    from claimgrid.operators.relational import table_counts

    tables, purged = lifecycle.purge(_tables(t), AS_OF)
    return table_counts({**tables, "purged": purged})


_POLICY = [
    ("claims", "v_claims", "created_at", "2006-01-01 00:00:00", 2555, "archive"),
    ("decisions", "v_decisions", "decided_at", "2006-01-01 00:00:00", 2555, "archive"),
    ("processing_queue", "v_queue", "scheduled_at", "2024-02-15 00:00:00", 30, "purge"),
    ("soft_deleted_claims", "v_claims", "deleted_at", AS_OF, 90, "purge"),
]


@query(
    "L3",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, CASE WHEN {c} < TIMESTAMP '{a}' - INTERVAL {d} DAY THEN '{x}' ELSE 'keep' END AS retention_action, count(*) AS row_count FROM {v} GROUP BY ALL"
        for n, v, c, a, d, x in _POLICY
    ),
)
def retention_actions(t):
    out = None
    for name, view, column, as_of, _, _ in _POLICY:
        part = (
            lifecycle.retention_actions(getattr(t, view[2:]), name, column, as_of)
            .groupBy(F.lit(name).alias("table_name"), "retention_action")
            .agg(F.count(F.lit(1)).alias("row_count"))
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "L4",
    """WITH req AS (SELECT DISTINCT l_partkey AS claim_id FROM lineitem)
SELECT batch_id, status, count(*) AS items FROM (SELECT batch_id, status FROM v_queue
  UNION ALL SELECT 'batch-new', 'pending' FROM req WHERE claim_id IN (SELECT claim_id FROM v_claims)
  UNION ALL SELECT 'unknown', 'rejected' FROM req WHERE claim_id NOT IN (SELECT claim_id FROM v_claims)) GROUP BY ALL""",
)
def submitted_batch(t):
    requested = t.lineitem.select(F.col("l_partkey").alias("claim_id")).distinct()
    queue, unknown = lifecycle.submit_batch(
        t.queue, t.claims, requested, "batch-new", "2024-02-01 00:00:00"
    )
    rejected = unknown.select(F.lit("unknown").alias("batch_id"), F.lit("rejected").alias("status"))
    return (
        queue.select("batch_id", "status").unionByName(rejected)
        .groupBy("batch_id", "status").agg(F.count(F.lit(1)).alias("items"))
    )


@query(
    "L4",
    """WITH e AS (SELECT 'batch-' || CAST(user_id % 25 AS VARCHAR) AS batch_id, event_id AS claim_id, event_id, ts + INTERVAL 1 HOUR AS ts,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'completed' ELSE 'processing' END AS status,
    CASE WHEN event_type = 'error' THEN 'no documents' ELSE '' END AS error_message FROM events)
SELECT e.status, q.status AS was, CASE WHEN e.error_message <> '' THEN e.error_message ELSE q.error_message END AS error_message, count(*) AS items,
  count(CASE WHEN e.status = 'processing' THEN e.ts ELSE q.started_at END) AS started, count(CASE WHEN e.status IN ('completed', 'failed') THEN e.ts ELSE q.completed_at END) AS ended
FROM v_queue q JOIN e USING (batch_id, claim_id) GROUP BY ALL""",
)
def queue_transitions(t):
    events = t.events.select(
        F.concat(F.lit("batch-"), (F.col("user_id") % 25).cast("string")).alias("batch_id"),
        F.col("event_id").alias("claim_id"), "event_id",
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"),
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "view", "completed").otherwise("processing").alias("status"),
        F.when(F.col("event_type") == "error", "no documents").otherwise("").alias("error_message"),
    )
    queue = t.queue.withColumn("was", F.col("status"))
    return (
        lifecycle.apply_status_events(queue, events)
        .groupBy("status", "was", "error_message")
        .agg(F.count(F.lit(1)).alias("items"), F.count("started_at").alias("started"),
             F.count("completed_at").alias("ended"))
    )
