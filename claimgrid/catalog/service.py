"""Service levels, error budgets, result reuse, rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrid.catalog import query
from claimgrid.catalog.relational import stamps
from claimgrid.operators import service


@query(
    "W7",
    """WITH r AS (SELECT document_type, metric_id, processing_time_ms FROM v_metrics QUALIFY row_number() OVER (PARTITION BY document_type ORDER BY ts DESC, metric_id DESC) <= 1000
  UNION ALL SELECT 'ALL', metric_id, processing_time_ms FROM v_metrics QUALIFY row_number() OVER (ORDER BY ts DESC, metric_id DESC) <= 1000),
p AS (SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY processing_time_ms, metric_id) AS i, count(*) OVER (PARTITION BY document_type) AS n FROM r),
g AS (SELECT document_type, count(*) AS total_count, avg(processing_time_ms) AS a, max(processing_time_ms) FILTER (WHERE i = least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1, n)) AS p95_time_ms,
  max(processing_time_ms) FILTER (WHERE i = least(CAST(floor(n * 0.99::DOUBLE) AS BIGINT) + 1, n)) AS p99_time_ms, max(processing_time_ms) AS max_time_ms,
  count(*) FILTER (WHERE processing_time_ms > 60000) AS violation_count FROM p GROUP BY 1)
SELECT document_type, total_count, round(a, 6) AS avg_time_ms, p95_time_ms, p99_time_ms, max_time_ms, violation_count,
  round((1 - violation_count / total_count::DOUBLE) * 100, 6) AS compliance_percentage, a <= 5000 AS avg_ok, p95_time_ms <= 15000 AS p95_ok, p99_time_ms <= 30000 AS p99_ok,
  max_time_ms <= 60000 AS max_ok, a <= 5000 AND p95_time_ms <= 15000 AND p99_time_ms <= 30000 AND max_time_ms <= 60000 AS compliant,
  violation_count / total_count::DOUBLE > 0.05 AS alert FROM g""",
)
def sla_metrics(t):
    metrics = service.sla_metrics(t.metrics)
    return metrics.withColumns(
        {c: F.round(c, 6) for c in ("avg_time_ms", "compliance_percentage")}
    )


@query(
    "W8",
    """WITH m AS (SELECT substr(tier, 1, 5) AS tier, ts, CASE WHEN confidence < 50 THEN 1 ELSE 0 END AS low FROM v_metrics),
w AS (SELECT DISTINCT tier, ts, count(*) OVER f AS n, CAST(sum(low) OVER f AS BIGINT) AS low FROM m
  WINDOW f AS (PARTITION BY tier ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW))
SELECT tier, epoch_us(ts) AS ts_us, n AS total_documents, low AS low_confidence_count, round(low / n::DOUBLE, 6) AS error_rate,
  round(low / n::DOUBLE / 0.05, 6) AS budget_consumed, low / n::DOUBLE / 0.05::DOUBLE >= 0.8 AS alert, low / n::DOUBLE / 0.05::DOUBLE >= 1.0 AS exhausted FROM w""",
)
def error_budget(t):
    return service.error_budget(t.metrics).select(
        "tier", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "total_documents",
        "low_confidence_count", F.round("error_rate", 6).alias("error_rate"),
        F.round("budget_consumed", 6).alias("budget_consumed"), "alert", "exhausted",
    )


@query(
    "W12",
    """WITH RECURSIVE a AS (SELECT file_hash, min(ts) AS anchor FROM v_arrivals GROUP BY 1
  UNION ALL SELECT a.file_hash, (SELECT min(v.ts) FROM v_arrivals v WHERE v.file_hash = a.file_hash AND v.ts > a.anchor + INTERVAL 7 DAY)
  FROM a WHERE a.anchor IS NOT NULL),
r AS (SELECT v.arrival_id, v.file_hash, v.ts, max(a.anchor) AS anchor FROM v_arrivals v JOIN a ON a.file_hash = v.file_hash AND a.anchor <= v.ts GROUP BY ALL)
SELECT file_hash, count(*) AS arrivals, count(*) FILTER (WHERE ts = anchor) AS processed, count(DISTINCT anchor) AS anchors FROM r GROUP BY 1""",
)
def result_reuse(t):
    reused = service.reuse_windows(t.arrivals, days=7)
    return reused.groupBy("file_hash").agg(
        F.count(F.lit(1)).alias("arrivals"),
        F.count_if("is_new").alias("processed"),
        F.count_distinct("anchor_ts").alias("anchors"),
    )
