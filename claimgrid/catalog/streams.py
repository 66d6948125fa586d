"""Streams over the event and order files, run to completion and compared with batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimgrid.catalog import query
from claimgrid.catalog.decisions import DECIDED, FLAT_SQL, analysis_of, flat
from claimgrid.catalog.items import with_suggestions
from claimgrid.session import checkpoint_dir
from claimgrid.sources.views import VIEWS, bind
from claimgrid.streaming import jobs


def _events(t):
    """The event file as a stream, and a fresh scratch folder beside the checkpoints."""
    schema = t.events.schema
    scratch = f"{checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    return jobs.read_events(t.spark, t.folder, "events.parquet", schema), scratch


def _metrics(events):
    kind = (
        F.when(F.col("event_type") == "signup", "lease").when(F.col("event_type") == "view", "invoice")
        .when(F.col("event_type") == "error", "unknown").otherwise("addendum")
    )
    tier = (
        F.when(F.col("event_type") == "signup", "tier2_tesseract")
        .when(F.col("event_type") == "error", "tier3_mistral")
        .when(F.col("event_type") == "view", "tier1_pypdf2").otherwise("tier1_pdfplumber")
    )
    value = F.col("value")
    return events.select(
        "ts", kind.alias("document_type"), tier.alias("tier"),
        F.floor(value * 400).alias("processing_time_ms"),
        F.when(value > 100, 100.0 - value / 10).otherwise(100.0 - value).alias("confidence"),
    )


@query("ST1", "SELECT DISTINCT file_hash FROM v_arrivals")
def stream_unique_arrivals(t):
    events, scratch = _events(t)
    arrivals = events.select(
        "ts", F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("file_hash")
    )
    unique = jobs.unique_arrivals(arrivals)
    return jobs.run_to_table(unique, scratch + "/out", scratch + "/cp").select("file_hash")


@query(
    "ST2",
    """WITH w AS (SELECT date_trunc('hour', ts) AS s, document_type, processing_time_ms FROM v_metrics)
SELECT epoch_us(s) AS start_us, document_type, count(*) AS documents, round(avg(processing_time_ms), 6) AS avg_time_ms, max(processing_time_ms) AS max_time_ms,
  list_sort(list(processing_time_ms))[least(CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1, count(*))] AS p95_time_ms,
  count(*) FILTER (WHERE processing_time_ms > 60000) AS violations FROM w GROUP BY s, document_type""",
)
def stream_sla_windows(t):
    events, scratch = _events(t)
    levels = jobs.run_sla_windows(_metrics(events), scratch + "/out", scratch + "/cp").result
    return levels.select(
        F.unix_micros("start").alias("start_us"), "document_type", "documents",
        F.round("avg_time_ms", 6).alias("avg_time_ms"), "max_time_ms", "p95_time_ms", "violations",
    )


@query(
    "ST3",
    """WITH m AS (SELECT ts, substr(tier, 1, 5) AS tier, confidence FROM v_metrics),
w AS (SELECT date_trunc('hour', ts) - h.k * INTERVAL 1 HOUR AS s, tier, confidence FROM m, (SELECT unnest(generate_series(0, 23)) AS k) h)
SELECT epoch_us(s) AS start_us, tier, count(*) AS documents, count(*) FILTER (WHERE confidence < 50) AS low_confidence,
  round(count(*) FILTER (WHERE confidence < 50) / count(*)::DOUBLE / 0.05::DOUBLE, 6) AS budget_consumed,
  count(*) FILTER (WHERE confidence < 50) / count(*)::DOUBLE / 0.05::DOUBLE >= 0.8 AS alert,
  count(*) FILTER (WHERE confidence < 50) / count(*)::DOUBLE / 0.05::DOUBLE >= 1.0 AS exhausted FROM w GROUP BY s, tier""",
)
def stream_error_budget(t):
    events, scratch = _events(t)
    budgets = jobs.run_error_budgets(_metrics(events), scratch + "/out", scratch + "/cp").result
    return budgets.select(
        F.unix_micros("start").alias("start_us"), "tier", "documents", "low_confidence",
        F.round("budget_consumed", 6).alias("budget_consumed"), "alert", "exhausted",
    )


@query(
    "ST4",
    """WITH e AS (SELECT 'batch-' || CAST(user_id % 25 AS VARCHAR) AS batch_id, user_id AS claim_id,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT batch_id, count(*) AS claim_count, count(*) FILTER (WHERE status IN ('completed', 'failed')) AS processed_count,
  count(*) FILTER (WHERE status = 'completed') AS successful_count, count(*) FILTER (WHERE status = 'failed') AS failed_count FROM e WHERE rn = 1 GROUP BY 1""",
)
def stream_batch_progress(t):
    events, scratch = _events(t)
    status = (
        F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "processing")
        .when(F.col("event_type") == "error", "failed").otherwise("completed")
    )
    changes = events.select(
        F.concat(F.lit("batch-"), (F.col("user_id") % 25).cast("string")).alias("batch_id"),
        F.col("user_id").alias("claim_id"), "event_id", "ts", status.alias("status"),
    )
    return jobs.run_batch_progress(changes, scratch + "/out", scratch + "/cp").result


@query("ST6", f"WITH {DECIDED} {FLAT_SQL} WHERE claim_id IN (SELECT claim_id FROM v_items)")
def stream_adjudication(t):
    """Decisions of all claims with items, from a stream of the item file."""
    scratch = f"{checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    lines = (
        t.spark.readStream.schema(t.lineitem.schema)
        .option("pathGlobFilter", "lineitem.parquet").parquet(t.folder)
    )
    name = f"cg_stream_{uuid.uuid4().hex}"
    lines.createOrReplaceTempView(name)
    items = with_suggestions(t.spark.sql(bind(VIEWS["v_items"], {"lineitem": name})))
    run = jobs.run_adjudication(
        items, t.claims, t.documents, scratch + "/out", scratch + "/cp", analysis_of(t)
    )
    return flat(run.result)
