"""Relational queries: filters, joins, counts, latest rows, sets, constraints."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from claimgrid.catalog import query
from claimgrid.catalog.items import sql_any
from claimgrid.functions import text
from claimgrid.functions.text import as_double, extract_tracking, text_preview
from claimgrid.operators import relational as rel
from claimgrid.rules import fixed_values as fv

AS_OF = "2001-08-02 00:00:00"
CUTOFF = "1998-01-01 00:00:00"


def stamps(df, *names):
    """Timestamps as text, so that engines agree on their rendering."""
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def ts(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name or expr}"


@query(
    "F1 S3",
    """SELECT claim_id, claim_tracking_number, status FROM v_claims
WHERE claim_tracking_number IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_quantity >= 45)""",
)
def claims_by_tracking(t):
    keys = t.lineitem.filter("l_quantity >= 45").select(
        F.col("l_orderkey").cast("string").alias("claim_tracking_number")
    )
    return rel.claims_by_keys(t.claims, keys, "claim_tracking_number").select(
        "claim_id", "claim_tracking_number", "status"
    )


@query(
    "F2",
    """SELECT document_id, claim_id, document_type, coalesce(extracted_text, '') AS extracted_text
FROM v_documents WHERE document_type = 'unknown'
  AND claim_id IN (SELECT claim_id FROM v_claims WHERE status = 'pending')""",
)
def claim_documents_by_type(t):
    pending = t.claims.filter("status = 'pending'")
    return rel.documents_for(pending, t.documents, "unknown").select(
        "document_id", "claim_id", "document_type", "extracted_text"
    )


@query(
    "F3",
    f"""WITH s AS (SELECT *, CASE WHEN {sql_any("lower(original_filename)", fv.PRIORITY_FILE_KEYWORDS)} THEN 3
    WHEN {sql_any("lower(original_filename)", fv.SECONDARY_FILE_KEYWORDS)} THEN 2 ELSE 1 END AS stage
  FROM v_documents WHERE mime_type = 'application/pdf'
    AND NOT {sql_any("lower(original_filename)", fv.SKIP_FILE_KEYWORDS)}),
r AS (SELECT *, max(stage) OVER (PARTITION BY claim_id) AS best,
  row_number() OVER (PARTITION BY claim_id, stage ORDER BY created_at, document_id) AS rn FROM s)
SELECT claim_id, document_id, stage FROM r WHERE stage = best AND (stage > 1 OR rn <= 5)""",
)
def relevant_documents(t):
    return rel.select_relevant_documents(t.documents).select("claim_id", "document_id", "stage")


CANDIDATE_SQL = """((NOT contains(lower(original_filename), 'authorization') AND (lower(document_type) IN ('invoice', 'unknown')
    OR contains(lower(original_filename), 'invoice') OR contains(lower(original_filename), 'move-out-statement')
    OR contains(lower(original_filename), 'move out statement')
    OR (contains(lower(original_filename), 'statement') AND contains(lower(original_filename), 'move'))
    OR (contains(lower(original_filename), 'deposit') AND contains(lower(original_filename), 'disposition'))))
  OR (contains(lower(original_filename), 'deposit') AND (contains(lower(original_filename), 'disposition')
      OR contains(lower(original_filename), 'amount due')) AND NOT contains(lower(original_filename), 'ledger')
    AND length(coalesce(extracted_text, '')) BETWEEN 1 AND 1999))"""


@query(
    "F4",
    f"""SELECT document_type, original_filename LIKE 'Invoice%' AS named_invoice, count(*) AS documents
FROM v_documents WHERE {CANDIDATE_SQL} GROUP BY ALL""",
)
def invoice_candidate_counts(t):
    return (
        rel.invoice_candidates(t.documents)
        .groupBy("document_type", F.col("original_filename").like("Invoice%").alias("named_invoice"))
        .agg(F.count(F.lit(1)).alias("documents"))
    )


@query(
    "F5",
    f"""SELECT d.document_id, d.claim_id, d.document_type FROM v_documents d
WHERE d.document_type <> 'addendum' AND d.claim_id NOT IN
  (SELECT claim_id FROM v_documents WHERE document_type = 'invoice')
AND ({sql_any("lower(coalesce(extracted_text, ''))", fv.INVOICE_LIKE_KEYWORDS)}
  OR {sql_any("lower(original_filename)", fv.INVOICE_LIKE_KEYWORDS)})""",
)
def fallback_invoice_documents(t):
    return rel.fallback_invoice_candidates(t.documents).select(
        "document_id", "claim_id", "document_type"
    )


@query(
    "F6 T6",
    """SELECT claim_id, claim_tracking_number, TRY_CAST(claim_tracking_number AS BIGINT) AS tracking_no
FROM v_claims WHERE regexp_matches(claim_tracking_number, '^[0-9]+$')
  AND TRY_CAST(claim_tracking_number AS BIGINT) BETWEEN 100 AND 9000
  AND NOT TRY_CAST(claim_tracking_number AS BIGINT) BETWEEN 900 AND 920
ORDER BY TRY_CAST(claim_tracking_number AS BIGINT)""",
)
def tracking_number_range(t):
    return (
        rel.tracking_range(t.claims, 100, 9000, (900, 920))
        .select("claim_id", "claim_tracking_number", "tracking_no")
        .orderBy("tracking_no")
    )


@query(
    "F7",
    """SELECT tracking, count(*) AS documents FROM (SELECT CASE
  WHEN regexp_matches(original_filename, '(?i)CLM[_-]?(\\d+)') THEN regexp_extract(original_filename, '(?i)CLM[_-]?(\\d+)', 1)
  WHEN regexp_matches(original_filename, '\\d{4,}') THEN regexp_extract(original_filename, '(\\d{4,})', 1)
  WHEN regexp_matches(original_filename, '(?i)Claim[_-]?(\\d+)') THEN regexp_extract(original_filename, '(?i)Claim[_-]?(\\d+)', 1)
  WHEN regexp_matches(original_filename, '^(\\d+)$') THEN original_filename END AS tracking
FROM v_documents) GROUP BY tracking""",
)
def tracking_from_filenames(t):
    tracking = extract_tracking(F.col("original_filename"), F.lit(None).cast("string"))
    return t.documents.groupBy(tracking.alias("tracking")).agg(
        F.count(F.lit(1)).alias("documents")
    )


@query(
    "F8 T1",
    """SELECT q.queue_id, q.claim_id, q.priority, q.batch_id, c.claim_tracking_number,
  CAST(c.claim_amount AS DOUBLE) AS claim_amount FROM v_queue q JOIN v_claims c USING (claim_id)
WHERE q.status = 'pending' AND q.scheduled_at <= TIMESTAMP '2024-01-20 00:00:00'
ORDER BY q.priority DESC, q.scheduled_at, q.queue_id LIMIT 10""",
)
def next_work_items(t):
    return rel.claim_work_items(
        t.queue, t.claims.drop("priority", "status"), "2024-01-20 00:00:00"
    ).select(
        "queue_id", "claim_id", "priority", "batch_id", "claim_tracking_number",
        as_double("claim_amount").alias("claim_amount"),
    )


@query(
    "T1",
    """WITH p AS (SELECT queue_id FROM v_queue WHERE status = 'pending'
  AND scheduled_at <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY priority DESC, scheduled_at, queue_id LIMIT 10)
SELECT CASE WHEN p.queue_id IS NULL THEN q.status ELSE 'processing' END AS status,
  CASE WHEN p.queue_id IS NOT NULL THEN 'worker-1' END AS worker_id, count(*) AS items
FROM v_queue q LEFT JOIN p USING (queue_id) GROUP BY ALL""",
)
def queue_after_pick(t):
    return (
        rel.take_work_items(t.queue, "2024-01-20 00:00:00", "worker-1")
        .groupBy("status", "worker_id")
        .agg(F.count(F.lit(1)).alias("items"))
    )


CAP_SQL = """CASE WHEN coalesce(d.cap_amount, 0) = 0 THEN NULL
  WHEN d.invoice_total < CASE WHEN c.claim_amount > 0 AND c.max_benefit > 0 THEN least(c.claim_amount, c.max_benefit)
    WHEN c.claim_amount > 0 THEN c.claim_amount WHEN c.max_benefit > 0 THEN c.max_benefit END THEN 'invoice_total'
  WHEN c.claim_amount > 0 AND c.max_benefit > 0 AND c.claim_amount = c.max_benefit THEN 'claim_amount_and_max_benefit'
  WHEN c.claim_amount > 0 AND (coalesce(c.max_benefit, 0) <= 0 OR c.claim_amount < c.max_benefit) THEN 'claim_amount'
  WHEN c.max_benefit > 0 THEN 'max_benefit' END"""


@query(
    "F9",
    f"""SELECT cap_reason, count(*) AS decisions, CAST(sum(cap_amount) AS DOUBLE) AS cap_amount FROM
(SELECT {CAP_SQL} AS cap_reason, d.cap_amount FROM v_decisions d JOIN v_claims c USING (claim_id)) GROUP BY ALL""",
)
def cap_reasons(t):
    joined = t.decisions.join(
        t.claims.select("claim_id", "claim_amount", "max_benefit"), "claim_id"
    )
    return rel.with_cap_reason(joined).groupBy("cap_reason").agg(
        F.count(F.lit(1)).alias("decisions"), as_double(F.sum("cap_amount")).alias("cap_amount")
    )


@query(
    "F13 A1",
    """SELECT status, count(*) AS claim_count, CAST(sum(claim_amount) AS DOUBLE) AS total_amount,
  CAST(sum(claim_amount) AS DOUBLE) / count(claim_amount) AS avg_amount
FROM v_claims WHERE created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1997-02-01' GROUP BY status""",
)
def month_by_status(t):
    month = rel.in_period(t.claims, "created_at", "1997-01-01", "1997-02-01")
    return rel.status_summary(month).select("status", "claim_count", "total_amount", "avg_amount")


@query(
    "A2",
    f"""SELECT status, count(*) AS claim_count, {ts("min(created_at)", "earliest")},
  {ts("max(created_at)", "latest")} FROM v_claims GROUP BY status""",
)
def claims_by_status(t):
    return stamps(rel.status_summary(t.claims), "earliest", "latest").select(
        "status", "claim_count", "earliest", "latest"
    )


@query(
    "J1",
    """SELECT c.claim_id, c.claim_tracking_number, CAST(c.claim_amount AS DOUBLE) AS claim_amount, c.status,
  count(d.document_id) AS document_count FROM v_claims c LEFT JOIN v_documents d USING (claim_id) GROUP BY ALL""",
)
def claim_document_counts(t):
    return rel.claims_with_document_count(t.claims, t.documents).select(
        "claim_id", "claim_tracking_number", as_double("claim_amount").alias("claim_amount"),
        "status", "document_count",
    )


@query(
    "J2 T3",
    f"""SELECT c.claim_id, c.claim_tracking_number, c.status, c.priority, d.proposed_status,
  CAST(d.proposed_benefit_amount AS DOUBLE) AS proposed_benefit_amount, d.confidence_score,
  count(cd.document_id) AS document_count, max(cd.processing_status) AS doc_processing_status
FROM v_claims c LEFT JOIN v_decisions d ON d.claim_id = c.claim_id AND d.is_active
LEFT JOIN v_documents cd ON cd.claim_id = c.claim_id
WHERE c.status IN ('pending', 'processing') AND c.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
GROUP BY c.claim_id, c.claim_tracking_number, c.status, c.priority, d.proposed_status, d.proposed_benefit_amount,
  d.confidence_score, c.created_at ORDER BY c.priority DESC, c.created_at, c.claim_id LIMIT 100""",
)
def batch_evaluation_view(t):
    return rel.batch_view(t.claims, t.decisions, t.documents, AS_OF, 30, 100).select(
        "claim_id", "claim_tracking_number", "status", "priority", "proposed_status",
        as_double("proposed_benefit_amount").alias("proposed_benefit_amount"), "confidence_score",
        "document_count", "doc_processing_status",
    )


@query(
    "J3 T2",
    """SELECT c.claim_id, c.policyholder_id, CAST(c.claim_date AS VARCHAR) AS claim_date, c.status,
  CAST(c.claim_amount AS DOUBLE) AS claim_amount, d.proposed_status,
  CAST(d.proposed_benefit_amount AS DOUBLE) AS proposed_benefit_amount
FROM v_claims c LEFT JOIN v_decisions d ON d.claim_id = c.claim_id AND d.is_active
ORDER BY c.policyholder_id, c.claim_date DESC, c.claim_id LIMIT 20 OFFSET 40""",
)
def policyholder_page(t):
    order = [F.asc("policyholder_id"), F.desc("claim_date"), F.asc("claim_id")]
    return rel.policyholder_page(t.claims, t.decisions, order, 20, 40).select(
        "claim_id", "policyholder_id", F.col("claim_date").cast("string").alias("claim_date"),
        "status", as_double("claim_amount").alias("claim_amount"), "proposed_status",
        as_double("proposed_benefit_amount").alias("proposed_benefit_amount"),
    )


VERSIONS_SQL = """versions AS (
SELECT decision_id, claim_id, 1 AS version_no, 'automated' AS decision_type, proposed_status, TRUE AS is_active,
  decided_by, decided_at AS changed_at FROM v_decisions
UNION ALL SELECT decision_id, claim_id, 2, decision_type, proposed_status, TRUE, decided_by, decided_at + INTERVAL 1 DAY
  FROM v_decisions WHERE decision_type = 'manual_override' OR confidence_score > 95
UNION ALL SELECT decision_id, claim_id, 3, decision_type, proposed_status, FALSE, decided_by, decided_at + INTERVAL 10 DAY
  FROM v_decisions WHERE NOT is_active)"""
AUDIT_SQL = f"""{VERSIONS_SQL}, lagged AS (SELECT *, lag(decision_type) OVER w AS old_type, lag(is_active) OVER w AS old_active
  FROM versions WINDOW w AS (PARTITION BY decision_id ORDER BY changed_at, version_no)),
audit AS (SELECT decision_id, claim_id, version_no, CASE WHEN old_active IS NULL THEN 'created'
  WHEN old_active AND NOT is_active THEN 'superseded'
  WHEN decision_type = 'manual_override' AND old_type <> 'manual_override' THEN 'overridden' ELSE 'reviewed' END AS action,
  coalesce(decided_by, 'system') AS user_id, old_type, decision_type AS new_type, changed_at AS created_at FROM lagged)"""


def decision_versions(t):
    """Row versions of every decision: inserted, edited, superseded."""
    base = t.decisions
    cols = ["decision_id", "claim_id"]
    first = base.select(
        *cols, F.lit(1).alias("version_no"), F.lit("automated").alias("decision_type"),
        "proposed_status", F.lit(True).alias("is_active"), "decided_by",
        F.col("decided_at").alias("changed_at"),
    )
    edited = base.filter(
        (F.col("decision_type") == "manual_override") | (F.col("confidence_score") > 95)
    ).select(
        *cols, F.lit(2).alias("version_no"), "decision_type", "proposed_status",
        F.lit(True).alias("is_active"), "decided_by",
        (F.col("decided_at") + F.expr("INTERVAL 1 DAY")).alias("changed_at"),
    )
    ended = base.filter(~F.col("is_active")).select(
        *cols, F.lit(3).alias("version_no"), "decision_type", "proposed_status",
        F.lit(False).alias("is_active"), "decided_by",
        (F.col("decided_at") + F.expr("INTERVAL 10 DAY")).alias("changed_at"),
    )
    return first.unionByName(edited).unionByName(ended)


AUDIT_FIELDS = ["decision_id", "decision_type", "proposed_status", "is_active"]


@query(
    "W4",
    f"""WITH {AUDIT_SQL} SELECT decision_id, claim_id, version_no, action, user_id, old_type, new_type,
{ts("created_at")} FROM audit""",
)
def decision_audit_log(t):
    events = rel.audit_events(decision_versions(t), AUDIT_FIELDS)
    return stamps(events, "created_at").select(
        "decision_id", "claim_id", "version_no", "action", "user_id",
        F.get_json_object("old_values", "$.decision_type").alias("old_type"),
        F.get_json_object("new_values", "$.decision_type").alias("new_type"), "created_at",
    )


@query(
    "J4",
    f"""WITH {AUDIT_SQL} SELECT d.decision_id, d.claim_id, d.proposed_status, d.is_active, d.superseded_by,
  count(a.decision_id) AS audit_log_count, {ts("max(a.created_at)", "last_audit_time")}
FROM v_decisions d LEFT JOIN audit a ON a.decision_id = d.decision_id
GROUP BY d.decision_id, d.claim_id, d.proposed_status, d.is_active, d.superseded_by""",
)
def decision_history(t):
    audit = rel.audit_events(decision_versions(t), AUDIT_FIELDS)
    return stamps(rel.decision_history(t.decisions, audit), "last_audit_time").select(
        "decision_id", "claim_id", "proposed_status", "is_active", "superseded_by",
        "audit_log_count", "last_audit_time",
    )


@query(
    "J5",
    f"""SELECT d.engine_version, count(*) AS total_decisions, count(v.validation_id) AS validated_count,
  count(*) FILTER (WHERE d.proposed_status = v.actual_status) AS accurate_count,
  CAST(sum(abs(d.proposed_benefit_amount - coalesce(v.actual_paid_amount, 0))) AS DOUBLE) / count(*) AS avg_amount_diff
FROM v_decisions d LEFT JOIN v_validation v ON v.decision_id = d.decision_id
WHERE d.decided_at >= TIMESTAMP '{AS_OF}' - INTERVAL 900 DAY AND d.is_active GROUP BY d.engine_version""",
)
def engine_version_scorecard(t):
    return rel.version_scorecard(t.decisions, t.validation, AS_OF, 900)


def _dashboard_sql(safe: bool) -> str:
    if safe:
        return f"""WITH d AS (SELECT claim_id, count(*) AS n, sum(proposed_benefit_amount) AS b, sum(confidence_score) AS c
  FROM v_decisions WHERE is_active GROUP BY claim_id), k AS (SELECT claim_id, count(*) AS n FROM v_documents GROUP BY claim_id)
SELECT CAST(CAST(c.created_at AS DATE) AS VARCHAR) AS claim_day, c.status, count(*) AS claim_count,
  CAST(coalesce(sum(d.n), 0) AS BIGINT) AS decision_count, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS document_count,
  CAST(sum(c.claim_amount) AS DOUBLE) AS total_claim_amount, CAST(sum(d.b) AS DOUBLE) / sum(d.n) AS avg_benefit_amount,
  sum(d.c) / sum(d.n) AS avg_confidence
FROM v_claims c LEFT JOIN d USING (claim_id) LEFT JOIN k USING (claim_id)
WHERE c.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY GROUP BY ALL"""
    return f"""SELECT CAST(CAST(c.created_at AS DATE) AS VARCHAR) AS claim_day, c.status, count(DISTINCT c.claim_id) AS claim_count,
  count(DISTINCT d.decision_id) AS decision_count, count(DISTINCT k.document_id) AS document_count,
  CAST(sum(c.claim_amount) AS DOUBLE) AS total_claim_amount,
  CAST(sum(d.proposed_benefit_amount) AS DOUBLE) / count(d.decision_id) AS avg_benefit_amount,
  sum(d.confidence_score) / count(d.decision_id) AS avg_confidence
FROM v_claims c LEFT JOIN v_decisions d ON d.claim_id = c.claim_id AND d.is_active
LEFT JOIN v_documents k ON k.claim_id = c.claim_id
WHERE c.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY GROUP BY ALL"""


def _dashboard(t, safe: bool):
    board = rel.daily_dashboard(t.claims, t.decisions, t.documents, AS_OF, 365, safe)
    return board.withColumn("claim_day", F.col("claim_day").cast("string"))


@query("J6 C9", _dashboard_sql(True))
def daily_dashboard(t):
    return _dashboard(t, True)


@query("J6 C9", _dashboard_sql(False))
def daily_dashboard_joined_totals(t):
    return _dashboard(t, False)


@query(
    "J8",
    """SELECT DISTINCT v.claim_id FROM v_validation v WHERE NOT EXISTS
(SELECT 1 FROM v_decisions d WHERE d.claim_id = v.claim_id AND d.is_active AND d.proposed_status = 'approve')""",
)
def validated_without_decision(t):
    approved = t.decisions.filter("proposed_status = 'approve'")
    return rel.unvalidated(t.validation, approved)


@query(
    "J9",
    """SELECT c.status, count(*) FILTER (WHERE d.claim_id IS NULL) AS without_documents,
  count(*) FILTER (WHERE d.claim_id IS NOT NULL) AS with_documents
FROM v_claims c LEFT JOIN (SELECT DISTINCT claim_id FROM v_documents) d USING (claim_id) GROUP BY c.status""",
)
def claims_by_document_presence(t):
    none = rel.claims_without_documents(t.claims, t.documents).withColumn("n", F.lit(0))
    some = rel.claims_with_documents(t.claims, t.documents).withColumn("n", F.lit(1))
    return none.unionByName(some).groupBy("status").agg(
        F.count_if(F.col("n") == 0).alias("without_documents"),
        F.count_if(F.col("n") == 1).alias("with_documents"),
    )


@query(
    "A3 X3",
    """SELECT count(*) AS total_validations,
  count(*) FILTER (WHERE d.proposed_status = v.actual_status) AS accurate_predictions,
  round(count(*) FILTER (WHERE d.proposed_status = v.actual_status) * 100.0::DOUBLE / count(*), 2) AS accuracy_percentage,
  round(CAST(sum(d.proposed_benefit_amount - v.actual_paid_amount) AS DOUBLE) / count(*), 2) AS avg_amount_difference,
  round(CAST(sum(abs(d.proposed_benefit_amount - v.actual_paid_amount)) AS DOUBLE) / count(*), 2) AS avg_absolute_difference
FROM v_validation v JOIN v_decisions d ON d.decision_id = v.decision_id
WHERE v.actual_decision_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND d.is_active""",
)
def decision_accuracy(t):
    return rel.decision_accuracy(t.decisions, t.validation, "1996-01-01", "2000-12-31")


@query(
    "A4",
    f"""SELECT batch_id, count(*) AS claim_count, count(*) FILTER (WHERE status IN ('completed', 'failed')) AS processed_count,
  count(*) FILTER (WHERE status = 'completed') AS successful_count, count(*) FILTER (WHERE status = 'failed') AS failed_count,
  {ts("min(scheduled_at)", "started_at")}, {ts("max(completed_at)", "completed_at")},
  CASE WHEN count(*) FILTER (WHERE status = 'failed') = count(*) THEN 'failed'
    WHEN count(*) FILTER (WHERE status IN ('completed', 'failed')) = count(*) THEN 'completed'
    WHEN count(*) FILTER (WHERE status = 'processing') > 0 THEN 'processing' ELSE 'pending' END AS status
FROM v_queue GROUP BY batch_id""",
)
def batch_status(t):
    return stamps(rel.batch_status(t.queue), "started_at", "completed_at")


@query(
    "A29",
    """WITH q AS (SELECT *, epoch_us(completed_at) - epoch_us(started_at) AS us FROM v_queue)
SELECT batch_id, count(*) AS claim_count, count(*) FILTER (WHERE status = 'completed') AS successful_count,
  count(*) FILTER (WHERE status = 'failed') AS failed_count, sum(us) / 1e6 AS total_seconds, avg(us) / 1e6 AS avg_seconds,
  min(us) / 1e6 AS min_seconds, max(us) / 1e6 AS max_seconds,
  (epoch_us(max(completed_at)) - epoch_us(min(started_at))) / 1e6 AS elapsed_seconds,
  count(*) FILTER (WHERE status = 'completed') * 100.0::DOUBLE / count(*) AS success_rate,
  count(*) * 60.0::DOUBLE / ((epoch_us(max(completed_at)) - epoch_us(min(started_at))) / 1e6) AS claims_per_minute
FROM q GROUP BY batch_id""",
)
def batch_performance(t):
    return rel.batch_performance(t.queue)


@query(
    "A30 X3",
    f"""SELECT claim_id, {ts("created_at")} FROM v_claims WHERE status = 'completed' AND created_at < TIMESTAMP '{CUTOFF}'""",
)
def archive_candidates(t):
    return stamps(rel.archive_candidates(t.claims, CUTOFF), "created_at")


@query(
    "A30",
    f"""SELECT count(*) AS archived_count, min(claim_id) AS first_claim_id, max(claim_id) AS last_claim_id
FROM v_claims WHERE status = 'completed' AND created_at < TIMESTAMP '{CUTOFF}'""",
)
def archive_summary(t):
    return rel.archive_summary(rel.archive_candidates(t.claims, CUTOFF))


@query(
    "A32",
    """SELECT count(*) AS claims, count(k.claim_id) AS has_documents, count(d.claim_id) AS has_decision,
  count(v.claim_id) AS has_validation, count(*) FILTER (WHERE d.claim_id IS NOT NULL AND v.claim_id IS NOT NULL) AS verified_claims
FROM v_claims c LEFT JOIN (SELECT DISTINCT claim_id FROM v_documents) k USING (claim_id)
LEFT JOIN (SELECT DISTINCT claim_id FROM v_decisions WHERE is_active) d USING (claim_id)
LEFT JOIN (SELECT DISTINCT claim_id FROM v_validation) v USING (claim_id)""",
)
def table_coverage(t):
    return rel.coverage(t.claims, t.documents, t.decisions, t.validation)


@query(
    "A33",
    """SELECT version, (SELECT count(*) FROM v_decisions d WHERE d.engine_version = l.version) AS affected_decision_count
FROM (SELECT DISTINCT 'v2.' || CAST(CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS VARCHAR) || '.0' AS version FROM orders) l""",
)
def rules_version_impact(t):
    changelog = t.orders.select(
        F.concat(
            F.lit("v2."),
            (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string"),
            F.lit(".0"),
        ).alias("version")
    ).distinct()
    return rel.affected_decisions(t.decisions, changelog)


@query(
    "A27",
    """SELECT count(*) AS decisions, count(*) FILTER (WHERE proposed_status = 'approve') AS approvals,
  count(*) FILTER (WHERE proposed_status = 'deny') AS denials,
  count(*) FILTER (WHERE proposed_status = 'approve') * 100.0::DOUBLE / count(*) AS approval_rate,
  count(*) FILTER (WHERE proposed_status = 'deny') * 100.0::DOUBLE / count(*) AS denial_rate,
  CAST(sum(proposed_benefit_amount) FILTER (WHERE proposed_status = 'approve') AS DOUBLE) AS approved_amount,
  avg(confidence_score) AS avg_confidence FROM v_decisions WHERE is_active""",
)
def decision_rates(t):
    return rel.decision_rates(t.decisions.filter("is_active"))


@query(
    "A28 R11",
    """WITH o AS (SELECT strftime(override_timestamp, 'batch_%Y_%m_%d') AS batch_id,
  CASE WHEN NOT system_should_be_included AND user_should_be_included THEN 'denied_to_approved'
    WHEN system_should_be_included AND NOT user_should_be_included THEN 'approved_to_denied' ELSE 'unchanged' END AS direction,
  list_filter([CASE WHEN is_rent THEN 'is_rent' END, CASE WHEN is_cleaning THEN 'is_cleaning' END,
    CASE WHEN is_repair THEN 'is_repair' END, CASE WHEN is_damage THEN 'is_damage' END], lambda x: x IS NOT NULL) AS tags
  FROM v_overrides WHERE NOT is_applied_to_rules)
SELECT batch_id, direction, category, count(*) AS overrides FROM (SELECT batch_id, direction,
  unnest(CASE WHEN len(tags) = 0 THEN ['none'] ELSE tags END) AS category FROM o) GROUP BY ALL""",
)
def override_patterns(t):
    return rel.override_analysis(t.overrides)


LATEST_DECISION_SQL = """SELECT * FROM v_decisions WHERE is_active
QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY decided_at DESC, decision_id DESC) = 1"""


@query(
    "W1 X3",
    f"""SELECT claim_id, decision_id, decision_type, proposed_status,
  CAST(proposed_benefit_amount AS DOUBLE) AS proposed_benefit_amount, confidence_score, {ts("decided_at")}
FROM ({LATEST_DECISION_SQL})""",
)
def latest_active_decision(t):
    latest = rel.latest_active_decision(t.decisions)
    return stamps(latest, "decided_at").select(
        "claim_id", "decision_id", "decision_type", "proposed_status",
        as_double("proposed_benefit_amount").alias("proposed_benefit_amount"),
        "confidence_score", "decided_at",
    )


@query(
    "W2",
    """SELECT claim_id, validation_id, actual_status, CAST(actual_paid_amount AS DOUBLE) AS actual_paid_amount,
  CAST(actual_decision_date AS VARCHAR) AS actual_decision_date FROM v_validation
QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY actual_decision_date DESC, validation_id DESC) = 1""",
)
def latest_validation(t):
    return rel.latest_validation(t.validation).select(
        "claim_id", "validation_id", "actual_status",
        as_double("actual_paid_amount").alias("actual_paid_amount"),
        F.col("actual_decision_date").cast("string").alias("actual_decision_date"),
    )


@query(
    "W3 X4",
    """SELECT decision_id, claim_id, lead(decision_id) OVER w AS superseded_by,
  lead(decision_id) OVER w IS NULL AS is_active FROM v_decisions
WINDOW w AS (PARTITION BY claim_id ORDER BY decided_at, decision_id)""",
)
def supersede_chain(t):
    raw = t.decisions.drop("superseded_by", "is_active")
    return rel.supersede_chain(raw).select(
        "decision_id", "claim_id", "superseded_by", "is_active"
    )


@query(
    "S8 L5",
    """WITH a AS (SELECT decision_id, claim_id, decided_at, engine_version FROM v_decisions
  UNION ALL SELECT claim_id * 10 + 9, claim_id, TIMESTAMP '2002-01-01', 'v3.0.0' FROM v_claims WHERE status = 'pending'),
b AS (SELECT engine_version, lead(decision_id) OVER (PARTITION BY claim_id ORDER BY decided_at, decision_id) IS NULL AS is_active FROM a)
SELECT engine_version, is_active, count(*) AS decisions FROM b GROUP BY ALL""",
)
def appended_decisions(t):
    cols = ["decision_id", "claim_id", "decided_at", "engine_version"]
    new = t.claims.filter("status = 'pending'").select(
        (F.col("claim_id") * 10 + 9).alias("decision_id"), "claim_id",
        F.lit("2002-01-01").cast("timestamp_ntz").alias("decided_at"),
        F.lit("v3.0.0").alias("engine_version"),
    )
    return (
        rel.append_decisions(t.decisions.select(*cols), new)
        .groupBy("engine_version", "is_active")
        .agg(F.count(F.lit(1)).alias("decisions"))
    )


@query(
    "W14 J12 U2",
    """SELECT claim_id, line_no, line_number, part_id, CAST(amount AS DOUBLE) AS amount FROM (SELECT *,
  row_number() OVER (PARTITION BY claim_id ORDER BY line_number, part_id, supp_id, ship_date, price, qty, discount, tax) AS line_no
FROM v_items)""",
)
def numbered_lines(t):
    return rel.number_lines(t.items).select(
        "claim_id", "line_no", "line_number", "part_id", as_double("amount").alias("amount")
    )


@query(
    "U1",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM v_{n}"
        for n in ("claims", "documents", "decisions", "validation", "queue", "overrides")
    ),
)
def table_row_counts(t):
    names = ("claims", "documents", "decisions", "validation", "queue", "overrides")
    return rel.table_counts({n: getattr(t, n) for n in names})


@query("U3", "SELECT DISTINCT batch_id, claim_id FROM v_queue ORDER BY batch_id, claim_id")
def batch_claim_ids(t):
    return rel.batch_claims(t.queue).orderBy("batch_id", "claim_id")


@query(
    "T5",
    """SELECT claim_id, rank, description, CAST(amount AS DOUBLE) AS amount FROM (SELECT *, row_number() OVER
(PARTITION BY claim_id ORDER BY amount DESC, line_number, part_id, supp_id, ship_date, qty) AS rank FROM v_items) WHERE rank <= 5""",
)
def top_items_per_claim(t):
    order = [F.desc("amount"), *[F.asc(c) for c in ("line_number", "part_id", "supp_id", "ship_date", "qty")]]
    return rel.first_per_group(t.items, ["claim_id"], order, 5).select(
        "claim_id", "rank", "description", as_double("amount").alias("amount")
    )


@query(
    "S5 L5",
    """WITH u AS (SELECT claim_id, claim_tracking_number, CAST(claim_amount + 5 AS DECIMAL(12,2)) AS claim_amount, 'updated' AS status, created_at
  FROM v_claims WHERE status = 'pending'
  UNION ALL SELECT claim_id, claim_tracking_number, CAST(claim_amount + 9 AS DECIMAL(12,2)), 'updated', created_at FROM v_claims WHERE status = 'pending' AND priority = 1
  UNION ALL SELECT claim_id + 100000000, 'NEW-' || claim_tracking_number, claim_amount, 'new', created_at FROM v_claims WHERE priority = 2),
l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY claim_tracking_number ORDER BY claim_amount DESC NULLS LAST) = 1)
SELECT coalesce(c.claim_id, l.claim_id) AS claim_id, coalesce(c.claim_tracking_number, l.claim_tracking_number) AS claim_tracking_number,
  CAST(CASE WHEN l.claim_id IS NOT NULL THEN l.claim_amount ELSE c.claim_amount END AS DOUBLE) AS claim_amount,
  CASE WHEN c.claim_id IS NOT NULL THEN c.status ELSE l.status END AS status,
  CAST(CASE WHEN c.claim_id IS NOT NULL AND l.claim_id IS NOT NULL THEN TIMESTAMP '2024-03-01 00:00:00' WHEN c.claim_id IS NOT NULL THEN c.created_at
    ELSE l.created_at END AS VARCHAR) AS updated_at
FROM v_claims c FULL JOIN l USING (claim_tracking_number)""",
)
def upserted_claims(t):
    base = t.claims.select(
        "claim_id", "claim_tracking_number", "claim_amount", "status", F.col("created_at").alias("updated_at")
    )
    pending = t.claims.filter("status = 'pending'")

    def raised(df, extra):
        return df.select(
            "claim_id", "claim_tracking_number",
            (F.col("claim_amount") + extra).cast("decimal(12,2)").alias("claim_amount"),
            F.lit("updated").alias("status"), F.col("created_at").alias("updated_at"),
        )

    new = t.claims.filter("priority = 2").select(
        (F.col("claim_id") + 100000000).alias("claim_id"),
        F.concat(F.lit("NEW-"), "claim_tracking_number").alias("claim_tracking_number"),
        "claim_amount", F.lit("new").alias("status"), F.col("created_at").alias("updated_at"),
    )
    updates = raised(pending, 5).unionByName(raised(pending.filter("priority = 1"), 9)).unionByName(new)
    merged = rel.upsert(
        base, updates, ["claim_tracking_number"], ["claim_amount"], ["claim_amount"], "2024-03-01 00:00:00"
    )
    return merged.withColumns(
        {"claim_amount": as_double("claim_amount"), "updated_at": F.col("updated_at").cast("string")}
    )


@query(
    "S9",
    """SELECT c.claim_id, v.actual_status AS proposed_status, CAST(v.actual_paid_amount AS DOUBLE) AS proposed_benefit_amount,
  CAST(coalesce(c.claim_amount, v.actual_paid_amount) AS DOUBLE) AS invoice_total, CAST(c.max_benefit AS DOUBLE) AS cap_amount,
  'validation_based_v1.0' AS engine_version FROM v_claims c JOIN v_validation v USING (claim_id)
WHERE NOT EXISTS (SELECT 1 FROM v_decisions d WHERE d.claim_id = c.claim_id AND d.is_active AND d.engine_version = 'v2.0.0')""",
)
def backfilled_decisions(t):
    old = t.decisions.filter("engine_version = 'v2.0.0'")
    filled = rel.backfill_decisions(t.claims, t.validation, old)
    return filled.select(
        "claim_id", "proposed_status",
        *[as_double(c).alias(c) for c in ("proposed_benefit_amount", "invoice_total", "cap_amount")],
        "engine_version",
    )


@query(
    "L6",
    """SELECT 'claims.negative_amount' AS rule, count(*) FILTER (WHERE claim_amount < 0) AS violations FROM v_claims
UNION ALL SELECT 'claims.negative_benefit', count(*) FILTER (WHERE max_benefit < 0) FROM v_claims
UNION ALL SELECT 'claims.missing_amount', count(*) FILTER (WHERE claim_amount IS NULL) FROM v_claims
UNION ALL SELECT 'claims.status_domain', count(*) FILTER (WHERE status NOT IN ('pending', 'processing', 'completed', 'failed', 'cancelled')) FROM v_claims
UNION ALL SELECT 'claim_documents.confidence_range', count(*) FILTER (WHERE NOT classification_confidence BETWEEN 0 AND 100) FROM v_documents
UNION ALL SELECT 'claim_documents.ocr_range', count(*) FILTER (WHERE NOT ocr_confidence BETWEEN 0 AND 100) FROM v_documents
UNION ALL SELECT 'claim_documents.page_count', count(*) FILTER (WHERE page_count <= 0) FROM v_documents
UNION ALL SELECT 'claim_documents.file_size', count(*) FILTER (WHERE file_size_bytes <= 0) FROM v_documents
UNION ALL SELECT 'decisions.benefit_over_cap', count(*) FILTER (WHERE proposed_benefit_amount > cap_amount) FROM v_decisions
UNION ALL SELECT 'decisions.confidence_range', count(*) FILTER (WHERE NOT confidence_score BETWEEN 0 AND 100) FROM v_decisions
UNION ALL SELECT 'decisions.type_domain', count(*) FILTER (WHERE decision_type NOT IN ('automated', 'manual_override', 'appeal', 'reprocessed', 'initial', 'reconsideration')) FROM v_decisions
UNION ALL SELECT 'claims.unique_claim_tracking_number', count(*) FROM (SELECT claim_tracking_number FROM v_claims GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'claim_documents.unique_claim_id_file_hash', count(*) FROM (SELECT claim_id, file_hash FROM v_documents GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'decision_validation.unique_claim_id_actual_decision_date', count(*) FROM (SELECT claim_id, actual_decision_date FROM v_validation GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'claim_documents.fk_claim', count(*) FROM v_documents WHERE claim_id NOT IN (SELECT claim_id FROM v_claims)
UNION ALL SELECT 'decisions.fk_claim', count(*) FROM v_decisions WHERE claim_id NOT IN (SELECT claim_id FROM v_claims)""",
)
def constraint_report(t):
    return rel.constraint_report(t.claims, t.documents, t.decisions, t.validation)


@query(
    "C11",
    "SELECT doc_id, substr(text, 1, 100) AS text_preview FROM documents",
)
def text_previews(t):
    return t.raw("documents").select(
        "doc_id", text_preview(F.col("text")).alias("text_preview")
    )


_UNKNOWN = f"PROP-{zlib.crc32(b'unknown') % 10000}"


@query(
    "C5 C6 C7 C8",
    f"""SELECT o_orderkey AS claim_id,
  CASE WHEN o_orderkey % 5 < 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS claim_date,
  CASE WHEN o_orderkey % 6 < 2 THEN 0.0 WHEN o_orderkey % 6 = 2 THEN CAST(-o_custkey AS DOUBLE) ELSE o_custkey * 1000 + 0.5 END AS amount,
  CASE WHEN o_orderstatus = 'O' THEN 'deny' ELSE 'approve' END AS status,
  CASE o_orderkey % 7 WHEN 0 THEN '{_UNKNOWN}' WHEN 1 THEN '12_Main_St_' || o_custkey || '-WA-98101'
    ELSE '12_Main_St_' || o_custkey || '-Oak Town-WA-98101' END AS property_id
FROM orders""",
)
def cleaned_claim_cells(t):
    return t.cells.select(
        "claim_id",
        text.parse_date(F.col("date_text")).cast("string").alias("claim_date"),
        as_double(text.parse_currency(F.col("money_text"))).alias("amount"),
        text.normalize_status(F.col("status_text")).alias("status"),
        text.build_property_id(*(F.col(c) for c in ("address", "city", "state", "zip_code"))).alias("property_id"),
    )
