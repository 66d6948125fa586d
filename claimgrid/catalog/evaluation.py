"""Decisions against outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrid.catalog import query
from claimgrid.functions.text import as_double
from claimgrid.operators import evaluation as ev

PAIRS = """pairs AS (SELECT d.claim_id, c.claim_tracking_number, d.proposed_status, d.proposed_benefit_amount AS p,
  d.flags, d.missing_data, d.confidence_score, d.engine_version, d.processing_time_ms, v.actual_status, v.actual_paid_amount AS a,
  CASE WHEN d.proposed_status = 'approve' AND v.actual_status = 'approve' THEN d.proposed_benefit_amount - v.actual_paid_amount END AS gap
FROM v_decisions d JOIN v_claims c ON d.claim_id = c.claim_id JOIN v_validation v ON d.claim_id = v.claim_id WHERE d.is_active)"""
BASE = """base AS (SELECT d.claim_id, d.proposed_status, d.proposed_benefit_amount AS p, d.confidence_score, d.engine_version,
  v.actual_status, v.actual_paid_amount AS a, abs(d.proposed_benefit_amount - v.actual_paid_amount) AS diff,
  d.proposed_status = v.actual_status AS ok
FROM (SELECT * FROM v_decisions WHERE is_active QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY decided_at DESC, decision_id DESC) = 1) d
LEFT JOIN (SELECT * FROM v_validation QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY actual_decision_date DESC, validation_id DESC) = 1) v
  USING (claim_id))"""
METRICS = f"""{PAIRS}, m0 AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE proposed_status = 'approve' AND actual_status = 'approve') AS tp,
  count(*) FILTER (WHERE proposed_status <> 'approve' AND actual_status <> 'approve') AS tn,
  count(*) FILTER (WHERE proposed_status = 'approve' AND actual_status <> 'approve') AS fp,
  count(*) FILTER (WHERE proposed_status <> 'approve' AND actual_status = 'approve') AS fn,
  CAST(sum(abs(gap)) AS DOUBLE) AS sabs, avg(CAST(gap AS DOUBLE) * CAST(gap AS DOUBLE)) AS mse,
  avg(abs(CAST(gap AS DOUBLE) / CAST(a AS DOUBLE))) FILTER (WHERE a <> 0) AS mape,
  CAST(sum(p) FILTER (WHERE proposed_status = 'approve') AS DOUBLE) AS sp,
  CAST(sum(a) FILTER (WHERE actual_status = 'approve') AS DOUBLE) AS sa,
  avg(CASE WHEN json_array_length(missing_data, '$.fields') > 0 THEN 0.0 ELSE 1.0 END) AS complete,
  avg(CASE WHEN contains(lower(flags), 'manual') THEN 1.0 ELSE 0.0 END) AS manual,
  avg(confidence_score) AS conf, avg(processing_time_ms) AS ms,
  count(*) FILTER (WHERE proposed_status <> actual_status) AS sm,
  count(*) FILTER (WHERE gap > 50) AS over50, count(*) FILTER (WHERE gap < -50) AS under50 FROM pairs),
m1 AS (SELECT *, (tp + tn)::DOUBLE / n AS acc, tp::DOUBLE / (tp + fp) AS prec, tp::DOUBLE / (tp + fn) AS rec,
  sabs / tp AS mae, sqrt(mse) AS rmse, sp / (tp + fp) AS mp, sa / (tp + fn) AS ma FROM m0),
m AS (SELECT n AS total_claims, tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
  acc AS accuracy, prec AS precision, rec AS recall, 2 * prec * rec / (prec + rec) AS f1_score, round(mae, 6) AS mean_absolute_error,
  round(rmse, 6) AS root_mean_squared_error, round(mape, 6) AS mean_absolute_percentage_error, mp AS avg_proposed_benefit,
  ma AS avg_actual_benefit, abs(mp - ma) / ma AS bias_magnitude,
  CASE WHEN abs(mp - ma) < ma * 0.05 THEN 'neutral' WHEN mp > ma THEN 'more_generous' ELSE 'less_generous' END AS bias_direction,
  round(complete, 6) AS complete_data_rate, round(manual, 6) AS manual_review_rate, round(conf, 6) AS avg_confidence_score,
  round(ms, 6) AS avg_processing_time_ms, sm AS status_mismatches, over50 AS amount_over_by_50_plus, under50 AS amount_under_by_50_plus FROM m1)"""
ROUNDED = [
    "mean_absolute_error", "root_mean_squared_error", "mean_absolute_percentage_error",
    "complete_data_rate", "manual_review_rate", "avg_confidence_score", "avg_processing_time_ms",
]


def _pairs(t):
    return ev.evaluation_set(t.decisions, t.claims, t.validation)


def _metrics(t):
    return ev.evaluation_metrics(_pairs(t)).withColumns({c: F.round(c, 6) for c in ROUNDED})


def _base(t):
    return ev.variance_base(t.decisions, t.validation)


@query(
    "J7",
    """SELECT d.claim_id, d.decision_id, c.claim_tracking_number, d.proposed_status, CAST(d.proposed_benefit_amount AS DOUBLE) AS proposed_benefit_amount,
  v.actual_status, CAST(v.actual_paid_amount AS DOUBLE) AS actual_paid_amount
FROM v_decisions d JOIN v_claims c USING (claim_id) JOIN v_validation v USING (claim_id)
WHERE d.is_active AND d.engine_version = 'v2.1.0' AND d.decided_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'""",
)
def evaluation_pairs(t):
    pairs = ev.evaluation_set(
        t.decisions, t.claims, t.validation, "v2.1.0", "1996-01-01", "2000-12-31"
    )
    return pairs.select(
        "claim_id", "decision_id", "claim_tracking_number", "proposed_status",
        as_double("proposed_benefit_amount").alias("proposed_benefit_amount"), "actual_status",
        as_double("actual_paid_amount").alias("actual_paid_amount"),
    )


@query("A5 A6 A7 A8 A9", f"WITH {METRICS} SELECT * FROM m")
def evaluation_metrics(t):
    return _metrics(t)


@query("A6", f"WITH {PAIRS} SELECT median(CAST(abs(gap) AS DOUBLE)) AS median_absolute_error FROM pairs WHERE gap IS NOT NULL")
def median_absolute_error(t):
    return ev.median_absolute_error(_pairs(t))


MISMATCH = f"""{PAIRS}, x AS (SELECT *, proposed_status = actual_status AS status_match, coalesce(gap, 0) AS difference FROM pairs),
mm AS (SELECT *, CASE WHEN status_match THEN 'amount_only' ELSE 'status_only' END AS mismatch_type,
  CASE WHEN NOT status_match AND proposed_status = 'deny' AND actual_status = 'approve' THEN 'False negative: System too restrictive or missing eligible items'
    WHEN NOT status_match THEN 'False positive: System approved ineligible charges'
    WHEN difference > 100 THEN 'Amount too high: Possible eligibility over-classification or cap miscalculation'
    WHEN difference < -100 THEN 'Amount too low: Missing eligible items or incorrect cap'
    WHEN difference <> 0 THEN 'Minor amount difference: Likely due to rounding or line item interpretation' ELSE 'Unknown' END AS likely_cause,
  abs(difference) > 100 OR NOT status_match AS needs_review FROM x WHERE NOT status_match OR abs(difference) >= 50)"""


@query(
    "A10",
    f"""WITH {MISMATCH} SELECT claim_id, claim_tracking_number, proposed_status, actual_status, CAST(p AS DOUBLE) AS proposed_benefit_amount,
  CAST(a AS DOUBLE) AS actual_paid_amount, CAST(difference AS DOUBLE) AS difference, mismatch_type, likely_cause, needs_review,
  CASE WHEN contains(flags, 'Manual') THEN 'Manual_review_needed,rerun' WHEN contains(flags, 'no_eligible') THEN 'no_eligible_charges' ELSE '' END AS flags
FROM mm""",
)
def mismatch_records(t):
    return ev.mismatches(_pairs(t)).select(
        "claim_id", "claim_tracking_number", "proposed_status", "actual_status",
        *[as_double(c).alias(c) for c in ("proposed_benefit_amount", "actual_paid_amount", "difference")],
        "mismatch_type", "likely_cause", "needs_review",
        F.array_join("flag_list", ",").alias("flags"),
    )


@query(
    "A11",
    f"""WITH {MISMATCH}, s AS (SELECT CASE WHEN mismatch_type = 'amount_only' THEN CASE WHEN difference > 0 THEN 'over' ELSE 'under' END
    WHEN proposed_status = 'approve' THEN 'false_positive' ELSE 'false_negative' END AS side, likely_cause, count(*) AS occurrences FROM mm GROUP BY ALL)
SELECT side, likely_cause, occurrences, row_number() OVER (PARTITION BY side ORDER BY occurrences DESC, likely_cause) AS rank FROM s
QUALIFY rank <= 5""",
)
def mismatch_causes(t):
    return ev.top_causes(ev.mismatches(_pairs(t)))


@query(
    "A11",
    f"""WITH {MISMATCH} SELECT count(*) FILTER (WHERE mismatch_type = 'status_only') AS status_disagreements,
  count(*) FILTER (WHERE mismatch_type = 'amount_only') AS amount_disagreements,
  count(*) FILTER (WHERE mismatch_type = 'amount_only' AND difference > 0) AS over_estimates,
  coalesce(CAST(sum(difference) FILTER (WHERE mismatch_type = 'amount_only' AND difference > 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE mismatch_type = 'amount_only' AND difference > 0), 0), 0) AS avg_over,
  count(*) FILTER (WHERE mismatch_type = 'amount_only' AND difference < 0) AS under_estimates,
  coalesce(CAST(sum(-difference) FILTER (WHERE mismatch_type = 'amount_only' AND difference < 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE mismatch_type = 'amount_only' AND difference < 0), 0), 0) AS avg_under,
  count(*) FILTER (WHERE mismatch_type = 'amount_only' AND abs(difference) > 100) AS large_errors FROM mm""",
)
def mismatch_summary(t):
    return ev.mismatch_summary(ev.mismatches(_pairs(t)))


RUN_COLS = """count(*) AS total_claims, count(*) FILTER (WHERE ok) AS status_matches, CAST(sum(p) AS DOUBLE) AS total_proposed_amount,
  CAST(coalesce(sum(a), 0) AS DOUBLE) AS total_actual_amount, CAST(sum(abs(p - a)) AS DOUBLE) / count(a) AS mean_absolute_error,
  CAST(max(abs(p - a)) AS DOUBLE) AS max_absolute_error, CAST(min(abs(p - a)) AS DOUBLE) AS min_absolute_error,
  count(*) FILTER (WHERE ok)::DOUBLE / count(*) AS status_accuracy,
  CAST(coalesce(sum(a), 0) AS DOUBLE) - CAST(sum(p) AS DOUBLE) AS total_variance, CAST(sum(p) AS DOUBLE) / count(*) AS avg_proposed_amount,
  CAST(coalesce(sum(a), 0) AS DOUBLE) / count(*) FILTER (WHERE ok) AS avg_actual_amount"""
RUNS = """runs AS (SELECT d.engine_version AS run_id, d.claim_id, d.proposed_benefit_amount AS p, v.actual_paid_amount AS a,
  d.proposed_status = v.actual_status AS ok FROM v_decisions d
LEFT JOIN (SELECT * FROM v_validation QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY actual_decision_date DESC, validation_id DESC) = 1) v USING (claim_id))"""


def _runs(t):
    from claimgrid.operators.relational import latest_validation

    outcome = latest_validation(t.validation).select("claim_id", "actual_status", "actual_paid_amount")
    return t.decisions.join(outcome, "claim_id", "left").select(
        F.col("engine_version").alias("run_id"), "claim_id", "proposed_status",
        F.col("proposed_benefit_amount").alias("proposed_amount"), "actual_status",
        F.col("actual_paid_amount").alias("actual_amount"),
    )


@query("A12", f"WITH {RUNS} SELECT run_id, {RUN_COLS} FROM runs GROUP BY run_id")
def run_metrics(t):
    return ev.run_metrics(_runs(t), ["run_id"])


_NAMES = ["status_accuracy", "mean_absolute_error", "avg_proposed_amount", "avg_actual_amount"]


@query(
    "A13",
    f"""WITH {RUNS}, g AS (SELECT run_id, {RUN_COLS} FROM runs GROUP BY run_id)
SELECT {", ".join(f"n.{c} AS new_{c}, o.{c} AS previous_{c}, n.{c} - o.{c} AS {c}_change" for c in _NAMES)}
FROM g n, g o WHERE n.run_id = 'v2.1.0' AND o.run_id = 'v2.0.0'""",
)
def run_comparison(t):
    return ev.compare_runs(_runs(t), "v2.1.0", "v2.0.0")


@query(
    "A14 J10",
    f"""WITH {BASE} SELECT count(*) AS claims, count(*) FILTER (WHERE ok) AS status_matches,
  count(*) FILTER (WHERE ok) * 100.0::DOUBLE / count(*) AS status_accuracy, CAST(sum(p) AS DOUBLE) AS total_proposed,
  CAST(sum(a) AS DOUBLE) AS total_actual, CAST(sum(diff) AS DOUBLE) AS total_variance, CAST(sum(diff) AS DOUBLE) / count(*) AS mean_absolute_error,
  round(avg(CAST(diff AS DOUBLE) / CAST(a AS DOUBLE) * 100) FILTER (WHERE a > 0), 6) AS mean_percentage_error,
  count(*) FILTER (WHERE diff > 0.01) AS amount_variances,
  count(*) FILTER (WHERE proposed_status = 'approve' AND actual_status = 'deny') AS false_positives,
  count(*) FILTER (WHERE proposed_status = 'deny' AND actual_status = 'approve') AS false_negatives
FROM base WHERE actual_status IS NOT NULL""",
)
def variance_summary(t):
    return ev.variance_summary(_base(t)).withColumn(
        "mean_percentage_error", F.round("mean_percentage_error", 6)
    )


@query(
    "A14 J10",
    f"""WITH {BASE} SELECT claim_id, proposed_status, actual_status, CAST(p AS DOUBLE) AS proposed_benefit_amount,
  CAST(a AS DOUBLE) AS actual_paid_amount, CAST(diff AS DOUBLE) AS difference,
  CASE WHEN ok THEN 'amount_variance' WHEN proposed_status = 'approve' THEN 'false_positive' ELSE 'false_negative' END AS tag
FROM base WHERE actual_status IS NOT NULL AND (NOT ok OR diff > 0.01)""",
)
def variance_rows(t):
    return ev.variance_rows(_base(t)).select(
        "claim_id", "proposed_status", "actual_status",
        *[as_double(c).alias(c) for c in ("proposed_benefit_amount", "actual_paid_amount", "difference")],
        "tag",
    )


@query(
    "A15",
    f"""WITH {BASE}, x AS (SELECT CAST(diff AS DOUBLE) AS x FROM base WHERE actual_status IS NOT NULL),
s AS (SELECT min(x) AS lo, max(x) AS hi, least(10, count(*)) AS bins FROM x),
c AS (SELECT least(CAST(floor((x - lo) / (hi - lo) * bins) AS BIGINT), bins - 1) AS bin, count(*) AS claims FROM x, s GROUP BY ALL)
SELECT g.bin, lo + g.bin * ((hi - lo) / bins) AS bin_start, lo + (g.bin + 1) * ((hi - lo) / bins) AS bin_end, coalesce(claims, 0) AS claims
FROM s, (SELECT unnest(generate_series(0, 9)) AS bin) g LEFT JOIN c ON c.bin = g.bin WHERE g.bin < bins""",
)
def variance_histogram(t):
    return ev.histogram(_base(t).filter(F.col("actual_status").isNotNull()), "difference")


@query(
    "A16",
    f"""WITH {BASE} SELECT CAST(floor(confidence_score / 10) * 10 AS BIGINT) AS confidence_band, count(*) AS claims,
  count(*) FILTER (WHERE ok) AS matches, count(*) FILTER (WHERE ok)::DOUBLE / count(*) AS accuracy
FROM base WHERE actual_status IS NOT NULL GROUP BY 1""",
)
def accuracy_by_confidence(t):
    return ev.accuracy_by_confidence(_base(t))


@query(
    "A17",
    f"""WITH {BASE} SELECT round(count(*) FILTER (WHERE ok) * 100.0::DOUBLE / count(actual_status), 6) AS status_accuracy,
  round(CAST(sum(diff) AS DOUBLE) / count(actual_status), 6) AS mae,
  round(sum(CASE WHEN a > 0 THEN CAST(diff AS DOUBLE) / CAST(a AS DOUBLE) * 100 ELSE 0 END) / count(actual_status), 6) AS avg_percentage_error,
  count(actual_status) AS total_with_actual, count(*) AS total_decisions FROM base""",
)
def dashboard_kpis(t):
    kpis = ev.dashboard_kpis(_base(t))
    return kpis.withColumns(
        {c: F.round(c, 6) for c in ("status_accuracy", "mae", "avg_percentage_error")}
    )


@query(
    "A35",
    f"""WITH {METRICS}, r AS (
SELECT 'HIGH' AS priority, 'High False Positive Rate' AS issue, false_positives::DOUBLE AS value FROM m WHERE false_positives > false_negatives * 1.5
UNION ALL SELECT 'HIGH', 'High False Negative Rate', false_negatives FROM m WHERE false_negatives > false_positives * 1.5
UNION ALL SELECT 'HIGH', 'High Amount Variance', mean_absolute_error FROM m WHERE mean_absolute_error > 100
UNION ALL SELECT 'MEDIUM', 'High Percentage Error', mean_absolute_percentage_error FROM m WHERE mean_absolute_percentage_error > 0.10
UNION ALL SELECT 'MEDIUM', 'System Bias: ' || bias_direction, bias_magnitude FROM m WHERE bias_direction <> 'neutral' AND bias_magnitude > 0.05
UNION ALL SELECT 'MEDIUM', 'Low Confidence Scores', avg_confidence_score FROM m WHERE avg_confidence_score < 70
UNION ALL SELECT 'LOW', 'High Manual Review Rate', manual_review_rate FROM m WHERE manual_review_rate > 0.3
UNION ALL SELECT 'HIGH', 'Status accuracy below 80%', accuracy FROM m WHERE accuracy < 0.8)
SELECT * FROM r UNION ALL SELECT 'INFO', 'System Performing Well', NULL WHERE NOT EXISTS (SELECT 1 FROM r)""",
)
def recommendations(t):
    return ev.recommendations(_metrics(t))
