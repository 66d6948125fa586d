"""Claim decisions, stored items, overrides, what-if, responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrid.catalog import query
from claimgrid.catalog.items import RULED_CTE, sql_any, with_suggestions
from claimgrid.catalog.relational import LATEST_DECISION_SQL
from claimgrid.functions import jsonio
from claimgrid.functions.text import as_double
from claimgrid.operators import classify, decide
from claimgrid.operators.relational import number_lines
from claimgrid.plans.barrier import computed_once
from claimgrid.rules import fixed_values as fv

EXCLUDED = [p for phrases in fv.INVOICE_TOTAL_EXCLUSIONS.values() for p in phrases]
TOTALS = f"""{RULED_CTE},
totals0 AS (SELECT claim_id,
  coalesce(sum(amount) FILTER (WHERE NOT {sql_any("lower(description)", EXCLUDED)} AND amount >= 0), 0) AS invoice_total,
  coalesce(sum(amount) FILTER (WHERE should_be_included), 0) AS included_total,
  coalesce(sum(amount) FILTER (WHERE NOT should_be_included), 0) AS excluded_total,
  coalesce(sum(amount) FILTER (WHERE should_be_included AND amount >= 0), 0) AS charge_total,
  coalesce(sum(amount) FILTER (WHERE should_be_included AND amount < 0), 0) AS credit_total,
  count(*) AS line_item_count, count(*) FILTER (WHERE should_be_included) AS approved_items,
  count(*) FILTER (WHERE NOT should_be_included) AS ineligible_items, count(*) FILTER (WHERE amount < 0) AS credit_items,
  bool_and(is_cleaning) AS cleaning_only FROM ruled GROUP BY claim_id),
totals AS (SELECT *, invoice_total > 0 AND included_total > CAST(invoice_total * 1.5 AS DECIMAL(28,2)) AS eligible_capped,
  CASE WHEN invoice_total > 0 AND included_total > CAST(invoice_total * 1.5 AS DECIMAL(28,2))
    THEN CAST(invoice_total * 1.5 AS DECIMAL(28,2)) ELSE CAST(included_total AS DECIMAL(28,2)) END AS eligible_total FROM totals0)"""
PROFILE = """profile AS (SELECT claim_id, bool_or(document_type = 'addendum') AS has_addendum, bool_or(document_type = 'invoice') AS has_invoice,
  min(CASE WHEN classification_confidence = 0 THEN 100.0 ELSE classification_confidence END) AS document_confidence,
  count(*) FILTER (WHERE ocr_confidence < 50) AS low_ocr_documents, count(*) FILTER (WHERE document_type = 'invoice') AS invoice_count,
  count(*) AS document_count FROM v_documents GROUP BY claim_id)"""


def _decision_ctes(limit: str, source: str = "v_claims", mode: str = "production", extra: str = "") -> str:
    """Decision cascade in SQL; ``limit`` is the benefit limit expression over alias c."""
    none = "NULL" if mode == "backtest" else "CAST(0 AS DECIMAL(28,2))"
    return f"""{TOTALS}, {PROFILE},
i AS (SELECT c.claim_id, c.claim_tracking_number, CAST(c.claim_amount AS DECIMAL(28,2)) AS claim_amount, CAST({limit} AS DECIMAL(28,2)) AS lim{extra},
    c.lease_start_date IS NULL AS no_start, coalesce(t.invoice_total, 0) AS invoice_total, coalesce(t.eligible_total, 0) AS eligible_total,
    coalesce(t.charge_total, 0) AS charge_total, coalesce(t.credit_total, 0) AS credit_total,
    coalesce(t.line_item_count, 0) AS line_item_count, coalesce(t.approved_items, 0) AS approved_items, coalesce(t.ineligible_items, 0) AS ineligible_items, coalesce(t.credit_items, 0) AS credit_items,
    coalesce(t.eligible_capped, FALSE) AS eligible_capped, coalesce(p.has_addendum, FALSE) AS has_addendum, coalesce(p.has_invoice, FALSE) AS has_invoice,
    p.document_confidence AS dc, coalesce(p.document_confidence < 50, FALSE) AS low, coalesce(p.low_ocr_documents, 0) AS low_ocr,
    a.is_normal_wear_tear AS wear_all, a.has_eligible_charges AS some_eligible, a.denial_reason
  FROM {source} c LEFT JOIN totals t USING (claim_id) LEFT JOIN profile p USING (claim_id) LEFT JOIN v_analysis a USING (claim_id)),
b AS (SELECT *, CASE WHEN NOT has_addendum AND NOT low THEN 'missing_waiver_addendum' WHEN NOT has_invoice AND NOT low THEN 'missing_invoice'
    WHEN lim IS NULL THEN 'missing_max_benefit' WHEN eligible_total = 0 THEN 'no_eligible_charges' ELSE 'evaluated' END AS branch,
    CASE WHEN NOT has_invoice AND low AND invoice_total = 0 THEN coalesce(claim_amount, 0) ELSE invoice_total END AS raw FROM i),
u AS (SELECT *, claim_amount > 0 AND raw > claim_amount * 1.5 AS absurd,
    CASE WHEN claim_amount > 0 AND raw > claim_amount * 1.5 THEN CAST(claim_amount * 1.5 AS DECIMAL(28,2)) ELSE CAST(raw AS DECIMAL(28,2)) END AS used FROM b),
k AS (SELECT *, least(CASE WHEN claim_amount > 0 THEN claim_amount END, CASE WHEN lim > 0 THEN lim END, used) AS cap FROM u),
f AS (SELECT *, least(eligible_total, cap) AS benefit, concat_ws(',',
    CASE WHEN branch = 'missing_waiver_addendum' THEN 'addendum' WHEN branch = 'missing_invoice' THEN 'invoice' WHEN branch = 'missing_max_benefit' THEN 'max_benefit' END,
    CASE WHEN branch = 'evaluated' AND NOT has_addendum THEN 'addendum' END, CASE WHEN branch = 'evaluated' AND NOT has_invoice THEN 'invoice' END,
    CASE WHEN branch = 'evaluated' AND no_start THEN 'lease_start_date' END) AS fields FROM k),
g AS (SELECT *, CASE WHEN branch <> 'evaluated' THEN 100.0 WHEN low THEN greatest(50.0, 85.0 - CASE WHEN fields <> '' THEN 10 ELSE 0 END - (50.0 - dc) / 50.0 * 30)
    ELSE 85.0 - CASE WHEN fields <> '' THEN 10 ELSE 0 END END AS confidence_score,
  CASE WHEN branch = 'missing_max_benefit' THEN '{"pending" if mode == "backtest" else "deny"}' WHEN branch = 'evaluated' AND benefit > 0 THEN 'approve' ELSE 'deny' END AS proposed_status,
  CASE WHEN branch = 'missing_max_benefit' THEN {none} WHEN branch = 'evaluated' THEN benefit ELSE 0 END AS proposed_benefit_amount FROM f),
decided AS (SELECT *, CASE WHEN branch IN ('evaluated', 'no_eligible_charges') THEN cap END AS cap_amount,
  CASE WHEN branch <> 'evaluated' THEN branch ELSE '' END AS critical,
  concat_ws('|', CASE WHEN eligible_capped THEN 'eligible_total_sanity_check_applied: capped to $' || CAST(eligible_total AS VARCHAR) END,
    CASE WHEN low_ocr > 0 THEN 'low_ocr_confidence: ' || low_ocr || ' document(s) with OCR confidence < 50%' END,
    CASE WHEN wear_all AND NOT some_eligible AND eligible_total = 0 THEN 'document_analysis_suggests_all_normal_wear_tear' END,
    CASE WHEN wear_all AND some_eligible THEN 'document_analysis_suggests_some_normal_wear_tear' END,
    CASE WHEN denial_reason <> '' THEN 'document_analysis_advisory: ' || denial_reason END,
    CASE WHEN branch = 'evaluated' AND NOT has_addendum THEN 'addendum_not_confidently_detected' END,
    CASE WHEN branch = 'evaluated' AND NOT has_invoice THEN 'invoice_not_confidently_detected' END,
    CASE WHEN branch = 'evaluated' AND absurd THEN 'invoice_total_sanity_check_applied: capped to $' || CAST(used AS VARCHAR) END,
    CASE WHEN branch = 'evaluated' AND credit_items > 0 THEN 'credits_detected: ' || credit_items || ' credit items found' END,
    CASE WHEN branch = 'evaluated' AND no_start THEN 'Missing lease start date' END,
    CASE WHEN branch = 'evaluated' AND low THEN 'low_document_confidence_' || printf('%.1f', dc) || '%_reduces_decision_confidence_to_' || printf('%.1f', confidence_score) || '%' END) AS warnings,
  CASE WHEN branch = 'evaluated' AND (NOT has_addendum OR NOT has_invoice) THEN 'document_confidence_' || printf('%.1f', dc) || '%_may_affect_classification' ELSE '' END AS info,
  CASE branch WHEN 'missing_waiver_addendum' THEN 'Missing required waiver addendum' WHEN 'missing_invoice' THEN 'Missing required invoice'
    WHEN 'missing_max_benefit' THEN 'Cannot determine cap without max_benefit{" (backtest mode)" if mode == "backtest" else ""}'
    WHEN 'no_eligible_charges' THEN 'No eligible charges found'
    ELSE CASE WHEN proposed_status = 'approve' THEN 'Approved' ELSE 'Denied' END || ' $' || CAST(CAST(benefit AS DECIMAL(28,2)) AS VARCHAR) || ' benefit from $'
      || CAST(eligible_total AS VARCHAR) || ' eligible charges, capped at $' || CAST(CAST(cap AS DECIMAL(28,2)) AS VARCHAR) || '.' END AS summary,
  CASE WHEN NOT has_addendum THEN 'missing_waiver_addendum' WHEN NOT has_invoice THEN 'missing_invoice' WHEN coalesce(lim, 0) = 0 THEN 'missing_max_benefit'
    WHEN eligible_total = 0 THEN 'no_eligible_charges' WHEN proposed_benefit_amount > 0 THEN 'normal_approve' ELSE 'deny_other' END AS rule_branch FROM g)"""


DECIDED = _decision_ctes("nullif(c.max_benefit, 0)")


def analysis_of(t):
    def listed(name):
        return F.when(F.col(name) != "", F.array(name)).otherwise(F.array().cast("array<string>"))

    return t.analysis.withColumns(
        {
            "denial_reasons": listed("denial_reason"),
            "missing_information": listed("missing_information"),
        }
    )


def _inputs(t):
    return decide.claim_inputs(t.claims, with_suggestions(t.items), t.documents, analysis_of(t))


def adjudicate(t, mode="production"):
    return decide.evaluate_claims(
        t.claims, with_suggestions(t.items), t.documents, analysis_of(t), mode
    )


def flat(decided):
    return decided.select(
        "claim_id", "proposed_status",
        *[as_double(c).alias(c) for c in (
            "proposed_benefit_amount", "eligible_total", "invoice_total", "cap_amount")],
        "line_item_count", "approved_items", "confidence_score", "rule_branch",
        F.array_join("flags.critical", "|").alias("critical"),
        F.array_join("flags.warnings", "|").alias("warnings"),
        F.array_join("flags.info", "|").alias("info"),
        F.array_join("missing_data.fields", ",").alias("missing_fields"),
        F.col("reasoning.summary").alias("summary"),
        F.concat_ws(
            "|",
            *[F.coalesce(F.col("reasoning." + c), F.lit("-")) for c in (
                "eligible_total", "max_benefit", "final_amount", "key_metrics.invoice_total",
                "key_metrics.cap_amount")],
        ).alias("reasoning_amounts"),
        F.col("reasoning.key_metrics.eligible_line_items").alias("metric_eligible_items"),
        F.col("reasoning.key_metrics.ineligible_line_items").alias("metric_ineligible_items"),
    )


FLAT_SQL = """SELECT claim_id, proposed_status, CAST(proposed_benefit_amount AS DOUBLE) AS proposed_benefit_amount,
  CAST(eligible_total AS DOUBLE) AS eligible_total, CAST(invoice_total AS DOUBLE) AS invoice_total, CAST(cap_amount AS DOUBLE) AS cap_amount,
  line_item_count, approved_items, CAST(confidence_score AS DOUBLE) AS confidence_score, rule_branch, critical, warnings, info,
  fields AS missing_fields, summary,
  CASE WHEN branch = 'evaluated' THEN concat_ws('|', CAST(eligible_total AS VARCHAR), CAST(lim AS VARCHAR), CAST(CAST(benefit AS DECIMAL(28,2)) AS VARCHAR),
    CAST(used AS VARCHAR), CAST(CAST(cap AS DECIMAL(28,2)) AS VARCHAR)) ELSE '-|-|-|-|-' END AS reasoning_amounts,
  CASE WHEN branch = 'evaluated' THEN approved_items END AS metric_eligible_items,
  CASE WHEN branch = 'evaluated' THEN ineligible_items END AS metric_ineligible_items FROM decided"""


@query("R1 R2 R3 R4 R5 R7 R8 A20 A21 A22 K11", f"WITH {DECIDED} {FLAT_SQL}")
def claim_adjudication(t):
    return flat(adjudicate(t))


@query(
    "R1",
    f"""WITH {_decision_ctes("nullif(c.max_benefit, 0)", mode="backtest")}
SELECT proposed_status, rule_branch, count(*) AS claims, CAST(sum(proposed_benefit_amount) AS DOUBLE) AS benefit FROM decided GROUP BY ALL""",
)
def backtest_outcomes(t):
    return adjudicate(t, "backtest").groupBy("proposed_status", "rule_branch").agg(
        F.count(F.lit(1)).alias("claims"),
        as_double(F.sum("proposed_benefit_amount")).alias("benefit"),
    )


@query(
    "A20 A21 A26 A34",
    f"""WITH {TOTALS} SELECT claim_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("invoice_total", "included_total", "excluded_total", "charge_total", "credit_total", "eligible_total"))},
  line_item_count, approved_items, ineligible_items, credit_items, cleaning_only, eligible_capped FROM totals""",
)
def claim_item_totals(t):
    totals = decide.cap_eligible(
        decide.item_totals(classify.apply_rules(with_suggestions(t.items)))
    )
    names = ("invoice_total", "included_total", "excluded_total", "charge_total", "credit_total", "eligible_total")
    return totals.select(
        "claim_id", *[as_double(c).alias(c) for c in names], "line_item_count", "approved_items",
        "ineligible_items", "credit_items", "cleaning_only", "eligible_capped",
    )


@query("A22", f"WITH {PROFILE} SELECT * FROM profile")
def claim_document_profile(t):
    return decide.document_profile(t.documents)


@query(
    "R6",
    """SELECT claim_id, is_normal_wear_tear AND NOT has_eligible_charges AND NOT charges_covered_by_addendum AS should_deny,
  CASE WHEN is_normal_wear_tear AND NOT has_eligible_charges THEN 'charges_are_normal_wear_tear' ELSE '' END AS critical_flags,
  concat_ws('|', CASE WHEN is_normal_wear_tear AND has_eligible_charges THEN 'some_charges_may_be_normal_wear_tear' END,
    CASE WHEN contains(lower(missing_information), 'explanation of protections') THEN 'missing_explanation_of_protections_document'
      WHEN missing_information <> '' THEN 'missing_information: ' || missing_information END) AS warnings FROM v_analysis""",
)
def document_analysis_advisories(t):
    return decide.analysis_advisories(analysis_of(t)).select(
        "claim_id", "should_deny", F.array_join("critical_flags", "|").alias("critical_flags"),
        F.array_join("warnings", "|").alias("warnings"),
    )


SCENARIOS = [500, 1000, 2000]


@query(
    "R9",
    f"""WITH scen AS (SELECT c.* EXCLUDE (max_benefit), s.scenario FROM v_claims c, (VALUES (500), (1000), (2000)) s(scenario)),
{_decision_ctes("c.scenario", "scen", extra=", c.scenario")}
SELECT claim_id, CAST(scenario AS DOUBLE) AS scenario, proposed_status, CAST(proposed_benefit_amount AS DOUBLE) AS proposed_benefit_amount,
  CAST(cap_amount AS DOUBLE) AS cap_amount FROM decided""",
)
def benefit_scenarios(t):
    decided = decide.what_if(_inputs(t), SCENARIOS)
    return decided.select(
        "claim_id", as_double("scenario").alias("scenario"), "proposed_status",
        as_double("proposed_benefit_amount").alias("proposed_benefit_amount"),
        as_double("cap_amount").alias("cap_amount"),
    )


@query(
    "R9",
    f"""WITH scen AS (SELECT c.* EXCLUDE (max_benefit), s.scenario FROM v_claims c, (VALUES (500), (1000), (2000)) s(scenario)),
{_decision_ctes("c.scenario", "scen", extra=", c.scenario")},
steps AS (SELECT claim_id, proposed_benefit_amount < lag(proposed_benefit_amount) OVER (PARTITION BY claim_id ORDER BY scenario) AS falls FROM decided)
SELECT claim_id, CAST(count(*) AS INT) AS scenarios, CAST(count(*) FILTER (WHERE falls) AS INT) AS violations FROM steps GROUP BY claim_id""",
)
def benefit_monotonicity(t):
    return decide.monotonicity(decide.what_if(_inputs(t), SCENARIOS))


FIT_ORDER = ["line_number", "part_id", "supp_id", "ship_date", "price", "qty", "discount", "tax"]


@query(
    "W10",
    f"""WITH RECURSIVE {RULED_CTE}, caps AS (SELECT claim_id, CAST(least(claim_amount, max_benefit) * 100 AS BIGINT) AS cap FROM v_claims WHERE claim_amount IS NOT NULL),
r AS (SELECT claim_id, CAST(amount * 100 AS BIGINT) AS cents, row_number() OVER (PARTITION BY claim_id
    ORDER BY suggested_confidence DESC, amount DESC, {", ".join(FIT_ORDER)}) AS rn FROM ruled WHERE should_be_included),
w AS (SELECT c.claim_id, c.cap, 0::BIGINT AS rn, 0::BIGINT AS used, FALSE AS took FROM caps c
  UNION ALL SELECT w.claim_id, w.cap, r.rn, CASE WHEN w.used + r.cents <= w.cap THEN w.used + r.cents ELSE w.used END, w.used + r.cents <= w.cap
  FROM w JOIN r ON r.claim_id = w.claim_id AND r.rn = w.rn + 1)
SELECT claim_id, count(*) AS included_items, count(*) FILTER (WHERE took) AS kept_items, max_by(used, rn) / 100.0::DOUBLE AS kept_total
FROM w WHERE rn > 0 GROUP BY claim_id""",
)
def items_fitted_to_cap(t):
    ruled = classify.apply_rules(with_suggestions(t.items)).select(
        "claim_id", "amount", F.col("suggested_confidence").alias("confidence"),
        "should_be_included", *FIT_ORDER,
    )
    fitted = decide.fit_to_cap(ruled, t.claims, FIT_ORDER).join(
        t.claims.filter(F.col("claim_amount").isNotNull()).select("claim_id"), "claim_id", "left_semi"
    )
    return fitted.filter("should_be_included").groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("included_items"),
        F.count_if("kept").alias("kept_items"),
        as_double(F.sum(F.when(F.col("kept"), F.col("amount")).otherwise(0))).alias("kept_total"),
    )


# ----- stored items ---------------------------------------------------------------------------------

ITEMS_SQL = """stored AS (SELECT decision_id, claim_id, i - 1 AS line_item_index, i <= len(appr) AS original_included, list_extract(list_concat(appr, inel), i) AS item
  FROM (SELECT *, unnest(generate_series(1, len(appr) + len(inel))) AS i FROM (SELECT decision_id, claim_id,
    coalesce(CASE WHEN json_valid(approved_line_items) THEN CAST(approved_line_items AS JSON[]) END, []) AS appr,
    coalesce(CASE WHEN json_valid(ineligible_line_items) THEN CAST(ineligible_line_items AS JSON[]) END, []) AS inel FROM v_decisions))),
norm AS (SELECT decision_id, claim_id, line_item_index, original_included,
  coalesce(item->>'$.line_item.description', item->>'$.description') AS description,
  CAST(coalesce(item->>'$.line_item.amount', item->>'$.amount') AS DOUBLE) AS amount,
  coalesce(item->>'$.analysis.reasoning', item->>'$.analysis.reason', item->>'$.reason') AS reason FROM stored)"""


@query("F10 F11 W14 U2", f"WITH {ITEMS_SQL} SELECT * FROM norm")
def normalized_line_items(t):
    return decide.normalized_items(t.decisions)


@query(
    "F12 C11",
    """SELECT decision_id, c.claim_tracking_number, CAST(c.claim_amount AS DOUBLE) AS claim_amount,
  CASE WHEN json_valid(approved_line_items) THEN json_array_length(approved_line_items) ELSE 0 END AS approved_count,
  CASE WHEN json_valid(ineligible_line_items) THEN coalesce(json_array_length(ineligible_line_items), 0) ELSE 0 END AS ineligible_count,
  CASE WHEN contains(flags, 'Manual') THEN 'Manual_review_needed,rerun' WHEN contains(flags, 'no_eligible') THEN 'no_eligible_charges' ELSE '' END AS flag_text,
  CASE WHEN contains(missing_data, 'lease_start') THEN 'lease_start_date' ELSE '' END AS missing_fields
FROM v_decisions d JOIN v_claims c USING (claim_id)""",
)
def decision_views(t):
    return decide.decision_view(t.decisions, t.claims).select(
        "decision_id", "claim_tracking_number", as_double("claim_amount").alias("claim_amount"),
        "approved_count", "ineligible_count", "flag_text", "missing_fields",
    )


@query(
    "J13",
    f"""WITH {ITEMS_SQL}, latest AS ({LATEST_DECISION_SQL}),
cached AS (SELECT n.claim_id, n.description, CAST(n.amount AS DECIMAL(12,2)) AS amount, 'decision' AS origin FROM norm n JOIN latest l USING (decision_id)),
fresh AS (SELECT claim_id, description, amount, 'parsed' FROM v_items WHERE claim_id IN (SELECT claim_id FROM v_claims)
  AND claim_id NOT IN (SELECT claim_id FROM cached))
SELECT claim_id, origin, count(*) AS items, CAST(sum(amount) AS DOUBLE) AS amount FROM (SELECT * FROM cached UNION ALL SELECT * FROM fresh) GROUP BY ALL""",
)
def reused_line_items(t):
    return (
        decide.reuse_items(t.claims, t.decisions, t.items)
        .groupBy("claim_id", "origin")
        .agg(F.count(F.lit(1)).alias("items"), as_double(F.sum("amount")).alias("amount"))
    )


@query(
    "J12 R10",
    f"""WITH {ITEMS_SQL} SELECT n.decision_id, n.line_item_index, n.original_included,
  coalesce(o.user_should_be_included, n.original_included) AS should_be_included,
  coalesce(o.user_should_be_included <> n.original_included, FALSE) AS changed,
  coalesce(nullif(o.user_reasoning, ''), n.reason) AS reason, n.amount
FROM norm n LEFT JOIN v_overrides o ON o.decision_id = n.decision_id AND o.line_item_index = n.line_item_index""",
)
def overridden_items(t):
    return decide.apply_overrides(t.decisions, t.overrides).select(
        "decision_id", "line_item_index", "original_included", "should_be_included", "changed",
        "reason", "amount",
    )


def _requests(t):
    return t.overrides.select(
        "decision_id",
        F.col("is_damage").alias("cap_enabled"),
        F.when(F.col("is_rent"), F.lit("250.00").cast("decimal(12,2)")).alias("override_cap_amount"),
        F.when(F.col("is_cleaning"), "DENY").when(F.col("is_repair"), "bogus").alias("override_status"),
    )


@query(
    "R10",
    f"""WITH {ITEMS_SQL}, ov AS (SELECT n.*, coalesce(o.user_should_be_included, n.original_included) AS inc,
  coalesce(o.user_should_be_included <> n.original_included, FALSE) AS changed FROM norm n
  LEFT JOIN v_overrides o ON o.decision_id = n.decision_id AND o.line_item_index = n.line_item_index),
s AS (SELECT decision_id, coalesce(sum(CAST(amount AS DECIMAL(12,2))) FILTER (WHERE inc), 0) AS tot, count(*) FILTER (WHERE inc) AS n, count(*) FILTER (WHERE changed) AS ch FROM ov GROUP BY 1),
q AS (SELECT d.decision_id, d.proposed_status, coalesce(s.tot, 0) AS tot, coalesce(s.n, 0) AS n, coalesce(s.ch, 0) AS ch,
  CASE WHEN r.is_damage THEN coalesce(CASE WHEN r.is_rent THEN 250.00 END, nullif(d.cap_amount, 0)) END AS cap,
  CASE WHEN r.is_cleaning THEN 'deny' ELSE d.proposed_status END AS chosen
  FROM v_decisions d JOIN v_overrides r USING (decision_id) LEFT JOIN s USING (decision_id))
SELECT decision_id, CAST(tot AS DOUBLE) AS new_eligible_total, CAST(cap AS DOUBLE) AS new_cap_amount, CAST(least(tot, cap) AS DOUBLE) AS new_benefit,
  n AS new_approved_count, ch AS changed_items, CASE WHEN least(tot, cap) > 0 AND chosen = 'deny' AND n > 0 THEN 'approve' ELSE chosen END AS new_status FROM q""",
)
def recalculated_decisions(t):
    overridden = decide.apply_overrides(t.decisions, t.overrides)
    return decide.recalculate(t.decisions, overridden, _requests(t)).select(
        "decision_id",
        *[as_double(c).alias(c) for c in ("new_eligible_total", "new_cap_amount", "new_benefit")],
        "new_approved_count", "changed_items", "new_status",
    )


@query(
    "R11",
    """WITH b AS (SELECT * FROM v_overrides WHERE is_applied_to_rules), u AS (SELECT * FROM v_overrides WHERE user_reasoning <> '')
SELECT coalesce(b.decision_id, u.decision_id) AS decision_id, coalesce(b.line_item_index, u.line_item_index) AS line_item_index,
  CASE WHEN u.decision_id IS NOT NULL THEN NOT u.user_should_be_included ELSE b.user_should_be_included END AS user_should_be_included,
  CASE WHEN b.decision_id IS NOT NULL THEN b.system_should_be_included ELSE u.system_should_be_included END AS system_should_be_included
FROM b FULL JOIN u ON b.decision_id = u.decision_id AND b.line_item_index = u.line_item_index""",
)
def upserted_overrides(t):
    from claimgrid.operators.relational import upsert

    base = t.overrides.filter("is_applied_to_rules")
    updates = t.overrides.filter("user_reasoning <> ''").withColumn(
        "user_should_be_included", ~F.col("user_should_be_included")
    )
    merged = upsert(
        base, updates, ["decision_id", "line_item_index"],
        ["user_should_be_included", "user_reasoning", "override_timestamp"],
        ["override_timestamp", "override_id"],
    )
    return merged.select(
        "decision_id", "line_item_index", "user_should_be_included", "system_should_be_included"
    )


@query(
    "R12",
    """SELECT decision_id, line_item_index, user_should_be_included, user_reasoning, system_should_be_included
FROM v_overrides WHERE decision_id IN (SELECT decision_id FROM v_decisions WHERE is_active)
ORDER BY decision_id, line_item_index""",
)
def overrides_of_decisions(t):
    active = t.decisions.filter("is_active").select("decision_id")
    return (
        t.overrides.join(active, "decision_id", "left_semi")
        .select("decision_id", "line_item_index", "user_should_be_included", "user_reasoning",
                "system_should_be_included")
        .orderBy("decision_id", "line_item_index")
    )


# ----- model responses ------------------------------------------------------------------------------


@query(
    "C43",
    """SELECT claim_id, md5(trim(regexp_replace(CASE WHEN contains(response_text, '```json') THEN regexp_extract(response_text, '(?s)```json(.*?)(?:```|$)', 1)
  WHEN contains(response_text, '```') THEN regexp_extract(response_text, '(?s)```(.*?)(?:```|$)', 1) ELSE response_text END, '^\\s+|\\s+$', '', 'g'))) AS body_hash FROM v_responses""",
)
def response_bodies(t):
    return t.responses.select(
        "claim_id", F.md5(jsonio.strip_fences(F.col("response_text"))).alias("body_hash")
    )


@query(
    "C44 C45",
    """SELECT claim_id, CASE shape WHEN '1-URGENT' THEN '' WHEN '2-HIGH' THEN ''
  WHEN '3-MEDIUM' THEN 'Analysis 1: ''is_covered_by_addendum'' must be boolean|Analysis 1: ''confidence'' must be between 0.0 and 1.0'
  WHEN '4-NOT SPECIFIED' THEN 'Missing ''line_item_analyses'' field' ELSE 'Invalid JSON' END AS errors FROM v_responses""",
)
def response_errors(t):
    return t.responses.select(
        "claim_id",
        F.array_join(
            jsonio.response_errors(F.col("response_text"), F.col("expected_count")), "|"
        ).alias("errors"),
    )


@query(
    "C46 J11",
    """WITH n AS (SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY line_number, part_id, supp_id, ship_date, price, qty, discount, tax) AS line_no FROM v_items)
SELECT n.claim_id, count(*) AS lines, count(*) FILTER (WHERE NOT (n.line_no = 1 AND r.shape IN ('1-URGENT', '2-HIGH'))) AS json_failed_items
FROM n JOIN v_responses r USING (claim_id) GROUP BY n.claim_id""",
)
def validated_suggestions(t):
    lines = number_lines(t.items).select("claim_id", "line_no")
    known = lines.join(t.responses.select("claim_id"), "claim_id", "left_semi")
    rows = decide.validated_suggestions(t.responses, known)
    return rows.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if("json_validation_failed").alias("json_failed_items"),
    )


@query(
    "S11",
    f"""WITH {DECIDED} SELECT i.claim_id, i.line_no, d.proposed_status AS decision_status,
  i.description, CAST(i.amount AS DOUBLE) AS amount
FROM decided d JOIN (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY line_number, part_id, supp_id, ship_date, price, qty, discount, tax) AS line_no FROM v_items) i USING (claim_id)""",
)
def line_item_audit_records(t):
    ruled = classify.apply_rules(with_suggestions(number_lines(t.items)))
    records = decide.line_item_audit(ruled, adjudicate(t))
    # Each record is read back once, for all three of its fields.
    read = F.from_json("record", "decision_status string, line_item struct<description:string,amount:double>")
    parsed = computed_once(records.select("claim_id", "line_no", read.alias("_read")), ["_read"])
    return parsed.select(
        "claim_id", "line_no", F.col("_read.decision_status").alias("decision_status"),
        F.col("_read.line_item.description").alias("description"), F.col("_read.line_item.amount").alias("amount"),
    )
