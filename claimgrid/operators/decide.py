"""Claim decisions: item totals, document profile, the decision cascade, overrides, what-if."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions import jsonio
from claimgrid.functions.text import WIDE_MONEY, contains_any
from claimgrid.operators.classify import apply_rules
from claimgrid.plans.greedy import greedy_fit
from claimgrid.rules import fixed_values as fv
from claimgrid.session import written_once

def _money(value) -> Column:
    return F.lit(value).cast(WIDE_MONEY)


def counts_towards_invoice(lowered: Column) -> Column:
    """A real charge: not a prior balance, rent, fee or payment (its own phrase lists)."""
    excluded = [phrase for phrases in fv.INVOICE_TOTAL_EXCLUSIONS.values() for phrase in phrases]
    return ~contains_any(lowered, excluded) & (F.col("amount") >= 0)


def item_totals(ruled: DataFrame) -> DataFrame:
    """Per claim totals and counts in one aggregation; input is ``apply_rules`` output."""
    amount = F.col("amount")
    included = F.col("should_be_included")
    failed = (
        F.col("json_validation_failed")
        if "json_validation_failed" in ruled.columns
        else F.lit(False)
    )

    def total(condition: Column) -> Column:
        # whole cents add up as machine integers; decimals of this width would not
        cents = F.sum(F.when(condition, F.col("_cents")).otherwise(F.lit(0)))
        return (cents.cast("decimal(26,0)") / 100).cast(WIDE_MONEY)

    lowered = F.lower(F.coalesce(F.col("description"), F.lit("")))
    cents = (amount.cast("decimal(12,2)") * 100).cast("bigint")
    marked = ruled.withColumns({"_lowered": lowered, "_cents": cents}).withColumn(
        "_counts", counts_towards_invoice(F.col("_lowered"))
    )
    return marked.groupBy("claim_id").agg(
        total(F.col("_counts")).alias("invoice_total"),
        total(included).alias("included_total"),
        total(~included).alias("excluded_total"),
        total(included & (amount >= 0)).alias("charge_total"),
        total(included & (amount < 0)).alias("credit_total"),
        F.count(F.lit(1)).alias("line_item_count"),
        F.count_if(included).alias("approved_items"),
        F.count_if(~included).alias("ineligible_items"),
        F.count_if(amount < 0).alias("credit_items"),
        F.every(F.col("is_cleaning")).alias("cleaning_only"),
        F.count_if(F.coalesce(failed, F.lit(False))).alias("json_failed_items"),
    )


def cap_eligible(totals: DataFrame) -> DataFrame:
    """Eligible total, held to a multiple of a positive invoice total, with a marker."""
    limit = (F.col("invoice_total") * F.lit(fv.ELIGIBLE_TO_INVOICE_MULTIPLIER).cast("decimal(3,1)")).cast(
        WIDE_MONEY
    )
    over = (F.col("invoice_total") > 0) & (F.col("included_total") > limit)
    return totals.withColumns(
        {
            "eligible_total": F.when(over, limit).otherwise(F.col("included_total")),
            "eligible_capped": over,
        }
    )


def document_profile(docs: DataFrame) -> DataFrame:
    """Per claim: which document types exist, lowest type confidence, poor scans, counts."""
    kind = F.col("document_type")
    confidence = F.col("classification_confidence")
    return docs.groupBy("claim_id").agg(
        F.bool_or(kind == "addendum").alias("has_addendum"),
        F.bool_or(kind == "invoice").alias("has_invoice"),
        F.min(F.when(confidence == 0, 100.0).otherwise(confidence)).alias("document_confidence"),
        F.count_if(F.col("ocr_confidence") < fv.LOW_OCR_CONFIDENCE).alias("low_ocr_documents"),
        F.count_if(kind == "invoice").alias("invoice_count"),
        F.count(F.lit(1)).alias("document_count"),
    )


def analysis_advisories(analysis: DataFrame) -> DataFrame:
    """What a document analysis suggests: critical flags, warnings and whether it would deny."""
    wear, eligible = F.col("is_normal_wear_tear"), F.col("has_eligible_charges")
    missing = F.transform(
        F.coalesce("missing_information", F.array().cast("array<string>")),
        lambda info: F.when(
            F.lower(info).contains("explanation of protections"),
            F.lit("missing_explanation_of_protections_document"),
        ).otherwise(F.concat(F.lit("missing_information: "), F.left(info, F.lit(50)))),
    )
    some = F.when(wear & eligible, F.lit("some_charges_may_be_normal_wear_tear"))
    return analysis.withColumns(
        {
            "critical_flags": F.array_compact(
                F.array(F.when(wear & ~eligible, F.lit("charges_are_normal_wear_tear")))
            ),
            "warnings": F.concat(F.array_compact(F.array(some)), missing),
            "should_deny": wear & ~eligible & ~F.col("charges_covered_by_addendum"),
        }
    )


def _text(value: Column) -> Column:
    return value.cast("decimal(28,2)").cast("string")


def _one(value: Column) -> Column:
    return F.format_string("%.1f", value)


def claim_inputs(
    claims: DataFrame,
    items: DataFrame,
    docs: DataFrame,
    analysis: DataFrame | None = None,
) -> DataFrame:
    """One row per claim with everything a decision needs: three aggregates joined on claim_id."""
    totals = cap_eligible(item_totals(apply_rules(items)))
    wide = claims.join(totals, "claim_id", "left").join(
        document_profile(docs), "claim_id", "left"
    )
    if analysis is not None:
        wide = wide.join(
            analysis.select(
                "claim_id",
                F.col("is_normal_wear_tear").alias("_wear"),
                F.col("has_eligible_charges").alias("_eligible"),
                F.col("denial_reasons").alias("_reasons"),
            ),
            "claim_id",
            "left",
        )
    else:
        wide = wide.withColumns(
            {
                "_wear": F.lit(None).cast("boolean"),
                "_eligible": F.lit(None).cast("boolean"),
                "_reasons": F.lit(None).cast("array<string>"),
            }
        )
    zero_money = ["invoice_total", "eligible_total", "included_total", "charge_total", "credit_total",
                  "excluded_total"]
    zero_count = ["line_item_count", "approved_items", "ineligible_items", "credit_items",
                  "json_failed_items", "low_ocr_documents", "invoice_count", "document_count"]
    false = ["has_addendum", "has_invoice", "eligible_capped", "cleaning_only"]
    # A stored benefit of 0 stands for a blank cell, as the loader reads it.
    return wide.withColumns(
        {
            "max_benefit": F.nullif(F.col("max_benefit"), F.lit(0).cast("decimal(12,2)")),
            **{c: F.coalesce(F.col(c), _money(0)) for c in zero_money},
            **{c: F.coalesce(F.col(c), F.lit(0)) for c in zero_count},
            **{c: F.coalesce(F.col(c), F.lit(False)) for c in false},
        }
    )


def decide(
    inputs: DataFrame, mode: str = "production", override_max_benefit: Column | None = None
) -> DataFrame:
    """The decision cascade over ``claim_inputs`` rows.

    Order: addendum, invoice, max benefit, claim amount zero, eligible charges, benefit. Low
    document confidence turns the first two denials into warnings.
    """
    stored = F.col("max_benefit").cast(WIDE_MONEY)
    override = (
        F.nullif(override_max_benefit.cast(WIDE_MONEY), _money(0))
        if override_max_benefit is not None
        else F.lit(None).cast(WIDE_MONEY)
    )
    claim_amount = F.col("claim_amount").cast(WIDE_MONEY)
    doc_conf = F.col("document_confidence")
    multiplier = F.lit(fv.INVOICE_TO_CLAIM_MULTIPLIER).cast("decimal(3,1)")
    frame = inputs.withColumns(
        {
            "_low": F.coalesce(doc_conf < fv.LOW_DOCUMENT_CONFIDENCE, F.lit(False)),
            "_benefit_limit": F.when(stored.isNotNull(), F.coalesce(override, stored)),
        }
    )
    low, limit = F.col("_low"), F.col("_benefit_limit")
    frame = frame.withColumns(
        {
            "_branch": F.when(~F.col("has_addendum") & ~low, "missing_waiver_addendum")
            .when(~F.col("has_invoice") & ~low, "missing_invoice")
            .when(stored.isNull(), "missing_max_benefit")
            .when((claim_amount == 0) & limit.isNull(), "claim_amount_zero")
            .when(F.col("eligible_total") == 0, "no_eligible_charges")
            .otherwise("evaluated"),
            "_raw_invoice": F.when(
                ~F.col("has_invoice") & low & (F.col("invoice_total") == 0),
                F.coalesce(claim_amount, _money(0)),
            ).otherwise(F.col("invoice_total")),
        }
    )
    frame = frame.withColumns(
        {
            "_negative_invoice": F.col("_raw_invoice") < 0,
            "_absurd_invoice": (claim_amount > 0)
            & (F.col("_raw_invoice") > claim_amount * multiplier),
        }
    )
    frame = frame.withColumns(
        {
            "_used_invoice": F.when(F.col("_negative_invoice"), _money(0))
            .when(F.col("_absurd_invoice"), (claim_amount * multiplier).cast(WIDE_MONEY))
            .otherwise(F.col("_raw_invoice")),
            "_effective_cap": F.least(
                F.when(claim_amount > 0, claim_amount), F.when(limit > 0, limit)
            ),
        }
    )
    frame = frame.withColumn(
        "_cap", F.least(F.col("_effective_cap"), F.col("_used_invoice"))
    ).withColumn("_benefit", F.least(F.col("eligible_total"), F.col("_cap")))
    branch = F.col("_branch")
    evaluated = branch == "evaluated"
    missing_start = F.col("lease_start_date").isNull()
    soft_addendum = ~F.col("has_addendum") & low
    soft_invoice = ~F.col("has_invoice") & low
    fields = (
        F.when(branch == "missing_waiver_addendum", F.array(F.lit("addendum")))
        .when(branch == "missing_invoice", F.array(F.lit("invoice")))
        .when(branch == "missing_max_benefit", F.array(F.lit("max_benefit")))
        .when(
            evaluated,
            F.array_compact(
                F.array(
                    F.when(soft_addendum, F.lit("addendum")),
                    F.when(soft_invoice, F.lit("invoice")),
                    F.when(missing_start, F.lit("lease_start_date")),
                )
            ),
        )
        .otherwise(F.array().cast("array<string>"))
    )
    frame = frame.withColumn("_fields", fields)
    base = F.lit(85.0) - F.when(F.size("_fields") > 0, 10.0).otherwise(0.0)
    reduced = F.greatest(
        F.lit(50.0),
        base - (fv.LOW_DOCUMENT_CONFIDENCE - doc_conf) / fv.LOW_DOCUMENT_CONFIDENCE * 30,
    )
    frame = frame.withColumns(
        {
            "confidence_score": F.when(
                evaluated,
                F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when(low, reduced).otherwise(base))),
            ).otherwise(100.0),
            "proposed_status": F.when(
                branch == "missing_max_benefit", "pending" if mode == "backtest" else "deny"
            )
            .when(branch == "claim_amount_zero", "approve")
            .when(evaluated & (F.col("_benefit") > 0), "approve")
            .otherwise("deny"),
            "proposed_benefit_amount": F.when(
                branch == "missing_max_benefit",
                F.lit(None).cast(WIDE_MONEY) if mode == "backtest" else _money(0),
            )
            .when(evaluated, F.col("_benefit"))
            .otherwise(_money(0)),
            "cap_amount": F.when(
                branch.isin("evaluated", "no_eligible_charges"), F.col("_cap")
            ),
        }
    )
    doc_note = F.concat(
        F.lit("document_confidence_"), _one(doc_conf), F.lit("%_may_affect_classification")
    )
    shared_warnings = [
        F.when(
            F.col("json_failed_items") > 0,
            F.concat(
                F.lit("json_validation_failed_for_"), F.col("json_failed_items").cast("string"),
                F.lit("_line_items"),
            ),
        ),
        F.when(
            F.col("eligible_capped"),
            F.concat(
                F.lit("eligible_total_sanity_check_applied: capped to $"),
                _text(F.col("eligible_total")),
            ),
        ),
        F.when(
            F.col("low_ocr_documents") > 0,
            F.concat(
                F.lit("low_ocr_confidence: "), F.col("low_ocr_documents").cast("string"),
                F.lit(" document(s) with OCR confidence < 50%"),
            ),
        ),
        F.when(
            F.col("_wear") & ~F.col("_eligible") & (F.col("eligible_total") == 0),
            F.lit("document_analysis_suggests_all_normal_wear_tear"),
        ),
        F.when(
            F.col("_wear") & F.col("_eligible"),
            F.lit("document_analysis_suggests_some_normal_wear_tear"),
        ),
    ]
    advisory = F.transform(
        F.coalesce("_reasons", F.array().cast("array<string>")),
        lambda reason: F.concat(
            F.lit("document_analysis_advisory: "), F.left(reason, F.lit(100))
        ),
    )
    own_warnings = [
        F.when(soft_addendum, F.lit("addendum_not_confidently_detected")),
        F.when(soft_invoice, F.lit("invoice_not_confidently_detected")),
        F.when(F.col("_negative_invoice"), F.lit("invoice_total_negative_set_to_zero")),
        F.when(
            F.col("_absurd_invoice"),
            F.concat(
                F.lit("invoice_total_sanity_check_applied: capped to $"),
                _text(F.col("_used_invoice")),
            ),
        ),
        F.when(
            F.col("credit_items") > 0,
            F.concat(
                F.lit("credits_detected: "), F.col("credit_items").cast("string"),
                F.lit(" credit items found"),
            ),
        ),
        F.when(missing_start, F.lit("Missing lease start date")),
        F.when(
            low,
            F.concat(
                F.lit("low_document_confidence_"), _one(doc_conf),
                F.lit("%_reduces_decision_confidence_to_"), _one(F.col("confidence_score")),
                F.lit("%"),
            ),
        ),
    ]
    nothing = F.array().cast("array<string>")
    critical = F.array_compact(
        F.array(
            F.when(
                branch.isin(
                    "missing_waiver_addendum", "missing_invoice", "missing_max_benefit",
                    "no_eligible_charges",
                ),
                branch,
            ),
            F.when(F.col("json_failed_items") > 0, F.lit("llm_json_validation_failure")),
        )
    )
    warnings = F.array_distinct(
        F.concat(
            F.array_compact(F.array(*shared_warnings)),
            advisory,
            F.when(evaluated, F.array_compact(F.array(*own_warnings))).otherwise(nothing),
        )
    )
    info = (
        F.when(
            evaluated & (soft_addendum | soft_invoice), F.array(doc_note)
        )
        .when(branch == "claim_amount_zero", F.array(F.lit("claim_amount_zero")))
        .otherwise(nothing)
    )
    frame = frame.withColumns({"_critical": critical, "_warnings": warnings, "_info": info})
    known = list(fv.FLAG_EXPLANATIONS.items())
    explained = F.create_map(*[F.lit(x) for pair in known for x in pair])
    all_flags = F.array_distinct(F.concat("_critical", "_warnings"))
    summary = (
        F.when(branch == "missing_waiver_addendum", "Missing required waiver addendum")
        .when(branch == "missing_invoice", "Missing required invoice")
        .when(
            branch == "missing_max_benefit",
            "Cannot determine cap without max_benefit"
            + (" (backtest mode)" if mode == "backtest" else ""),
        )
        .when(
            branch == "claim_amount_zero",
            "Claim amount is zero and no max_benefit, approving with zero benefit",
        )
        .when(branch == "no_eligible_charges", "No eligible charges found")
        .otherwise(
            F.concat(
                F.when(F.col("proposed_status") == "approve", "Approved").otherwise("Denied"),
                F.lit(" $"), _text(F.col("_benefit")), F.lit(" benefit from $"),
                _text(F.col("eligible_total")), F.lit(" eligible charges, capped at $"),
                _text(F.col("_cap")), F.lit("."),
            )
        )
    )

    def whole(value: Column) -> Column:
        """A part of the reasoning that only a decision on the amounts has."""
        return F.when(evaluated, value)

    return frame.select(
        "claim_id",
        "claim_tracking_number",
        "proposed_status",
        "proposed_benefit_amount",
        "eligible_total",
        "charge_total",
        "credit_total",
        "invoice_total",
        "cap_amount",
        "claim_amount",
        "max_benefit",
        "document_count",
        "line_item_count",
        "approved_items",
        "ineligible_items",
        F.struct(
            F.col("_critical").alias("critical"),
            F.col("_warnings").alias("warnings"),
            F.col("_info").alias("info"),
        ).alias("flags"),
        F.struct(
            F.col("_fields").alias("fields"),
            (
                (branch == "missing_max_benefit")
                | (evaluated & (soft_addendum | soft_invoice))
            ).alias("needs_user_input"),
        ).alias("missing_data"),
        F.struct(
            summary.alias("summary"),
            whole(_text(F.col("eligible_total"))).alias("eligible_total"),
            _text(F.col("_used_invoice")).alias("invoice_total"),
            whole(_text(limit)).alias("max_benefit"),
            _text(F.col("_cap")).alias("cap_amount"),
            whole(_text(F.col("_benefit"))).alias("final_amount"),
            whole(
                F.struct(
                    F.col("approved_items").alias("eligible_line_items"),
                    F.col("ineligible_items").alias("ineligible_line_items"),
                    _text(F.col("_used_invoice")).alias("invoice_total"),
                    _text(F.col("_cap")).alias("cap_amount"),
                )
            ).alias("key_metrics"),
            F.map_from_arrays(
                all_flags,
                F.transform(
                    all_flags,
                    lambda flag: F.coalesce(
                        F.try_element_at(explained, flag), F.concat(F.lit("Flag: "), flag)
                    ),
                ),
            ).alias("flag_explanations"),
            F.lit(fv.ENGINE_VERSION).alias("rule_version"),
        ).alias("reasoning"),
        "confidence_score",
        rule_branch().alias("rule_branch"),
        F.lit(fv.ENGINE_VERSION).alias("engine_version"),
    )


def rule_branch() -> Column:
    """Which branch explains the decision, judged from the inputs alone."""
    return (
        F.when(~F.col("has_addendum"), "missing_waiver_addendum")
        .when(~F.col("has_invoice"), "missing_invoice")
        .when(F.coalesce("max_benefit", F.lit(0)) == 0, "missing_max_benefit")
        .when(F.col("eligible_total") == 0, "no_eligible_charges")
        .when(F.col("proposed_benefit_amount") > 0, "normal_approve")
        .otherwise("deny_other")
    )


def evaluate_claims(
    claims: DataFrame,
    items: DataFrame,
    docs: DataFrame,
    analysis: DataFrame | None = None,
    mode: str = "production",
) -> DataFrame:
    """Claims, items and documents to one decision row per claim, in one job."""
    return decide(claim_inputs(claims, items, docs, analysis), mode)


def what_if(inputs: DataFrame, limits: Sequence[float]) -> DataFrame:
    """Each claim decided at several benefit limits."""
    values = F.array(*[F.lit(str(v)).cast("decimal(12,2)") for v in limits])
    scenarios = inputs.withColumn("scenario", F.explode(values)).drop("max_benefit")
    decided = decide(scenarios.withColumnRenamed("scenario", "max_benefit"))
    return decided.withColumnRenamed("max_benefit", "scenario")


def monotonicity(decided: DataFrame) -> DataFrame:
    """Benefit drops along rising limits, per claim; a claim has one row per scenario."""
    listed = decided.groupBy("claim_id").agg(
        F.array_sort(
            F.collect_list(F.struct("scenario", "proposed_benefit_amount"))
        ).alias("s")
    )
    steps = F.zip_with(
        F.slice("s", 1, F.size("s") - 1),
        F.slice("s", 2, F.size("s") - 1),
        lambda a, b: (b["proposed_benefit_amount"] < a["proposed_benefit_amount"]).cast("int"),
    )
    return listed.select(
        "claim_id",
        F.size("s").alias("scenarios"),
        F.size(F.filter(steps, lambda x: x == 1)).alias("violations"),
    )


def fit_to_cap(
    items: DataFrame, claims: DataFrame, order: list[str], fold_limit: int = 1000
) -> DataFrame:
    """Included items kept within min(claim amount, benefit): best confidence first, then largest.

    Items that do not fit are excluded with a reason; the walk continues past them.
    """
    caps = claims.filter(F.col("claim_amount").isNotNull()).select(
        "claim_id", F.least("claim_amount", "max_benefit").alias("cap_amount")
    )
    items = written_once(items)  # its rules are costly, and the fit reads it several times
    wanted = items.filter("should_be_included")
    fitted = greedy_fit(wanted, caps, order, fold_limit)
    rest = items.filter(~F.col("should_be_included")).withColumn("kept", F.lit(False))
    return fitted.unionByName(rest, allowMissingColumns=True).withColumn(
        "exclusion_reason",
        F.when(
            F.col("should_be_included") & ~F.col("kept"),
            F.lit("Excluded due to claim_amount constraint"),
        ),
    )


# ----- stored line items, responses and overrides ---------------------------------------------------


def stored_items(decisions: DataFrame) -> DataFrame:
    """approved ++ ineligible items of each decision, numbered from 0, with their origin."""
    approved = jsonio.line_items(F.col("approved_line_items"))
    ineligible = jsonio.line_items(F.col("ineligible_line_items"))
    tagged = F.concat(
        F.transform(approved, lambda i: F.struct(F.lit(True).alias("included"), i.alias("item"))),
        F.transform(ineligible, lambda i: F.struct(F.lit(False).alias("included"), i.alias("item"))),
    )
    return decisions.select(
        "decision_id", "claim_id", F.posexplode(tagged).alias("line_item_index", "x")
    ).select(
        "decision_id",
        "claim_id",
        "line_item_index",
        F.col("x.included").alias("original_included"),
        F.col("x.item").alias("item"),
    )


def normalized_items(decisions: DataFrame) -> DataFrame:
    return stored_items(decisions).select(
        "decision_id", "claim_id", "line_item_index", "original_included",
        jsonio.normalized_item(F.col("item")).alias("n"),
    ).select("decision_id", "claim_id", "line_item_index", "original_included", "n.*")


def decision_view(decisions: DataFrame, claims: DataFrame) -> DataFrame:
    """Response projection: amounts, cap reason, item counts, parsed flags."""
    from claimgrid.operators.relational import with_cap_reason

    joined = decisions.join(
        claims.select("claim_id", "claim_tracking_number", "claim_amount", "max_benefit"),
        "claim_id",
    )
    approved = F.size(jsonio.line_items(F.col("approved_line_items")))
    ineligible = F.size(jsonio.line_items(F.col("ineligible_line_items")))
    flags = jsonio.flag_lists(F.col("flags"))
    return with_cap_reason(joined).withColumns(
        {
            "approved_count": approved,
            "ineligible_count": ineligible,
            "line_item_count": approved + ineligible,
            "flag_text": F.array_join(flags, ","),
            "missing_fields": F.array_join(jsonio.missing_fields(F.col("missing_data")), ","),
        }
    )


def reuse_items(claims: DataFrame, decisions: DataFrame, parsed: DataFrame) -> DataFrame:
    """Items of the latest decision where it stored any, freshly parsed items elsewhere."""
    from claimgrid.operators.relational import latest_active_decision

    cached = normalized_items(latest_active_decision(decisions)).select(
        "claim_id", "description", F.col("amount").cast("decimal(12,2)").alias("amount"),
        F.lit("decision").alias("origin"),
    )
    known = cached.select("claim_id").distinct()
    fresh = (
        parsed.join(claims.select("claim_id"), "claim_id", "left_semi")
        .join(known, "claim_id", "left_anti")
        .select("claim_id", "description", "amount", F.lit("parsed").alias("origin"))
    )
    return cached.unionByName(fresh)


def apply_overrides(decisions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Stored items with the user's verdict by position; ``changed`` marks real changes."""
    verdicts = overrides.select(
        "decision_id", "line_item_index", "user_should_be_included", "user_reasoning"
    )
    joined = stored_items(decisions).join(verdicts, ["decision_id", "line_item_index"], "left")
    decided = F.coalesce("user_should_be_included", "original_included")
    return (
        joined.withColumns(
            {
                "should_be_included": decided,
                "changed": F.coalesce(
                    F.col("user_should_be_included") != F.col("original_included"), F.lit(False)
                ),
                "n": jsonio.normalized_item(F.col("item"), F.col("user_reasoning")),
            }
        )
        .select(
            "decision_id", "claim_id", "line_item_index", "original_included",
            "should_be_included", "changed", "n.*",
        )
    )


def recalculate(
    decisions: DataFrame,
    overridden: DataFrame,
    requests: DataFrame,
) -> DataFrame:
    """New totals, cap, benefit and status of decisions after overrides.

    ``requests`` carries ``cap_enabled``, ``override_cap_amount`` and ``override_status`` per
    decision.
    """
    amount = F.col("amount").cast("decimal(12,2)").cast(WIDE_MONEY)
    included = F.col("should_be_included")
    sums = overridden.groupBy("decision_id").agg(
        F.sum(F.when(included, amount).otherwise(_money(0))).alias("new_eligible_total"),
        F.count_if(included).alias("new_approved_count"),
        F.count_if("changed").alias("changed_items"),
    )
    stored_cap = F.nullif(F.col("cap_amount"), F.lit(0).cast("decimal(12,2)")).cast(WIDE_MONEY)
    cap = F.when(
        F.col("cap_enabled"),
        F.coalesce(F.col("override_cap_amount").cast(WIDE_MONEY), stored_cap),
    )
    joined = (
        decisions.select("decision_id", "claim_id", "proposed_status", "cap_amount")
        .join(requests, "decision_id")
        .join(sums, "decision_id", "left")
        .withColumns(
            {
                "new_eligible_total": F.coalesce("new_eligible_total", _money(0)),
                "new_approved_count": F.coalesce("new_approved_count", F.lit(0)),
                "changed_items": F.coalesce("changed_items", F.lit(0)),
                "new_cap_amount": cap,
            }
        )
        .withColumn("new_benefit", F.least("new_eligible_total", "new_cap_amount"))
    )
    asked = F.lower("override_status")
    chosen = F.when(asked.isin("approve", "deny", "pending"), asked).otherwise(
        F.col("proposed_status")
    )
    lifted = (
        (F.col("new_benefit") > 0)
        & (chosen == "deny")
        & (F.coalesce(asked == "approve", F.lit(False)) | (F.col("new_approved_count") > 0))
    )
    return joined.withColumn("new_status", F.when(lifted, "approve").otherwise(chosen))


def validated_suggestions(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """Suggestions per expected line; an invalid response gives default-include rows, flagged."""
    checked = responses.withColumn(
        "errors", jsonio.response_errors(F.col("response_text"), F.col("expected_count"))
    )
    valid = (
        checked.filter(F.size("errors") == 0)
        .select("claim_id", F.explode(jsonio.analysis_rows(F.col("response_text"))).alias("a"))
        .select("claim_id", "a.*")
    )
    joined = expected.select("claim_id", "line_no").join(valid, ["claim_id", "line_no"], "left")
    failed = F.col("confidence").isNull()
    return joined.withColumns(
        {
            "json_validation_failed": failed,
            "should_be_included": F.coalesce("should_be_included", F.lit(True)),
            "is_normal_wear_tear": F.coalesce("is_normal_wear_tear", F.lit(False)),
            "is_covered_by_addendum": F.coalesce("is_covered_by_addendum", F.lit(True)),
            "is_covered_by_other_insurance": F.coalesce(
                "is_covered_by_other_insurance", F.lit(False)
            ),
            "confidence": F.coalesce("confidence", F.lit(0.3)),
            "reasoning": F.coalesce(
                "reasoning",
                F.lit(
                    "JSON validation failed, defaulting to include "
                    "(deterministic rules will filter)"
                ),
            ),
            "addendum_reference": F.coalesce("addendum_reference", F.lit("N/A")),
        }
    )


def line_item_audit(ruled: DataFrame, decided: DataFrame) -> DataFrame:
    """JSON records for rule improvement: one per line item, each with its claim's decision.

    Every record has the same shape however many lines a claim has. Input lines carry ``line_no``.
    """
    tags = [
        "is_rent", "is_month_to_month", "is_cleaning", "is_repair", "is_damage",
        "is_improper_notice", "is_other_insurance", "is_contractual_fee", "is_after_lease_end",
        "is_normal_wear_tear",
    ]
    lines = ruled.select("claim_id", "line_no", "description", "amount", "should_be_included", *tags)
    header = decided.select(
        "claim_id", "claim_tracking_number",
        F.col("proposed_status").alias("decision_status"),
        F.col("proposed_benefit_amount").alias("proposed_amount"),
    )
    record = F.struct(
        "claim_id", "claim_tracking_number", "decision_status", "proposed_amount",
        F.struct("line_no", "description", "amount", "should_be_included", *tags).alias("line_item"),
    )
    return lines.join(header, "claim_id").select("claim_id", "line_no", F.to_json(record).alias("record"))
