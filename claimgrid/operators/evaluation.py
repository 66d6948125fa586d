"""Decisions against outcomes: accuracy, error, bias, variance and run comparison.

Every report is conditional aggregates in one pass; exact medians and histograms come from value
counts, so no task ever holds the raw values of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions.jsonio import flag_lists, missing_fields
from claimgrid.functions.text import WIDE_MONEY
from claimgrid.operators.relational import first_per_group, latest_active_decision, latest_validation
from claimgrid.plans import ordered


def evaluation_set(
    decisions: DataFrame,
    claims: DataFrame,
    validation: DataFrame,
    engine_version: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Active decisions with their claim and outcome; filters apply before the joins."""
    active = decisions.filter("is_active")
    if engine_version:
        active = active.filter(F.col("engine_version") == engine_version)
    if start and end:
        active = active.filter(
            F.col("decided_at").between(
                F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
            )
        )
    active = active.select(
        "claim_id", "decision_id", "proposed_status", "proposed_benefit_amount", "eligible_total",
        "invoice_total", "flags", "missing_data", "confidence_score", "engine_version",
        "decided_at", "processing_time_ms",
    )
    outcome = validation.select(
        "claim_id", "actual_status", "actual_paid_amount", "actual_decision_date"
    )
    return active.join(claims.select("claim_id", "claim_tracking_number"), "claim_id").join(
        outcome, "claim_id"
    )


def variance_base(decisions: DataFrame, validation: DataFrame) -> DataFrame:
    """Latest active decision beside the latest outcome per claim; outcome may be missing."""
    left = latest_active_decision(decisions).select(
        "claim_id", "proposed_status", "proposed_benefit_amount", "confidence_score",
        "engine_version",
    )
    right = latest_validation(validation).select(
        "claim_id", "actual_status", "actual_paid_amount"
    )
    joined = left.join(right, "claim_id", "left")
    known = F.col("actual_status").isNotNull()
    paid = F.when(known, F.coalesce("actual_paid_amount", F.lit(0)).cast("decimal(12,2)"))
    return joined.withColumns(
        {
            "actual_paid_amount": paid,
            "difference": F.abs(F.col("proposed_benefit_amount") - paid),
            "status_match": F.lower("proposed_status") == F.lower("actual_status"),
        }
    )


def exact_median(values: DataFrame, column: str) -> DataFrame:
    """One-row exact median from value counts.

    Equal values are combined on the map side, ranked inside ranges of near equal size and shifted
    by the sizes of the ranges below: one task sees a row for each range, whose number is fixed.
    """
    counts = (
        values.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    chunked = ordered.cut_by_quantiles(counts, "_v")
    ranked = ordered.running_sum(chunked, [], ["_chunk"], ["_v"], {"_upto": "_n"})
    total = counts.agg(F.sum("_n").alias("n")).select("n").scalar()
    low, high = F.floor((total + 1) / 2), F.floor((total + 2) / 2)
    below = F.col("_upto") - F.col("_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((below < rank) & (rank <= F.col("_upto")), F.col("_v")))

    marked = ranked.withColumns({"_low": low, "_high": high})
    return marked.agg(((at(F.col("_low")) + at(F.col("_high"))) / 2).alias("median"))


def evaluation_metrics(pairs: DataFrame) -> DataFrame:
    """One row of confusion counts, errors, bias, data quality and disagreement counts."""
    proposed = F.col("proposed_status") == "approve"
    actual = F.col("actual_status") == "approve"
    both = proposed & actual
    gap = F.when(both, F.col("proposed_benefit_amount") - F.col("actual_paid_amount"))
    paid = F.col("actual_paid_amount").cast("double")
    manual = F.exists(flag_lists(F.col("flags")), lambda f: F.lower(f).contains("manual"))
    frame = pairs.withColumns(
        {
            "_gap": gap,
            "_square": gap.cast("double") * gap.cast("double"),
            "_relative": F.when(paid != 0, F.abs(gap.cast("double") / paid)),
            "_manual": manual,
            "_missing": F.size(missing_fields(F.col("missing_data"))) > 0,
        }
    )
    total = F.count(F.lit(1))
    sums = frame.agg(
        total.alias("total_claims"),
        F.count_if(both).alias("true_positives"),
        F.count_if(~proposed & ~actual).alias("true_negatives"),
        F.count_if(proposed & ~actual).alias("false_positives"),
        F.count_if(~proposed & actual).alias("false_negatives"),
        F.sum(F.abs("_gap")).cast("double").alias("_abs"),
        F.avg("_square").alias("_mse"),
        F.avg("_relative").alias("_mape"),
        F.sum(F.when(proposed, F.col("proposed_benefit_amount"))).cast("double").alias("_proposed"),
        F.sum(F.when(actual, F.col("actual_paid_amount"))).cast("double").alias("_actual"),
        F.avg((~F.col("_missing")).cast("double")).alias("complete_data_rate"),
        F.avg(F.col("_manual").cast("double")).alias("manual_review_rate"),
        F.avg("confidence_score").alias("avg_confidence_score"),
        F.avg("processing_time_ms").alias("avg_processing_time_ms"),
        F.count_if(F.col("proposed_status") != F.col("actual_status")).alias("status_mismatches"),
        F.count_if(F.col("_gap") > 50).alias("amount_over_by_50_plus"),
        F.count_if(F.col("_gap") < -50).alias("amount_under_by_50_plus"),
    )
    tp, tn = F.col("true_positives"), F.col("true_negatives")
    fp, fn = F.col("false_positives"), F.col("false_negatives")

    def rate(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    rated = sums.withColumns(
        {
            "accuracy": rate(tp + tn, F.col("total_claims")),
            "precision": rate(tp, tp + fp),
            "recall": rate(tp, tp + fn),
            "mean_absolute_error": rate(F.col("_abs"), tp),
            "root_mean_squared_error": F.coalesce(F.sqrt("_mse"), F.lit(0.0)),
            "mean_absolute_percentage_error": F.coalesce("_mape", F.lit(0.0)),
            "avg_proposed_benefit": rate(F.col("_proposed"), tp + fp),
            "avg_actual_benefit": rate(F.col("_actual"), tp + fn),
        }
    )
    mean_p, mean_a = F.col("avg_proposed_benefit"), F.col("avg_actual_benefit")
    return rated.withColumns(
        {
            "f1_score": rate(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
            "bias_magnitude": F.when(mean_a > 0, F.abs(mean_p - mean_a) / mean_a).otherwise(0.0),
            "bias_direction": F.when(mean_a <= 0, "neutral")
            .when(F.abs(mean_p - mean_a) < mean_a * 0.05, "neutral")
            .when(mean_p > mean_a, "more_generous")
            .otherwise("less_generous"),
        }
    ).drop("_abs", "_mse", "_mape", "_proposed", "_actual")


def median_absolute_error(pairs: DataFrame) -> DataFrame:
    both = (F.col("proposed_status") == "approve") & (F.col("actual_status") == "approve")
    errors = pairs.filter(both).select(
        F.abs(F.col("proposed_benefit_amount") - F.col("actual_paid_amount")).alias("error")
    )
    return exact_median(errors, "error").select(
        F.coalesce("median", F.lit(0.0)).alias("median_absolute_error")
    )


def mismatches(pairs: DataFrame) -> DataFrame:
    """Claims whose status disagrees, or whose approved amounts differ by 50 or more."""
    approve = F.lit("approve")
    both = (F.col("proposed_status") == approve) & (F.col("actual_status") == approve)
    gap = F.when(
        both, F.col("proposed_benefit_amount") - F.col("actual_paid_amount")
    ).otherwise(F.lit(0)).cast("decimal(13,2)")
    status_match = F.col("proposed_status") == F.col("actual_status")
    cause = (
        F.when(
            ~F.col("status_match")
            & (F.col("proposed_status") == "deny")
            & (F.col("actual_status") == approve),
            "False negative: System too restrictive or missing eligible items",
        )
        .when(~F.col("status_match"), "False positive: System approved ineligible charges")
        .when(
            F.col("difference") > 100,
            "Amount too high: Possible eligibility over-classification or cap miscalculation",
        )
        .when(
            F.col("difference") < -100, "Amount too low: Missing eligible items or incorrect cap"
        )
        .when(
            F.col("difference") != 0,
            "Minor amount difference: Likely due to rounding or line item interpretation",
        )
        .otherwise("Unknown")
    )
    return (
        pairs.withColumns({"status_match": status_match, "difference": gap})
        .filter(~F.col("status_match") | (F.abs("difference") >= 50))
        .withColumns(
            {
                "mismatch_type": F.when(F.col("status_match"), "amount_only").otherwise(
                    "status_only"
                ),
                "likely_cause": cause,
                "needs_review": (F.abs("difference") > 100) | ~F.col("status_match"),
                "flag_list": flag_lists(F.col("flags")),
                "actual_paid_amount": F.coalesce("actual_paid_amount", F.lit(0)).cast(
                    "decimal(12,2)"
                ),
            }
        )
    )


def top_causes(found: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent causes per side."""
    side = F.when(
        F.col("mismatch_type") == "amount_only",
        F.when(F.col("difference") > 0, "over").otherwise("under"),
    ).otherwise(
        F.when(F.col("proposed_status") == "approve", "false_positive").otherwise("false_negative")
    )
    counts = found.groupBy(side.alias("side"), "likely_cause").agg(
        F.count(F.lit(1)).alias("occurrences")
    )
    return first_per_group(
        counts, ["side"], [F.desc("occurrences"), F.asc("likely_cause")], k
    )


def mismatch_summary(found: DataFrame) -> DataFrame:
    over = F.col("difference") > 0
    amount = F.col("mismatch_type") == "amount_only"
    return found.agg(
        F.count_if(~amount).alias("status_disagreements"),
        F.count_if(amount).alias("amount_disagreements"),
        F.count_if(amount & over).alias("over_estimates"),
        F.coalesce(
            F.try_divide(
                F.sum(F.when(amount & over, F.col("difference"))).cast("double"),
                F.count_if(amount & over),
            ),
            F.lit(0.0),
        ).alias("avg_over"),
        F.count_if(amount & ~over).alias("under_estimates"),
        F.coalesce(
            F.try_divide(
                F.sum(F.when(amount & ~over, -F.col("difference"))).cast("double"),
                F.count_if(amount & ~over),
            ),
            F.lit(0.0),
        ).alias("avg_under"),
        F.count_if(amount & (F.abs("difference") > 100)).alias("large_errors"),
    )


def run_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Metrics of one run. Denominators as published: matches over all claims, mean actual over
    matches, errors over rows with an amount."""
    known = F.coalesce(F.col("actual_status"), F.lit("")) != ""
    match = known & (F.lower("proposed_status") == F.lower("actual_status"))
    error = F.when(
        known & F.col("actual_amount").isNotNull(),
        F.abs(F.col("proposed_amount") - F.col("actual_amount")),
    )
    actual = F.sum(F.when(known, F.coalesce("actual_amount", F.lit(0))).otherwise(0)).cast("double")
    proposed = F.sum("proposed_amount").cast("double")
    grouped = results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(match).alias("status_matches"),
        proposed.alias("total_proposed_amount"),
        actual.alias("total_actual_amount"),
        F.try_divide(F.sum(error).cast("double"), F.count(error)).alias("mean_absolute_error"),
        F.max(error).cast("double").alias("max_absolute_error"),
        F.min(error).cast("double").alias("min_absolute_error"),
    )
    return grouped.withColumns(
        {
            "status_accuracy": F.coalesce(
                F.try_divide(F.col("status_matches"), F.col("total_claims")), F.lit(0.0)
            ),
            "total_variance": F.col("total_actual_amount") - F.col("total_proposed_amount"),
            "avg_proposed_amount": F.coalesce(
                F.try_divide(F.col("total_proposed_amount"), F.col("total_claims")), F.lit(0.0)
            ),
            "avg_actual_amount": F.coalesce(
                F.try_divide(F.col("total_actual_amount"), F.col("status_matches")), F.lit(0.0)
            ),
        }
    )


def compare_runs(results: DataFrame, new: str, previous: str) -> DataFrame:
    """Change of accuracy, error and mean amounts between two runs, in one aggregation pass."""
    metrics = run_metrics(results.filter(F.col("run_id").isin(new, previous)), ["run_id"])
    names = ["status_accuracy", "mean_absolute_error", "avg_proposed_amount", "avg_actual_amount"]
    side = {
        label: F.col("run_id") == run for label, run in (("new", new), ("previous", previous))
    }
    wide = metrics.agg(
        *[
            F.max(F.when(condition, F.col(name))).alias(f"{label}_{name}")
            for label, condition in side.items()
            for name in names
        ]
    )
    return wide.withColumns(
        {f"{n}_change": F.col(f"new_{n}") - F.col(f"previous_{n}") for n in names}
    )


def variance_summary(base: DataFrame) -> DataFrame:
    """Totals and errors over claims with an outcome."""
    rows = base.filter(F.col("actual_status").isNotNull())
    pct = F.when(
        F.col("actual_paid_amount") > 0,
        F.col("difference").cast("double") / F.col("actual_paid_amount").cast("double") * 100,
    )
    proposed_yes = F.lower("proposed_status") == "approve"
    actual_yes = F.lower("actual_status") == "approve"
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("claims"),
        F.count_if("status_match").alias("status_matches"),
        F.try_divide(F.count_if("status_match") * 100.0, n).alias("status_accuracy"),
        F.sum("proposed_benefit_amount").cast("double").alias("total_proposed"),
        F.sum("actual_paid_amount").cast("double").alias("total_actual"),
        F.sum("difference").cast("double").alias("total_variance"),
        F.try_divide(F.sum("difference").cast("double"), n).alias("mean_absolute_error"),
        F.avg(pct).alias("mean_percentage_error"),
        F.count_if(F.col("difference") > F.lit("0.01").cast(WIDE_MONEY)).alias("amount_variances"),
        F.count_if(proposed_yes & (F.lower("actual_status") == "deny")).alias("false_positives"),
        F.count_if((F.lower("proposed_status") == "deny") & actual_yes).alias("false_negatives"),
    )


def variance_rows(base: DataFrame) -> DataFrame:
    """Claims that differ in status or by more than a cent, tagged."""
    tag = (
        F.when(F.col("status_match"), "amount_variance")
        .when(F.lower("proposed_status") == "approve", "false_positive")
        .otherwise("false_negative")
    )
    return base.filter(
        F.col("actual_status").isNotNull()
        & (~F.col("status_match") | (F.col("difference") > F.lit("0.01").cast(WIDE_MONEY)))
    ).withColumn("tag", tag)


def histogram(values: DataFrame, column: str, max_bins: int = 10) -> DataFrame:
    """Equal-width bins over the observed range; the last bin includes the maximum."""
    x = F.col(column).cast("double")
    rows = values.filter(F.col(column).isNotNull()).select(x.alias("x"))
    bounds = rows.agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")
    )
    flat = F.col("low") == F.col("high")
    shape = bounds.select(
        F.struct(
            F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
            F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
            F.least(F.lit(max_bins), F.col("n")).cast("int").alias("bins"),
        ).alias("shape")
    )
    placed = rows.withColumn("s", shape.scalar()).select(
        F.least(
            F.floor((F.col("x") - F.col("s.low")) / (F.col("s.high") - F.col("s.low")) * F.col("s.bins")),
            F.col("s.bins") - 1,
        ).cast("int").alias("bin")
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("claims"))
    grid = shape.filter(F.col("shape.bins") > 0).select(
        F.explode(F.sequence(F.lit(0), F.col("shape.bins") - 1)).alias("bin"), "shape.*"
    )
    width = (F.col("high") - F.col("low")) / F.col("bins")
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.col("low") + F.col("bin") * width).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("claims", F.lit(0)).alias("claims"),
    )


def accuracy_by_confidence(base: DataFrame) -> DataFrame:
    rows = base.filter(F.col("actual_status").isNotNull())
    return rows.groupBy((F.floor(F.col("confidence_score") / 10) * 10).alias("confidence_band")).agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if("status_match").alias("matches"),
        F.avg(F.col("status_match").cast("double")).alias("accuracy"),
    )


def dashboard_kpis(base: DataFrame) -> DataFrame:
    """Accuracy, error and mean absolute percentage over rows with an outcome; both row totals."""
    known = F.col("actual_status").isNotNull()
    pct = F.when(
        F.col("actual_paid_amount") > 0,
        F.abs(F.col("proposed_benefit_amount") - F.col("actual_paid_amount")).cast("double")
        / F.col("actual_paid_amount").cast("double") * 100,
    ).otherwise(0.0)
    return base.agg(
        F.avg(F.when(known, F.col("status_match").cast("double") * 100)).alias("status_accuracy"),
        F.avg(F.when(known, F.col("difference").cast("double"))).alias("mae"),
        F.avg(F.when(known, pct)).alias("avg_percentage_error"),
        F.count_if(known).alias("total_with_actual"),
        F.count(F.lit(1)).alias("total_decisions"),
    )


def recommendations(metrics: DataFrame) -> DataFrame:
    """Issues raised by the metric thresholds, with priority and a measured value."""
    fp, fn = F.col("false_positives"), F.col("false_negatives")

    def issue(condition: Column, priority: str, name: Column, value: Column) -> Column:
        return F.when(
            condition,
            F.struct(
                F.lit(priority).alias("priority"),
                name.alias("issue"),
                value.cast("double").alias("value"),
            ),
        )

    mae, mape = F.col("mean_absolute_error"), F.col("mean_absolute_percentage_error")
    bias, confidence = F.col("bias_magnitude"), F.col("avg_confidence_score")
    review, accuracy = F.col("manual_review_rate"), F.col("accuracy")
    found = F.array_compact(
        F.array(
            issue(fp > fn * 1.5, "HIGH", F.lit("High False Positive Rate"), fp),
            issue(fn > fp * 1.5, "HIGH", F.lit("High False Negative Rate"), fn),
            issue(mae > 100, "HIGH", F.lit("High Amount Variance"), mae),
            issue(mape > 0.10, "MEDIUM", F.lit("High Percentage Error"), mape),
            issue(
                (F.col("bias_direction") != "neutral") & (bias > 0.05),
                "MEDIUM",
                F.concat(F.lit("System Bias: "), F.col("bias_direction")),
                bias,
            ),
            issue(confidence < 70, "MEDIUM", F.lit("Low Confidence Scores"), confidence),
            issue(review > 0.3, "LOW", F.lit("High Manual Review Rate"), review),
            issue(accuracy < 0.8, "HIGH", F.lit("Status accuracy below 80%"), accuracy),
        )
    )
    fine = F.struct(
        F.lit("INFO").alias("priority"),
        F.lit("System Performing Well").alias("issue"),
        F.lit(None).cast("double").alias("value"),
    )
    return metrics.select(
        F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(fine))).alias("r")
    ).select("r.*")
