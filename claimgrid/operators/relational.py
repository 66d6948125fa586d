"""Filters, joins, counts and listings over the claims relations.

One-to-many joins never fan out: the many side is reduced per claim first (map-side combine), so
a claim that owns a third of all documents reaches the join as a single row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions.text import WIDE_MONEY, contains_any
from claimgrid.plans import ordered
from claimgrid.plans.barrier import tasks_for
from claimgrid.plans.skewed import join_back
from claimgrid.rules import fixed_values as fv


# ----- filters and selections -------------------------------------------------------------------


def claims_by_keys(claims: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Claims whose id or tracking number is listed in ``keys`` (a batch, not one at a time)."""
    return claims.join(keys.select(on).distinct(), on, "left_semi")


def documents_for(claims: DataFrame, docs: DataFrame, doc_type: str | None = None) -> DataFrame:
    """Documents of the given claims, NULL text as ''; the type filter reaches the scan."""
    if doc_type is not None:
        docs = docs.filter(F.col("document_type") == doc_type)
    return docs.join(claims.select("claim_id").distinct(), "claim_id", "left_semi").withColumn(
        "extracted_text", F.coalesce("extracted_text", F.lit(""))
    )


def select_relevant_documents(docs: DataFrame, fallback: int = 5) -> DataFrame:
    """Files worth reading per claim: priority names, else secondary names, else the first PDFs.

    The stage of a claim is one ``max`` per claim; the fallback keeps the feature's own limit of
    five files, found with a bounded top-k that Spark prunes before the shuffle.
    """
    name = F.lower("original_filename")
    usable = (F.col("mime_type") == "application/pdf") & ~contains_any(name, fv.SKIP_FILE_KEYWORDS)
    staged = docs.filter(usable).withColumn(
        "stage",
        F.when(contains_any(name, fv.PRIORITY_FILE_KEYWORDS), 3)
        .when(contains_any(name, fv.SECONDARY_FILE_KEYWORDS), 2)
        .otherwise(1),
    )
    best = staged.groupBy("claim_id").agg(F.max("stage").alias("best_stage"))
    kept = join_back(staged, best, ["claim_id"], spread=["claim_id", "document_id"])
    kept = kept.filter(F.col("stage") == F.col("best_stage"))
    first = ordered.Window.partitionBy("claim_id").orderBy("created_at", "document_id")
    named = kept.filter(F.col("best_stage") > 1)
    rest = (
        kept.filter(F.col("best_stage") == 1)
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= fallback)
        .drop("_rn")
    )
    return named.unionByName(rest).drop("best_stage")


def invoice_candidate() -> Column:
    """Invoice-like document, or a short deposit disposition; never an authorization form."""
    name = F.lower("original_filename")
    kind = F.lower("document_type")
    length = F.length(F.coalesce("extracted_text", F.lit("")))
    move_out = ~name.contains("authorization") & (
        kind.isin("invoice", "unknown")
        | name.contains("invoice")
        | name.contains("move-out-statement")
        | name.contains("move out statement")
        | (name.contains("statement") & name.contains("move"))
        | (name.contains("deposit") & name.contains("disposition"))
    )
    disposition = (
        name.contains("deposit")
        & (name.contains("disposition") | name.contains("amount due"))
        & ~name.contains("ledger")
        & (length > 0)
        & (length < 2000)
    )
    return move_out | disposition


def invoice_candidates(docs: DataFrame) -> DataFrame:
    return docs.filter(invoice_candidate())


def fallback_invoice_candidates(docs: DataFrame) -> DataFrame:
    """Only for claims without an invoice: documents that read or are named like one."""
    with_invoice = docs.filter(F.col("document_type") == "invoice").select("claim_id").distinct()
    text = F.lower(F.coalesce("extracted_text", F.lit("")))
    name = F.lower("original_filename")
    like = (
        contains_any(name, fv.MOVE_OUT_FILE_PATTERNS)
        | contains_any(text, fv.INVOICE_LIKE_KEYWORDS)
        | contains_any(name, fv.INVOICE_LIKE_KEYWORDS)
    )
    return docs.filter(like & (F.col("document_type") != "addendum")).join(
        with_invoice, "claim_id", "left_anti"
    )


def tracking_range(
    claims: DataFrame, low: int, high: int, exclude: tuple[int, int] | None = None
) -> DataFrame:
    """Numeric tracking numbers inside a range and outside another."""
    number = F.when(
        F.col("claim_tracking_number").rlike("^[0-9]+$"), F.col("claim_tracking_number")
    ).try_cast("bigint")
    kept = claims.withColumn("tracking_no", number).filter(
        F.col("tracking_no").between(low, high)
    )
    if exclude:
        kept = kept.filter(~F.col("tracking_no").between(*exclude))
    return kept


def ready_queue(queue: DataFrame, claims: DataFrame, as_of: str) -> DataFrame:
    """Pending work that is due, with its claim."""
    due = queue.filter(
        (F.col("status") == "pending") & (F.col("scheduled_at") <= F.lit(as_of).cast("timestamp_ntz"))
    )
    return due.join(
        claims.select("claim_id", "claim_tracking_number", "claim_amount"), "claim_id"
    )


def claim_work_items(queue: DataFrame, claims: DataFrame, as_of: str, size: int = 10) -> DataFrame:
    """The next items by priority and time: a top-k, never a full sort."""
    return (
        ready_queue(queue, claims, as_of)
        .orderBy(F.desc("priority"), F.asc("scheduled_at"), F.asc("queue_id"))
        .limit(size)
    )


def take_work_items(
    queue: DataFrame, as_of: str, worker: str, size: int = 10
) -> DataFrame:
    """The queue after the next items were taken: they become processing with start and worker."""
    now = F.lit(as_of).cast("timestamp_ntz")
    picked = (
        queue.filter((F.col("status") == "pending") & (F.col("scheduled_at") <= now))
        .orderBy(F.desc("priority"), F.asc("scheduled_at"), F.asc("queue_id"))
        .limit(size)
        .select("queue_id", F.lit(True).alias("_picked"))
    )
    taken = F.coalesce("_picked", F.lit(False))
    return (
        queue.join(picked, "queue_id", "left")
        .withColumns(
            {
                "status": F.when(taken, "processing").otherwise(F.col("status")),
                "started_at": F.when(taken, now).otherwise(F.col("started_at")),
                "worker_id": F.when(taken, worker),
            }
        )
        .drop("_picked")
    )


def page(df: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """LIMIT / OFFSET over a total order."""
    return df.orderBy(*order).offset(offset).limit(size)


def in_period(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Half-open date range; the bounds are literals, so they prune partitions and row groups."""
    stamp = F.col(column)
    return df.filter(
        (stamp >= F.lit(start).cast("timestamp_ntz")) & (stamp < F.lit(end).cast("timestamp_ntz"))
    )


def with_cap_reason(decisions: DataFrame) -> DataFrame:
    """Which amount bound the cap: claim, benefit, both, or the invoice total."""
    claim = F.coalesce("claim_amount", F.lit(0))
    benefit = F.coalesce("max_benefit", F.lit(0))
    effective = (
        F.when((claim > 0) & (benefit > 0), F.least(claim, benefit))
        .when(claim > 0, claim)
        .when(benefit > 0, benefit)
    )
    reason = (
        F.when(F.coalesce("cap_amount", F.lit(0)) == 0, None)
        .when(F.col("invoice_total") < effective, "invoice_total")
        .when((claim > 0) & (benefit > 0) & (claim == benefit), "claim_amount_and_max_benefit")
        .when((claim > 0) & ((benefit <= 0) | (claim < benefit)), "claim_amount")
        .when(benefit > 0, "max_benefit")
    )
    return decisions.withColumn("cap_reason", reason)


# ----- joins ------------------------------------------------------------------------------------


def document_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("claim_id").agg(
        F.count("document_id").alias("document_count"),
        F.max("processing_status").alias("doc_processing_status"),
    )


def claims_with_document_count(claims: DataFrame, docs: DataFrame) -> DataFrame:
    counts = document_counts(docs).select("claim_id", "document_count")
    return claims.join(counts, "claim_id", "left").withColumn(
        "document_count", F.coalesce("document_count", F.lit(0))
    )


def batch_view(
    claims: DataFrame, decisions: DataFrame, docs: DataFrame, as_of: str, days: int, size: int
) -> DataFrame:
    """Open recent claims with their active decision and document state, most urgent first.

    The order is that of the claims, so the first ``size`` of them are cut before the other tables
    are touched; only rows of those claims are joined and counted.
    """
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAY")
    recent = claims.filter(
        F.col("status").isin("pending", "processing") & (F.col("created_at") >= since)
    )
    active = decisions.filter("is_active").select(
        "claim_id", "proposed_status", "proposed_benefit_amount", "confidence_score"
    )
    order = [F.desc("priority"), F.asc("created_at"), F.asc("claim_id")]
    first = recent.orderBy(*order).limit(size)
    ids = F.broadcast(first.select("claim_id"))  # at most ``size`` rows
    return (
        first.join(active.join(ids, "claim_id", "left_semi"), "claim_id", "left")
        .join(document_counts(docs.join(ids, "claim_id", "left_semi")), "claim_id", "left")
        .withColumn("document_count", F.coalesce("document_count", F.lit(0)))
        .orderBy(*order)
        .limit(size)
    )


def policyholder_page(
    claims: DataFrame, decisions: DataFrame, order: list[Column], size: int, offset: int = 0
) -> DataFrame:
    """One page of claims with their active decisions; ``order`` is over columns of the claims.

    Every claim gives at least one row, so the page lies within the first offset + size claims.
    """
    first = claims.orderBy(*order).limit(offset + size)
    ids = F.broadcast(first.select("claim_id"))  # at most offset + size rows
    return page(policyholder_claims(first, decisions.join(ids, "claim_id", "left_semi")), order, size, offset)


def policyholder_claims(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    active = decisions.filter("is_active").select(
        "claim_id", "proposed_status", "proposed_benefit_amount"
    )
    return claims.join(active, "claim_id", "left")


def decision_history(decisions: DataFrame, audit: DataFrame) -> DataFrame:
    """Every decision with the size and last time of its audit trail."""
    trail = audit.groupBy("decision_id").agg(
        F.count(F.lit(1)).alias("audit_log_count"), F.max("created_at").alias("last_audit_time")
    )
    return decisions.join(trail, "decision_id", "left").withColumn(
        "audit_log_count", F.coalesce("audit_log_count", F.lit(0))
    )


def version_scorecard(
    decisions: DataFrame, validation: DataFrame, as_of: str, days: int
) -> DataFrame:
    """Per engine version: decisions, validated, accurate, mean absolute amount difference."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAY")
    recent = decisions.filter(F.col("is_active") & (F.col("decided_at") >= since)).select(
        "decision_id", "engine_version", "proposed_status", "proposed_benefit_amount"
    )
    joined = recent.join(
        validation.select("decision_id", "validation_id", "actual_status", "actual_paid_amount"),
        "decision_id",
        "left",
    )
    gap = F.abs(F.col("proposed_benefit_amount") - F.coalesce("actual_paid_amount", F.lit(0)))
    return joined.groupBy("engine_version").agg(
        F.count(F.lit(1)).alias("total_decisions"),
        F.count("validation_id").alias("validated_count"),
        F.count_if(F.col("proposed_status") == F.col("actual_status")).alias("accurate_count"),
        F.try_divide(F.sum(gap).cast("double"), F.count(F.lit(1))).alias("avg_amount_diff"),
    )


def daily_dashboard(
    claims: DataFrame,
    decisions: DataFrame,
    docs: DataFrame,
    as_of: str,
    days: int,
    fanout_safe: bool = True,
) -> DataFrame:
    """Daily counts and amounts by status.

    Decisions and documents are reduced per claim, so three COUNT DISTINCTs become sums.
    ``fanout_safe=False`` reproduces the totals of a plain three-way join: each claim then weighs
    as often as its decisions times its documents, which is a multiplication, not a fan-out.
    """
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAY")
    recent = claims.filter(F.col("created_at") >= since).select(
        "claim_id", "status", "claim_amount", F.to_date("created_at").alias("claim_day")
    )
    # One aggregate holds both counts of a claim and one join follows, so a task sorts and hashes few
    # sets of rows; the claims are dealt out in as many tasks as all tables have rows for.
    active = decisions.filter("is_active")
    recent = recent.repartition(tasks_for(claims, active, docs), "claim_id")
    counted = active.select(
        "claim_id", "proposed_benefit_amount", "confidence_score", F.lit(1).alias("_decision")
    ).unionByName(docs.select("claim_id", "document_id"), allowMissingColumns=True)
    per_claim = counted.groupBy("claim_id").agg(
        F.count("_decision").alias("n_dec"),
        F.sum("proposed_benefit_amount").alias("benefit"),
        F.sum("confidence_score").alias("conf"),
        F.count("document_id").alias("n_doc"),
    )
    wide = recent.join(per_claim, "claim_id", "left")
    n_dec = F.coalesce("n_dec", F.lit(0))
    n_doc = F.coalesce("n_doc", F.lit(0))
    claim_weight = F.lit(1) if fanout_safe else F.greatest(n_dec, F.lit(1)) * F.greatest(n_doc, F.lit(1))
    decision_weight = F.lit(1) if fanout_safe else F.greatest(n_doc, F.lit(1))
    return wide.groupBy("claim_day", "status").agg(
        F.count(F.lit(1)).alias("claim_count"),
        F.sum(n_dec).alias("decision_count"),
        F.sum(n_doc).alias("document_count"),
        F.sum(F.col("claim_amount").cast(WIDE_MONEY) * claim_weight).cast("double").alias(
            "total_claim_amount"
        ),
        F.try_divide(
            F.sum(F.col("benefit").cast(WIDE_MONEY) * decision_weight).cast("double"),
            F.sum(n_dec * decision_weight),
        ).alias("avg_benefit_amount"),
        F.try_divide(
            F.sum(F.col("conf") * decision_weight), F.sum(n_dec * decision_weight)
        ).alias("avg_confidence"),
    )


def unvalidated(validation: DataFrame, decisions: DataFrame) -> DataFrame:
    """Validated claims that lack an active decision."""
    return (
        validation.select("claim_id")
        .distinct()
        .join(decisions.filter("is_active").select("claim_id"), "claim_id", "left_anti")
    )


def claims_without_documents(claims: DataFrame, docs: DataFrame) -> DataFrame:
    return claims.join(docs.select("claim_id"), "claim_id", "left_anti")


def claims_with_documents(claims: DataFrame, docs: DataFrame) -> DataFrame:
    return claims.join(docs.select("claim_id"), "claim_id", "left_semi")


# ----- aggregates -------------------------------------------------------------------------------


def status_summary(claims: DataFrame) -> DataFrame:
    return claims.groupBy("status").agg(
        F.count(F.lit(1)).alias("claim_count"),
        F.sum("claim_amount").cast("double").alias("total_amount"),
        F.try_divide(F.sum("claim_amount").cast("double"), F.count("claim_amount")).alias(
            "avg_amount"
        ),
        F.min("created_at").alias("earliest"),
        F.max("created_at").alias("latest"),
    )


def decision_accuracy(
    decisions: DataFrame, validation: DataFrame, start: str, end: str
) -> DataFrame:
    """Status accuracy and amount differences of active decisions, zero-safe."""
    window = validation.filter(
        F.col("actual_decision_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    ).select("decision_id", "actual_status", "actual_paid_amount")
    active = decisions.filter("is_active").select(
        "decision_id", "proposed_status", "proposed_benefit_amount"
    )
    gap = F.col("proposed_benefit_amount") - F.col("actual_paid_amount")
    totals = window.join(active, "decision_id").agg(
        F.count(F.lit(1)).alias("total_validations"),
        F.count_if(F.col("proposed_status") == F.col("actual_status")).alias("accurate_predictions"),
        F.sum(gap).cast("double").alias("_signed"),
        F.sum(F.abs(gap)).cast("double").alias("_absolute"),
    )
    n = F.col("total_validations")
    return totals.select(
        "total_validations",
        "accurate_predictions",
        F.round(F.coalesce(F.try_divide(F.col("accurate_predictions") * 100, n), F.lit(0.0)), 2).alias(
            "accuracy_percentage"
        ),
        F.round(F.coalesce(F.try_divide(F.col("_signed"), n), F.lit(0.0)), 2).alias(
            "avg_amount_difference"
        ),
        F.round(F.coalesce(F.try_divide(F.col("_absolute"), n), F.lit(0.0)), 2).alias(
            "avg_absolute_difference"
        ),
    )


def batch_status(queue: DataFrame) -> DataFrame:
    """Rollup and derived state per batch."""
    done = F.col("status").isin("completed", "failed")
    counts = queue.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("claim_count"),
        F.count_if(done).alias("processed_count"),
        F.count_if(F.col("status") == "completed").alias("successful_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.count_if(F.col("status") == "processing").alias("_running"),
        F.min("scheduled_at").alias("started_at"),
        F.max("completed_at").alias("completed_at"),
    )
    everything = F.col("claim_count")
    return counts.withColumn(
        "status",
        F.when(F.col("failed_count") == everything, "failed")
        .when(F.col("processed_count") == everything, "completed")
        .when(F.col("_running") > 0, "processing")
        .otherwise("pending"),
    ).drop("_running")


def batch_performance(queue: DataFrame) -> DataFrame:
    """Seconds per item, success rate and throughput per batch."""
    micros = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    )
    seconds = micros / F.lit(1e6)
    ok = F.col("status") == "completed"
    span = (
        F.unix_micros(F.max("completed_at").cast("timestamp"))
        - F.unix_micros(F.min("started_at").cast("timestamp"))
    ) / F.lit(1e6)
    grouped = queue.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("claim_count"),
        F.count_if(ok).alias("successful_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.sum(seconds).alias("total_seconds"),
        F.avg(seconds).alias("avg_seconds"),
        F.min(seconds).alias("min_seconds"),
        F.max(seconds).alias("max_seconds"),
        span.alias("elapsed_seconds"),
    )
    return grouped.withColumns(
        {
            "success_rate": F.try_divide(F.col("successful_count") * 100.0, F.col("claim_count")),
            "claims_per_minute": F.try_divide(
                F.col("claim_count") * 60.0, F.col("elapsed_seconds")
            ),
        }
    )


def archive_candidates(claims: DataFrame, cutoff: str) -> DataFrame:
    """Completed claims created before the cutoff: the ids as rows, so any number fits."""
    return claims.filter(
        (F.col("status") == "completed")
        & (F.col("created_at") < F.lit(cutoff).cast("timestamp_ntz"))
    ).select("claim_id", "created_at")


def archive_summary(candidates: DataFrame) -> DataFrame:
    return candidates.agg(
        F.count(F.lit(1)).alias("archived_count"),
        F.min("claim_id").alias("first_claim_id"),
        F.max("claim_id").alias("last_claim_id"),
    )


def coverage(claims: DataFrame, docs: DataFrame, decisions: DataFrame, validation: DataFrame) -> DataFrame:
    """How many claims have documents, decisions, validations, and both of the latter."""
    flags = [
        (docs.select("claim_id").distinct(), "has_documents"),
        (decisions.filter("is_active").select("claim_id").distinct(), "has_decision"),
        (validation.select("claim_id").distinct(), "has_validation"),
    ]
    wide = claims.select("claim_id")
    for keys, name in flags:
        wide = wide.join(keys.withColumn(name, F.lit(1)), "claim_id", "left")
    both = F.col("has_decision").isNotNull() & F.col("has_validation").isNotNull()
    return wide.agg(
        F.count(F.lit(1)).alias("claims"),
        *[F.count(name).alias(name) for _, name in flags],
        F.count_if(both).alias("verified_claims"),
    )


def affected_decisions(decisions: DataFrame, changelog: DataFrame) -> DataFrame:
    """Decisions made by each released rules version."""
    counts = decisions.groupBy(F.col("engine_version").alias("version")).agg(
        F.count(F.lit(1)).alias("affected_decision_count")
    )
    return changelog.join(counts, "version", "left").withColumn(
        "affected_decision_count", F.coalesce("affected_decision_count", F.lit(0))
    )


def decision_rates(decisions: DataFrame) -> DataFrame:
    """Approvals, denials, rates, approved money and mean confidence."""
    approved = F.col("proposed_status") == "approve"
    total = F.count(F.lit(1))
    return decisions.agg(
        total.alias("decisions"),
        F.count_if(approved).alias("approvals"),
        F.count_if(F.col("proposed_status") == "deny").alias("denials"),
        F.try_divide(F.count_if(approved) * 100.0, total).alias("approval_rate"),
        F.try_divide(F.count_if(F.col("proposed_status") == "deny") * 100.0, total).alias(
            "denial_rate"
        ),
        F.sum(F.when(approved, F.col("proposed_benefit_amount"))).cast("double").alias(
            "approved_amount"
        ),
        F.avg("confidence_score").alias("avg_confidence"),
    )


def override_analysis(overrides: DataFrame) -> DataFrame:
    """Unapplied overrides by direction and category; an item counts once per category it has."""
    direction = F.when(
        ~F.col("system_should_be_included") & F.col("user_should_be_included"), "denied_to_approved"
    ).when(
        F.col("system_should_be_included") & ~F.col("user_should_be_included"), "approved_to_denied"
    ).otherwise("unchanged")
    names = ["is_rent", "is_cleaning", "is_repair", "is_damage"]
    tags = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    return (
        overrides.filter(~F.col("is_applied_to_rules"))
        .withColumns(
            {
                "direction": direction,
                "batch_id": F.date_format("override_timestamp", "'batch_'yyyy_MM_dd"),
            }
        )
        .withColumn("category", F.explode_outer(tags))
        .groupBy("batch_id", "direction", F.coalesce("category", F.lit("none")).alias("category"))
        .agg(F.count(F.lit(1)).alias("overrides"))
    )


# ----- latest rows, chains, audit ----------------------------------------------------------------


def latest_active_decision(decisions: DataFrame) -> DataFrame:
    return ordered.latest_per_key(
        decisions.filter("is_active"), ["claim_id"], ["decided_at", "decision_id"]
    )


def latest_validation(validation: DataFrame) -> DataFrame:
    return ordered.latest_per_key(
        validation, ["claim_id"], ["actual_decision_date", "validation_id"]
    )


def supersede_chain(decisions: DataFrame) -> DataFrame:
    """Only the last decision of a claim stays active; the others point to their successor."""
    chunked = ordered.cut_by_quantiles(decisions, "decided_at")
    linked = ordered.shift(
        chunked, ["claim_id"], ["_chunk"], ["decided_at", "decision_id"],
        {"_next": "decision_id"}, forward=True,
    )
    return linked.withColumns(
        {"superseded_by": F.col("_next"), "is_active": F.col("_next").isNull()}
    ).drop("_next", "_chunk")


def append_decisions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add decision rows and re-derive which one is active."""
    return supersede_chain(existing.unionByName(new, allowMissingColumns=True))


def audit_events(versions: DataFrame, fields: list[str]) -> DataFrame:
    """Audit rows from decision row versions: created, superseded, overridden or reviewed."""
    row = F.struct(*fields)
    chunked = ordered.cut_by_quantiles(versions, "changed_at").withColumn("_row", row)
    paired = ordered.shift(
        chunked, ["decision_id"], ["_chunk"], ["changed_at", "version_no"],
        {"_old": "_row"}, forward=False,
    )
    old = F.col("_old")
    action = (
        F.when(old.isNull(), "created")
        .when(old["is_active"] & ~F.col("is_active"), "superseded")
        .when(
            (F.col("decision_type") == "manual_override")
            & (old["decision_type"] != "manual_override"),
            "overridden",
        )
        .otherwise("reviewed")
    )
    return paired.select(
        "decision_id",
        "claim_id",
        "version_no",
        action.alias("action"),
        F.coalesce("decided_by", F.lit("system")).alias("user_id"),
        F.when(old.isNotNull(), F.to_json(old)).alias("old_values"),
        F.to_json("_row").alias("new_values"),
        F.col("changed_at").alias("created_at"),
    )


def number_lines(items: DataFrame) -> DataFrame:
    """Position of every line inside its claim, in a total order."""
    order = ["line_number", "part_id", "supp_id", "ship_date", "price", "qty", "discount", "tax"]
    chunked = ordered.cut_by_quantiles(items, "line_number")
    return ordered.row_number(chunked, ["claim_id"], ["_chunk"], order, "line_no").drop("_chunk")


# ----- sets -------------------------------------------------------------------------------------


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of row counts; each count is answered from file footers."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def batch_claims(queue: DataFrame) -> DataFrame:
    return queue.select("batch_id", "claim_id").distinct()


def first_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int
) -> DataFrame:
    """Top ``k`` rows per key; Spark's window group limit prunes each map task before the shuffle."""
    w = ordered.Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ----- upserts and constraints --------------------------------------------------------------------


def upsert(
    base: DataFrame,
    updates: DataFrame,
    keys: list[str],
    update_cols: list[str],
    order: list[str],
    as_of: str | None = None,
) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO UPDATE SET update_cols.

    With ``as_of`` given, ``updated_at`` of every conflicting row becomes that time.

    Repeats inside the batch are settled by the last one in ``order``; other columns of a
    conflicting row keep their stored value.
    """
    last = ordered.latest_per_key(updates, keys, order)
    renamed = last.select(
        *[F.col(k).alias("_k_" + k) for k in keys],
        F.struct(*[F.col(c) for c in base.columns]).alias("_new"),
        F.lit(True).alias("_hit"),
    )
    on = reduce(lambda a, b: a & b, [base[k].eqNullSafe(renamed["_k_" + k]) for k in keys])
    stored = base.withColumn("_stored", F.lit(True)).join(renamed, on, "full")
    columns = []
    for name in base.columns:
        if name in keys:
            value = F.when(F.col("_stored"), F.col(name)).otherwise(F.col("_new." + name))
        elif name == "updated_at" and as_of is not None:
            value = (
                F.when(F.col("_stored") & F.col("_hit"), F.lit(as_of).cast("timestamp_ntz"))
                .when(F.col("_stored"), F.col(name))
                .otherwise(F.col("_new." + name))
            )
        elif name in update_cols:
            value = F.when(F.col("_hit"), F.col("_new." + name)).otherwise(F.col(name))
        else:
            value = F.when(F.col("_stored"), F.col(name)).otherwise(F.col("_new." + name))
        columns.append(value.alias(name))
    return stored.select(*columns)


def backfill_decisions(
    claims: DataFrame,
    validation: DataFrame,
    decisions: DataFrame,
    docs: DataFrame | None = None,
) -> DataFrame:
    """Decisions copied from validations for claims without an active one.

    With ``docs`` given, only claims without documents are filled (at lower confidence).
    """
    open_claims = claims.join(
        decisions.filter("is_active").select("claim_id"), "claim_id", "left_anti"
    )
    confidence, version = 100.0, "validation_based_v1.0"
    if docs is not None:
        open_claims = open_claims.join(docs.select("claim_id"), "claim_id", "left_anti")
        confidence, version = 85.0, "validation_based_v1"
    return open_claims.select("claim_id", "claim_amount", "max_benefit").join(
        validation, "claim_id"
    ).select(
        "claim_id",
        F.lit("initial").alias("decision_type"),
        F.col("actual_status").alias("proposed_status"),
        F.col("actual_paid_amount").alias("proposed_benefit_amount"),
        F.col("actual_paid_amount").alias("eligible_total"),
        F.coalesce("claim_amount", "actual_paid_amount").alias("invoice_total"),
        F.col("max_benefit").alias("cap_amount"),
        F.lit(confidence).alias("confidence_score"),
        F.lit(version).alias("engine_version"),
        F.lit("system").alias("decided_by"),
        F.col("actual_decision_date").alias("decided_at"),
        F.lit(True).alias("is_active"),
    )


def constraint_report(
    claims: DataFrame, docs: DataFrame, decisions: DataFrame, validation: DataFrame
) -> DataFrame:
    """Violations per rule: checks in one pass per table, uniqueness and foreign keys by key."""

    def checks(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
        wide = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
        return wide.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(f"{table}.{name}").alias("rule"), F.col(name).alias("violations"))
                        for name in rules
                    ]
                )
            ).alias("r")
        ).select("r.*")

    def repeated(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
        return (
            df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.count_if(F.col("n") > 1).alias("violations"))
            .select(F.lit(f"{table}.unique_{'_'.join(keys)}").alias("rule"), "violations")
        )

    def orphans(df: DataFrame, table: str) -> DataFrame:
        return (
            df.join(claims.select("claim_id"), "claim_id", "left_anti")
            .agg(F.count(F.lit(1)).alias("violations"))
            .select(F.lit(f"{table}.fk_claim").alias("rule"), "violations")
        )

    confidence = F.col("confidence_score")
    parts = [
        checks(claims, "claims", {
            "negative_amount": F.col("claim_amount") < 0,
            "negative_benefit": F.col("max_benefit") < 0,
            "missing_amount": F.col("claim_amount").isNull(),
            "status_domain": ~F.col("status").isin(
                "pending", "processing", "completed", "failed", "cancelled"),
        }),
        checks(docs, "claim_documents", {
            "confidence_range": ~F.col("classification_confidence").between(0, 100),
            "ocr_range": ~F.col("ocr_confidence").between(0, 100),
            "page_count": F.col("page_count") <= 0,
            "file_size": F.col("file_size_bytes") <= 0,
        }),
        checks(decisions, "decisions", {
            "benefit_over_cap": F.col("proposed_benefit_amount") > F.col("cap_amount"),
            "confidence_range": ~confidence.between(0, 100),
            "type_domain": ~F.col("decision_type").isin(
                "automated", "manual_override", "appeal", "reprocessed", "initial",
                "reconsideration"),
        }),
        repeated(claims, "claims", ["claim_tracking_number"]),
        repeated(docs, "claim_documents", ["claim_id", "file_hash"]),
        repeated(validation, "decision_validation", ["claim_id", "actual_decision_date"]),
        orphans(docs, "claim_documents"),
        orphans(decisions, "decisions"),
    ]
    return reduce(DataFrame.unionByName, parts)
