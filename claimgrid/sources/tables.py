"""Readers, CSV loads with reject rows, partitioned writes and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from claimgrid.functions import text as tx
from claimgrid.schemas import SCHEMAS
from claimgrid.session import cut_lineage
from claimgrid.sources import quoted_csv

CLAIM_CSV = [
    "Tracking Number", "Claim Date", "Move-Out Date", "Lease Start Date", "Lease End Date",
    "Amount of Claim", "Max Benefit", "Status", "Approved Benefit Amount", "Posted Date",
    "Approval Date", "Lease Street Address", "Lease City", "Lease State", "Lease Zip", "Policy",
    "Monthly Rent", "PM Explanation", "Hold Reason",
]
VALIDATION_CSV = [
    "claim_tracking_number", "actual_status", "actual_paid_amount", "actual_decision_date",
    "adjudication_notes", "adjudicator_id", "validation_source",
]


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored relation with its declared types."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def read_documents(spark: SparkSession, glob: str) -> DataFrame:
    """Whole text files; the claim's tracking number comes from the folder or file name."""
    path = F.col("_metadata.file_path")
    parts = F.split(path, "/")
    return spark.read.text(glob, wholetext=True).select(
        path.alias("file_path"),
        F.element_at(parts, -1).alias("original_filename"),
        tx.extract_tracking(F.element_at(parts, -1), F.element_at(parts, -2)).alias(
            "claim_tracking_number"
        ),
        F.col("value").alias("extracted_text"),
        F.sha2("value", 256).alias("file_hash"),
        F.col("_metadata.file_size").alias("file_size_bytes"),
    )


def _read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header-named CSV as text, split anywhere; columns absent from the file read as null."""
    raw = quoted_csv.read(spark, path)
    found = set(raw.columns)
    return raw.select(
        *[(F.col(f"`{c}`") if c in found else F.lit(None).cast("string")).alias(c) for c in columns]
    )


def load_claims_csv(
    spark: SparkSession, path: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims, validations and rejects from one wide export."""
    raw = _read_csv(spark, path, CLAIM_CSV)

    def cell(name: str):
        return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))

    claim_date = tx.parse_date(cell("Claim Date"))
    reason = F.when(cell("Tracking Number") == "", "Missing Tracking Number").when(
        claim_date.isNull(), "Missing or invalid Claim Date"
    )
    checked = raw.withColumn("reject_reason", reason)
    good = checked.filter(F.col("reject_reason").isNull())
    benefit = tx.parse_currency(cell("Max Benefit"))
    rent = tx.parse_currency(cell("Monthly Rent"))
    deposit = F.when(rent > 0, rent).otherwise(
        (benefit * F.lit("0.4").cast("decimal(2,1)")).cast(tx.MONEY)
    )
    claims = good.select(
        cell("Tracking Number").alias("claim_tracking_number"),
        tx.parse_currency(cell("Amount of Claim")).alias("claim_amount"),
        benefit.alias("max_benefit"),
        deposit.alias("security_deposit_amount"),
        tx.build_policy_id(F.col("Policy")).alias("policyholder_id"),
        tx.build_property_id(
            cell("Lease Street Address"), cell("Lease City"), cell("Lease State"), cell("Lease Zip")
        ).alias("property_id"),
        claim_date.alias("claim_date"),
        tx.parse_date(cell("Move-Out Date")).alias("move_out_date"),
        tx.parse_date(cell("Lease Start Date")).alias("lease_start_date"),
        tx.parse_date(cell("Lease End Date")).alias("lease_end_date"),
        F.lit("completed").alias("status"),
        F.lit(0).alias("priority"),
        F.lit("csv_import").alias("created_by"),
    )
    posted = F.when(cell("Posted Date") != "", cell("Posted Date")).otherwise(cell("Approval Date"))
    notes = F.coalesce(
        F.nullif(cell("PM Explanation"), F.lit("")),
        F.nullif(cell("Hold Reason"), F.lit("")),
        F.concat(F.lit("Status: "), F.coalesce(F.col("Status"), F.lit(""))),
    )
    validation = good.select(
        cell("Tracking Number").alias("claim_tracking_number"),
        tx.normalize_status(F.col("Status")).alias("actual_status"),
        tx.parse_currency(cell("Approved Benefit Amount")).alias("actual_paid_amount"),
        F.coalesce(tx.parse_date(posted), claim_date).alias("actual_decision_date"),
        notes.alias("adjudication_notes"),
    )
    return claims, validation, checked.filter(F.col("reject_reason").isNotNull())


def load_validation_csv(
    spark: SparkSession, path: str, claims: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Accepted validations with claim ids, and rejects with a reason."""
    raw = _read_csv(spark, path, VALIDATION_CSV)

    def cell(name: str):
        return F.trim(F.coalesce(F.col(name), F.lit("")))

    status = F.lower(cell("actual_status"))
    amount = cell("actual_paid_amount").try_cast("double")
    day = F.when(
        cell("actual_decision_date").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), cell("actual_decision_date")
    )
    date = F.try_to_timestamp(day, F.lit("yyyy-M-d")).cast("date")
    missing = F.coalesce(
        *[
            F.when(cell(c) == "", F.lit(f"Missing required field '{c}'"))
            for c in VALIDATION_CSV[:4]
        ]
    )
    reason = (
        F.when(missing.isNotNull(), missing)
        .when(
            ~status.isin("approve", "deny"),
            F.concat(
                F.lit("Invalid actual_status '"), status, F.lit("'. Must be 'approve' or 'deny'")
            ),
        )
        .when(amount.isNull(), F.concat(F.lit("Invalid actual_paid_amount '"), F.col("actual_paid_amount"), F.lit("'")))
        .when(amount < 0, F.lit("actual_paid_amount cannot be negative"))
        .when(date.isNull(), F.lit("Invalid actual_decision_date format. Expected YYYY-MM-DD"))
    )
    checked = raw.withColumns({"_date": date, "_reason": reason}).withColumn(
        "claim_tracking_number", cell("claim_tracking_number")
    )
    known = claims.select("claim_tracking_number", "claim_id")
    joined = checked.join(known, "claim_tracking_number", "left").withColumn(
        "reject_reason",
        F.coalesce(
            "_reason",
            F.when(
                F.col("claim_id").isNull(),
                F.concat(F.lit("Claim tracking number not found: "), "claim_tracking_number"),
            ),
        ),
    )
    paid = F.when(status == "deny", F.lit(0)).otherwise(amount).cast(tx.MONEY)
    accepted = joined.filter(F.col("reject_reason").isNull()).select(
        "claim_id",
        status.alias("actual_status"),
        paid.alias("actual_paid_amount"),
        F.col("_date").alias("actual_decision_date"),
        F.nullif(cell("adjudication_notes"), F.lit("")).alias("adjudication_notes"),
        F.nullif(cell("adjudicator_id"), F.lit("")).alias("adjudicator_id"),
        F.coalesce(F.nullif(cell("validation_source"), F.lit("")), F.lit("csv_import")).alias(
            "validation_source"
        ),
    )
    return accepted, joined.filter(F.col("reject_reason").isNotNull()).drop("_date", "_reason")


def write_claims(claims: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Claims by year of creation; overwriting replaces only the years that are written."""
    claims.withColumn("created_year", F.year("created_at")).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("created_year").parquet(f"{root}/claims")


def write_audit(audit: DataFrame, root: str, mode: str = "append") -> None:
    """Audit rows by month; overwriting replaces only the months that are written."""
    audit.withColumn("created_month", F.date_format("created_at", "yyyy-MM")).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("created_month").parquet(f"{root}/decision_audit_log")


def _stored(spark: SparkSession, path: str, schema: StructType | None, partition: StructField) -> DataFrame:
    """Files with the types they were written with; without a schema, with those of one file."""
    reader = spark.read if schema is None else spark.read.schema(StructType([*schema.fields, partition]))
    return reader.parquet(path)


def read_claims(
    spark: SparkSession, root: str, start: str, end: str, schema: StructType | None = None
) -> DataFrame:
    """Claims of a period; the year predicate prunes folders, the time predicate row groups."""
    first, last = int(start[:4]), int(end[:4])
    year = StructField("created_year", IntegerType())
    return _stored(spark, f"{root}/claims", schema, year).filter(
        F.col("created_year").between(first, last)
        & (F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("created_at") < F.lit(end).cast("timestamp_ntz"))
    )


def read_audit(
    spark: SparkSession, root: str, first: str, last: str, schema: StructType | None = None
) -> DataFrame:
    """Audit rows of the months ``first`` to ``last`` (yyyy-MM); other months' folders are not read."""
    # Types of folder names are guessed: a month is text to be compared as text.
    month = StructField("created_month", StringType())
    rows = _stored(spark, f"{root}/decision_audit_log", schema, month)
    return rows.filter(F.col("created_month").between(first, last))


def write_evaluation(metrics: DataFrame, found: DataFrame, folder: str) -> None:
    """Metrics as JSON, mismatches and the ones needing review as CSV."""
    metrics.write.mode("overwrite").json(f"{folder}/metrics")
    flat = found.withColumn("flags", F.array_join("flag_list", "; ")).drop("flag_list", "missing_data")
    flat = cut_lineage(flat)  # written twice, worked out once
    writer = flat.write.mode("overwrite").option("header", True)
    writer.csv(f"{folder}/mismatches")
    flat.filter("needs_review").write.mode("overwrite").option("header", True).csv(
        f"{folder}/high_priority"
    )
