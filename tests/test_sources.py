from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimgrid.functions import jsonio
from claimgrid.functions import text as tx
from claimgrid.operators import evaluation as ev
from claimgrid.operators import lifecycle
from claimgrid.sources import tables


def one(spark, value, column, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column(F.col("x")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text,want",
    [("03/04/22", date(2022, 3, 4)), ("3/4/75", date(1975, 3, 4)), ("03/04/2022", date(2022, 3, 4)),
     (" 2022-03-04 ", date(2022, 3, 4)), ("13/40/22", None), ("", None), ("soon", None), (None, None)],
)
def test_dates(spark, text, want):
    assert one(spark, text, tx.parse_date) == want


@pytest.mark.parametrize("text,want", [("$1,234.50", "1234.50"), ("", "0"), ("abc", "0"), (None, "0"), ("-5", "-5")])
def test_currency(spark, text, want):
    assert one(spark, text, tx.parse_currency) == Decimal(want)


@pytest.mark.parametrize("text,want", [("Posted", "approve"), ("Approved", "approve"), ("Declined", "deny"), (None, "deny"), ("?", "deny")])
def test_status(spark, text, want):
    assert one(spark, text, tx.normalize_status) == want


@pytest.mark.parametrize("name,folder,want", [("CLM-77.pdf", None, "77"), ("x 12345 y", None, "12345"), ("claim_12.pdf", None, "12"), ("x.pdf", "901", "901"), ("x.pdf", None, None)])
def test_tracking(spark, name, folder, want):
    df = spark.createDataFrame([(name, folder)], "n string, f string")
    assert df.select(tx.extract_tracking(F.col("n"), F.col("f")).alias("v")).first()["v"] == want


def test_claims_csv(spark, tmp_path):
    path = tmp_path / "claims.csv"
    path.write_text(
        "Tracking Number,Claim Date,Amount of Claim,Max Benefit,Status,Approved Benefit Amount,"
        "Lease Street Address,Lease City,Lease Zip,Policy,Monthly Rent,Hold Reason\n"
        '1,03/04/22,"$1,000.00",500,Posted,$450.00,"1 Main St, #2",Town,12345-6,P9,,late\n'
        ",03/04/22,1,1,,,,,,,,\n"
        "3,whenever,1,1,,,,,,,,\n"
        "4,2022-01-02,10,,Declined,,,,,,1200,\n"
    )
    claims, validation, rejects = tables.load_claims_csv(spark, str(path))
    rows = {r["claim_tracking_number"]: r for r in claims.collect()}
    assert set(rows) == {"1", "4"}
    assert rows["1"]["property_id"] == "1_Main_St_2-Town-12345" and rows["1"]["policyholder_id"] == "POL-P9"
    assert rows["1"]["security_deposit_amount"] == 200 and rows["4"]["security_deposit_amount"] == 1200
    assert rows["4"]["property_id"].startswith("PROP-") and rows["4"]["policyholder_id"] == "POL-UNKNOWN"
    outcomes = {r["claim_tracking_number"]: r for r in validation.collect()}
    assert (outcomes["1"]["actual_status"], outcomes["1"]["adjudication_notes"]) == ("approve", "late")
    assert outcomes["4"]["adjudication_notes"] == "Status: Declined"
    assert sorted(r["reject_reason"] for r in rejects.collect()) == ["Missing Tracking Number", "Missing or invalid Claim Date"]


def test_validation_csv(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text(
        "claim_tracking_number,actual_status,actual_paid_amount,actual_decision_date\n"
        "A,Approve,10.5,2024-01-02\nA,deny,99,2024-01-03\nB,approve,1,2024-01-02\n"
        "A,maybe,1,2024-01-02\nA,approve,-1,2024-01-02\nA,approve,x,2024-01-02\nA,approve,1,01/02/24\nA,,1,2024-01-02\n"
    )
    claims = spark.createDataFrame([(5, "A")], "claim_id bigint, claim_tracking_number string")
    good, bad = tables.load_validation_csv(spark, str(path), claims)
    assert sorted((r["actual_status"], float(r["actual_paid_amount"])) for r in good.collect()) == [("approve", 10.5), ("deny", 0.0)]
    reasons = sorted(r["reject_reason"] for r in bad.collect())
    assert len(reasons) == 6 and reasons[0] == "Claim tracking number not found: B"


def test_partitioned_claims(spark, tmp_path):
    rows = [(i, datetime(2020 + i % 3, 5, 1)) for i in range(9)]
    df = spark.createDataFrame(rows, "claim_id bigint, created_at timestamp_ntz")
    tables.write_claims(df, str(tmp_path))
    tables.write_claims(df.filter("claim_id = 1").withColumn("claim_id", F.lit(100).cast("bigint")), str(tmp_path))
    back = tables.read_claims(spark, str(tmp_path), "2021-01-01", "2022-12-31")
    assert sorted(r["claim_id"] for r in back.collect()) == [2, 5, 8, 100]
    assert "PartitionFilters: [isnotnull(created_year" in back._jdf.queryExecution().toString()
    assert tables.read_claims(spark, str(tmp_path), "2020-01-01", "2020-12-31").count() == 3


def test_documents_from_folders(spark, tmp_path):
    (tmp_path / "901").mkdir()
    (tmp_path / "901" / "invoice.txt").write_text("Total $5.00\nline")
    row = tables.read_documents(spark, str(tmp_path / "*" / "*.txt")).first()
    assert (row["claim_tracking_number"], row["original_filename"]) == ("901", "invoice.txt")
    assert row["extracted_text"] == "Total $5.00\nline"


def test_evaluation_export(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "T", "approve", Decimal(900), "approve", Decimal(100), '{"warnings":["w"]}', "{}", 80.0, 5)],
        "claim_id int, claim_tracking_number string, proposed_status string, proposed_benefit_amount decimal(12,2), "
        "actual_status string, actual_paid_amount decimal(12,2), flags string, missing_data string, "
        "confidence_score double, processing_time_ms int",
    )
    tables.write_evaluation(ev.evaluation_metrics(df), ev.mismatches(df), str(tmp_path))
    assert spark.read.json(str(tmp_path / "metrics")).first()["total_claims"] == 1
    row = spark.read.option("header", True).csv(str(tmp_path / "high_priority")).first()
    assert row["mismatch_type"] == "amount_only" and row["flags"] == "w"


def test_response_validation(spark):
    entry = ('{"line_item_number": 1, "should_be_included": "yes", "is_normal_wear_tear": false, '
             '"is_covered_by_addendum": true, "is_covered_by_other_insurance": false, "confidence": "0.5", '
             '"reasoning": "fine", "addendum_reference": "a"}')
    cases = {
        "ok": ('```json\n{"line_item_analyses": [' + entry + "]}\n```", []),
        "single": (('{"line_item_analyses": [' + entry + "]}").replace('"', "'"), []),
        "empty": ("``````", ["No JSON content found in response"]),
        "bad": ("{nope", ["Invalid JSON"]),
        "none": ('{"a": 1}', ["Missing 'line_item_analyses' field"]),
        "type": ('{"line_item_analyses": 5}', ["'line_item_analyses' must be an array"]),
        "count": ('{"line_item_analyses": []}', ["Expected 1 analyses, got 0"]),
        "object": ('{"line_item_analyses": [3]}', ["Analysis 1: Must be an object"]),
        "blank": ('{"line_item_analyses": [' + entry.replace("fine", " ") + "]}",
                  ["Analysis 1: 'reasoning' must be non-empty string"]),
        "number": ('{"line_item_analyses": [' + entry.replace('"line_item_number": 1', '"line_item_number": 2') + "]}",
                   ["Analysis 1: 'line_item_number' is out of sequence"]),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, t string")
    out = df.select("k", jsonio.response_errors(F.col("t"), F.lit(1)).alias("e")).collect()
    assert {r["k"]: r["e"] for r in out} == {k: v[1] for k, v in cases.items()}


def test_soft_delete_cycle(spark):
    claims = spark.createDataFrame([(1, None), (2, datetime(2023, 1, 1))], "claim_id bigint, deleted_at timestamp_ntz")
    docs = spark.createDataFrame([(1, None), (2, datetime(2023, 1, 1))], "claim_id bigint, deleted_at timestamp_ntz")
    keys = spark.createDataFrame([(1,), (2,), (9,)], "claim_id bigint")
    deleted, missing = lifecycle.soft_delete({"claims": claims, "claim_documents": docs}, keys, "2024-06-01", "me")
    assert sorted(r[0] for r in missing.collect()) == [2, 9]
    assert deleted["claim_documents"].filter("deleted_at is null").count() == 0
    kept, purged = lifecycle.purge(deleted, "2024-06-02")
    assert [r[0] for r in purged.collect()] == [2] and kept["claim_documents"].count() == 1
    back, gone = lifecycle.restore(deleted, keys)
    assert back["claims"].filter("deleted_at is null").count() == 2 and [r[0] for r in gone.collect()] == [9]


def test_pruned_reads(spark, tmp_path):
    """Only the folders of the period are scanned, and writing a month again replaces it alone."""
    rows = [(k, datetime(2020 + k % 4, 1 + k % 12, 3)) for k in range(48)]
    df = spark.createDataFrame(rows, "claim_id long, created_at timestamp_ntz")
    tables.write_claims(df, str(tmp_path))
    period = tables.read_claims(spark, str(tmp_path), "2021-01-01", "2021-12-31", df.schema)
    plan = period._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(created_year" in plan and "PushedFilters: [IsNotNull(created_at)" in plan
    assert period.count() == 12 and {r["created_year"] for r in period.collect()} == {2021}
    tables.write_audit(df, str(tmp_path))
    tables.write_audit(df.filter("created_at < '2020-02-01'").limit(1), str(tmp_path), "overwrite")
    months = tables.read_audit(spark, str(tmp_path), "2020-01", "2020-05", df.schema)
    assert "PartitionFilters: [isnotnull(created_month" in months._jdf.queryExecution().toString()
    assert {r["created_month"] for r in months.collect()} == {"2020-01", "2020-05"}
    assert months.filter("created_month = '2020-01'").count() == 1
    assert tables.read_audit(spark, str(tmp_path), "2000-01", "2100-01", df.schema).count() == 48 - 4 + 1
