from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimgrid.operators import decide
from claimgrid.operators import evaluation as ev
from claimgrid.operators.relational import with_cap_reason

CLAIM = "claim_id bigint, claim_tracking_number string, claim_amount decimal(12,2), max_benefit decimal(12,2), lease_start_date date"
ITEM = "claim_id bigint, description string, amount decimal(12,2)"
DOC = "claim_id bigint, document_type string, classification_confidence double, ocr_confidence double"
DAY = date(2024, 1, 1)


def run(spark, claim, items, docs, mode="production"):
    claims = spark.createDataFrame([(1, "T1", *claim)], CLAIM)
    item_df = spark.createDataFrame([(1, d, Decimal(a)) for d, a in items], ITEM)
    doc_df = spark.createDataFrame([(1, *d) for d in docs], DOC)
    return decide.evaluate_claims(claims, item_df, doc_df, mode=mode).first()


FULL = [("addendum", 90.0, 90.0), ("invoice", 85.0, 90.0)]
WALL = [("Wall repair", "400.00"), ("Carpet cleaning", "200.00")]


@pytest.mark.parametrize(
    "claim,items,docs,status,benefit,cap,flag",
    [
        ((500, 1000, DAY), WALL, FULL, "approve", 500, 500, None),
        ((5000, 300, DAY), WALL, FULL, "approve", 300, 300, None),
        ((5000, 5000, DAY), WALL, FULL, "approve", 600, 600, None),
        ((None, 1000, DAY), WALL, FULL, "approve", 600, 600, None),
        ((500, None, DAY), WALL, FULL, "deny", 0, None, "missing_max_benefit"),
        ((500, 0, DAY), WALL, FULL, "deny", 0, None, "missing_max_benefit"),
        ((0, 0, DAY), WALL, FULL, "deny", 0, None, "missing_max_benefit"),
        ((500, 1000, DAY), WALL, FULL[1:], "deny", 0, None, "missing_waiver_addendum"),
        ((500, 1000, DAY), WALL, FULL[:1], "deny", 0, None, "missing_invoice"),
        ((500, 1000, DAY), [("Monthly rent", "900.00")], FULL, "deny", 0, 0, "no_eligible_charges"),
        ((500, 1000, DAY), [], FULL, "deny", 0, 0, "no_eligible_charges"),
        ((500, 1000, DAY), WALL, [("invoice", 40.0, 90.0)], "approve", 500, 500, None),
    ],
)
def test_cascade(spark, claim, items, docs, status, benefit, cap, flag):
    claim = tuple(Decimal(v) if isinstance(v, int) else v for v in claim)
    row = run(spark, claim, items, docs)
    assert (row["proposed_status"], row["proposed_benefit_amount"], row["cap_amount"]) == (status, benefit, cap)
    assert row["flags"]["critical"] == ([flag] if flag else [])


def test_flags_confidence_and_modes(spark):
    row = run(spark, (Decimal(5000), Decimal(5000), None), WALL + [("Payment received", "-50.00")],
              [("addendum", 40.0, 20.0), ("invoice", 30.0, 20.0)])
    assert row["confidence_score"] == pytest.approx(63.0)
    assert "Missing lease start date" in row["flags"]["warnings"]
    assert "credits_detected: 1 credit items found" in row["flags"]["warnings"]
    assert "low_ocr_confidence: 2 document(s) with OCR confidence < 50%" in row["flags"]["warnings"]
    assert row["missing_data"]["fields"] == ["lease_start_date"]
    assert row["reasoning"]["flag_explanations"]["Missing lease start date"] == "Lease start date is missing"
    back = run(spark, (Decimal(500), None, DAY), WALL, FULL, mode="backtest")
    assert (back["proposed_status"], back["proposed_benefit_amount"]) == ("pending", None)


def test_monotone_in_benefit_limit(spark):
    claims = spark.createDataFrame([(1, "T", Decimal(3000), Decimal(1), DAY)], CLAIM)
    items = spark.createDataFrame([(1, "Wall repair", Decimal(1500)), (1, "Current balance as of", Decimal(500))], ITEM)
    docs = spark.createDataFrame([(1, *d) for d in FULL], DOC)
    out = decide.what_if(decide.claim_inputs(claims, items, docs), [500, 1000, 2000])
    benefits = [r["proposed_benefit_amount"] for r in out.orderBy("scenario").collect()]
    assert benefits == [500, 1000, 1500]
    assert decide.monotonicity(out).first()["violations"] == 0


@pytest.mark.parametrize(
    "cap,claim,benefit,invoice,want",
    [(100, 100, 200, 300, "claim_amount"), (100, 200, 100, 300, "max_benefit"),
     (100, 100, 100, 300, "claim_amount_and_max_benefit"), (50, 100, 100, 50, "invoice_total"),
     (None, 100, 100, 50, None), (0, 100, 100, 50, None)],
)
def test_cap_reason(spark, cap, claim, benefit, invoice, want):
    df = spark.createDataFrame([(cap, claim, benefit, invoice)],
                               "cap_amount int, claim_amount int, max_benefit int, invoice_total int")
    assert with_cap_reason(df).first()["cap_reason"] == want




# Recorded outcomes of one published run (tracking, proposed, amount, actual, paid).
RECORDED = [
    ("900", "approve", 258.0, "deny", None), ("901", "deny", 0.0, "approve", 770.0),
    ("902", "approve", 113.0, "approve", 100.0), ("903", "approve", 263.0, "approve", 190.0),
    ("904", "approve", 494.0, "approve", 1500.0), ("905", "approve", 34.0, "approve", 274.0),
    ("906", "approve", 1500.0, "approve", 1500.0), ("907", "approve", 1500.0, "approve", 1500.0),
    ("908", "approve", 383.0, "approve", 1500.0), ("909", "approve", 500.0, "approve", 200.0),
    ("910", "approve", 2500.0, "approve", 2500.0), ("911", "approve", 1110.0, "approve", 1500.0),
    ("915", "approve", 1225.0, "approve", 1225.0), ("916", "approve", 554.56, "approve", 554.56),
    ("917", "approve", 2785.0, "approve", 2785.0), ("918", "approve", 1436.64, "approve", 1436.64),
    ("920", "approve", 2000.0, "approve", 2000.0),
]


def test_recorded_run(spark):
    df = spark.createDataFrame(
        RECORDED, "tracking string, proposed_status string, proposed_amount double, "
        "actual_status string, actual_amount double"
    )
    m = ev.run_metrics(df).first()
    assert (m["total_claims"], m["status_matches"]) == (17, 15)
    assert m["status_accuracy"] == pytest.approx(0.8823529411764706)
    assert m["mean_absolute_error"] == pytest.approx(244.3125)
    assert (m["max_absolute_error"], m["min_absolute_error"]) == (1117.0, 0.0)
    assert m["avg_actual_amount"] == pytest.approx(1302.3466666666668)
    assert m["total_variance"] == pytest.approx(2879.0)


def test_small_evaluation(spark):
    rows = [("approve", 1500, "deny", 0), ("approve", 1500, "approve", 770), ("approve", 1500, "approve", 100),
            ("approve", 1500, "approve", 190), ("approve", 1500, "approve", 1500)]
    df = spark.createDataFrame(
        [(i, p, Decimal(a), s, Decimal(b), '{"critical":[]}', '{"fields":[]}', 85.0, 5) for i, (p, a, s, b) in enumerate(rows)],
        "claim_id int, proposed_status string, proposed_benefit_amount decimal(12,2), actual_status string, "
        "actual_paid_amount decimal(12,2), flags string, missing_data string, confidence_score double, processing_time_ms int",
    )
    m = ev.evaluation_metrics(df).first()
    assert m["accuracy"] == pytest.approx(0.8) and m["f1_score"] == pytest.approx(0.8889, abs=1e-4)
    assert m["mean_absolute_error"] == pytest.approx(860) and m["root_mean_squared_error"] == pytest.approx(1025.79, abs=0.01)
    assert m["bias_magnitude"] == pytest.approx(1.34375) and m["bias_direction"] == "more_generous"
    assert ev.median_absolute_error(df).first()["median_absolute_error"] == 1020
    issues = {r["issue"] for r in ev.recommendations(ev.evaluation_metrics(df)).collect()}
    assert "High Amount Variance" in issues and "System Bias: more_generous" in issues


def test_overrides(spark):
    decisions = spark.createDataFrame(
        [(11, 1, "deny", Decimal(100), '[{"line_item":{"description":"a","amount":50},"analysis":{"reasoning":"r"}}]',
          '[{"description":"b","amount":80,"reason":"no"}]')],
        "decision_id bigint, claim_id bigint, proposed_status string, cap_amount decimal(12,2), "
        "approved_line_items string, ineligible_line_items string",
    )
    overrides = spark.createDataFrame(
        [(11, 1, True, "seen")],
        "decision_id bigint, line_item_index int, user_should_be_included boolean, user_reasoning string",
    )
    items = decide.apply_overrides(decisions, overrides)
    rows = {r["line_item_index"]: r for r in items.collect()}
    assert rows[1]["should_be_included"] and rows[1]["changed"] and rows[1]["reason"] == "seen"
    assert rows[0]["reason"] == "r" and not rows[0]["changed"]
    for cap_on, override_cap, benefit in [(True, None, 100), (True, Decimal(60), 60), (False, None, 130)]:
        requests = spark.createDataFrame(
            [(11, cap_on, override_cap, None)],
            "decision_id bigint, cap_enabled boolean, override_cap_amount decimal(12,2), override_status string",
        )
        row = decide.recalculate(decisions, items, requests).first()
        assert (row["new_benefit"], row["new_status"], row["changed_items"]) == (benefit, "approve", 1)
    assert items.filter(F.col("changed")).count() == 1


def test_items_are_ruled_once_for_the_fit(spark):
    """The fit reads its items several times; what they are made from is worked out once."""
    ruled = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            ruled.add(batch.num_rows)
            yield batch

    kind = "claim_id long, amount decimal(12,2), confidence double, should_be_included boolean, line_number int"
    rows = [(c, Decimal(10 + i), 0.5, i != 3, i) for c in range(5) for i in range(6)]
    items = spark.createDataFrame(rows, kind).mapInArrow(count, kind)
    claims = spark.createDataFrame([(c, Decimal(30), Decimal(40)) for c in range(5)], "claim_id long, claim_amount decimal(12,2), max_benefit decimal(12,2)")
    fitted = decide.fit_to_cap(items, claims, ["line_number"]).filter("kept").groupBy("claim_id").agg(F.sum("amount").cast("int"))
    assert sorted(map(tuple, fitted.collect())) == [(c, 29) for c in range(5)]
    assert ruled.value == len(rows)
