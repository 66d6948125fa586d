import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimgrid.functions import pii
from claimgrid.functions.amounts import parse_amount
from claimgrid.operators import invoice
from claimgrid.operators.documents import redact_documents
from claimgrid.rules import fixed_values as fv

AMOUNTS = [
    ("Cleaning $150.00", "150", "standard_dollar", False),
    ("($45.50)", "-45.5", "standard_dollar", True),
    ("- 20.00", "-20", "negative_minus", True),
    ("Labor 3 x $45.50", "136.5", "formula_calculation", False),
    ("Estimate $100 - $200", "150", "range_midpoint", False),
    ("1.200,50 €", "1320.55", "euro_conversion", False),
    ("Blinds TBD", "0", "tbd_flag", False),
    ("Total 75 items", "75", "integer_amount", False),
    ("Fee $90", "90", "dollar_no_cents", False),
    ("12.5 of it", "12.5", "single_decimal", False),
    ("no number", None, None, None),
    ("", None, None, None),
    (",", None, None, None),
]


@pytest.mark.parametrize("text,amount,method,negative", AMOUNTS)
def test_amounts(spark, text, amount, method, negative):
    row = spark.createDataFrame([(text,)], "t string").select(parse_amount(F.col("t")).alias("r")).first()["r"]
    if method is None:
        assert row is None
    else:
        assert (row["amount"], row["method"], row["is_negative"]) == (Decimal(amount), method, negative)


def test_strict_sign_and_percentage(spark):
    df = spark.createDataFrame([("Service fee (15%) $150.00",)], "t string")
    loose = df.select(parse_amount(F.col("t")).alias("r")).first()["r"]
    strict = df.select(parse_amount(F.col("t"), strict_sign=True).alias("r")).first()["r"]
    share = df.select(parse_amount(F.col("t"), F.lit(200)).alias("r")).first()["r"]
    assert (loose["amount"], strict["amount"], share["amount"]) == (-150, 150, 30)


TEXTS = {
    "table": (
        "INVOICE #: INV-9\nDescription                    Amount\n"
        "Carpet cleaning                $150.00\nWall repair                    $75.50\n"
        "Sales tax                      $45.25\nTotal                          $270.75"
    ),
    "credit": (
        "Item description               Charge\nDoor replacement               $100.00\n"
        "Deposit credit                 ($40.00)\nDoor replacement               $100.00\n"
        "Total                          $160.00"
    ),
    "merge": (
        "INVOICE\nDeep cleaning of entire\napartment including all\n"
        "rooms and common areas      $200.00\nTotal                       $200.00"
    ),
    "plain": "nothing to see\nshort 5\nBroken blinds\n",
    "empty": "",
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "document_id string, extracted_text string")
    rows = invoice.parse_quality(invoice.reconcile(invoice.parse_invoices(df))).collect()
    return {r["document_id"]: r for r in rows}


def test_table_invoice(parsed):
    row = parsed["table"]
    assert [i["description"] for i in row["items"]] == ["Carpet cleaning", "Wall repair", "Sales tax"]
    assert all(i["confidence"] == "high" for i in row["items"])
    assert row["stated_total"] == Decimal("270.7500") and row["reconciled"]
    assert row["items"][2]["is_tax"] and row["invoice_number"] == "INV-9"
    assert not row["requires_manual_review"]


def test_credits_duplicates_and_merge(parsed):
    row = parsed["credit"]
    assert [i["amount"] for i in row["items"]] == [100, -40, 100]
    assert row["duplicate_items"] == 1 and row["credit_total"] == -40 and row["reconciled"]
    merged = parsed["merge"]
    assert any("entire apartment" in i["description"] for i in merged["items"])
    assert [i["description"] for i in parsed["plain"]["items"]] == ["short 5"]
    assert parsed["empty"]["fallback_used"] and parsed["empty"]["items_parsed"] == 0


def test_generated_invoice(spark):
    n = 200
    lines = "\n".join(f"Charge number {i:04d}             ${10 * i}.00" for i in range(1, n + 1))
    text = f"Description of item             Amount\n{lines}\nTotal                           ${5 * n * (n + 1)}.00"
    df = spark.createDataFrame([(1, text)], "document_id int, extracted_text string")
    row = invoice.reconcile(invoice.parse_invoices(df)).first()
    assert len(row["items"]) == n and row["calculated_total"] == 5 * n * (n + 1) and row["reconciled"]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_detect(text):
    found = []
    for order, (kind, pattern, conf) in enumerate(fv.PII_PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[-\s]", "", m.group())
            if kind == "ssn" and (digits[:3] in ("000", "666") or digits[3:5] == "00" or digits[5:] == "0000"):
                continue
            if kind == "credit_card" and not luhn(digits):
                continue
            if kind == "bank_account" and set(digits) == {"0"}:
                continue
            found.append((m.start(), -conf, order, m.end(), kind))
    kept = []
    for x in sorted(found):
        clash = next((e for e in kept if x[0] < e[3] and x[3] > e[0]), None)
        if clash is None:
            kept.append(x)
        elif x[1] < clash[1]:
            kept.remove(clash)
            kept.append(x)
    return sorted(kept)


PII_TEXTS = [
    "SSN 123-45-6789, mail a.b@c.org and call (415) 555-1234 or 415-555-1234.",
    "card 4111 1111 1111 1111 and bad 4111 1111 1111 1112, account 00000000 or 12345678",
    "666-12-3456 000-12-3456 123-00-4567 nothing", "4155551234 is both", "", "no data here",
    "1234567890123456 x@y.de 987654321 987-65-4321 end",
]


def test_pii_matches_brute_force(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(PII_TEXTS)], "i int, text string")
    rows = df.select("text", pii.detect(F.col("text")).alias("d")).collect()
    for row in rows:
        got = [(d["start"], d["stop"], d["kind"]) for d in row["d"]]
        assert got == [(s, e, k) for s, _, _, e, k in brute_detect(row["text"])], row["text"]


@pytest.mark.parametrize("mode", ["REDACT", "TAG", "MASK", "NONE"])
def test_redaction(spark, mode):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(PII_TEXTS)], "i int, text string")
    for row in redact_documents(df, "text", mode).collect():
        want, at = "", 0
        for s, _, _, e, kind in brute_detect(row["text"]):
            mark = {"REDACT": "[REDACTED]", "TAG": f"[{kind.upper()}: REDACTED]",
                    "MASK": "*" * min(e - s, 20)}.get(mode, row["text"][s:e])
            want += row["text"][at:s] + mark
            at = e
        assert row["redacted_text"] == want + row["text"][at:]


# ---- islands of table rows -----------------------------------------------------------------

ROWS = ["Deep clean", "x", "- bullet", "1. step", "Wall repair and paint        $75.50", "Long row without any number at all here",
        "* wide bullet row of many words  $1.00", "Sales                          12.00", "9"]


def walked(rows, col):
    """The items of table rows, one row after another."""
    out, opened = [], None
    for at, row in enumerate(rows):
        wide = col is not None and len(row) > col
        closes = (wide and col > 0 and re.search(r"\$?\s*[\d,]+\.?\d*", row[col:].strip())) or re.match(r"(•|-|\*|1\.|2\.|3\.)", row)
        if opened is None and wide:
            out.append((row[:col].strip() or "Unknown charge", row, at + 1))
        elif opened is None:
            opened = [row]
        elif closes:
            out.append((" ".join(opened), opened[0], at + 1))
            opened = None
        else:
            opened.append(row)
    if opened:
        out.append((" ".join(opened), opened[0], len(rows) + 1))
    return out


def test_islands_match_a_walk(spark):
    import random

    r = random.Random(6)
    docs = []
    for k in range(150):
        rows = [r.choice(ROWS) for _ in range(r.randrange(1, 14))]
        docs.append((k, "\n".join(["Description of item           Amount", *rows, "Total                          $270.75"])))
    df = spark.createDataFrame(docs, "document_id int, extracted_text string")
    checked = 0
    for row in invoice.parse_invoices(df).collect():
        if row["fallback_used"] or row["header_row"] != 0 or row["footer_row"] != len(row["lines"]) - 1:
            continue
        want = walked(row["lines"][1:-1], row["amount_col"])
        assert [(i["description"], i["original_text"], i["line_number"]) for i in row["items"]] == want
        checked += 1
    assert checked > 100


def test_long_island_and_long_table(spark):
    """Tens of thousands of rows: one item over all of them, or one item each."""
    n = 20_000
    head, foot = "Description of item           Amount", "Total                          $270.75"
    sample = "\n".join(["Some work as agreed upon      $1.00"] * 19)
    docs = [(1, "\n".join([head, sample, *["narrow"] * n, foot])), (2, "\n".join([head, *["Some work as agreed upon      $1.00"] * n, foot]))]
    df = spark.createDataFrame(docs, "document_id int, extracted_text string")
    sizes = {row["document_id"]: row for row in invoice.parse_invoices(df).select("document_id", F.size("items").alias("n"), F.length(F.element_at("items", -1)["description"]).alias("last")).collect()}
    assert (sizes[1]["n"], sizes[1]["last"]) == (20, 7 * n - 1) and sizes[2]["n"] == n


def test_unreadable_invoices(spark):
    texts = [(1, "Description                   Charge\nTotal amount due $77.10"), (2, "scan failed"), (3, None)]
    df = spark.createDataFrame(texts, "document_id int, extracted_text string")
    rows = {r["document_id"]: r for r in invoice.parse_quality(invoice.reconcile(invoice.parse_invoices(df))).collect()}
    assert all(r["fallback_used"] and not r["reconciled"] and r["overall_confidence"] == 20 for r in rows.values())
    assert [(i["description"], i["amount"]) for i in rows[1]["items"]] == [("Unknown charge 1", Decimal("77.1"))]
    assert rows[1]["stated_total"] is None and rows[2]["items_parsed"] == rows[3]["items_parsed"] == 0


def test_header_without_amounts_is_one_item(spark):
    """No amount column: every row lacks an amount, so they merge up to a bullet, as in the reference."""
    text = "Description and amount\nsome work was done\nin two rooms\n- and the hall"
    docs = spark.createDataFrame([(1, text)], "document_id int, extracted_text string")
    items = invoice.invoice_items(invoice.parse_invoices(docs), ["document_id"]).collect()
    assert [(i["line_number"], i["description"]) for i in items] == [(3, "some work was done in two rooms")]


def test_what_is_not_asked_for_is_not_worked_out(spark):
    docs = spark.createDataFrame([(1, "Item charge\nwork $5.00"), (2, "scan failed")], "document_id int, extracted_text string")
    parsed = invoice.parse_invoices(docs)
    assert [r[0] for r in parsed.select("fallback_used").orderBy("document_id").collect()] == [False, True]
    few = parsed.select("document_id", "fallback_used")._jdf.queryExecution().optimizedPlan().toString()
    assert "ambiguity_score" not in few and "standard_dollar" not in few


def test_spread_view_deals_out_the_table_not_the_view(spark):
    from claimgrid.sources.views import WAVES, Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    dealt = t.spread("invoices")
    assert dealt.rdd.getNumPartitions() == WAVES * spark.sparkContext.defaultParallelism
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and plan.index("extracted_text") < plan.index("Repartition")
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, t.invoices.collect()))
