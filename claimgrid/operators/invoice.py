"""Invoice text to line items.

A document is one row, so its layout is worked out inside that row with array functions: no
explode and no shuffle until the items themselves become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions.amounts import extract_all_amounts, let, parse_amount, strip
from claimgrid.functions.text import WIDE_MONEY, contains_any, count_contained
from claimgrid.plans.barrier import computed_once
from claimgrid.plans.skewed import join_back
from claimgrid.rules import fixed_values as fv

AMOUNT_AT = r"\$?\s*[\d,]+\.\d{2}"
NUMBER_AT = r"\$?\s*[\d,]+\.?\d*"
BULLETS = r"^(•|-|\*|1\.|2\.|3\.)"
FRAME = ["lines", "header_row", "footer_row", "detected_table", "fallback_used"]


def holds_any(text: Column, phrases: list[str]) -> Column:
    """Any phrase occurs in the text in lower case, which is made once."""
    return let(F.lower(text), lambda low: contains_any(low, phrases))


def document_lines(text: Column) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def _first_index(lines: Column, test) -> Column:
    """0-based index of the first line that passes, or null."""
    hits = F.filter(
        F.transform(lines, lambda line, i: F.when(test(line, i), i)), lambda i: i.isNotNull()
    )
    return F.array_min(hits)


def header_row(lines: Column) -> Column:
    """First of the first 20 lines with two header words, or one and a digit or dollar sign."""

    def is_header(line: Column, i: Column) -> Column:
        words = let(F.lower(line), lambda low: count_contained(low, fv.HEADER_KEYWORDS))
        return let(words, lambda n: (n >= 2) | ((n == 1) & line.rlike(r"\$|\d")))

    return _first_index(F.slice(lines, 1, 20), is_header)


def footer_row(lines: Column) -> Column:
    """Last line within the last 30, never the first, with a footer word and an amount."""
    size = F.size(lines)

    def is_footer(line: Column, i: Column) -> Column:
        return (
            (i > F.greatest(F.lit(0), size - 30))
            & (line.contains("$") | line.rlike(r"\d+\.\d{2}"))
            & holds_any(line, fv.FOOTER_KEYWORDS)
        )

    hits = F.filter(
        F.transform(lines, lambda line, i: F.when(is_footer(line, i), i)), lambda i: i.isNotNull()
    )
    return F.array_max(hits)


def match_positions(line: Column, pattern: str) -> Column:
    """0-based start offsets of all matches, from the lengths of the pieces around them."""
    return let(
        F.struct(
            F.split(line, pattern).alias("gaps"),
            F.regexp_extract_all(line, F.lit(pattern), F.lit(0)).alias("hits"),
        ),
        lambda p: F.transform(
            p["hits"],
            lambda hit, k: F.aggregate(
                F.slice(p["gaps"], 1, k + 1), F.lit(0), lambda total, gap: total + F.length(gap)
            )
            + F.aggregate(
                F.slice(p["hits"], 1, k), F.lit(0), lambda total, h: total + F.length(h)
            ),
        ),
    )


def sample_lines(lines: Column, header: Column, footer: Column) -> Column:
    """Up to 20 lines from the header to the footer."""
    start = F.coalesce(header, F.lit(0))
    end = F.coalesce(footer, F.size(lines))
    return F.slice(lines, start + 1, F.greatest(F.lit(0), F.least(F.lit(20), end - start)))


def amount_column(lines: Column, header: Column, footer: Column) -> Column:
    """Offset of the amount column over up to 20 lines: the most frequent 10-wide bucket when it
    has three hits (first seen wins ties), else the rightmost offset."""
    sample = sample_lines(lines, header, footer)
    positions = F.flatten(F.transform(sample, lambda line: match_positions(line, AMOUNT_AT)))

    def pick(found: Column) -> Column:
        buckets = F.transform(found, lambda p: (F.floor(p / 10) * 10).cast("int"))
        return let(
            buckets,
            lambda all_buckets: let(
                F.array_max(
                    F.transform(
                        F.array_distinct(all_buckets),
                        lambda b, i: F.struct(
                            F.size(F.filter(all_buckets, lambda x: x == b)).alias("hits"),
                            (-i).alias("rank"),
                            b.alias("bucket"),
                        ),
                    )
                ),
                lambda best: F.when(best["hits"] >= 3, best["bucket"]).otherwise(
                    F.array_max(found)
                ),
            ),
        )

    return let(positions, pick)


def _frame(docs: DataFrame, text: str) -> DataFrame:
    """Lines, header, footer and whether a table was found."""
    framed = docs.withColumn("lines", document_lines(F.coalesce(F.col(text), F.lit(""))))
    framed = framed.withColumns(
        {"header_row": header_row(F.col("lines")), "footer_row": footer_row(F.col("lines"))}
    )
    sample = sample_lines(F.col("lines"), F.col("header_row"), F.col("footer_row"))
    # There is an amount column where a sampled line holds an amount.
    return framed.withColumn(
        "detected_table",
        F.col("header_row").isNotNull()
        | F.col("footer_row").isNotNull()
        | F.exists(sample, lambda line: line.rlike(AMOUNT_AT)),
    )


def _with_columns(framed: DataFrame) -> DataFrame:
    """Add amount column and description start."""
    framed = framed.withColumn(
        "amount_col", amount_column(F.col("lines"), F.col("header_row"), F.col("footer_row"))
    )
    sample = sample_lines(F.col("lines"), F.col("header_row"), F.col("footer_row"))
    starts = F.filter(
        F.transform(
            sample,
            lambda line: F.when(
                F.length(line) > F.col("amount_col"),
                let(
                    F.rtrim(F.substr(line, F.lit(1), F.col("amount_col"))),
                    lambda part: F.when(part != "", F.length(line) - F.length(F.ltrim(part))),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    average = let(
        starts,
        lambda s: F.when(
            F.size(s) > 0,
            F.floor(F.aggregate(s, F.lit(0), lambda a, x: a + x) / F.size(s)).cast("int"),
        ).otherwise(F.lit(0)),
    )
    return framed.withColumn(
        "description_start", F.when(F.col("amount_col").isNotNull() & (F.size(sample) > 0), average)
    )


def detect_structure(docs: DataFrame, text: str = "extracted_text") -> DataFrame:
    """Lines, header, footer, amount column, description start and whether a table was found."""
    return _with_columns(_frame(docs, text))


def looks_like_item(line: Column) -> Column:
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return (F.length(line) >= 5) & line.rlike(NUMBER_AT) & (letters > 3)


#: One item in the string of row codes: a wide row alone, or a narrow row with all that follow up to
#: the one that closes it. Records have one length, so matching takes time in proportion to the rows.
PLACE = 9
_RECORD = "[{}][0-9]{{%d}}" % PLACE
ISLAND = (
    f"{_RECORD.format('wi')}|{_RECORD.format('os')}(?:{_RECORD.format('oi')})*(?:{_RECORD.format('ws')})?"
)


def _table_range() -> tuple[Column, Column]:
    """First row of the table and the one after its last."""
    begin = F.when(F.col("header_row").isNotNull(), F.col("header_row") + 1).otherwise(F.lit(0))
    return begin, F.coalesce("footer_row", F.size("lines"))


def _nothing_found() -> Column:
    """The layout gives no item: each row of a table is in one, other lines must look like one."""
    begin, end = _table_range()
    return F.when(F.col("detected_table"), end <= begin).otherwise(~F.exists("lines", looks_like_item))


def _table_items() -> Column:
    """Rows between header and footer; a row without an amount gathers the following rows until
    one with an amount or a bullet, which closes it.

    Each row becomes a code: w wide (it reaches the amount column) and closing, i wide, s narrow and
    closing, o narrow. The islands of the code string are the items.
    """
    lines, col = F.col("lines"), F.col("amount_col")
    begin, end = _table_range()
    rows = F.slice(lines, begin + 1, F.greatest(F.lit(0), end - begin))

    def reaches(row: Column) -> Column:
        return F.coalesce(F.length(row) > col, F.lit(False))

    def tail(row: Column) -> Column:
        return strip(F.substr(row, col + 1, F.length(row)))

    def code(row: Column, i: Column) -> Column:
        closes = (reaches(row) & (col > 0) & tail(row).rlike(NUMBER_AT)) | row.rlike(BULLETS)
        kind = F.when(reaches(row), F.when(closes, "w").otherwise("i")).otherwise(
            F.when(closes, "s").otherwise("o")
        )
        return F.concat(kind, F.lpad(i.cast("string"), PLACE, "0"))

    def place(island: Column) -> Column:
        return F.struct(
            F.substr(island, F.lit(2), F.lit(PLACE)).cast("int").alias("first"),
            (F.length(island) / (PLACE + 1)).cast("int").alias("size"),
            F.left(island, F.lit(1)).isin("w", "i").alias("alone"),
            F.substr(island, F.lit(-PLACE - 1), F.lit(1)).isin("w", "s").alias("closes"),
        )

    def item(table: Column, island: Column) -> Column:
        first, size, alone = island["first"], island["size"], island["alone"]
        closed = ~alone & (size > 1) & island["closes"]
        head, last = F.get(table, first), F.get(table, first + size - 1)
        gathered = F.array_join(F.slice(table, first + 1, size - closed.cast("int")), " ")
        description = F.when(alone, strip(F.substr(head, F.lit(1), col))).otherwise(gathered)
        return F.struct(
            F.when(description == "", F.lit("Unknown charge")).otherwise(description).alias("description"),
            head.alias("original_text"),
            (first + size + F.when(alone | closed, 0).otherwise(1)).cast("int").alias("line_number"),
            F.when(closed & reaches(last), tail(last)).alias("closing_text"),
        )

    return let(
        rows,
        lambda table: F.transform(
            F.transform(
                F.regexp_extract_all(F.array_join(F.transform(table, code), ""), F.lit(ISLAND), F.lit(0)),
                place,
            ),
            lambda island: item(table, island),
        ),
    )


def _plain_items() -> Column:
    numbered = F.transform(
        F.col("lines"),
        lambda line, i: F.struct(
            line.alias("description"),
            line.alias("original_text"),
            (i + 1).cast("int").alias("line_number"),
            F.lit(None).cast("string").alias("closing_text"),
        ),
    )
    return F.filter(numbered, lambda x: looks_like_item(x["description"]))


def _priced(raw: Column, table: Column, use_closing_amount: bool) -> Column:
    """Attach amount, confidence band, notes, flags and ambiguity to a raw item."""

    def price(x: Column) -> Column:
        return F.struct(x.alias("raw"), parse_amount(x["original_text"]).alias("own"))

    def fill(x: Column) -> Column:
        raw, own = x["raw"], x["own"]
        other = parse_amount(raw["description"])
        if use_closing_amount:
            other = F.coalesce(other, parse_amount(raw["closing_text"]))
        return F.struct(
            raw["description"].alias("description"),
            raw["original_text"].alias("original_text"),
            raw["line_number"].alias("line_number"),
            own.alias("own"),
            F.when(own.isNull(), other).alias("other"),
        )

    def weigh(x: Column) -> Column:
        own, other = x["own"], x["other"]
        amount = F.coalesce(own["amount"], other["amount"], F.lit(0).cast("decimal(18,4)"))
        band = (
            F.when(own["confidence"] >= 0.8, "high")
            .when(own["confidence"] >= 0.5, "medium")
            .when(own["confidence"].isNotNull(), "low")
            .when(table, "medium")
            .otherwise("low")
        )
        return F.struct(
            x.alias("x"), amount.alias("amount"), band.alias("band"),
            F.lower(x["description"]).alias("lowered"),
        )

    def mark(v: Column) -> Column:
        lowered = v["lowered"]
        return F.struct(
            v["x"].alias("x"), v["amount"].alias("amount"), v["band"].alias("band"),
            lowered.alias("lowered"),
            contains_any(lowered, fv.TAX_KEYWORDS).alias("tax"),
            contains_any(lowered, fv.FEE_KEYWORDS).alias("fee"),
        )

    def finish(v: Column) -> Column:
        x, amount, band, lowered, tax, fee = (v[c] for c in ("x", "amount", "band", "lowered", "tax", "fee"))
        own, other, description = x["own"], x["other"], x["description"]
        lost = own.isNull() & other.isNull()
        length = F.length(strip(description))
        score = (
            F.when(length < 3, 40.0).when(length < 10, 20.0).otherwise(0.0)
            + F.when(amount == 0, 50.0).when(band == "low", 30.0).when(band == "medium", 15.0).otherwise(0.0)
            + F.when(lowered.contains("unknown"), 30.0).otherwise(0.0)
            + F.when(lost, 40.0).otherwise(0.0)
        )
        notes = F.array_compact(
            F.array(
                F.when(~table, F.lit("No table structure detected")),
                F.when(own.isNotNull(), F.concat(F.lit("Parsed via "), own["method"])),
                F.when(other.isNotNull(), F.lit("Amount found in description")),
                F.when(lost, F.lit("Amount not found - manual review needed")),
                F.when(tax, F.lit("Identified as tax")),
                F.when(fee, F.lit("Identified as fee")),
            )
        )
        return F.struct(
            description.alias("description"),
            amount.cast("decimal(18,4)").alias("amount"),
            x["line_number"].alias("line_number"),
            band.alias("confidence"),
            F.least(F.lit(100.0), score).alias("ambiguity_score"),
            notes.alias("notes"),
            F.coalesce(own["is_negative"], other["is_negative"], F.lit(False)).alias("is_credit"),
            tax.alias("is_tax"),
            fee.alias("is_fee"),
            contains_any(lowered, fv.SUBTOTAL_KEYWORDS).alias("is_subtotal"),
            x["original_text"].alias("original_text"),
        )

    steps = raw
    for step in (price, fill, weigh, mark, finish):
        steps = F.transform(steps, step)
    return steps


def _fallback_items(text: Column) -> Column:
    """All amounts as unknown charges."""
    found = extract_all_amounts(text)
    return F.transform(
        found,
        lambda x, i: F.struct(
            F.concat(F.lit("Unknown charge "), (i + 1).cast("string")).alias("description"),
            x["result"]["amount"].alias("amount"),
            (i + 1).cast("int").alias("line_number"),
            F.lit("low").alias("confidence"),
            F.lit(90.0).alias("ambiguity_score"),
            F.array(F.lit("Fallback parsing")).alias("notes"),
            F.lit(False).alias("is_credit"),
            F.lit(False).alias("is_tax"),
            F.lit(False).alias("is_fee"),
            F.lit(False).alias("is_subtotal"),
            x["original_text"].alias("original_text"),
        ),
    )


def stated_total(text: Column) -> Column:
    """Absolute amount of the last total-like line whose amount is certain enough."""
    candidates = F.filter(
        F.split(text, "\n"), lambda line: holds_any(line, fv.TOTAL_KEYWORDS)
    )
    amounts = F.filter(
        F.transform(candidates, lambda line: parse_amount(line)), lambda a: a["confidence"] > 0.7
    )
    return F.abs(F.try_element_at(amounts, F.lit(-1))["amount"])


def _metadata(text: Column) -> dict[str, Column]:
    day = r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"

    def group(pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        return F.when(found != "", found)

    return {
        "invoice_number": group(r"(?i)invoice\s*#?\s*:?\s*([A-Z0-9\-]+)"),
        "invoice_date": group(r"(?i)date\s*:?\s*" + day),
        "due_date": F.coalesce(
            group(r"(?i)due\s+date\s*:?\s*" + day), group(r"(?i)payment\s+due\s*:?\s*" + day)
        ),
    }


def parse_invoices(
    docs: DataFrame, text: str = "extracted_text", use_closing_amount: bool = False
) -> DataFrame:
    """One row per document: structure, ``items``, stated total, metadata, fallback marker.

    The fallback list is used only where the layout gave no item. ``use_closing_amount`` lets a
    merged description take the amount of the row that closes it.
    """
    framed = _frame(docs, text).withColumn("fallback_used", _nothing_found())
    # What a caller does not ask for of the rest is never worked out.
    framed = _with_columns(computed_once(framed, FRAME))
    raw = F.when(F.col("detected_table"), _table_items()).otherwise(_plain_items())
    priced = _priced(raw, F.col("detected_table"), use_closing_amount)
    whole = F.coalesce(F.col(text), F.lit(""))
    return framed.withColumns(
        {
            "items": F.when(F.col("fallback_used"), _fallback_items(whole)).otherwise(priced),
            "stated_total": F.when(~F.col("fallback_used"), stated_total(whole)),
            **_metadata(whole),
        }
    )


def invoice_items(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Items as rows."""
    once = computed_once(parsed.select(*keys, "items"), ["items"])
    return once.select(*keys, F.explode("items").alias("i")).select(*keys, "i.*")


def _sum(items: Column, value) -> Column:
    return F.aggregate(
        items,
        F.lit(0).cast(WIDE_MONEY),
        lambda total, i: (total + value(i)).cast(WIDE_MONEY),
    )


def reconcile(parsed: DataFrame) -> DataFrame:
    """Signed total of regular, tax, fee and credit items against the stated total, with notes.

    An item carrying two of the three marks counts in both buckets, as the buckets overlap.
    """
    items = F.col("items")
    marks = lambda i: (
        i["is_credit"].cast("int") + i["is_tax"].cast("int") + i["is_fee"].cast("int")
    )
    total = _sum(items, lambda i: i["amount"] * F.greatest(marks(i), F.lit(1)))
    framed = computed_once(parsed, ["items", "stated_total"]).withColumns(
        {
            "calculated_total": total,
            "credit_total": _sum(F.filter(items, lambda i: i["is_credit"]), lambda i: i["amount"]),
            "tax_total": _sum(F.filter(items, lambda i: i["is_tax"]), lambda i: i["amount"]),
            "fee_total": _sum(F.filter(items, lambda i: i["is_fee"]), lambda i: i["amount"]),
            "_negative": F.size(F.filter(items, lambda i: i["amount"] < 0)),
            "_credits": F.size(F.filter(items, lambda i: i["is_credit"])),
        }
    )
    stated = F.col("stated_total").cast(WIDE_MONEY)
    fallback = F.col("fallback_used")  # an unreadable invoice is never reconciled
    gap = F.when(~fallback, F.abs(F.col("calculated_total") - stated))
    framed = framed.withColumn(
        "difference", F.coalesce(gap, F.lit(0).cast(WIDE_MONEY))
    ).withColumn("reconciled", ~fallback & (stated.isNull() | (F.col("difference") <= 1)))
    short = F.col("calculated_total") < stated
    notes = F.array_compact(
        F.array(
            F.when(stated.isNull(), F.lit("No stated total found, using calculated total")),
            F.when(
                ~F.col("reconciled"),
                F.concat(F.lit("Reconciliation difference: $"), F.col("difference").cast("string")),
            ),
            F.when(
                ~F.col("reconciled") & short,
                F.lit("Calculated total is less than stated total - possible missing items"),
            ),
            F.when(
                ~F.col("reconciled") & ~short,
                F.lit(
                    "Calculated total exceeds stated total - possible duplicate items or "
                    "calculation error"
                ),
            ),
            F.when(
                stated.isNotNull() & (F.col("_negative") > 0) & (F.col("_credits") == 0),
                F.concat(
                    F.lit("Found "), F.col("_negative").cast("string"),
                    F.lit(" negative amounts not classified as credits"),
                ),
            ),
        )
    )
    missing = ~F.col("reconciled") & F.coalesce(short, F.lit(False))
    errors = F.array_compact(
        F.array(
            F.when(
                (F.size(items) == 0) & (stated > 0),
                F.lit("No line items found but stated total is non-zero"),
            ),
            F.when(missing, F.lit("Possible missing line items detected")),
            F.when(
                F.col("difference") > 10,
                F.concat(
                    F.lit("Large reconciliation difference: $"), F.col("difference").cast("string")
                ),
            ),
        )
    )
    reference = F.coalesce(F.nullif(stated, F.lit(0).cast(WIDE_MONEY)), F.col("calculated_total"))
    return framed.withColumns(
        {
            "missing_items_detected": missing,
            "negative_amounts_found": F.col("_negative") > 0,
            "reconciliation_notes": notes,
            "reconciliation_errors": errors,
            "severity": F.when(
                ~F.col("reconciled"),
                F.when(
                    F.col("difference") > reference * F.lit("0.05").cast("decimal(3,2)"), "critical"
                ).otherwise("warning"),
            ),
        }
    ).drop("_negative", "_credits")


def parse_quality(reconciled: DataFrame) -> DataFrame:
    """Counts, mean ambiguity, confidence, flags and review reasons per document."""
    items = F.col("items")
    names = F.transform(items, lambda i: F.lower(strip(i["description"])))
    duplicates = let(
        names,
        lambda keys: F.size(
            F.filter(
                F.transform(
                    items,
                    lambda i, k: let(
                        F.array_position(keys, F.lower(strip(i["description"]))),
                        lambda first: (first < k + 1)
                        & (
                            F.abs(F.element_at(items, first.cast("int"))["amount"] - i["amount"])
                            <= F.lit("0.01").cast("decimal(4,2)")
                        ),
                    ),
                ),
                lambda hit: hit,
            )
        ),
    )
    framed = reconciled.withColumns(
        {
            "items_parsed": F.size(items),
            "items_ambiguous": F.size(F.filter(items, lambda i: i["ambiguity_score"] >= 70)),
            "avg_ambiguity": F.when(
                F.size(items) > 0,
                F.aggregate(items, F.lit(0.0), lambda a, i: a + i["ambiguity_score"]) / F.size(items),
            ).otherwise(100.0),
            "duplicate_items": duplicates,
            "_plain_total": _sum(items, lambda i: i["amount"]),
        }
    )
    base = F.greatest(F.col("_plain_total"), F.lit(0)).cast("double")
    base = F.when(base > 0, base).otherwise(1.0)
    unnamed = lambda i: F.length(strip(F.coalesce(i["description"], F.lit("")))) < 3
    suspicious = F.filter(
        items,
        lambda i: (i["amount"] > 0)
        & ((i["amount"].cast("double") / base * 100 > 50) | (i["amount"] > 10000) | unnamed(i)),
    )
    item_reasons = F.transform(
        suspicious,
        lambda i: F.when(
            i["amount"] > 10000, F.concat(F.lit("Item exceeds $10,000: "), i["description"])
        ).when(unnamed(i), F.lit("Item has missing or very short description")),
    )
    framed = framed.withColumns(
        {
            "suspicious_items": F.size(suspicious),
            "_item_reasons": item_reasons,
            # An unreadable invoice keeps the parser's own fixed state.
            "avg_ambiguity": F.when(F.col("fallback_used"), 90.0).otherwise(F.col("avg_ambiguity")),
        }
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("items_parsed") == 0, F.lit("No line items found")),
            F.when(
                F.col("duplicate_items") > 0,
                F.format_string("Found %d potential duplicate items", F.col("duplicate_items")),
            ),
            F.when(
                F.col("suspicious_items") > 0,
                F.format_string("Found %d suspicious items", F.col("suspicious_items")),
            ),
            F.when(~F.col("reconciled"), F.lit("Reconciliation failed")),
        )
    )
    before = F.array(
        F.when(F.col("items_parsed") == 0, F.lit("No line items could be extracted from invoice")),
        F.when(F.col("duplicate_items") > 0, F.lit("Duplicate line items detected")),
    )
    after = (
        F.array(
            F.when(
                ~F.col("reconciled"),
                F.concat(F.lit("Total mismatch: $"), F.col("difference").cast("string")),
            ),
            F.when(F.col("avg_ambiguity") > 60, F.lit("High average ambiguity score")),
        )
    )
    reasons = F.array_compact(F.concat(before, F.col("_item_reasons"), after))
    return framed.withColumns(
        {
            "overall_confidence": F.when(F.col("fallback_used"), 20.0).otherwise(
                F.greatest(F.lit(0.0), 100 - F.col("avg_ambiguity"))
            ),
            "requires_manual_review": F.col("fallback_used")
            | (F.col("items_parsed") == 0)
            | ~F.col("reconciled")
            | (F.col("avg_ambiguity") > 60),
            "flags": F.when(
                F.col("fallback_used"), F.array(F.lit("Fallback parsing used"))
            ).otherwise(flags),
            "manual_review_reasons": F.when(
                F.col("fallback_used"), F.array(F.lit("Primary parsing failed"))
            ).otherwise(reasons),
        }
    ).drop("_plain_total", "_item_reasons")


# ----- checks over item tables ------------------------------------------------------------------


def duplicate_items(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Items repeating the first item of the same description within a cent.

    The first occurrence per (key, description) is found by ``min_by`` with map-side combine and
    joined back, a frequent description in pieces.
    """
    named = items.withColumn("_name", F.lower(F.trim("description")))
    group = [*keys, "_name"]
    first = named.groupBy(*group).agg(
        F.min_by(F.struct("amount", *order), F.struct(*order)).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
    ).filter(F.col("_n") > 1)
    later = F.struct(*order) > F.struct(*[F.col("_first." + c) for c in order])
    close = F.abs(F.col("amount") - F.col("_first.amount")) <= F.lit("0.01").cast("decimal(4,2)")
    return join_back(named, first, group).filter(later & close).drop("_name", "_first", "_n")


def suspicious_items(items: DataFrame, key: str) -> DataFrame:
    """Positive items above half of their group's total, above 10,000, or hardly described."""
    totals = items.groupBy(key).agg(F.sum("amount").cast("double").alias("_sum"))
    base = F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(1.0)
    share = F.col("amount").cast("double") / base * 100
    reason = (
        F.when(share > 50, "over_half")
        .when(F.col("amount") > 10000, "over_10000")
        .when(F.length(F.trim("description")) < 3, "short_description")
    )
    return (
        join_back(items.filter(F.col("amount") > 0), totals, [key])
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .drop("_sum")
    )


__all__ = [
    "amount_column", "detect_structure", "document_lines", "duplicate_items", "footer_row",
    "header_row", "invoice_items", "looks_like_item", "parse_invoices",
    "parse_quality", "reconcile", "stated_total", "suspicious_items",
]
