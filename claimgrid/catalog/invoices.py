"""Amounts in text, invoice layout, line items, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrid.catalog import query
from claimgrid.catalog.items import quote, sql_any
from claimgrid.functions.amounts import amount_problem, extract_all_amounts, parse_amount
from claimgrid.functions.text import as_double
from claimgrid.operators import invoice
from claimgrid.plans.barrier import spread
from claimgrid.rules import fixed_values as fv

SPACE = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def strip_sql(x: str) -> str:
    return f"trim({x}, {SPACE})"


def _num(x: str) -> str:
    return f"TRY_CAST(replace({x}, ',', '') AS DECIMAL(18,4))"


def _group(pattern: str, i: int, t: str = "t") -> str:
    return f"regexp_extract({t}, {quote(pattern)}, {i})"


ORDERED = sorted(fv.STANDARD_AMOUNT_PATTERNS, key=lambda e: -e[1])


def amount_ctes(source: str, prefix: str, base: str = "NULL") -> str:
    """CTE ``{prefix}amt``: rows of ``source`` (with stripped text t) plus amount, confidence,
    is_negative, method."""
    std = ", ".join(f"{_num(_group(p, 1))} AS s{i}" for i, (p, _, _) in enumerate(ORDERED))
    method = " ".join(f"WHEN s{i} IS NOT NULL THEN '{m}'" for i, (_, _, m) in enumerate(ORDERED))
    conf = " ".join(f"WHEN '{m}' THEN {c}" for _, c, m in ORDERED)
    value = " ".join(f"WHEN '{m}' THEN s{i}" for i, (_, _, m) in enumerate(ORDERED))
    standard = ", ".join(f"'{m}'" for _, _, m in ORDERED)
    return f"""{prefix}g AS (SELECT *, regexp_matches(t, {quote(fv.TBD_PATTERN)}) AS tbd,
  TRY_CAST({_group(fv.PERCENT_PATTERN, 1)} AS DECIMAL(18,4)) AS pct, CAST({base} AS DECIMAL(18,4)) AS base,
  {_num(_group(fv.RANGE_PATTERN, 1))} AS r1, {_num(_group(fv.RANGE_PATTERN, 2))} AS r2,
  {_num(_group(fv.FORMULA_PATTERN, 1))} AS f1, {_num(_group(fv.FORMULA_PATTERN, 2))} AS f2,
  TRY_CAST(replace(replace({_group(fv.EURO_PATTERN, 1)}, '.', ''), ',', '.') AS DECIMAL(18,4)) AS eu, {std} FROM {source}),
{prefix}m AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN tbd THEN 'tbd_flag' WHEN pct IS NOT NULL AND base IS NOT NULL THEN 'percentage_calculation'
    WHEN r1 <> 0 AND r2 <> 0 AND r1 <= r2 THEN 'range_midpoint' WHEN f1 IS NOT NULL AND f2 <> 0 THEN 'formula_calculation'
    WHEN eu IS NOT NULL THEN 'euro_conversion' {method} END AS method FROM {prefix}g),
{prefix}n AS (SELECT *, method IN ({standard}) AND (contains(t, '(') OR starts_with(t, '-') OR method LIKE 'negative%') AS is_negative,
  CAST(CASE method WHEN 'tbd_flag' THEN 0.0 WHEN 'percentage_calculation' THEN 0.85 WHEN 'range_midpoint' THEN 0.75 WHEN 'formula_calculation' THEN 0.9
    WHEN 'euro_conversion' THEN 0.7 {conf} END AS DOUBLE) AS confidence,
  CAST(CASE method WHEN 'tbd_flag' THEN 0 WHEN 'percentage_calculation' THEN base * pct / 100 WHEN 'range_midpoint' THEN (r1 + r2) / 2
    WHEN 'formula_calculation' THEN CAST(f1 AS DOUBLE) * CAST(f2 AS DOUBLE) WHEN 'euro_conversion' THEN CAST(eu AS DOUBLE) * 1.10 {value} END AS DOUBLE) AS magnitude FROM {prefix}m),
{prefix}amt AS (SELECT *, CASE WHEN is_negative THEN -magnitude ELSE magnitude END AS amount FROM {prefix}n)"""


INVOICE_LINES = f"lines AS (SELECT document_id, {strip_sql('unnest(string_split(extracted_text, chr(10)))')} AS t FROM v_invoices)"
PROSE_LINES = f"lines AS (SELECT doc_id AS document_id, {strip_sql('unnest(string_split(text, chr(10)))')} AS t FROM documents)"


def _amount_rows(lines, base=None):
    return lines.withColumn("r", parse_amount(F.col("t"), base)).groupBy(
        F.col("r.method").alias("method"),
        F.col("r.confidence").alias("confidence"),
        F.coalesce("r.is_negative", F.lit(False)).alias("is_negative"),
    ).agg(
        F.count(F.lit(1)).alias("lines"),
        F.round(as_double(F.sum("r.amount")), 2).alias("amount"),
    )


AMOUNT_REPORT = """SELECT method, confidence, coalesce(is_negative, FALSE) AS is_negative, count(*) AS lines, round(sum(amount), 2) AS amount FROM amt GROUP BY ALL"""


@query("C12 C14 C15 C16 C17", f"WITH {INVOICE_LINES}, {amount_ctes('lines', '')} {AMOUNT_REPORT}")
def invoice_line_amounts(t):
    return _amount_rows(
        t.spread("invoices").select(F.explode(F.split("extracted_text", "\n")).alias("t"))
    )


@query("C12 C14 C15 C16 C17", f"WITH {PROSE_LINES}, {amount_ctes('lines', '')} {AMOUNT_REPORT}")
def prose_line_amounts(t):
    return _amount_rows(spread(t.raw("documents")).select(F.explode(F.split("text", "\n")).alias("t")))


@query(
    "C13",
    f"""WITH lines AS (SELECT 'Service charge ' || CAST(l_tax * 100 AS INT) || '% of rent' AS t, CAST(l_extendedprice AS DECIMAL(18,4)) AS b FROM lineitem),
{amount_ctes("lines", "", "b")} {AMOUNT_REPORT}""",
)
def percentage_amounts(t):
    lines = t.lineitem.select(
        F.concat(
            F.lit("Service charge "), F.round(F.col("l_tax") * 100).cast("int").cast("string"),
            F.lit("% of rent"),
        ).alias("t"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("b"),
    )
    return _amount_rows(lines, F.col("b"))


@query(
    "C18",
    f"""WITH {INVOICE_LINES}, {amount_ctes("lines", "")}
SELECT document_id, count(*) AS amounts, round(sum(amount), 2) AS total FROM amt WHERE confidence > 0.5 GROUP BY document_id""",
)
def amounts_per_document(t):
    found = t.spread("invoices").select(
        "document_id", F.explode(extract_all_amounts(F.col("extracted_text"))).alias("x")
    )
    return found.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("amounts"),
        F.round(as_double(F.sum("x.result.amount")), 2).alias("total"),
    )


@query(
    "C19",
    """WITH a AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(14,4)) WHEN l_linenumber % 3 = 1 THEN -CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(14,4))
  ELSE CAST(CAST(l_discount AS DECIMAL(12,4)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(14,4)) END AS amount FROM lineitem)
SELECT CASE WHEN amount = 0 THEN 'Amount is zero' WHEN abs(amount) > 10000 THEN 'Amount exceeds maximum: $' || CAST(abs(amount) AS VARCHAR)
  WHEN abs(amount) < 0.01 THEN 'Amount below minimum: $' || CAST(abs(amount) AS VARCHAR) END AS problem, count(*) AS items FROM a GROUP BY ALL""",
)
def amount_validation(t):
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("decimal(14,4)")
    small = (F.col("l_discount").cast("decimal(12,4)") * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(14,4)")
    place = F.col("l_linenumber") % 3
    amount = F.when(place == 0, price).when(place == 1, -price).otherwise(small)
    problems = t.lineitem.select(amount.alias("amount")).select(amount_problem(F.col("amount")).alias("problem"))
    return problems.groupBy("problem").agg(F.count(F.lit(1)).alias("items"))


# ----- layout -----------------------------------------------------------------------------------------

HEADER_COUNT = " + ".join(
    f"CAST(contains(lower(line), {quote(k)}) AS INT)" for k in fv.HEADER_KEYWORDS
)


def layout_ctes(source: str, key: str, text: str) -> str:
    return f"""numbered AS (SELECT {key} AS document_id, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS idx, line
  FROM (SELECT {key}, i, {strip_sql("list_extract(string_split(coalesce(" + text + ", ''), chr(10)), i)")} AS line
    FROM (SELECT *, unnest(generate_series(1, len(string_split(coalesce({text}, ''), chr(10))))) AS i FROM {source})) WHERE line <> ''),
sized AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM numbered),
hf AS (SELECT {key} AS document_id, coalesce(max(n), 0) AS n,
  min(idx) FILTER (WHERE idx < 20 AND (({HEADER_COUNT}) >= 2 OR (({HEADER_COUNT}) = 1 AND regexp_matches(line, '\\$|\\d')))) AS header_row,
  max(idx) FILTER (WHERE idx > greatest(0, n - 30) AND {sql_any("lower(line)", fv.FOOTER_KEYWORDS)} AND (contains(line, '$') OR regexp_matches(line, '\\d+\\.\\d{{2}}'))) AS footer_row
  FROM (SELECT d.{key}, s.idx, s.n, s.line FROM {source} d LEFT JOIN sized s ON s.document_id = d.{key}) GROUP BY 1),
samp AS (SELECT s.document_id, s.idx, s.line FROM sized s JOIN hf h USING (document_id)
  WHERE s.idx >= coalesce(h.header_row, 0) AND s.idx < least(coalesce(h.header_row, 0) + 20, coalesce(h.footer_row, s.n))),
hits AS (SELECT document_id, idx, line, string_split_regex(line, '\\$?\\s*[\\d,]+\\.\\d{{2}}') AS gaps, regexp_extract_all(line, '\\$?\\s*[\\d,]+\\.\\d{{2}}') AS found FROM samp),
pos AS (SELECT document_id, idx, k, CAST(list_sum(list_transform(list_slice(gaps, 1, k), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(found, 1, k - 1), lambda x: length(x))), 0) AS INT) AS p
  FROM (SELECT *, unnest(generate_series(1, len(found))) AS k FROM hits)),
buckets AS (SELECT document_id, CAST(floor(p / 10) * 10 AS INT) AS bucket, count(*) AS hits, min(idx * 1000 + k) AS seen FROM pos GROUP BY ALL),
best AS (SELECT document_id, bucket, hits FROM buckets QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY hits DESC, seen) = 1),
layout AS (SELECT h.document_id, h.n, h.header_row, h.footer_row, CASE WHEN b.hits >= 3 THEN b.bucket ELSE m.mp END AS amount_col,
  h.header_row IS NOT NULL OR h.footer_row IS NOT NULL OR m.mp IS NOT NULL AS detected_table
  FROM hf h LEFT JOIN best b USING (document_id) LEFT JOIN (SELECT document_id, max(p) AS mp FROM pos GROUP BY 1) m USING (document_id))"""


LAYOUT_REPORT = "SELECT document_id, n AS lines, CAST(header_row AS INT) AS header_row, CAST(footer_row AS INT) AS footer_row, amount_col, detected_table FROM layout"


def _layout(docs, text):
    framed = invoice.detect_structure(docs, text)
    return framed.select(
        "document_id", F.size("lines").cast("bigint").alias("lines"), "header_row", "footer_row",
        "amount_col", "detected_table",
    )


@query(
    "C20 C21 C22 C23",
    f"WITH {layout_ctes('v_invoices', 'document_id', 'extracted_text')} {LAYOUT_REPORT}",
)
def invoice_layout(t):
    return _layout(t.spread("invoices"), "extracted_text")


@query(
    "C20 C21 C22 C23",
    f"WITH {layout_ctes('documents', 'doc_id', 'text')} {LAYOUT_REPORT}",
)
def prose_layout(t):
    return _layout(spread(t.raw("documents")).withColumnRenamed("doc_id", "document_id"), "text")


_DESC_LOW = "lower(description)"


def item_ctes(source: str, key: str, text: str) -> str:
    """CTE ``items``: parsed line items, islands of table rows by running counts.

    Before a row an item is open if the last row that decides it alone left one open, turned over by
    every narrow closing row since. Documents without items list their certain amounts.
    """
    return f"""{layout_ctes(source, key, text)},
rws AS (SELECT s.document_id, s.idx - CASE WHEN l.header_row IS NULL THEN 0 ELSE l.header_row + 1 END AS r, s.line, l.amount_col AS col,
    coalesce(l.footer_row, l.n) - CASE WHEN l.header_row IS NULL THEN 0 ELSE l.header_row + 1 END AS nrows
  FROM sized s JOIN layout l USING (document_id) WHERE l.detected_table
    AND s.idx >= CASE WHEN l.header_row IS NULL THEN 0 ELSE l.header_row + 1 END AND s.idx < coalesce(l.footer_row, l.n)),
fl AS (SELECT *, col IS NOT NULL AND length(line) > col AS wide,
    (col > 0 AND length(line) > col AND regexp_matches({strip_sql("substr(line, col + 1)")}, '\\$?\\s*[\\d,]+\\.?\\d*'))
      OR regexp_matches(line, '^(•|-|\\*|1\\.|2\\.|3\\.)') AS closes FROM rws),
swaps AS (SELECT *, sum(CAST(NOT wide AND closes AS INT)) OVER (PARTITION BY document_id ORDER BY r) AS q FROM fl),
opens AS (SELECT *, (coalesce(last_value(CASE WHEN wide = closes THEN CAST(NOT wide AS INT) - q END IGNORE NULLS) OVER earlier, 0)
    + coalesce(last_value(q) OVER earlier, 0)) % 2 = 1 AS is_open FROM swaps
  WINDOW earlier AS (PARTITION BY document_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
islands AS (SELECT *, sum(CAST(NOT is_open AS INT)) OVER (PARTITION BY document_id ORDER BY r) AS island FROM opens),
grouped AS (SELECT document_id, min(r) AS r0, max(r) AS r1, any_value(nrows) AS nrows, any_value(col) AS col, arg_min(line, r) AS original_text, arg_min(wide, r) AS alone,
    bool_or(is_open AND closes) AS closed, string_agg(line, ' ' ORDER BY r) FILTER (WHERE NOT (is_open AND closes)) AS gathered FROM islands GROUP BY document_id, island),
raw AS (SELECT document_id, CASE WHEN alone THEN r0 + 1 WHEN closed THEN r1 + 1 ELSE nrows + 1 END AS line_number,
    coalesce(nullif(CASE WHEN alone THEN {strip_sql("substr(original_text, 1, col)")} ELSE gathered END, ''), 'Unknown charge') AS description, original_text, TRUE AS tab FROM grouped
  UNION ALL SELECT s.document_id, s.idx + 1, s.line, s.line, FALSE FROM sized s JOIN layout l USING (document_id)
    WHERE NOT l.detected_table AND length(s.line) >= 5 AND regexp_matches(s.line, '\\$?\\s*[\\d,]+\\.?\\d*') AND length(regexp_replace(s.line, '[^\\p{{L}}]', '', 'g')) > 3),
own0 AS (SELECT *, {strip_sql("original_text")} AS t FROM raw), {amount_ctes("own0", "o_")},
oth0 AS (SELECT document_id, line_number, {strip_sql("description")} AS t FROM raw), {amount_ctes("oth0", "d_")},
both_ AS (SELECT o.document_id, o.line_number, o.description, o.original_text, o.tab, o.method, o.confidence AS oc, o.amount AS oa, o.is_negative AS oneg,
    CASE WHEN o.method IS NULL THEN d.method END AS dm, CASE WHEN o.method IS NULL THEN d.amount END AS da, CASE WHEN o.method IS NULL THEN d.is_negative END AS dneg
  FROM o_amt o JOIN d_amt d USING (document_id, line_number)),
banded AS (SELECT *, round(coalesce(oa, da, 0), 4) AS amount, CASE WHEN oc >= 0.8 THEN 'high' WHEN oc >= 0.5 THEN 'medium' WHEN oc IS NOT NULL THEN 'low' WHEN tab THEN 'medium' ELSE 'low' END AS confidence,
  coalesce(CASE WHEN method IS NOT NULL THEN oneg END, CASE WHEN dm IS NOT NULL THEN dneg END, FALSE) AS is_credit, method IS NULL AND dm IS NULL AS lost,
  {sql_any(_DESC_LOW, fv.TAX_KEYWORDS)} AS is_tax, {sql_any(_DESC_LOW, fv.FEE_KEYWORDS)} AS is_fee FROM both_),
found AS (SELECT *, least(100.0, CASE WHEN length(description) < 3 THEN 40.0 WHEN length(description) < 10 THEN 20.0 ELSE 0.0 END
    + CASE WHEN amount = 0 THEN 50.0 WHEN confidence = 'low' THEN 30.0 WHEN confidence = 'medium' THEN 15.0 ELSE 0.0 END
    + CASE WHEN contains(lower(description), 'unknown') THEN 30.0 ELSE 0.0 END + CASE WHEN lost THEN 40.0 ELSE 0.0 END) AS ambiguity_score,
  concat_ws('|', CASE WHEN NOT tab THEN 'No table structure detected' END, CASE WHEN method IS NOT NULL THEN 'Parsed via ' || method END, CASE WHEN dm IS NOT NULL THEN 'Amount found in description' END,
    CASE WHEN lost THEN 'Amount not found - manual review needed' END, CASE WHEN is_tax THEN 'Identified as tax' END, CASE WHEN is_fee THEN 'Identified as fee' END) AS notes FROM banded),
fbl AS (SELECT {key} AS document_id, i, {strip_sql("list_extract(string_split(" + text + ", chr(10)), i)")} AS t
  FROM (SELECT *, unnest(generate_series(1, len(string_split({text}, chr(10))))) AS i FROM {source} WHERE {key} NOT IN (SELECT document_id FROM raw))),
{amount_ctes("fbl", "f_")},
items AS (SELECT document_id, line_number, description, amount, confidence, ambiguity_score, notes, is_credit, is_tax, is_fee FROM found
  UNION ALL SELECT document_id, k, 'Unknown charge ' || k, round(amount, 4), 'low', 90.0, 'Fallback parsing', FALSE, FALSE, FALSE
  FROM (SELECT document_id, amount, row_number() OVER (PARTITION BY document_id ORDER BY i) AS k FROM f_amt WHERE confidence > 0.5))"""


ITEM_REPORT = """SELECT document_id, CAST(line_number AS INT) AS line_number, md5(description) AS description_hash, CAST(amount AS DOUBLE) AS amount, confidence,
  CAST(ambiguity_score AS DOUBLE) AS ambiguity_score, notes, is_credit, is_tax, is_fee FROM items"""


def _items(docs, text):
    return invoice.invoice_items(invoice.parse_invoices(docs, text), ["document_id"]).select(
        "document_id", "line_number", F.md5("description").alias("description_hash"),
        as_double("amount").alias("amount"), "confidence", "ambiguity_score",
        F.array_join("notes", "|").alias("notes"), "is_credit", "is_tax", "is_fee",
    )


@query(
    "C24 C25 C26 C27 C28",
    f"WITH {item_ctes('v_invoices', 'document_id', 'extracted_text')} {ITEM_REPORT}",
)
def invoice_line_items(t):
    return _items(t.spread("invoices"), "extracted_text")


@query(
    "C24 C25 C26 C27 C28",
    f"WITH {item_ctes('documents', 'doc_id', 'text')} {ITEM_REPORT}",
)
def prose_line_items(t):
    return _items(spread(t.raw("documents")).withColumnRenamed("doc_id", "document_id"), "text")


STATED = f"""tl AS (SELECT document_id, i, {strip_sql("line")} AS t FROM (SELECT document_id, i, list_extract(string_split(extracted_text, chr(10)), i) AS line
  FROM (SELECT *, unnest(generate_series(1, len(string_split(extracted_text, chr(10))))) AS i FROM v_invoices)) WHERE {sql_any("lower(line)", fv.TOTAL_KEYWORDS)}),
{amount_ctes("tl", "t_")}, stated AS (SELECT document_id, max_by(abs(amount), i) AS stated_total FROM t_amt WHERE confidence > 0.7 GROUP BY 1)"""


FALLBACK = f"""{layout_ctes("v_invoices", "document_id", "extracted_text")}, fallback AS (SELECT l.document_id FROM layout l WHERE NOT detected_table AND NOT EXISTS (SELECT 1 FROM sized s
  WHERE s.document_id = l.document_id AND length(s.line) >= 5 AND regexp_matches(s.line, '\\$?\\s*[\\d,]+\\.?\\d*') AND length(regexp_replace(s.line, '[^\\p{{L}}]', '', 'g')) > 3)
  UNION ALL SELECT document_id FROM layout WHERE detected_table AND coalesce(footer_row, n) <= coalesce(header_row + 1, 0))"""


def _nz(expr: str) -> str:
    return f"CASE WHEN {expr} = '' THEN NULL ELSE {expr} END"


_DAY = r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"


@query(
    "C29",
    f"""WITH {STATED}, {FALLBACK} SELECT v.document_id, round(s.stated_total, 2) AS stated_total,
  {_nz("regexp_extract(extracted_text, '(?i)invoice\\s*#?\\s*:?\\s*([A-Z0-9\\-]+)', 1)")} AS invoice_number,
  {_nz(f"regexp_extract(extracted_text, '(?i)date\\s*:?\\s*{_DAY}', 1)")} AS invoice_date,
  coalesce({_nz(f"regexp_extract(extracted_text, '(?i)due\\s+date\\s*:?\\s*{_DAY}', 1)")}, {_nz(f"regexp_extract(extracted_text, '(?i)payment\\s+due\\s*:?\\s*{_DAY}', 1)")}) AS due_date
FROM v_invoices v LEFT JOIN stated s ON s.document_id = v.document_id AND v.document_id NOT IN (SELECT document_id FROM fallback)""",
)
def invoice_totals_and_metadata(t):
    return invoice.parse_invoices(t.spread("invoices")).select(
        "document_id", F.round(as_double("stated_total"), 2).alias("stated_total"),
        "invoice_number", "invoice_date", "due_date",
    )


RECON = f"""{item_ctes('v_invoices', 'document_id', 'extracted_text')}, {STATED},
unread AS (SELECT document_id FROM v_invoices WHERE document_id NOT IN (SELECT document_id FROM raw)),
calc0 AS (SELECT document_id, CAST(sum(CAST(amount AS DECIMAL(18,4)) * greatest(CAST(is_credit AS INT) + CAST(is_tax AS INT) + CAST(is_fee AS INT), 1)) AS DECIMAL(28,2)) AS calculated_total,
  coalesce(CAST(sum(CAST(amount AS DECIMAL(18,4))) FILTER (WHERE is_credit) AS DECIMAL(28,2)), 0) AS credit_total, coalesce(CAST(sum(CAST(amount AS DECIMAL(18,4))) FILTER (WHERE is_tax) AS DECIMAL(28,2)), 0) AS tax_total,
  coalesce(CAST(sum(CAST(amount AS DECIMAL(18,4))) FILTER (WHERE is_fee) AS DECIMAL(28,2)), 0) AS fee_total, count(*) AS items_parsed,
  count(*) FILTER (WHERE ambiguity_score >= 70) AS items_ambiguous, avg(ambiguity_score) AS avg_ambiguity, bool_or(amount < 0) AS neg,
  CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DECIMAL(28,2)) AS plain FROM items GROUP BY 1),
calc AS (SELECT v.document_id, u.document_id IS NOT NULL AS fallback, coalesce(calculated_total, 0) AS calculated_total, coalesce(credit_total, 0) AS credit_total, coalesce(tax_total, 0) AS tax_total,
  coalesce(fee_total, 0) AS fee_total, coalesce(items_parsed, 0) AS items_parsed, coalesce(items_ambiguous, 0) AS items_ambiguous, CASE WHEN u.document_id IS NOT NULL THEN 90.0 ELSE avg_ambiguity END AS avg_ambiguity,
  coalesce(neg, FALSE) AS neg, coalesce(plain, 0) AS plain FROM v_invoices v LEFT JOIN calc0 USING (document_id) LEFT JOIN unread u USING (document_id)),
dup AS (SELECT document_id, count(*) AS duplicate_items FROM (SELECT *, first_value(amount) OVER w AS fa, row_number() OVER w AS rn FROM items
  WINDOW w AS (PARTITION BY document_id, lower(description) ORDER BY line_number)) WHERE rn > 1 AND abs(fa - amount) <= 0.01 GROUP BY 1),
sus AS (SELECT document_id, count(*) AS suspicious_items, string_agg(CASE WHEN amount > 10000 THEN 'Item exceeds $10,000: ' || description WHEN length(description) < 3 THEN 'Item has missing or very short description' END, '|' ORDER BY line_number) AS item_reasons FROM items JOIN calc USING (document_id) WHERE amount > 0 AND
  (amount / CASE WHEN plain > 0 THEN CAST(plain AS DOUBLE) ELSE 1.0 END * 100 > 50 OR amount > 10000 OR length(description) < 3) GROUP BY 1),
rc AS (SELECT c.*, s.stated_total, coalesce(abs(c.calculated_total - CAST(s.stated_total AS DECIMAL(28,2))), 0) AS difference FROM calc c LEFT JOIN stated s ON s.document_id = c.document_id AND NOT c.fallback),
rd AS (SELECT *, NOT fallback AND (stated_total IS NULL OR difference <= 1) AS reconciled FROM rc)"""


def _reconciled(t):
    return invoice.reconcile(invoice.parse_invoices(t.spread("invoices")))


@query(
    "A23 A24",
    f"""WITH {RECON} SELECT document_id, CAST(calculated_total AS DOUBLE) AS calculated_total, round(stated_total, 2) AS stated_total, CAST(difference AS DOUBLE) AS difference,
  CAST(credit_total AS DOUBLE) AS credit_total, CAST(tax_total AS DOUBLE) AS tax_total, CAST(fee_total AS DOUBLE) AS fee_total, reconciled, neg AS negative_amounts_found,
  NOT reconciled AND coalesce(calculated_total < stated_total, FALSE) AS missing_items_detected,
  CASE WHEN NOT reconciled THEN CASE WHEN difference > coalesce(nullif(stated_total, 0), calculated_total) * 0.05 THEN 'critical' ELSE 'warning' END END AS severity,
  concat_ws('|', CASE WHEN items_parsed = 0 AND stated_total > 0 THEN 'No line items found but stated total is non-zero' END,
    CASE WHEN NOT reconciled AND calculated_total < stated_total THEN 'Possible missing line items detected' END,
    CASE WHEN difference > 10 THEN 'Large reconciliation difference: $' || CAST(difference AS VARCHAR) END) AS reconciliation_errors FROM rd""",
)
def invoice_reconciliation(t):
    names = ("calculated_total", "difference", "credit_total", "tax_total", "fee_total")
    return _reconciled(t).select(
        "document_id", *[as_double(c).alias(c) for c in names],
        F.round(as_double("stated_total"), 2).alias("stated_total"), "reconciled",
        "negative_amounts_found", "missing_items_detected", "severity",
        F.array_join("reconciliation_errors", "|").alias("reconciliation_errors"),
    )


@query(
    "A25",
    f"""WITH {RECON} SELECT document_id, items_parsed, items_ambiguous, round(avg_ambiguity, 6) AS avg_ambiguity, CASE WHEN fallback THEN 20.0 ELSE round(greatest(0, 100 - avg_ambiguity), 6) END AS overall_confidence,
  coalesce(duplicate_items, 0) AS duplicate_items, coalesce(suspicious_items, 0) AS suspicious_items, NOT reconciled OR avg_ambiguity > 60 AS requires_manual_review,
  CASE WHEN fallback THEN 'Fallback parsing used' ELSE concat_ws('|', CASE WHEN duplicate_items > 0 THEN 'Found ' || duplicate_items || ' potential duplicate items' END, CASE WHEN suspicious_items > 0 THEN 'Found ' || suspicious_items || ' suspicious items' END,
    CASE WHEN NOT reconciled THEN 'Reconciliation failed' END) END AS flags,
  CASE WHEN fallback THEN 'Primary parsing failed' ELSE concat_ws('|', CASE WHEN duplicate_items > 0 THEN 'Duplicate line items detected' END, item_reasons, CASE WHEN NOT reconciled THEN 'Total mismatch: $' || CAST(difference AS VARCHAR) END,
    CASE WHEN avg_ambiguity > 60 THEN 'High average ambiguity score' END) END AS manual_review_reasons
FROM rd LEFT JOIN dup USING (document_id) LEFT JOIN sus USING (document_id)""",
)
def parse_quality(t):
    quality = invoice.parse_quality(_reconciled(t))
    return quality.select(
        "document_id",
        *[F.col(c).cast("bigint").alias(c) for c in ("items_parsed", "items_ambiguous", "duplicate_items", "suspicious_items")],
        F.round("avg_ambiguity", 6).alias("avg_ambiguity"),
        F.round("overall_confidence", 6).alias("overall_confidence"), "requires_manual_review",
        F.array_join("flags", "|").alias("flags"),
        F.array_join("manual_review_reasons", "|").alias("manual_review_reasons"),
    )


@query(
    "C29",
    f"WITH {FALLBACK} SELECT count(*) AS documents FROM fallback",
)
def fallback_parsed_documents(t):
    parsed = invoice.parse_invoices(t.spread("invoices"))
    return parsed.agg(F.count_if("fallback_used").alias("documents"))


@query(
    "W5",
    """SELECT claim_id, line_number, part_id, lower(trim(description)) AS name, CAST(amount AS DOUBLE) AS amount FROM (SELECT *,
  first_value(amount) OVER w AS fa, row_number() OVER w AS rn FROM (SELECT * REPLACE (CAST(quantity AS DECIMAL(12,2)) AS amount) FROM v_items)
  WINDOW w AS (PARTITION BY claim_id, lower(trim(description)) ORDER BY line_number, part_id, supp_id, ship_date, price, qty, discount, tax))
WHERE rn > 1 AND abs(fa - amount) <= 0.01""",
)
def duplicate_line_items(t):
    items = t.items.withColumn("amount", F.col("quantity").cast("decimal(12,2)"))
    order = ["line_number", "part_id", "supp_id", "ship_date", "price", "qty", "discount", "tax"]
    return invoice.duplicate_items(items, ["claim_id"], order).select(
        "claim_id", "line_number", "part_id", F.lower(F.trim("description")).alias("name"),
        as_double("amount").alias("amount"),
    )


@query(
    "W6",
    """SELECT claim_id, reason, count(*) AS items, CAST(sum(amount) AS DOUBLE) AS amount FROM (SELECT i.claim_id, i.amount, CASE WHEN CAST(i.amount AS DOUBLE) / CASE WHEN s > 0 THEN s ELSE 1.0 END * 100 > 50 THEN 'over_half'
  WHEN i.amount > 10000 THEN 'over_10000' WHEN length(trim(description)) < 3 THEN 'short_description' END AS reason
FROM v_items i JOIN (SELECT claim_id, CAST(sum(amount) AS DOUBLE) AS s FROM v_items GROUP BY 1) t USING (claim_id) WHERE i.amount > 0) WHERE reason IS NOT NULL GROUP BY ALL""",
)
def suspicious_line_items(t):
    return (
        invoice.suspicious_items(t.items, "claim_id")
        .groupBy("claim_id", "reason")
        .agg(F.count(F.lit(1)).alias("items"), as_double(F.sum("amount")).alias("amount"))
    )
