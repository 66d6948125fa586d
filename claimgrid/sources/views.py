"""The claims model as views over the driver tables.

The SQL is the same text in Spark and in an ANSI engine, so a query and its check see the same
rows. ``{orders}``-style names stand for the driver tables. No view sorts or groups: each is a
projection (or union of projections) of whole tables, so any key may be as hot as it likes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimgrid.plans.barrier import spread
from claimgrid.session import tune

#: Tasks for each core where a view is dealt out: they end together, and each is short.
WAVES = 4

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

DESCRIPTIONS = [
    "Professional carpet cleaning", "Deep clean of kitchen and bath", "Carpet shampoo bedroom 2",
    "Broken window pane replacement", "Repair holes in drywall", "Scratch and dent on front door",
    "Unpaid rent - October", "Monthly rent balance", "Unpaid electric bill",
    "Outstanding water utility charges", "Pet damage to carpet", "Dog urine odor treatment",
    "Smoking damage to walls", "Nicotene stain removl", "Repaint due to damage",
    "Broken refrigerator repair", "Replace stove burner", "Carpet damage repair",
    "Tile floor stain", "Broken pipe repair", "Faucet leak under sink",
    "Normal wear and tear on walls", "Aging blinds depreciation",
    "Kitchen upgrade to granite counters", "Routine maintenance service",
    "Scheduled annual inspection", "Pre-existing damage", "Damage prior to move in",
    "Monthly electric bill", "Sewer service charge", "Lawn maintenance",
    "Yard care and hedge trim", "Late fee May", "Balance forward from ledger",
    "Improper notice charge", "Month to month premium", "Clean up water damage",
    "Damage beyond normal use", "Misc adjustment", "Broken windw pane replacment",
]

_DESCRIPTION_CASE = (
    "CASE l_partkey % 40 "
    + " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(DESCRIPTIONS))
    + " END"
)
_AMT = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 0.01 AS DECIMAL(12,2))"


def _money(factor: str) -> str:
    return f"CAST({_AMT} * {factor} AS DECIMAL(12,2))"


def _text(factor: str) -> str:
    return f"CAST({_money(factor)} AS STRING)"


def _decision(
    step: int, where: str, active: str, version: str, next_id: str, status: str, factor: str
) -> str:
    money = f"CASE WHEN {status} = 'approve' THEN {_money(factor)} ELSE CAST(0 AS DECIMAL(12,2)) END"
    return f"""
SELECT o_orderkey * 10 + {step} AS decision_id, o_orderkey AS claim_id,
  CASE WHEN o_orderstatus = 'P' THEN 'manual_override' ELSE 'automated' END AS decision_type,
  {status} AS proposed_status, {money} AS proposed_benefit_amount,
  {_money(factor)} AS eligible_total, {_AMT} AS invoice_total,
  CASE WHEN o_orderpriority = '5-LOW' THEN CAST(NULL AS DECIMAL(12,2)) ELSE {_AMT} END AS cap_amount,
  CASE WHEN {status} <> 'approve' THEN '[]'
    WHEN o_orderstatus = 'F' THEN '[{{"line_item":{{"description":"Carpet repair","amount":' || {_text("0.5")}
      || '}},"analysis":{{"reasoning":"within policy","confidence":0.9}},"is_repair":true}},'
      || '{{"line_item":{{"description":"Deep cleaning","amount":' || {_text("0.3")}
      || '}},"analysis":{{"reason":"soiled beyond use"}},"is_cleaning":true}}]'
    ELSE '[{{"description":"Door repair","amount":' || {_text("0.6")} || ',"reason":"broken hinge"}}]'
  END AS approved_line_items,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'not json'
    WHEN o_orderpriority = '3-MEDIUM' THEN CAST(NULL AS STRING)
    ELSE '[{{"description":"Monthly rent","amount":' || {_text("0.2")} || ',"reason":"rent is excluded"}}]'
  END AS ineligible_line_items,
  CASE WHEN o_orderpriority = '1-URGENT'
      THEN '{{"critical":[],"warnings":["Manual_review_needed"],"info":["rerun"]}}'
    WHEN o_orderstatus = 'P' THEN '{{"critical":["no_eligible_charges"],"warnings":[],"info":[]}}'
    ELSE '{{"critical":[],"warnings":[],"info":[]}}' END AS flags,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED'
      THEN '{{"fields":["lease_start_date"],"needs_user_input":false}}'
    ELSE '{{"fields":[],"needs_user_input":false}}' END AS missing_data,
  CAST(50 + (o_orderkey + {step}) % 50 AS DOUBLE) AS confidence_score,
  {version} AS engine_version, CAST(800 + o_orderkey % 900 AS INT) AS processing_time_ms,
  CASE WHEN o_orderstatus = 'P' THEN CAST(NULL AS STRING) ELSE 'system' END AS decided_by,
  o_orderdate + INTERVAL {step * 10} DAY AS decided_at,
  {active} AS is_active, {next_id} AS superseded_by
FROM {{orders}} WHERE {where}"""


_HIGH = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
_TOP = "(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"
_STATUS = "CASE WHEN o_orderkey % 5 = 0 THEN 'deny' ELSE 'approve' END"

VIEWS: dict[str, str] = {}

VIEWS["v_claims"] = f"""
SELECT o_orderkey AS claim_id,
  CASE WHEN o_orderstatus = 'P' THEN 'CLM-' || CAST(o_orderkey AS STRING)
    ELSE CAST(o_orderkey AS STRING) END AS claim_tracking_number,
  CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN CAST(NULL AS DECIMAL(12,2))
    WHEN o_orderkey % 37 = 0 THEN CAST(0 AS DECIMAL(12,2)) ELSE {_AMT} END AS claim_amount,
  CASE WHEN o_orderkey % 10 = 0 THEN CAST(NULL AS DECIMAL(12,2))
    WHEN o_orderkey % 31 = 0 THEN CAST(0 AS DECIMAL(12,2))
    WHEN o_orderkey % 3 = 0 THEN {_money("0.5")} ELSE {_AMT} END AS max_benefit,
  {_money("0.4")} AS security_deposit_amount,
  'POL-' || CAST(o_custkey AS STRING) AS policyholder_id,
  CAST(o_orderdate AS DATE) AS claim_date,
  CASE WHEN o_orderkey % 19 = 0 THEN CAST(NULL AS DATE)
    ELSE CAST(CAST(o_orderdate AS DATE) - INTERVAL 365 DAY AS DATE) END AS lease_start_date,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 40 DAY AS DATE) AS lease_end_date,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status,
  CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) AS priority,
  o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN o_orderdate + INTERVAL 20 DAY
    ELSE CAST(NULL AS TIMESTAMP) END AS deleted_at
FROM {{orders}}"""

VIEWS["v_items"] = f"""
SELECT l_orderkey AS claim_id, l_linenumber AS line_number, l_partkey AS part_id,
  l_suppkey AS supp_id, l_shipdate AS ship_date, l_extendedprice AS price, l_quantity AS qty,
  l_discount AS discount, l_tax AS tax,
  CASE WHEN l_discount = 0.1 AND l_tax = 0.08 THEN '' ELSE {_DESCRIPTION_CASE} END AS description,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 1
      THEN -CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.01 AS DECIMAL(12,2))
    ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.01 AS DECIMAL(12,2)) END AS amount,
  CAST(l_quantity AS INT) AS quantity, CAST(l_shipdate AS DATE) AS charge_date,
  l_tax = 0.08 AS suggested_wear, l_discount <> 0.1 AS suggested_covered,
  l_linestatus = 'O' AS has_suggestion, 1.0 - l_discount AS suggested_confidence
FROM {{lineitem}}"""

VIEWS["v_documents"] = f"""
SELECT o_orderkey * 10 + 1 AS document_id, o_orderkey AS claim_id,
  'Waiver Addendum.pdf' AS original_filename, 'a' || CAST(o_custkey AS STRING) AS file_hash,
  CAST(10000 + o_orderkey AS BIGINT) AS file_size_bytes, 'application/pdf' AS mime_type,
  'addendum' AS document_type,
  CASE WHEN o_orderkey % 9 = 0 THEN CAST(NULL AS DOUBLE)
    ELSE CAST(60 + o_orderkey % 40 AS DOUBLE) END AS classification_confidence,
  'ADDENDUM to lease agreement, security deposit waiver, enrollment active' AS extracted_text,
  CAST(40 + o_orderkey % 60 AS DOUBLE) AS ocr_confidence, CAST(2 AS INT) AS page_count,
  'completed' AS processing_status, o_orderdate + INTERVAL 1 DAY AS created_at
FROM {{orders}} WHERE o_orderpriority <> '5-LOW'
  AND NOT (o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P')
UNION ALL
SELECT o_orderkey * 10 + 2, o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN 'Invoice ' || CAST(o_orderkey AS STRING) || '.pdf'
    WHEN 'O' THEN 'Move-Out-Statement.pdf' ELSE 'deposit disposition.pdf' END,
  'b' || CAST(o_orderkey AS STRING), CAST(20000 + o_orderkey AS BIGINT), 'application/pdf',
  'invoice', CAST(35 + o_orderkey % 60 AS DOUBLE),
  'INVOICE for services. Carpet repair and damage charges. Balance due $' || {_text("1.0")},
  CAST(30 + o_orderkey % 65 AS DOUBLE), CAST(1 AS INT), 'completed',
  o_orderdate + INTERVAL 2 DAY
FROM {{orders}} WHERE NOT (o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus <> 'F')
  AND NOT (o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P')
UNION ALL
SELECT o_orderkey * 10 + 3, o_orderkey, 'Signed Lease Copy.pdf',
  'c' || CAST(o_orderkey AS STRING), CAST(900000 + o_orderkey AS BIGINT), 'application/pdf',
  'lease', CAST(90 AS DOUBLE),
  'LEASE AGREEMENT between landlord and tenant. TERM: 12 months MONTHLY RENT: $1500',
  CAST(NULL AS DOUBLE), CAST(12 AS INT),
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'pending' ELSE 'completed' END,
  o_orderdate + INTERVAL 3 DAY
FROM {{orders}} WHERE o_orderstatus <> 'P'
UNION ALL
SELECT o_orderkey * 10 + 4, o_orderkey, 'Tenant statement of charges.pdf',
  'd' || CAST(o_orderkey AS STRING), CAST(30000 + o_orderkey AS BIGINT),
  CASE WHEN o_orderstatus = 'F' THEN 'image/png' ELSE 'application/pdf' END,
  'unknown', CAST(20 + o_orderkey % 30 AS DOUBLE),
  CASE WHEN o_orderstatus = 'O' THEN CAST(NULL AS STRING)
    ELSE 'Statement of charges, total amount due for repair' END,
  CAST(55 AS DOUBLE), CAST(3 AS INT), 'failed', o_orderdate + INTERVAL 4 DAY
FROM {{orders}} WHERE o_orderpriority = '4-NOT SPECIFIED'"""

_NL = "|| CHR(10) ||"
VIEWS["v_invoices"] = f"""
SELECT o_orderkey AS document_id, o_orderkey AS claim_id,
  CASE WHEN o_orderkey % 43 = 0 THEN 'Description                   Charge' {_NL} 'Total amount due $' || {_text("0.8")}
  WHEN o_orderkey % 47 = 0 THEN 'scan failed'
  WHEN o_orderkey % 53 = 0 THEN 'Description                   Amount' {_NL} 'Roof and gutter works         $' || CAST(10500 + o_orderkey AS STRING) || '.00' {_NL}
    'x                             $12.00' {_NL} '- hauling' {_NL} 'Wall' {_NL} '1. paint' {_NL} 'Amount due                    $' || CAST(10512 + o_orderkey AS STRING) || '.00'
  ELSE CASE o_orderpriority
  WHEN '1-URGENT' THEN 'INVOICE #: INV-' || CAST(o_orderkey AS STRING) {_NL}
    'Date: 01/15/2024   Payment due: 02/15/2024' {_NL}
    'Description                   Amount' {_NL}
    'Carpet cleaning               $' || {_text("0.5")} {_NL}
    'Drywall repair                $' || {_text("0.3")} {_NL}
    'Paint touch up                $' || {_text("0.1")} {_NL}
    'Sales tax                     $' || {_text("0.1")} {_NL}
    'Total                         $' || {_text("1.0")}
  WHEN '2-HIGH' THEN 'Statement of account' {_NL} 'Item description              Charge' {_NL}
    'Door replacement              $' || {_text("0.7")} {_NL}
    'Credit for deposit            ($' || {_text("0.2")} || ')' {_NL}
    'Late fee                      $25.00' {_NL}
    'Door replacement              $' || {_text("0.7")} {_NL}
    'Balance due                   $' || {_text("1.2")}
  WHEN '3-MEDIUM' THEN 'Work order ' || CAST(o_orderkey AS STRING) {_NL}
    'Labor 3 x $45.50' {_NL} 'Cleaning estimate $100 - $200' {_NL}
    'Imported tile 120,50 €' {_NL} 'Blinds repair TBD' {_NL}
    'Fixtures ' || {_text("0.4")} || ' USD' {_NL} 'Subtotal: $' || {_text("0.9")}
  WHEN '4-NOT SPECIFIED' THEN 'Broken blinds in room 45' {_NL} ' ' {_NL} 'ok' {_NL}
    'Please pay soon' {_NL} 'Hauling unit 7 for $' || CAST(o_orderkey % 900 AS STRING)
  ELSE 'Description of work           Price' {_NL}
    'Removal of large items' {_NL} 'left in the garage and shed' {_NL}
    'by the tenant                 $' || {_text("0.6")} {_NL}
    'Trash bags                    $' || {_text("0.1")} {_NL}
    'Total                         $' || {_text("0.7")} END END AS extracted_text
FROM {{orders}}"""

VIEWS["v_decisions"] = " UNION ALL ".join(
    [
        _decision(1, "TRUE", f"NOT ({_HIGH})", "'v2.0.0'",
                  f"CASE WHEN {_HIGH} THEN o_orderkey * 10 + 2 ELSE CAST(NULL AS BIGINT) END",
                  _STATUS, "0.8"),
        _decision(2, _HIGH, f"NOT {_TOP}", "'v2.1.0'",
                  f"CASE WHEN {_TOP} THEN o_orderkey * 10 + 3 ELSE CAST(NULL AS BIGINT) END",
                  "CASE WHEN o_orderkey % 7 = 0 THEN 'deny' ELSE 'approve' END", "0.9"),
        _decision(3, _TOP, "TRUE", "'v2.2.0'", "CAST(NULL AS BIGINT)", _STATUS, "0.7"),
    ]
)

_PAID = f"""CASE WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DECIMAL(12,2))
    WHEN o_orderkey % 3 = 0 THEN {_money("0.72")} WHEN o_orderkey % 3 = 1 THEN {_money("0.8")}
    ELSE {_money("0.88")} END"""
VIEWS["v_validation"] = f"""
SELECT o_orderkey * 10 + 1 AS validation_id, o_orderkey AS claim_id,
  CASE WHEN {_TOP} THEN o_orderkey * 10 + 3 WHEN {_HIGH} THEN o_orderkey * 10 + 2
    ELSE o_orderkey * 10 + 1 END AS decision_id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'deny' ELSE 'approve' END AS actual_status,
  {_PAID} AS actual_paid_amount,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS actual_decision_date
FROM {{orders}} WHERE o_orderstatus <> 'P'
UNION ALL
SELECT o_orderkey * 10 + 2, o_orderkey, o_orderkey * 10 + 2, 'approve', {_money("0.95")},
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 45 DAY AS DATE)
FROM {{orders}} WHERE o_orderpriority = '2-HIGH'"""

VIEWS["v_analysis"] = """
SELECT o_orderkey AS claim_id, o_orderpriority IN ('1-URGENT', '3-MEDIUM') AS is_normal_wear_tear,
  o_orderstatus <> 'P' AS has_eligible_charges, o_orderstatus = 'F' AS charges_covered_by_addendum,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'Tenant gave improper notice' ELSE '' END AS denial_reason,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Explanation of Protections not found'
    WHEN o_orderpriority = '2-HIGH' THEN 'Itemised receipts' ELSE '' END AS missing_information
FROM {orders}"""

_ENTRY = (
    '{"line_item_number": 1, "should_be_included": true, "is_normal_wear_tear": false, '
    '"is_covered_by_addendum": "yes", "is_covered_by_other_insurance": "0", '
    '"confidence": 0.8, "reasoning": "ok", "addendum_reference": "s1"}'
)
_WHOLE = '{"line_item_analyses": [' + _ENTRY + "]}"
_BAD = _WHOLE.replace('"confidence": 0.8', '"confidence": 1.8').replace('"yes"', '"maybe"')
VIEWS["v_responses"] = f"""
SELECT o_orderkey AS claim_id, CAST(1 AS INT) AS expected_count, o_orderpriority AS shape,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Here you go:' || CHR(10) || '```json' || CHR(10) || '{_WHOLE}' || CHR(10) || '```'
    WHEN '2-HIGH' THEN replace('{_WHOLE}', '"', CHR(39))
    WHEN '3-MEDIUM' THEN '{_BAD}' WHEN '4-NOT SPECIFIED' THEN '```' || CHR(10) || '{_WHOLE.replace("line_item_analyses", "items")}'
    ELSE 'Sorry, no result for ' || CAST(o_orderkey AS STRING) END AS response_text
FROM {{orders}}"""

_PART = "CAST(EXTRACT({} FROM o_orderdate) AS STRING)"
_MONTH, _DAY, _YEAR = (_PART.format(x) for x in ("MONTH", "DAY", "YEAR"))
VIEWS["v_cells"] = f"""
SELECT o_orderkey AS claim_id,
  CASE o_orderkey % 5 WHEN 0 THEN ' ' || {_MONTH} || '/' || {_DAY} || '/' || {_YEAR}
    WHEN 1 THEN {_YEAR} || '-' || {_MONTH} || '-' || {_DAY}
    WHEN 2 THEN {_MONTH} || '/' || {_DAY} || '/' || SUBSTR({_YEAR}, 3, 2)
    WHEN 3 THEN 'n/a' END AS date_text,
  CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'call us' WHEN 2 THEN '-' || CAST(o_custkey AS STRING)
    ELSE ' $' || CAST(o_custkey AS STRING) || ',000.50 ' END AS money_text,
  CASE o_orderstatus WHEN 'F' THEN ' Posted ' WHEN 'O' THEN 'Declined' ELSE 'pre-APPROVED' END AS status_text,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '12 Main St, #' || CAST(o_custkey AS STRING) END AS address,
  CASE WHEN o_orderkey % 7 IN (0, 1) THEN '' ELSE 'Oak Town' END AS city,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'WA' END AS state,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '98101-1234' END AS zip_code
FROM {{orders}}"""

VIEWS["v_queue"] = """
SELECT event_id AS queue_id, 'batch-' || CAST(user_id % 25 AS STRING) AS batch_id,
  event_id AS claim_id, CAST(user_id % 5 AS INT) AS priority,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing'
    WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
  ts AS scheduled_at,
  CASE WHEN event_type = 'signup' THEN CAST(NULL AS TIMESTAMP) ELSE ts + INTERVAL 5 SECOND END AS started_at,
  CASE WHEN event_type IN ('signup', 'view') THEN CAST(NULL AS TIMESTAMP)
    WHEN value > 50 THEN ts + INTERVAL 95 SECOND ELSE ts + INTERVAL 35 SECOND END AS completed_at,
  CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN 'stored message' END AS error_message
FROM {events}"""

VIEWS["v_metrics"] = """
SELECT event_id AS metric_id, ts,
  CASE event_type WHEN 'signup' THEN 'lease' WHEN 'view' THEN 'invoice' WHEN 'error' THEN 'unknown'
    ELSE 'addendum' END AS document_type,
  CAST(FLOOR(value * 400) AS BIGINT) AS processing_time_ms,
  CASE WHEN value > 100 THEN 100.0 - value / 10 ELSE 100.0 - value END AS confidence,
  CASE event_type WHEN 'signup' THEN 'tier2_tesseract' WHEN 'error' THEN 'tier3_mistral'
    WHEN 'view' THEN 'tier1_pypdf2' ELSE 'tier1_pdfplumber' END AS tier
FROM {events}"""

VIEWS["v_attempts"] = """
SELECT CAST(FLOOR(event_id / 3) AS BIGINT) AS document_id, CAST(event_id % 3 + 1 AS INT) AS attempt_no,
  CASE event_id % 3 WHEN 0 THEN 'tier1_pypdf2' WHEN 1 THEN 'tier2_tesseract'
    ELSE 'tier3_mistral' END AS tier,
  CASE WHEN value > 90 THEN 90.0 ELSE value END AS confidence,
  CASE WHEN event_id % 3 = 2 THEN 0.0002 ELSE 0.0 END AS cost,
  CAST(user_id % 4 + 1 AS INT) AS page_count, user_id % 6 <> 0 AS is_native_pdf,
  event_type = 'error' AS force_high_quality
FROM {events}"""

VIEWS["v_overrides"] = """
SELECT event_id AS override_id, event_id * 10 + 1 AS decision_id, event_id AS claim_id,
  CAST(user_id % 3 AS INT) AS line_item_index, 'Door repair' AS line_item_description,
  event_type IN ('click', 'signup') AS system_should_be_included,
  event_type IN ('purchase', 'signup', 'view') AS user_should_be_included,
  user_id % 2 = 0 AS is_rent, user_id % 3 = 0 AS is_cleaning, user_id % 5 = 0 AS is_repair,
  user_id % 7 = 0 AS is_damage,
  CASE WHEN value > 20 THEN 'checked photos' ELSE '' END AS user_reasoning,
  ts AS override_timestamp, user_id % 4 = 0 AS is_applied_to_rules
FROM {events}"""

VIEWS["v_arrivals"] = """
SELECT event_id AS arrival_id, 'h' || CAST(user_id AS STRING) AS file_hash, user_id, ts
FROM {events}"""


def bind(sql: str, names: dict[str, str]) -> str:
    """Fill ``{table}`` placeholders."""
    for name, target in names.items():
        sql = sql.replace("{" + name + "}", target)
    return sql


def oracle(sql: str) -> str:
    """A stand-alone SQL text: the views it names become common table expressions."""
    used: list[str] = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql.strip()
    plain = {table: table for table in TABLES}
    ctes = ",\n".join(f"{name} AS ({bind(VIEWS[name], plain)})" for name in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Driver tables and claims-model views of one folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder
        self._suffix = f"_{zlib.crc32(folder.encode()):08x}"

    def raw(self, name: str) -> DataFrame:
        """A driver table; ``documents`` is also the name of a view, so raw text is asked for here."""
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A view for CPU-bound work on its rows: the tables' rows are dealt out to all cores before
        the view's columns, which may be many times wider, are worked out."""
        return self._view("v_" + name, "cg_spread_", lambda df: spread(df, WAVES))

    def _view(self, view: str, prefix: str, dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
        sql = VIEWS[view]
        names = {}
        for table in TABLES:
            if "{" + table + "}" in sql:
                names[table] = prefix + table + self._suffix
                dealt(self.raw(table)).createOrReplaceTempView(names[table])
        return self.spark.sql(bind(sql, names))

    def __getattr__(self, name: str) -> DataFrame:
        if "v_" + name not in VIEWS:
            return self.raw(name)
        return self._view("v_" + name, "cg_", lambda df: df)
