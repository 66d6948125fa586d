"""Stored forms: partitioned claims and audit rows read back pruned, CSV files loaded with rejects, text indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimgrid.catalog import query
from claimgrid.catalog.documents import search_ctes
from claimgrid.catalog.relational import _UNKNOWN, AUDIT_FIELDS, AUDIT_SQL, decision_versions
from claimgrid.functions.text import as_double
from claimgrid.operators import relational as rel
from claimgrid.session import checkpoint_dir
from claimgrid.sources import tables
from claimgrid.sources.text_index import TextIndex


def _scratch(t) -> str:
    return f"{checkpoint_dir(t.spark)}/store-{uuid.uuid4().hex}"


@query(
    "S7 F13",
    """SELECT CASE WHEN year(created_at) = 1997 THEN 'archived' ELSE status END AS status, CAST(year(created_at) AS INT) AS created_year,
  count(*) AS claims, CAST(sum(claim_amount) AS DOUBLE) AS amount FROM v_claims
WHERE created_at >= TIMESTAMP '1996-07-01' AND created_at < TIMESTAMP '1998-02-01' GROUP BY ALL""",
)
def claims_stored_by_year(t):
    """All claims by year, one year written anew, a period read back from its years alone."""
    root, claims = _scratch(t), t.claims
    tables.write_claims(claims, root)
    year = claims.filter(F.year("created_at") == 1997)
    tables.write_claims(year.withColumn("status", F.lit("archived")), root)
    period = tables.read_claims(t.spark, root, "1996-07-01", "1998-02-01", claims.schema)
    return period.groupBy("status", "created_year").agg(
        F.count(F.lit(1)).alias("claims"), as_double(F.sum("claim_amount")).alias("amount")
    )


@query(
    "S7 F13",
    f"""WITH {AUDIT_SQL} SELECT strftime(created_at, '%Y-%m') AS created_month, action, user_id, count(*) AS events FROM audit
WHERE strftime(created_at, '%Y-%m') BETWEEN '1996-11' AND '1997-03' GROUP BY ALL""",
)
def audit_stored_by_month(t):
    """Audit rows of decision versions appended by month, five months read back."""
    root = _scratch(t)
    events = rel.audit_events(decision_versions(t), AUDIT_FIELDS)
    tables.write_audit(events, root)
    months = tables.read_audit(t.spark, root, "1996-11", "1997-03", events.schema)
    return months.groupBy("created_month", "action", "user_id").agg(F.count(F.lit(1)).alias("events"))


def _claims_file(t) -> str:
    """A wide claims export of all orders: quotes, commas and line feeds inside cells, blanks, bad dates."""
    path = f"{_scratch(t)}/claims.csv"
    key = F.col("claim_id")
    t.cells.select(
        F.when(key % 17 != 0, key.cast("string")).alias("Tracking Number"),
        F.col("date_text").alias("Claim Date"),
        F.col("money_text").alias("Amount of Claim"),
        F.col("status_text").alias("Status"),
        F.col("address").alias("Lease Street Address"),
        F.col("city").alias("Lease City"),
        F.col("state").alias("Lease State"),
        F.col("zip_code").alias("Lease Zip"),
        F.when(key % 3 == 0, F.concat(F.lit('said "fine",\nthen left '), key.cast("string"))).alias("PM Explanation"),
        F.when(key % 3 == 1, "on hold").alias("Hold Reason"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return path


@query(
    "S1",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS claim_tracking_number, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS claim_date,
  CASE WHEN o_orderkey % 6 < 2 THEN 0.0 WHEN o_orderkey % 6 = 2 THEN CAST(-o_custkey AS DOUBLE) ELSE o_custkey * 1000 + 0.5 END AS claim_amount,
  CASE o_orderkey % 7 WHEN 0 THEN '{_UNKNOWN}' WHEN 1 THEN '12_Main_St_' || o_custkey || '-WA-98101' ELSE '12_Main_St_' || o_custkey || '-Oak Town-WA-98101' END AS property_id,
  CASE WHEN o_orderstatus = 'O' THEN 'deny' ELSE 'approve' END AS actual_status,
  CASE o_orderkey % 3 WHEN 0 THEN 'said "fine",' || chr(10) || 'then left ' || o_orderkey WHEN 1 THEN 'on hold'
    ELSE 'Status: ' || CASE o_orderstatus WHEN 'F' THEN 'Posted' WHEN 'O' THEN 'Declined' ELSE 'pre-APPROVED' END END AS adjudication_notes
FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 5 < 3""",
)
def claims_loaded_from_csv(t):
    claims, validation, _ = tables.load_claims_csv(t.spark, _claims_file(t))
    return claims.join(validation, "claim_tracking_number").select(
        "claim_tracking_number", F.col("claim_date").cast("string").alias("claim_date"),
        as_double("claim_amount").alias("claim_amount"), "property_id", "actual_status", "adjudication_notes",
    )


@query(
    "S1",
    """SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'Missing Tracking Number' ELSE 'Missing or invalid Claim Date' END AS reject_reason, count(*) AS lines
FROM orders WHERE o_orderkey % 17 = 0 OR o_orderkey % 5 >= 3 GROUP BY 1""",
)
def claims_csv_rejects(t):
    _, _, rejects = tables.load_claims_csv(t.spark, _claims_file(t))
    return rejects.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("lines"))


_OUTCOMES = """outcomes AS (SELECT claim_id, CASE WHEN claim_id % 7 = 0 THEN 'T' || claim_id WHEN claim_id % 29 = 1 THEN '' ELSE claim_tracking_number END AS tracking,
  CASE claim_id % 4 WHEN 0 THEN 'Approve' WHEN 1 THEN 'DENY' WHEN 2 THEN 'approve' ELSE CASE WHEN claim_id % 5 = 0 THEN 'maybe' ELSE 'deny' END END AS status,
  CASE claim_id % 11 WHEN 0 THEN 'abc' WHEN 1 THEN '-5' ELSE CAST(claim_id AS VARCHAR) || '.25' END AS paid,
  CASE claim_id % 13 WHEN 0 THEN '02/03/1998' WHEN 1 THEN '1998-2-3' ELSE '1999-12-31' END AS day FROM v_claims),
judged AS (SELECT *, CASE WHEN tracking = '' THEN 'Missing required field ''claim_tracking_number''' WHEN lower(status) = 'maybe' THEN 'Invalid actual_status ''maybe''. Must be ''approve'' or ''deny'''
  WHEN paid = 'abc' THEN 'Invalid actual_paid_amount ''abc''' WHEN paid = '-5' THEN 'actual_paid_amount cannot be negative' WHEN day = '02/03/1998' THEN 'Invalid actual_decision_date format. Expected YYYY-MM-DD'
  WHEN claim_id % 7 = 0 THEN 'Claim tracking number not found: ' || tracking END AS reason FROM outcomes)"""


def _validations(t):
    path = f"{_scratch(t)}/outcomes.csv"
    key = F.col("claim_id")
    text = key.cast("string")
    t.claims.select(
        F.when(key % 7 == 0, F.concat(F.lit("T"), text)).when(key % 29 == 1, "").otherwise(F.col("claim_tracking_number")).alias("claim_tracking_number"),
        F.when(key % 4 == 0, "Approve").when(key % 4 == 1, "DENY").when(key % 4 == 2, "approve")
        .when(key % 5 == 0, "maybe").otherwise("deny").alias("actual_status"),
        F.when(key % 11 == 0, "abc").when(key % 11 == 1, "-5").otherwise(F.concat(text, F.lit(".25"))).alias("actual_paid_amount"),
        F.when(key % 13 == 0, "02/03/1998").when(key % 13 == 1, "1998-2-3").otherwise("1999-12-31").alias("actual_decision_date"),
    ).write.option("header", True).csv(path)
    return tables.load_validation_csv(t.spark, path, t.claims)


@query(
    "S2",
    f"""WITH {_OUTCOMES} SELECT claim_id, lower(status) AS actual_status, CASE WHEN lower(status) = 'deny' THEN 0.0 ELSE CAST(paid AS DOUBLE) END AS actual_paid_amount,
  CASE day WHEN '1998-2-3' THEN '1998-02-03' ELSE day END AS actual_decision_date FROM judged WHERE reason IS NULL""",
)
def validations_loaded_from_csv(t):
    accepted, _ = _validations(t)
    return accepted.select(
        "claim_id", "actual_status", as_double("actual_paid_amount").alias("actual_paid_amount"),
        F.col("actual_decision_date").cast("string").alias("actual_decision_date"),
    )


@query("S2", f"WITH {_OUTCOMES} SELECT reason AS reject_reason, count(*) AS lines FROM judged WHERE reason IS NOT NULL GROUP BY 1")
def validation_csv_rejects(t):
    _, rejects = _validations(t)
    return rejects.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "C30 T4 X4",
    f"""WITH {search_ctes("documents", "doc_id", "text", ["the", "and", "for"], "or")}
SELECT doc_id, lang, rank FROM ranked ORDER BY rank DESC, doc_id LIMIT 25""",
)
def indexed_search_any(t):
    """All texts filed once; the search reads the postings of its terms, and names of the 25 found."""
    docs = t.raw("documents")
    index = TextIndex(t.spark, _scratch(t), "doc_id", docs.schema["doc_id"].dataType)
    index.upsert(docs, "text", 0)
    best = index.search(["the", "and", "for"], "or", 25)
    return docs.select("doc_id", "lang").join(F.broadcast(best), "doc_id").select("doc_id", "lang", "rank")


#: Claim documents as they stand after a second batch: badly scanned ones withdrawn, invoices with a new last line.
_EDITED = """edited AS (SELECT * REPLACE (CASE WHEN document_type = 'invoice' THEN coalesce(extracted_text, '') || chr(10) || 'Lease agreement attached' ELSE coalesce(extracted_text, '') END AS extracted_text)
  FROM v_documents WHERE coalesce(ocr_confidence, 100) >= 45)"""


def _edited_index(t):
    docs = t.spread("documents")
    index = TextIndex(t.spark, _scratch(t), "document_id", docs.schema["document_id"].dataType)
    index.upsert(docs, "extracted_text", 0)
    text = F.concat_ws("\n", F.coalesce("extracted_text", F.lit("")), F.lit("Lease agreement attached"))
    index.upsert(docs.filter("document_type = 'invoice'").withColumn("extracted_text", text), "extracted_text", 1)
    index.remove(docs.filter("ocr_confidence < 45"), 2)
    return index


@query(
    "C30 J14 T4 X4",
    f"""WITH {_EDITED}, {search_ctes("edited", "document_id", "extracted_text", ["lease", "agreement"], "and")}
SELECT r.document_id, r.claim_id, c.claim_tracking_number, r.rank FROM ranked r JOIN v_claims c USING (claim_id)
ORDER BY r.rank DESC, r.document_id LIMIT 50""",
)
def indexed_claim_search(t):
    """Search with claims through an index that had texts replaced and documents withdrawn."""
    best = F.broadcast(_edited_index(t).search(["lease", "agreement"], "and", 50))
    found = t.documents.select("document_id", "claim_id").join(best, "document_id")
    return found.join(t.claims.select("claim_id", "claim_tracking_number"), "claim_id").select(
        "document_id", "claim_id", "claim_tracking_number", "rank"
    )


@query(
    "C30 X4",
    f"""WITH {_EDITED}, words AS (SELECT document_id, unnest(list_filter(string_split_regex(lower(extracted_text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM edited)
SELECT term, count(DISTINCT document_id) AS documents, count(*) AS hits FROM words GROUP BY term""",
)
def indexed_term_counts(t):
    """Documents and hits of every term of the edited index."""
    return _edited_index(t).document_counts()
