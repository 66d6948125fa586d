"""Fixed values. They must equal the published rules for results to agree.

Nothing here is computed; every list is plain text in its natural order.
"""

# --- phrase lists for line-item flags (substring match on the lower-cased description) ---------
PHRASES: dict[str, list[str]] = {
    "is_rent": [
        "residential rent", "garage rent", "rent", "monthly rent", "future months rent",
        "future month rent",
    ],
    "is_month_to_month": ["month to month", "month-to-month", "m2m"],
    "is_cleaning": [
        "cleaning", "carpet cleaning", "carpet", "stain", "stains", "filth",
        "excessive cleaning", "deep cleaning",
    ],
    "is_repair": [
        "repair", "repairs", "drywall", "paint", "painting", "broken", "drip pan", "drip pans",
        "fixture",
    ],
    "is_damage": ["damage", "damages", "hole", "holes", "scratch", "scratches"],
    "is_improper_notice": ["improper notice", "improper", "notice charge"],
    "is_other_insurance": [
        "flea", "pet", "dog", "cat", "animal", "pest control", "pest treatment", "pet deposit",
        "pet damage", "fire", "smoke", "burn", "flame", "water damage", "flood", "leak",
        "overflow", "sewer", "drain", "sump",
    ],
    "is_contractual_fee": [
        "reletting fee", "reletting", "late charge", "late fee", "utility revenue",
        "security deposit protection", "renters insurance",
    ],
    "is_prior_balance": [
        "balance as of", "beginning balance", "initial balance", "prior balance",
        "opening balance", "balance forward", "carryover balance", "previous balance",
        "outstanding balance", "amount due", "total amount due", "past due", "amount owed",
    ],
}

# Only this flag matches short phrases (up to 4 letters) as whole words.
WORD_BOUNDARY_FLAGS = {"is_other_insurance"}
WORD_BOUNDARY_MAX_LENGTH = 4

# --- what does not count towards an invoice total (substring match) ----------------------------
INVOICE_TOTAL_EXCLUSIONS: dict[str, list[str]] = {
    "prior_balance": [
        "balance as of", "beginning balance", "initial balance", "prior balance",
        "opening balance", "balance forward", "carryover balance", "carry over balance",
        "previous balance", "balance brought forward", "balance b/f", "balance bf",
    ],
    "rent": ["rent", "monthly rent", "residential rent"],
    "fee": [
        "late charge", "late fee", "utility revenue", "security deposit protection",
        "renters insurance", "renter insurance", "reletting",
    ],
}

# --- advisory adjustment: terms that point to other insurance (plain substring) ----------------
ADVISORY_TERMS: dict[str, list[str]] = {
    "pet": [
        "flea", "pet", "dog", "cat", "animal", "pest control", "pest treatment", "pet deposit",
        "pet damage", "pet cleaning",
    ],
    "fire": ["fire", "smoke", "burn", "flame"],
    "water": ["water damage", "flood", "leak", "overflow", "sewer", "drain", "sump"],
}

# --- thresholds of a ruleset; default_rules.yaml holds the ruleset itself -----------------------
THRESHOLDS = {"low_confidence_review": 60, "high_value_review": 500, "manual_review_required": 40}

# --- decision limits -----------------------------------------------------------------------------
ENGINE_VERSION = "v2.1.0"
INVOICE_TO_CLAIM_MULTIPLIER = "1.5"
ELIGIBLE_TO_INVOICE_MULTIPLIER = "1.5"
LOW_DOCUMENT_CONFIDENCE = 50.0
LOW_OCR_CONFIDENCE = 50
FLAG_EXPLANATIONS: dict[str, str] = {
    "missing_waiver_addendum": "Required waiver addendum document not found",
    "missing_invoice": "Required invoice document not found",
    "missing_max_benefit": "Maximum benefit amount not provided",
    "no_eligible_charges": "No charges were classified as eligible",
    "credits_detected": "Credit/refund items found in invoice",
    "claim_amount_zero": "Claim amount is zero",
    "Missing lease start date": "Lease start date is missing",
}

# --- document selection keywords -----------------------------------------------------------------
PRIORITY_FILE_KEYWORDS = [
    "addendum", "move-out", "move out", "moveout", "invoice", "itemization", "final statement",
]
SECONDARY_FILE_KEYWORDS = ["statement", "charges", "deposit"]
SKIP_FILE_KEYWORDS = ["ledger", "application", "lease", "id", "license", "identification"]
MOVE_OUT_FILE_PATTERNS = [
    "move-out-statement", "move out statement", "move-out statement", "moveout statement",
    "move-out-stmt", "move out stmt",
]
INVOICE_LIKE_KEYWORDS = [
    "invoice", "statement", "ledger", "sdi", "charge", "total", "amount due", "balance",
    "move-out-statement", "move out statement", "move-out statement", "moveout statement",
    "move-out-stmt", "move out stmt", "move-out stmt",
]

# --- invoice text ----------------------------------------------------------------------------------
HEADER_KEYWORDS = [
    "description", "item", "charge", "amount", "price", "cost", "service", "fee", "line",
    "detail", "particulars",
]
FOOTER_KEYWORDS = [
    "total", "subtotal", "sum", "balance", "amount due", "due", "grand total", "invoice total",
    "final total", "payable", "previous balance", "payment", "credit", "adjustment",
]
TAX_KEYWORDS = ["tax", "gst", "vat", "sales tax", "use tax", "hst"]
FEE_KEYWORDS = [
    "fee", "processing", "service charge", "convenience", "late fee", "administrative",
]
SUBTOTAL_KEYWORDS = ["subtotal", "sub-total", "sub total"]
TOTAL_KEYWORDS = ["total", "amount due", "balance", "grand total"]

# --- amount patterns. A trailing "(?!x)" is written as "(?:[^x]|$)", the same at pattern end ------
TBD_PATTERN = r"(?i)\b(?:TBD|Pending|TBA|To\s+be\s+determined|N/A)\b"
PERCENT_PATTERN = r"(\d+(?:\.\d+)?)\s*%"
RANGE_PATTERN = r"\$?\s*([\d,]+\.?\d*)\s*[-–—]\s*\$?\s*([\d,]+\.?\d*)"
FORMULA_PATTERN = r"(\d+(?:\.\d+)?)\s*[×xX*]\s*\$?\s*([\d,]+\.?\d*)"
EURO_PATTERN = r"([\d.,]+)\s*€"
EURO_RATE = "1.10"
STANDARD_AMOUNT_PATTERNS: list[tuple[str, float, str]] = [
    (r"\$\s*([\d,]+\.\d{2})\b", 1.0, "standard_dollar"),
    (r"\(\$\s*([\d,]+\.\d{2})\)", 0.95, "negative_parentheses"),
    (r"-\s*\$?\s*([\d,]+\.\d{2})\b", 0.95, "negative_minus"),
    (r"\$\s*([\d,]+)\b(?:[^.]|$)", 0.85, "dollar_no_cents"),
    (r"([\d,]+\.\d{2})\s*(?:USD|usd|\$)", 0.9, "amount_with_currency"),
    (r"([\d,]+\.\d{2})\b(?:[^%]|$)", 0.8, "decimal_amount"),
    (r"([\d,]+)\b(?:$|[^.%]|\.(?:\D|$))", 0.7, "integer_amount"),
    (r"([\d,]+\.\d{1})\b", 0.75, "single_decimal"),
]

# --- document typing -------------------------------------------------------------------------------
LEASE_KEYWORDS = ["lease agreement", "term:", "monthly rent", "tenant", "landlord"]
INVOICE_KEYWORDS = [
    "invoice", "balance due", "total", "amount due", "itemized", "move-out-statement",
    "move out statement", "move-out statement", "moveout statement", "move-out-stmt",
    "move out stmt",
]
ADDENDUM_KEYWORDS = ["addendum", "security deposit waiver", "enrollment"]
TYPE_SEEDS: list[tuple[str, str]] = [
    ("LEASE AGREEMENT This lease agreement is entered into on TERM: 12 months MONTHLY RENT: $1500", "lease"),
    ("RESIDENTIAL LEASE TERM: January 1, 2023 to December 31, 2023 MONTHLY RENT: $2000 Security Deposit: $2000", "lease"),
    ("LEASE AGREEMENT Property Address: 123 Main St TERM: 24 months MONTHLY RENT: $1800", "lease"),
    ("INVOICE Invoice Number: INV-001 BALANCE DUE: $500.00 Itemized charges: Flooring $300, Paint $200", "invoice"),
    ("Invoice for Services Rendered Total Amount: $1,500.00 BALANCE DUE: $1,500.00", "invoice"),
    ("INVOICE #12345 Date: 2024-01-15 Itemized charges: Repair $800, Labor $200 Total: $1000.00", "invoice"),
    ("ADDENDUM TO LEASE AGREEMENT This addendum modifies the lease SECURITY DEPOSIT WAIVER: Yes", "addendum"),
    ("ADDENDUM ENROLLMENT: Confirmed This addendum is part of the lease agreement", "addendum"),
    ("Lease Addendum SECURITY DEPOSIT WAIVER granted ENROLLMENT: Active", "addendum"),
]
TYPE_CONFIDENCE_THRESHOLD = 0.75
OCR_RETRY_CONFIDENCE = 60.0
RTL_LANGUAGES = ["ar", "he", "ur", "fa", "yi"]
MIME_TYPES: dict[str, str] = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "tiff": "image/tiff", "tif": "image/tiff", "heic": "image/heic",
}
MAX_FILE_SIZE_BYTES = 50 * 1024 * 1024

# --- personal data ---------------------------------------------------------------------------------
PII_PATTERNS: list[tuple[str, str, float]] = [
    ("ssn", r"\b\d{3}-?\d{2}-?\d{4}\b", 0.95),
    ("phone", r"\b(?:\+?1[-.]?)?\(?\d{3}\)?[-.]?\d{3}[-.]?\d{4}\b", 0.90),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.95),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", 0.90),
    ("bank_account", r"\b\d{8,17}\b", 0.70),
]

# --- service targets -------------------------------------------------------------------------------
SLA_WINDOW = 1000
SLA_TARGETS_MS = {"avg": 5000, "p95": 15000, "p99": 30000, "max": 60000}
SLA_ALERT_RATE = 0.05
ERROR_BUDGET_RATE = 0.05
ERROR_BUDGET_ALERT = 0.80
ERROR_BUDGET_HOURS = 24
REUSE_TTL_DAYS = 90

# --- retention: table, days, archive table, purge ----------------------------------------------------
RETENTION_POLICY: list[tuple[str, int, str | None, bool]] = [
    ("claims", 2555, "claims_archive", False),
    ("claim_documents", 2555, "claim_documents_archive", False),
    ("decisions", 2555, "decisions_archive", False),
    ("decision_validation", 2555, "decision_validation_archive", False),
    ("decision_audit_log", 3650, "decision_audit_log_archive", False),
    ("processing_queue", 30, None, True),
    ("soft_deleted_claims", 90, None, True),
]
