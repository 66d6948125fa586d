"""Line-item rules and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrid.catalog import query
from claimgrid.functions.text import as_double
from claimgrid.operators import classify
from claimgrid.rules import fixed_values as fv
from claimgrid.rules.ruleset import default_ruleset, ruleset_df

RULES = default_ruleset()


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(column: str, phrases, boundary: bool = False) -> str:
    parts = []
    for phrase in phrases:
        if boundary and len(phrase) <= fv.WORD_BOUNDARY_MAX_LENGTH:
            parts.append(f"regexp_matches({column}, '\\b{phrase}\\b')")
        else:
            parts.append(f"contains({column}, {quote(phrase)})")
    return "(" + " OR ".join(parts) + ")"


FLAG_SQL = ",\n".join(
    f"{sql_any('lower(description)', phrases, flag in fv.WORD_BOUNDARY_FLAGS)} AS {flag}"
    for flag, phrases in fv.PHRASES.items()
)
INCLUDE_SQL = (
    "CASE WHEN amount > 100000 OR amount < 0 THEN FALSE WHEN "
    + " OR ".join(classify.DENY_FLAGS)
    + " OR wear THEN FALSE ELSE TRUE END"
)
# items with flags and inclusion, reused by several checks
RULED_CTE = f"""ruled0 AS (
SELECT *, suggested_wear AND has_suggestion AS wear,
  CASE WHEN has_suggestion THEN suggested_covered ELSE TRUE END AS covered,
{FLAG_SQL} FROM v_items),
ruled AS (SELECT *, {INCLUDE_SQL} AS should_be_included FROM ruled0)"""
NORM_SQL = "trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g'))"


def with_suggestions(items):
    """Items with their advisory columns; rows without a suggestion take the defaults."""
    return items.withColumns(
        {
            "is_normal_wear_tear": F.when(F.col("has_suggestion"), F.col("suggested_wear")),
            "is_covered_by_addendum": F.when(F.col("has_suggestion"), F.col("suggested_covered")),
        }
    )


@query(
    "C2 C3 K11",
    f"""WITH {RULED_CTE}
SELECT description, {", ".join(fv.PHRASES)}, count(*) AS items,
  CAST(sum(amount) AS DOUBLE) AS amount FROM ruled GROUP BY ALL""",
)
def phrase_flag_counts(t):
    flagged = classify.flag_items(t.items)
    return flagged.groupBy("description", *fv.PHRASES).agg(
        F.count(F.lit(1)).alias("items"), as_double(F.sum("amount")).alias("amount")
    )


@query(
    "K10 K11 J11",
    f"""WITH {RULED_CTE}
SELECT description, wear AS is_normal_wear_tear, covered AS is_covered_by_addendum,
  should_be_included, count(*) AS items, CAST(sum(amount) AS DOUBLE) AS amount
FROM ruled GROUP BY ALL""",
)
def deterministic_inclusion(t):
    ruled = classify.apply_rules(with_suggestions(t.items))
    return ruled.groupBy(
        "description", "is_normal_wear_tear", "is_covered_by_addendum", "should_be_included"
    ).agg(F.count(F.lit(1)).alias("items"), as_double(F.sum("amount")).alias("amount"))


@query(
    "C4",
    """SELECT i.claim_id, count(*) AS items,
  count(*) FILTER (WHERE i.charge_date > c.lease_end_date) AS after_lease_end
FROM v_items i JOIN v_claims c ON c.claim_id = i.claim_id GROUP BY i.claim_id""",
)
def charges_after_lease_end(t):
    joined = t.items.select("claim_id", "description", "charge_date").join(
        t.claims.select("claim_id", "lease_end_date"), "claim_id"
    )
    flagged = classify.flag_items(joined)
    return flagged.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("is_after_lease_end")).alias("after_lease_end"),
    )


@query(
    "K13",
    f"""WITH a AS (SELECT description, suggested_covered AS wanted,
  contains(lower(description), 'improper') AND contains(lower(description), 'notice') AS improper,
  {sql_any("lower(description)", fv.ADVISORY_TERMS["pet"])}
  OR {sql_any("lower(description)", fv.ADVISORY_TERMS["fire"])}
  OR {sql_any("lower(description)", fv.ADVISORY_TERMS["water"])}
  OR (suggested_wear) AS elsewhere FROM v_items)
SELECT description, elsewhere AS is_covered_by_other_insurance,
  wanted AND NOT improper AND NOT elsewhere AS should_be_included, count(*) AS items
FROM a GROUP BY ALL""",
)
def advisory_adjustment(t):
    rows = t.items.select(
        "description",
        F.col("suggested_covered").alias("should_be_included"),
        F.col("suggested_wear").alias("is_covered_by_other_insurance"),
    )
    return (
        classify.adjust_suggestions(rows)
        .groupBy("description", "is_covered_by_other_insurance", "should_be_included")
        .agg(F.count(F.lit(1)).alias("items"))
    )


@query("C1", f"SELECT {NORM_SQL} AS normalized, count(*) AS items FROM v_items GROUP BY ALL")
def normalized_descriptions(t):
    from claimgrid.functions.text import normalize_description

    return t.items.groupBy(normalize_description(F.col("description")).alias("normalized")).agg(
        F.count(F.lit(1)).alias("items")
    )


# ----- the classifier's SQL twin ------------------------------------------------------------------


def _values(rows) -> str:
    def cell(value):
        return quote(value) if isinstance(value, str) else repr(value)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def classifier_ctes(rules, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}final``: one row per distinct description text and amount."""
    p = prefix
    phrase_rows = [
        (i, phrase, cat, float(conf), len(phrase.split()))
        for i, (phrase, cat, conf) in enumerate(rules.phrases())
    ] or [(0, "\x00none", "NONE", 0.0, 99)]
    pattern_rows = [
        (i, j, c.name, float(c.confidence), pattern)
        for i, c in enumerate(rules.categories)
        for j, pattern in enumerate(c.patterns)
    ]
    positive = [
        (i, c.name, float(c.confidence), j, kw, float(len(c.positive)))
        for i, c in enumerate(rules.categories)
        for j, kw in enumerate(c.positive)
    ]
    negative = [
        (c.name, kw) for c in rules.categories for kw in c.negative
    ] or [("NONE", "\x00none")]
    status = (
        "CASE WHEN category LIKE 'ELIGIBLE%' OR category = 'DEFAULT_ELIGIBLE' THEN 'eligible' "
        "WHEN category LIKE 'INELIGIBLE%' THEN 'ineligible' ELSE 'ambiguous' END"
    )
    low = "lower(description)"
    util = (
        f"(regexp_matches({low}, '\\b(electric|water|gas|sewer|utility)\\b') "
        f"AND regexp_matches({low}, '\\b(unpaid|outstand|balanc)\\b'))"
    )

    def both(a, b):
        return f"(contains({low}, '{a}') AND contains({low}, '{b}'))"

    return f"""
{p}phrases(ord, phrase, category, conf, n) AS (VALUES {_values(phrase_rows)}),
{p}pats(cord, pord, category, conf, pat) AS (VALUES {_values(pattern_rows)}),
{p}pos(cord, category, conf, kord, kw, possible) AS (VALUES {_values(positive)}),
{p}neg(category, kw) AS (VALUES {_values(negative)}),
{p}texts AS (SELECT DISTINCT {NORM_SQL} AS norm FROM v_items),
{p}exact AS (SELECT norm, category, conf, 'Exact match: "' || phrase || '"' AS reasoning, '' AS flags
  FROM {p}texts, {p}phrases WHERE contains(norm, phrase)
  QUALIFY row_number() OVER (PARTITION BY norm ORDER BY conf DESC, ord) = 1),
{p}windows AS (SELECT norm, n, array_to_string(list_slice(string_split(norm, ' '), i, i + n - 1), ' ') AS w
  FROM (SELECT norm, n, unnest(generate_series(1, len(string_split(norm, ' ')) - n + 1)) AS i
    FROM {p}texts, (SELECT DISTINCT n FROM {p}phrases) WHERE norm NOT IN (SELECT norm FROM {p}exact))),
{p}fuzzy AS (SELECT norm, category, greatest(conf - 5, 85.0) AS conf,
    'Fuzzy match: "' || phrase || '"' AS reasoning, 'FUZZY_MATCH' AS flags
  FROM {p}windows JOIN {p}phrases USING (n) WHERE levenshtein(w, phrase) <= 3
  QUALIFY row_number() OVER (PARTITION BY norm ORDER BY greatest(conf - 5, 85.0) DESC, ord) = 1),
{p}ex AS (SELECT * FROM {p}exact UNION ALL SELECT * FROM {p}fuzzy),
{p}negative AS (SELECT DISTINCT norm, category FROM {p}texts, {p}neg WHERE contains(norm, lower(kw))),
{p}pat AS (SELECT t.norm, p.category,
    CASE WHEN n.norm IS NULL THEN least(p.conf + 5, 99.0) ELSE p.conf END AS conf,
    'Pattern match: ' || p.category AS reasoning
  FROM {p}texts t JOIN {p}pats p ON regexp_matches(t.norm, p.pat, 'i')
  LEFT JOIN {p}negative n ON n.norm = t.norm AND n.category = p.category
  QUALIFY row_number() OVER (PARTITION BY t.norm ORDER BY
    CASE WHEN n.norm IS NULL THEN least(p.conf + 5, 99.0) ELSE p.conf END DESC, cord, pord) = 1),
{p}posscore AS (SELECT norm, cord, category, conf, possible, count(*) AS np,
    string_agg(kw, ', ' ORDER BY kord) AS kws
  FROM {p}texts, {p}pos WHERE contains(norm, lower(kw)) GROUP BY ALL),
{p}negscore AS (SELECT norm, category, count(*) AS nn FROM {p}texts, {p}neg
  WHERE contains(norm, lower(kw)) GROUP BY ALL),
{p}kw AS (SELECT s.norm, s.category, np - 2 * coalesce(nn, 0) AS score,
    least(conf * ((np - 2 * coalesce(nn, 0)) / possible), 85.0) AS conf, kws,
    CASE WHEN coalesce(nn, 0) > 0 THEN 'KEYWORD_BASED' ELSE '' END AS flags
  FROM {p}posscore s LEFT JOIN {p}negscore g ON g.norm = s.norm AND g.category = s.category
  WHERE np - 2 * coalesce(nn, 0) > 0
  QUALIFY row_number() OVER (PARTITION BY s.norm ORDER BY np - 2 * coalesce(nn, 0) DESC, cord) = 1),
{p}pick AS (SELECT t.norm,
    CASE WHEN e.norm IS NOT NULL AND (p.norm IS NULL OR e.conf >= p.conf - 5) THEN 'exact'
      WHEN p.conf > 80 THEN 'pattern' WHEN e.norm IS NOT NULL THEN 'exact'
      WHEN k.conf > 40 THEN 'keyword' ELSE 'default' END AS layer,
    e.category AS ec, e.conf AS ecf, e.reasoning AS er, e.flags AS ef,
    p.category AS pc, p.conf AS pcf, p.reasoning AS pr,
    k.category AS kc, k.conf AS kcf, k.flags AS kf,
    'Keyword score: ' || k.score || ' (' || k.kws || ')' AS kr
  FROM {p}texts t LEFT JOIN {p}ex e ON e.norm = t.norm LEFT JOIN {p}pat p ON p.norm = t.norm
  LEFT JOIN {p}kw k ON k.norm = t.norm),
{p}hit AS (SELECT norm, layer,
    CASE layer WHEN 'exact' THEN ec WHEN 'pattern' THEN pc WHEN 'keyword' THEN kc ELSE 'DEFAULT_ELIGIBLE' END AS category,
    CASE layer WHEN 'exact' THEN ecf WHEN 'pattern' THEN pcf WHEN 'keyword' THEN kcf ELSE 30.0 END AS conf,
    CASE layer WHEN 'exact' THEN er WHEN 'pattern' THEN pr WHEN 'keyword' THEN kr
      ELSE 'No strong match found, defaulting per policy' END AS reasoning,
    CASE layer WHEN 'exact' THEN FALSE WHEN 'pattern' THEN pcf < 60 WHEN 'keyword' THEN kcf < 60 ELSE TRUE END AS review,
    CASE layer WHEN 'exact' THEN ef WHEN 'pattern' THEN '' WHEN 'keyword' THEN kf
      ELSE 'LOW_CONFIDENCE_DEFAULT' END AS flags FROM {p}pick),
{p}s0 AS (SELECT i.claim_id, i.description, i.amount,
    CASE WHEN i.description = '' THEN 'default' ELSE layer END AS layer,
    CASE WHEN i.description = '' THEN 'DEFAULT_AMBIGUOUS' ELSE category END AS category,
    CASE WHEN i.description = '' THEN 30.0 ELSE conf END AS conf,
    CASE WHEN i.description = '' THEN 'Empty description' ELSE reasoning END AS reasoning,
    CASE WHEN i.description = '' THEN TRUE ELSE review END AS review,
    CASE WHEN i.description = '' THEN 'EDGE_CASE' ELSE flags END AS flags
  FROM v_items i JOIN {p}hit h ON h.norm = {NORM_SQL.replace("description", "i.description")}),
{p}s1 AS (SELECT * REPLACE (
    CASE WHEN o THEN 50.0 ELSE conf END AS conf, CASE WHEN o THEN TRUE ELSE review END AS review,
    CASE WHEN o THEN reasoning || '; Description contains both cleaning and damage keywords' ELSE reasoning END AS reasoning,
    CASE WHEN o THEN flags || ',SPECIAL_RULE_AMBIGUOUS_CLEANING_DAMAGE' ELSE flags END AS flags,
    CASE WHEN o THEN 'ambiguous' ELSE status END AS status)
  FROM (SELECT *, {status} AS status, layer <> 'default' AND {both('clean', 'damage')} AS o FROM {p}s0)),
{p}s2 AS (SELECT * REPLACE (CASE WHEN o THEN TRUE ELSE review END AS review,
    CASE WHEN o THEN reasoning || '; High dollar amount with low classification confidence' ELSE reasoning END AS reasoning,
    CASE WHEN o THEN flags || ',HIGH_VALUE_UNCERTAIN,SPECIAL_RULE_HIGH_AMOUNT_UNKNOWN' ELSE flags END AS flags)
  FROM (SELECT * REPLACE (layer <> 'default' AND amount > 500 AND conf < 60 AS o) FROM {p}s1)),
{p}s3 AS (SELECT * REPLACE (CASE WHEN o THEN 'eligible' ELSE status END AS status,
    CASE WHEN o THEN 'ELIGIBLE_UTILITIES_UNPAID' ELSE category END AS category,
    CASE WHEN o THEN 80.0 ELSE conf END AS conf,
    CASE WHEN o THEN flags || ',SPECIAL_RULE_UTILITIES_UNPAID' ELSE flags END AS flags)
  FROM (SELECT * REPLACE (layer <> 'default' AND {util} AS o) FROM {p}s2)),
{p}s4 AS (SELECT * REPLACE (CASE WHEN o THEN 'ineligible' ELSE status END AS status,
    CASE WHEN o THEN 'INELIGIBLE_ROUTINE_MAINTENANCE' ELSE category END AS category,
    CASE WHEN o THEN 85.0 ELSE conf END AS conf, CASE WHEN o THEN FALSE ELSE review END AS review,
    CASE WHEN o THEN reasoning || '; Routine cleaning is not eligible' ELSE reasoning END AS reasoning,
    CASE WHEN o THEN flags || ',SPECIAL_RULE_CLEANING_ROUTINE' ELSE flags END AS flags)
  FROM (SELECT * REPLACE (layer <> 'default' AND {both('clean', 'routine')} AS o) FROM {p}s3)),
{p}s5 AS (SELECT * REPLACE (CASE WHEN o THEN 'ineligible' ELSE status END AS status,
    CASE WHEN o THEN 90.0 ELSE conf END AS conf, CASE WHEN o THEN FALSE ELSE review END AS review,
    CASE WHEN o THEN reasoning || '; Normal damage/wear is not eligible' ELSE reasoning END AS reasoning,
    CASE WHEN o THEN flags || ',SPECIAL_RULE_DAMAGE_NORMAL_WEAR' ELSE flags END AS flags)
  FROM (SELECT * REPLACE (layer <> 'default' AND {both('damage', 'normal')} AS o) FROM {p}s4)),
{p}s6 AS (SELECT * REPLACE (CASE WHEN o THEN least(conf + 10, 99.0) ELSE conf END AS conf,
    CASE WHEN o THEN flags || ',AMOUNT_THRESHOLD_MET' ELSE flags END AS flags)
  FROM (SELECT * REPLACE (layer <> 'default' AND category = 'ELIGIBLE_DAMAGE' AND amount > 50 AS o) FROM {p}s5)),
{p}final AS (SELECT claim_id, description, amount, layer, category, status, conf AS confidence, reasoning,
    CASE WHEN layer <> 'default' AND ((amount > 500 AND conf < 60) OR conf < 40) THEN TRUE ELSE review END AS review,
    ltrim(CASE WHEN layer <> 'default' AND amount > 500 AND conf < 60 AND NOT contains(flags, 'HIGH_VALUE_UNCERTAIN')
      THEN flags || ',HIGH_VALUE_UNCERTAIN' ELSE flags END, ',') AS flags FROM {p}s6)"""


CLASSIFIER = classifier_ctes(RULES)
RELAXED = classify.relaxed_ruleset(RULES)


@query(
    "K1 K2 K3 K4 K6 K7 K8 K9 X1",
    f"""WITH {CLASSIFIER}
SELECT description, layer, category, status, CAST(confidence AS DOUBLE) AS confidence, reasoning,
  review AS requires_manual_review, flags, count(*) AS items, CAST(sum(amount) AS DOUBLE) AS amount
FROM final GROUP BY ALL""",
)
def item_classification(t):
    classified = classify.classify_items(t.items, RULES)
    return classified.groupBy(
        "description", "layer", "category", "status", "confidence", "reasoning",
        "requires_manual_review", F.array_join("flags", ",").alias("flags"),
    ).agg(F.count(F.lit(1)).alias("items"), as_double(F.sum("amount")).alias("amount"))


@query(
    "K12",
    f"""WITH {CLASSIFIER}
SELECT claim_id,
  CAST(coalesce(sum(amount) FILTER (WHERE amount >= 0 AND status <> 'ineligible'), 0) AS DOUBLE) AS eligible_total,
  count(*) FILTER (WHERE amount >= 0 AND status <> 'ineligible') AS approved_items,
  count(*) FILTER (WHERE amount >= 0 AND status = 'ineligible') AS ineligible_items,
  count(*) FILTER (WHERE amount < 0) AS credit_items,
  CAST(coalesce(sum(amount) FILTER (WHERE amount < 0), 0) AS DOUBLE) AS credit_total
FROM final GROUP BY claim_id""",
)
def classifier_claim_totals(t):
    totals = classify.eligibility_totals(t.items, RULES)
    return totals.withColumns(
        {c: as_double(c) for c in ("eligible_total", "credit_total")}
    )


@query(
    "J15 S6",
    f"""WITH {CLASSIFIER}
SELECT norm AS normalized, category, phrase FROM texts, phrases WHERE contains(norm, phrase)""",
)
def rule_phrase_matches(t):
    table = ruleset_df(t.spark, RULES)
    return classify.rule_hits(t.items, table, "example").select(
        "normalized", "category", "phrase"
    )


AB_SQL = f"""WITH {CLASSIFIER}, {classifier_ctes(RELAXED, "r_")},
pairs AS (SELECT a.claim_id, a.description, a.amount, a.n, a.status AS cs, b.status AS ts,
  a.confidence AS cc, b.confidence AS tc, a.review AS cr, b.review AS tr,
  CASE WHEN a.amount < 0 THEN 'ineligible' ELSE 'eligible' END AS expected
FROM (SELECT DISTINCT *, count(*) OVER (PARTITION BY claim_id, description, amount) AS n FROM final) a
JOIN (SELECT DISTINCT * FROM r_final) b
  ON a.claim_id = b.claim_id AND a.description = b.description AND a.amount = b.amount)"""


def _ab(t):
    items = t.items.select("claim_id", "description", "amount").withColumn(
        "expected_status", F.when(F.col("amount") < 0, "ineligible").otherwise("eligible")
    )
    return classify.ab_pairs(items, RULES, RELAXED)


@query(
    "A18",
    AB_SQL
    + """
SELECT CAST(sum(n) AS BIGINT) AS total,
  CAST(sum(n) FILTER (WHERE cs = 'eligible') AS BIGINT) AS control_eligible,
  CAST(sum(n) FILTER (WHERE cs = 'ineligible') AS BIGINT) AS control_ineligible,
  CAST(coalesce(sum(n) FILTER (WHERE cs = 'ambiguous'), 0) AS BIGINT) AS control_ambiguous,
  round(sum(n * cc) / sum(n), 6) AS control_avg_confidence,
  CAST(sum(n) FILTER (WHERE cr) AS BIGINT) AS control_review_count,
  CAST(sum(n) FILTER (WHERE ts = 'eligible') AS BIGINT) AS treatment_eligible,
  CAST(sum(n) FILTER (WHERE ts = 'ineligible') AS BIGINT) AS treatment_ineligible,
  CAST(coalesce(sum(n) FILTER (WHERE ts = 'ambiguous'), 0) AS BIGINT) AS treatment_ambiguous,
  round(sum(n * tc) / sum(n), 6) AS treatment_avg_confidence,
  CAST(sum(n) FILTER (WHERE tr) AS BIGINT) AS treatment_review_count,
  CAST(sum(n) FILTER (WHERE cs = ts) AS BIGINT) AS agreement_count,
  CAST(sum(n) FILTER (WHERE cs <> ts) AS BIGINT) AS disagreement_count,
  CAST(coalesce(sum(n) FILTER (WHERE tc - cc > 5), 0) AS BIGINT) AS confidence_improvements,
  CAST(coalesce(sum(n) FILTER (WHERE tc - cc < -5), 0) AS BIGINT) AS confidence_degradations,
  CAST(sum(n) FILTER (WHERE cs = expected) AS BIGINT) AS control_correct,
  CAST(sum(n) FILTER (WHERE ts = expected) AS BIGINT) AS treatment_correct,
  CAST(sum(n) FILTER (WHERE cs = expected AND ts = expected) AS BIGINT) AS both_correct,
  CAST(sum(n) FILTER (WHERE cs <> expected AND ts <> expected) AS BIGINT) AS both_wrong,
  CAST(coalesce(sum(n) FILTER (WHERE cs = expected AND ts <> expected), 0) AS BIGINT) AS control_only_correct,
  CAST(coalesce(sum(n) FILTER (WHERE cs <> expected AND ts = expected), 0) AS BIGINT) AS treatment_only_correct,
  round(sum(n) FILTER (WHERE cs = ts) / sum(n), 6) AS agreement_rate,
  round(sum(n) FILTER (WHERE cs <> ts) / sum(n), 6) AS disagreement_rate FROM pairs""",
)
def ruleset_ab_summary(t):
    summary = classify.ab_summary(_ab(t), "expected_status")
    rounded = [
        "control_avg_confidence", "treatment_avg_confidence", "agreement_rate",
        "disagreement_rate",
    ]
    return summary.withColumns({c: F.round(c, 6) for c in rounded})


@query(
    "A19",
    AB_SQL
    + """
SELECT description, cs AS control_status, ts AS treatment_status, CAST(tc - cc AS DOUBLE) AS confidence_delta,
  cs <> ts AS status_flip,
  CASE WHEN tc - cc > 5 THEN 'up' WHEN tc - cc < -5 THEN 'down' ELSE 'same' END AS confidence_move,
  CAST(sum(n) AS BIGINT) AS items FROM pairs
WHERE cs <> ts OR tc - cc > 5 OR tc - cc < -5 GROUP BY ALL""",
)
def ruleset_ab_details(t):
    return (
        classify.ab_details(_ab(t))
        .groupBy("description", "control_status", "treatment_status", "confidence_delta",
                 "status_flip", "confidence_move")
        .agg(F.count(F.lit(1)).alias("items"))
    )
