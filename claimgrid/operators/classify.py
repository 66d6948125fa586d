"""Line-item rules: phrase flags, inclusion, and the layered category classifier.

The layers depend on the description alone, and the amount counts only by the few limits it may
exceed, so the classifier answers once per *distinct* description and amount band. The distinct is
combined on the map side (a description carried by a third of all items costs one row per task) and
the answers join back, frequent descriptions in pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions.text import (
    after_lease_end,
    contains_any,
    normalize_description,
    phrase_flags,
    sql_text,
    text_array,
)
from claimgrid.plans.barrier import computed_once
from claimgrid.plans.skewed import join_back
from claimgrid.rules import fixed_values as fv
from claimgrid.rules.ruleset import RuleSet, normalize_text, status_of

DENY_FLAGS = [
    "is_rent", "is_month_to_month", "is_improper_notice", "is_other_insurance",
    "is_prior_balance", "is_contractual_fee",
]
HIT = (
    "struct<category:string,confidence:double,patterns:array<string>,keywords:array<string>,"
    "reasoning:string,review:boolean,flags:array<string>>"
)
#: Characters of the pieces that phrases are filed under.
GRAM = 3


# ----- phrase rules ---------------------------------------------------------------------------


def flag_items(items: DataFrame) -> DataFrame:
    """Add the phrase flags and ``is_after_lease_end`` (only where both dates exist)."""
    flags = phrase_flags(F.col("_lowered"))
    if {"charge_date", "lease_end_date"} <= set(items.columns):
        flags["is_after_lease_end"] = after_lease_end(
            F.col("charge_date"), F.col("lease_end_date")
        )
    else:
        flags["is_after_lease_end"] = F.lit(False)
    lowered = F.lower(F.coalesce(F.col("description"), F.lit("")))
    return items.withColumn("_lowered", lowered).withColumns(flags).drop("_lowered")


def should_include(amount: Column, is_normal_wear_tear: Column) -> Column:
    """False for credits, absurd amounts and the deny flags; true for everything else."""
    denied = reduce(lambda a, b: a | b, [F.col(flag) for flag in DENY_FLAGS])
    return (
        F.when((amount > 100000) | (amount < 0), False)
        .when(denied | is_normal_wear_tear, False)
        .otherwise(True)
    )


def apply_rules(items: DataFrame) -> DataFrame:
    """Flags plus the final inclusion. Advisory columns are optional: covered, not wear by default."""
    wear = F.col("is_normal_wear_tear") if "is_normal_wear_tear" in items.columns else F.lit(False)
    covered = (
        F.col("is_covered_by_addendum")
        if "is_covered_by_addendum" in items.columns
        else F.lit(True)
    )
    return (
        flag_items(items)
        .withColumns(
            {
                "amount": F.coalesce(F.col("amount"), F.lit(0).cast("decimal(12,2)")),
                "is_normal_wear_tear": F.coalesce(wear, F.lit(False)),
                "is_covered_by_addendum": F.coalesce(covered, F.lit(True)),
            }
        )
        .withColumn(
            "should_be_included", should_include(F.col("amount"), F.col("is_normal_wear_tear"))
        )
    )


def adjust_suggestions(items: DataFrame) -> DataFrame:
    """Advisory rows: improper notice and other-insurance terms turn a suggestion off."""
    lowered = F.lower(F.coalesce(F.col("description"), F.lit("")))
    improper = lowered.contains("improper") & lowered.contains("notice")
    elsewhere = (
        contains_any(lowered, fv.ADVISORY_TERMS["pet"])
        | contains_any(lowered, fv.ADVISORY_TERMS["fire"])
        | contains_any(lowered, fv.ADVISORY_TERMS["water"])
    )
    return items.withColumn(
        "is_covered_by_other_insurance",
        F.coalesce(F.col("is_covered_by_other_insurance"), F.lit(False)) | elsewhere,
    ).withColumn(
        "should_be_included",
        F.when(improper | F.col("is_covered_by_other_insurance"), False).otherwise(
            F.coalesce(F.col("should_be_included"), F.lit(False))
        ),
    )


# ----- text layers ----------------------------------------------------------------------------


def _hit(category, confidence, patterns, keywords, reasoning, review, flags) -> Column:
    return F.struct(
        category.alias("category"),
        confidence.cast("double").alias("confidence"),
        patterns.alias("patterns"),
        keywords.alias("keywords"),
        reasoning.alias("reasoning"),
        review.alias("review"),
        flags.alias("flags"),
    )


def _strings(values) -> Column:
    return text_array(values)


def _entry(confidence: str, position: int, category: str, text: str) -> str:
    """A candidate; ``array_max`` picks the greatest confidence, then the earliest position."""
    return (
        f"named_struct('confidence', {confidence}, 'rank', {-position}, "
        f"'category', {sql_text(category)}, 'text', {text})"
    )


def _phrase_array(entries: list[tuple[int, str, str, float]]) -> Column:
    cells = [_entry(f"{conf}D", i, cat, sql_text(phrase)) for i, phrase, cat, conf in entries]
    return F.expr("array(" + ", ".join(cells) + ")")


NO_ENTRY = "struct<confidence:double,rank:int,category:string,text:string>"


def exact_layer(text: Column, rules: RuleSet) -> Column:
    """Best example phrase contained in the text."""
    table = [(i, *entry) for i, entry in enumerate(rules.phrases())]
    if not table:
        return F.lit(None).cast(NO_ENTRY)
    return F.array_max(F.filter(_phrase_array(table), lambda p: F.contains(text, p["text"])))


def fuzzy_layer(text: Column, rules: RuleSet, max_distance: int = 3) -> Column:
    """Best example within edit distance 3 of a word window of the same length."""
    words = F.split(text, " ")
    groups: dict[int, list[tuple[int, str, str, float]]] = {}
    for i, (phrase, category, conf) in enumerate(rules.phrases()):
        groups.setdefault(len(phrase.split()), []).append(
            (i, phrase, category, max(conf - 5, 85.0))
        )

    def near(length: int, entries: list[tuple[int, str, str, float]]) -> Column:
        windows = F.when(
            F.size(words) >= length,
            F.transform(
                F.sequence(F.lit(1), F.size(words) - (length - 1)),
                lambda i: F.array_join(F.slice(words, i, length), " "),
            ),
        ).otherwise(_strings([]))
        return F.filter(
            _phrase_array(entries),
            lambda p: F.exists(
                windows, lambda window: F.levenshtein(window, p["text"], max_distance) >= 0
            ),
        )

    hits = [near(length, entries) for length, entries in sorted(groups.items())]
    if not hits:
        return F.lit(None).cast(NO_ENTRY)
    return F.array_max(F.concat(*hits))


def pattern_layer(column: str, rules: RuleSet) -> Column:
    """Best regex category; +5 (at most 99) unless a negative keyword is present."""
    candidates = []
    for order, category in enumerate(rules.categories):
        if not category.patterns:
            continue
        matched = " ".join(
            f"WHEN {column} RLIKE {sql_text('(?i)' + p)} THEN {sql_text(p)}"
            for p in category.patterns
        )
        confidence = f"{min(category.confidence + 5, 99.0)}D"
        if category.negative:
            blocked = "|".join(re.escape(k.lower()) for k in category.negative)
            confidence = (
                f"CASE WHEN {column} RLIKE {sql_text(blocked)} THEN {category.confidence}D "
                f"ELSE {confidence} END"
            )
        candidates.append(_entry(confidence, order, category.name, f"CASE {matched} END"))
    if not candidates:
        return F.lit(None).cast(NO_ENTRY)
    return F.array_max(
        F.filter(
            F.expr("array(" + ", ".join(candidates) + ")"), lambda hit: hit["text"].isNotNull()
        )
    )


def keyword_layer(column: str, rules: RuleSet) -> Column:
    """+1 per positive keyword, -2 per negative one; the best score wins, first on ties."""

    def found(keywords) -> str:
        cells = ", ".join(sql_text(k.lower()) for k in keywords)
        return f"size(filter(cast(array({cells}) as array<string>), k -> contains({column}, k)))"

    candidates = [
        f"named_struct('score', {found(c.positive)} - 2 * {found(c.negative)}, 'rank', {-order}, "
        f"'category', {sql_text(c.name)}, 'negative', {found(c.negative)} > 0)"
        for order, c in enumerate(rules.categories)
        if c.positive
    ]
    return F.array_max(
        F.filter(
            F.expr("array(" + ", ".join(candidates) + ")"), lambda hit: hit["score"] > 0
        )
    )


def text_layers(texts: DataFrame, rules: RuleSet, column: str = "normalized") -> DataFrame:
    """All text layers for distinct normalised descriptions, one small stage each.

    The costly fuzzy layer only sees rows the exact layer left open, the keyword layer only rows
    that neither exact nor a strong pattern decides: each ``when`` is evaluated lazily.
    """
    text = F.col(column)
    floor = float(rules.thresholds["low_confidence_review"])
    names = [c.name for c in rules.categories]
    positives = F.expr(
        "map(" + ", ".join(
            f"{sql_text(c.name)}, cast(array("
            + ", ".join(sql_text(k) for k in c.positive)
            + ") as array<string>)"
            for c in rules.categories
        ) + ")"
    )
    bases = F.expr(
        "map(" + ", ".join(f"{sql_text(c.name)}, {c.confidence}D" for c in rules.categories) + ")"
    )
    layered = (
        texts.withColumns(
            {"_phrase": exact_layer(text, rules), "_pattern": pattern_layer(column, rules)}
        )
        .withColumn(
            "_fuzzy", F.when(F.col("_phrase").isNull(), fuzzy_layer(text, rules))
        )
        .withColumn("_exact", F.coalesce(F.col("_phrase"), F.col("_fuzzy")))
        .withColumn(
            "_keyword",
            F.when(
                F.col("_exact").isNull()
                & (F.col("_pattern").isNull() | (F.col("_pattern.confidence") <= 80)),
                keyword_layer(column, rules),
            ),
        )
    )
    known = F.coalesce(F.col("_pattern.category"), F.col("_keyword.category"))
    layered = layered.withColumn(
        "_found",
        F.when(
            known.isin(names),
            F.filter(F.element_at(positives, known), lambda k: F.contains(text, F.lower(k))),
        ),
    ).withColumn(
        "_keyword_words",
        F.when(
            F.col("_keyword").isNotNull(),
            F.filter(
                F.element_at(positives, F.col("_keyword.category")),
                lambda k: F.contains(text, F.lower(k)),
            ),
        ),
    ).withColumn(
        "_keyword_confidence",
        F.when(
            F.col("_keyword").isNotNull(),
            F.least(
                F.element_at(bases, F.col("_keyword.category"))
                * (
                    F.col("_keyword.score").cast("double")
                    / F.size(F.element_at(positives, F.col("_keyword.category")))
                ),
                F.lit(85.0),
            ),
        ),
    )
    exact, pattern, keyword = F.col("_exact"), F.col("_pattern"), F.col("_keyword")
    fuzzy = F.col("_phrase").isNull()
    return layered.select(
        *texts.columns,
        F.when(
            exact.isNotNull(),
            _hit(
                exact["category"], exact["confidence"], F.array(exact["text"]),
                F.split(exact["text"], " "),
                F.concat(
                    F.when(fuzzy, "Fuzzy").otherwise("Exact"), F.lit(' match: "'),
                    exact["text"], F.lit('"'),
                ),
                F.lit(False),
                F.when(fuzzy, _strings(["FUZZY_MATCH"])).otherwise(_strings([])),
            ),
        ).alias("_exact"),
        F.when(
            pattern.isNotNull(),
            _hit(
                pattern["category"], pattern["confidence"], F.array(pattern["text"]),
                F.col("_found"), F.concat(F.lit("Pattern match: "), pattern["category"]),
                pattern["confidence"] < floor, _strings([]),
            ),
        ).alias("_pattern"),
        F.when(
            keyword.isNotNull(),
            _hit(
                keyword["category"], F.col("_keyword_confidence"), _strings([]),
                F.col("_keyword_words"),
                F.concat(
                    F.lit("Keyword score: "), keyword["score"].cast("string"), F.lit(" ("),
                    F.array_join("_keyword_words", ", "), F.lit(")"),
                ),
                F.col("_keyword_confidence") < floor,
                F.when(keyword["negative"], _strings(["KEYWORD_BASED"])).otherwise(_strings([])),
            ),
        ).alias("_keyword"),
    )


# ----- arbitration and special rules ------------------------------------------------------------


def _default_hit(rules: RuleSet) -> Column:
    name = "DEFAULT_ELIGIBLE" if rules.approval_bias else "DEFAULT_AMBIGUOUS"
    return _hit(
        F.lit(name), F.lit(30.0), _strings([]), _strings([]),
        F.lit("No strong match found, defaulting per policy"), F.lit(True),
        _strings(["LOW_CONFIDENCE_DEFAULT"]),
    )


def _empty_hit() -> Column:
    return _hit(
        F.lit("DEFAULT_AMBIGUOUS"), F.lit(30.0), _strings([]), _strings([]), F.lit("Empty description"),
        F.lit(True), _strings(["EDGE_CASE"]),
    )


def amount_limits(*rulesets: RuleSet) -> list[Decimal]:
    """The amounts that any rule compares with, ascending: between two of them an amount changes nothing."""
    limits = set()
    for rules in rulesets:
        limits.add(rules.thresholds["high_value_review"])
        limits |= {c.boost_above for c in rules.categories if c.boost_above is not None}
        triggers = [rule.get("trigger", {}) for rule in rules.special_rules]
        limits |= {t["amount_above"] for t in triggers if {"amount_above", "confidence_below"} <= set(t)}
    return sorted({Decimal(str(x)) for x in limits})


def amount_band(amount: Column, limits: list[Decimal]) -> Column:
    """How many of the limits an amount exceeds; none if it is null."""
    over = [F.coalesce((amount > F.lit(x)).cast("int"), F.lit(0)) for x in limits]
    return reduce(lambda a, b: a + b, over, F.lit(0))


def _apply_special(df: DataFrame, rules: RuleSet, limits: list[Decimal]) -> DataFrame:
    """Special rules in order, each seeing the previous result, as one select stage per rule."""
    open_ = F.col("_layer") != "default"
    lowered = F.lower(F.col("_text"))

    def above(x) -> Column:
        return F.col("_band") > limits.index(Decimal(str(x)))

    for rule in rules.special_rules:
        trigger, action = rule.get("trigger", {}), rule.get("action", {})
        fired: list[Column] = []
        if "contains_all" in trigger:
            fired.append(
                reduce(lambda a, b: a & b,
                       [lowered.contains(k.lower()) for k in trigger["contains_all"]])
            )
        if "amount_above" in trigger and "confidence_below" in trigger:
            fired.append(
                above(trigger["amount_above"])
                & (F.col("confidence") < float(trigger["confidence_below"]))
            )
        if "patterns" in trigger:
            fired.append(
                reduce(lambda a, b: a & b,
                       [lowered.rlike("(?i)" + p) for p in trigger["patterns"]])
            )
        if not fired:
            continue
        on = open_ & F.coalesce(reduce(lambda a, b: a | b, fired), F.lit(False))
        updates = {}
        if "status" in action:
            updates["status"] = F.lit(status_of(str(action["status"])))
        if "category" in action:
            updates["category"] = F.lit(action["category"])
        if "confidence" in action:
            updates["confidence"] = F.lit(float(action["confidence"]))
        if "requires_review" in action:
            updates["requires_manual_review"] = F.lit(bool(action["requires_review"]))
        if "reason" in action:
            updates["reasoning"] = F.concat(F.col("reasoning"), F.lit("; " + action["reason"]))
        added = ([action["flag"]] if "flag" in action else []) + [
            f"SPECIAL_RULE_{rule.get('rule_id', 'UNKNOWN')}"
        ]
        updates["flags"] = F.concat(F.col("flags"), _strings(added))
        df = df.withColumn("_on", on).withColumns(
            {name: F.when(F.col("_on"), value).otherwise(F.col(name))
             for name, value in updates.items()}
        )
    for category in rules.categories:
        if category.boost_above is None:
            continue
        df = df.withColumn(
            "_on",
            open_ & (F.col("category") == category.name) & above(category.boost_above),
        ).withColumns(
            {
                "confidence": F.when(
                    F.col("_on"), F.least(F.col("confidence") + category.boost, F.lit(99.0))
                ).otherwise(F.col("confidence")),
                "flags": F.when(
                    F.col("_on"), F.concat(F.col("flags"), _strings(["AMOUNT_THRESHOLD_MET"]))
                ).otherwise(F.col("flags")),
            }
        )
    uncertain = (
        open_
        & above(rules.thresholds["high_value_review"])
        & (F.col("confidence") < 60)
    )
    low = open_ & (F.col("confidence") < float(rules.thresholds["manual_review_required"]))
    return (
        df.withColumn("_on", uncertain)
        .withColumns(
            {
                "flags": F.array_distinct(
                    F.when(F.col("_on"),
                           F.concat(F.col("flags"), _strings(["HIGH_VALUE_UNCERTAIN"])))
                    .otherwise(F.col("flags"))
                ),
                "requires_manual_review": F.when(F.col("_on") | low, True).otherwise(
                    F.col("requires_manual_review")
                ),
            }
        )
        .drop("_on")
    )


def _arbitrated(
    texts: DataFrame, rules: RuleSet, model: Callable[[Column], Column] | None
) -> DataFrame:
    """The winning layer and its hit for every row of ``texts`` (_text, normalized)."""
    layered = text_layers(texts, rules)
    model_hit = F.lit(None).cast(HIT)
    if model is not None:
        layered = layered.withColumn("_guess", model(F.col("normalized")))
        guess = F.col("_guess")
        model_hit = F.when(
            guess["confidence"] > 70,
            F.struct(
                guess["category"].alias("category"),
                guess["confidence"].alias("confidence"),
                _strings([]).alias("patterns"),
                _strings([]).alias("keywords"),
                F.concat(F.lit("ML prediction: "), guess["category"]).alias("reasoning"),
                (guess["confidence"] < 85).alias("review"),
                _strings(["ML_BASED"]).alias("flags"),
            ),
        )
    exact, pattern, keyword = F.col("_exact"), F.col("_pattern"), F.col("_keyword")
    exact_wins = exact.isNotNull() & (
        pattern.isNull() | (exact["confidence"] >= pattern["confidence"] - 5)
    )
    layer = (
        F.when(F.col("_text") == "", "default")
        .when(exact_wins, "exact")
        .when(pattern["confidence"] > 80, "pattern")
        .when(exact.isNotNull(), "exact")
        .when(keyword["confidence"] > 40, "keyword")
        .when(F.col("_model").isNotNull(), "model")
        .otherwise("default")
    )
    return (
        layered.withColumn("_model", model_hit)
        .withColumn("_layer", layer)
        .withColumn(
            "_hit",
            F.when(F.col("_text") == "", _empty_hit())
            .when(F.col("_layer") == "exact", exact)
            .when(F.col("_layer") == "pattern", pattern)
            .when(F.col("_layer") == "keyword", keyword)
            .when(F.col("_layer") == "model", F.col("_model"))
            .otherwise(_default_hit(rules)),
        )
        .select(*texts.columns, "_layer", "_hit")
    )


def _text_of(items: DataFrame) -> Column:
    return F.coalesce(F.col("description"), F.lit(""))


def distinct_texts(items: DataFrame) -> DataFrame:
    """(_text, normalized) of the distinct descriptions, null as empty."""
    texts = items.select(_text_of(items).alias("_text")).distinct()
    return texts.withColumn("normalized", normalize_description(F.col("_text")))


def text_verdicts(
    texts: DataFrame,
    rules: RuleSet,
    limits: list[Decimal],
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The classifier's whole answer for every distinct description and amount band.

    Rules look at an item's description and at how its amount compares with a few limits, so an
    answer for each band of each description answers for all items.
    """
    hit = {
        "category": "category", "confidence": "confidence", "matched_patterns": "patterns",
        "matched_keywords": "keywords", "reasoning": "reasoning",
        "requires_manual_review": "review", "flags": "flags",
    }
    answered = (
        _arbitrated(texts, rules, model)
        .select("*", *[F.col("_hit." + field).alias(name) for name, field in hit.items()])
        .drop("_hit")
        .withColumn("status", _status(F.col("category")))
        .withColumn("_band", F.explode(F.sequence(F.lit(0), F.lit(len(limits)))))
    )
    return (
        _apply_special(answered, rules, limits)
        .withColumnRenamed("_layer", "layer")
        .withColumn("rule_version", F.lit(rules.version))
    )


def _join_verdicts(items: DataFrame, verdicts: DataFrame, limits: list[Decimal]) -> DataFrame:
    keyed = items.withColumns(
        {"_text": _text_of(items), "_band": amount_band(F.col("amount"), limits)}
    )
    return join_back(keyed, verdicts, ["_text", "_band"], "left", items.columns).drop("_text", "_band")


def classify_items(
    items: DataFrame,
    rules: RuleSet,
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add status, category, confidence, reasoning, review flag, flags, layer and rule version.

    ``model`` is an optional fourth layer: from the normalised text to
    ``struct<category string, confidence double>`` (an MLlib output or a pandas UDF). It counts
    above 70 only, as in the inner gate.
    """
    limits = amount_limits(rules)
    return _join_verdicts(items, text_verdicts(distinct_texts(items), rules, limits, model), limits)


def _status(category: Column) -> Column:
    return (
        F.when(category.startswith("ELIGIBLE"), "eligible")
        .when(category.startswith("INELIGIBLE"), "ineligible")
        .when(category == "DEFAULT_ELIGIBLE", "eligible")
        .otherwise("ambiguous")
    )


def grams(text: Column) -> Column:
    """The distinct pieces of one to GRAM characters of a text."""
    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
        pieces = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
        return F.when(F.length(text) >= size, F.array_distinct(pieces)).otherwise(F.array())

    return F.concat(*[of(size) for size in range(1, GRAM + 1)])


def phrase_matches(texts: DataFrame, phrases: DataFrame, text: str, phrase: str) -> DataFrame:
    """Every row of ``texts`` beside every row of ``phrases`` whose phrase it contains.

    Each phrase is filed under one of its pieces of GRAM characters (or itself if shorter), the one
    that the fewest texts hold, so an equal join finds the candidates and containment is checked on them
    alone; neither side needs to be small. Pieces, not words, because a phrase may begin or end
    inside a word. Null and empty phrases are in no text; repeated rows stay repeated.
    """
    asked = texts.withColumn("_gram", F.explode(grams(F.col(text))))
    # At most as many pieces as the alphabet allows, combined by every task first.
    held = asked.groupBy("_gram").agg(F.count(F.lit(1)).alias("_held"))
    size = F.least(F.length(phrase), F.lit(GRAM))
    filed = (
        phrases.select(phrase).distinct()
        .withColumn("_gram", F.explode(F.filter(grams(F.col(phrase)), lambda g: F.length(g) == size)))
        .join(held, "_gram")
        .groupBy(phrase)
        .agg(F.min_by("_gram", F.struct("_held", "_gram")).alias("_gram"))
    )
    known = phrases.join(filed, phrase)
    return asked.join(known, "_gram").filter(F.contains(text, phrase)).drop("_gram")


def rule_hits(items: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """Which rule phrases occur in which distinct description."""
    texts = items.select(
        normalize_description(F.coalesce(F.col("description"), F.lit(""))).alias("normalized")
    ).distinct()
    phrases = rules.filter(F.col("kind") == kind).select(
        "category", "confidence", "category_order", "position",
        normalize_description(F.col("text")).alias("phrase"),
    )
    return phrase_matches(texts, phrases, "normalized", "phrase")


def eligibility_totals(items: DataFrame, rules: RuleSet) -> DataFrame:
    """Per claim: eligible / ineligible totals by the classifier, with credits split off."""
    classified = classify_items(items, rules)
    credit = F.col("amount") < 0
    ok = (F.col("status") == "eligible") | (
        (F.col("status") == "ambiguous") & F.lit(rules.approval_bias)
    )
    return classified.groupBy("claim_id").agg(
        F.sum(F.when(~credit & ok, F.col("amount")).otherwise(0)).alias("eligible_total"),
        F.count_if(~credit & ok).alias("approved_items"),
        F.count_if(~credit & ~ok).alias("ineligible_items"),
        F.count_if(credit).alias("credit_items"),
        F.sum(F.when(credit, F.col("amount")).otherwise(0)).alias("credit_total"),
    )


# ----- comparing two rulesets -------------------------------------------------------------------


def ab_pairs(items: DataFrame, control: RuleSet, treatment: RuleSet) -> DataFrame:
    """Each item under both rulesets, side by side.

    Both rulesets answer for the distinct descriptions, and one join brings both answers back.
    """
    keep = ["status", "category", "confidence", "requires_manual_review", "reasoning"]
    limits = amount_limits(control, treatment)
    texts = distinct_texts(items)
    first = text_verdicts(texts, control, limits).select(
        "_text", "normalized", F.struct("_band", *keep).alias("_control")
    )
    paired = text_verdicts(first, treatment, limits).filter("_control._band = _band")
    verdicts = paired.select(
        "_text", "_band",
        *[F.col("_control." + c).alias("control_" + c) for c in keep],
        *[F.col(c).alias("treatment_" + c) for c in keep],
    )
    return _join_verdicts(items, verdicts, limits)


def ab_summary(pairs: DataFrame, expected: str | None = None) -> DataFrame:
    """One row: counts by status per side, agreement, review load, and correctness if known."""
    aggregates = [F.count(F.lit(1)).alias("total")]
    for side in ("control", "treatment"):
        status = F.col(f"{side}_status")
        aggregates += [
            F.count_if(status == "eligible").alias(f"{side}_eligible"),
            F.count_if(status == "ineligible").alias(f"{side}_ineligible"),
            F.count_if(status == "ambiguous").alias(f"{side}_ambiguous"),
            F.avg(f"{side}_confidence").alias(f"{side}_avg_confidence"),
            F.count_if(F.col(f"{side}_requires_manual_review")).alias(f"{side}_review_count"),
        ]
    agree = F.col("control_status") == F.col("treatment_status")
    delta = F.col("treatment_confidence") - F.col("control_confidence")
    aggregates += [
        F.count_if(agree).alias("agreement_count"),
        F.count_if(~agree).alias("disagreement_count"),
        F.count_if(delta > 5).alias("confidence_improvements"),
        F.count_if(delta < -5).alias("confidence_degradations"),
    ]
    if expected:
        left = F.coalesce(F.col("control_status") == F.lower(F.col(expected)), F.lit(False))
        right = F.coalesce(F.col("treatment_status") == F.lower(F.col(expected)), F.lit(False))
        known = F.col(expected).isNotNull()
        aggregates += [
            F.count_if(known & left).alias("control_correct"),
            F.count_if(known & right).alias("treatment_correct"),
            F.count_if(known & left & right).alias("both_correct"),
            F.count_if(known & ~left & ~right).alias("both_wrong"),
            F.count_if(known & left & ~right).alias("control_only_correct"),
            F.count_if(known & ~left & right).alias("treatment_only_correct"),
        ]
    return pairs.agg(*aggregates).withColumns(
        {
            "agreement_rate": F.try_divide(F.col("agreement_count"), F.col("total")),
            "disagreement_rate": F.try_divide(F.col("disagreement_count"), F.col("total")),
        }
    )


def ab_details(pairs: DataFrame) -> DataFrame:
    """Status flips and confidence moves of more than five points, with the signed delta."""
    delta = F.col("treatment_confidence") - F.col("control_confidence")
    compared = pairs.withColumns(
        {
            "confidence_delta": delta,
            "status_flip": F.col("control_status") != F.col("treatment_status"),
            "confidence_move": F.when(delta > 5, "up").when(delta < -5, "down").otherwise("same"),
        }
    )
    return computed_once(compared, ["confidence_delta", "status_flip", "confidence_move"]).filter(
        F.col("status_flip") | (F.col("confidence_move") != "same")
    )


def relaxed_ruleset(rules: RuleSet) -> RuleSet:
    """A treatment variant without examples and negative keywords, for A/B runs."""
    from dataclasses import replace

    categories = tuple(
        replace(c, examples=(), negative=()) for c in rules.categories
    )
    return replace(rules, version=rules.version + "-relaxed", categories=categories)


__all__ = [
    "ab_details", "ab_pairs", "ab_summary", "adjust_suggestions", "apply_rules",
    "classify_items", "eligibility_totals", "exact_layer", "flag_items", "fuzzy_layer",
    "keyword_layer", "normalize_text", "pattern_layer", "phrase_matches", "relaxed_ruleset", "rule_hits",
    "should_include", "text_layers",
]
