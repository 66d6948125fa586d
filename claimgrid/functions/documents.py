"""Document typing, quality, language and search as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrid.functions.amounts import let, strip
from claimgrid.functions.text import contains_any, count_contained, text_array
from claimgrid.rules import fixed_values as fv

# Frequent function words used to guess a language from text alone.
STOP_WORDS = {
    "en": ["the", "and", "of", "that", "for", "with", "was", "are", "this", "by"],
    "fr": ["le", "la", "les", "des", "que", "dans", "pour", "une", "avec", "et"],
    "de": ["der", "die", "und", "das", "nicht", "mit", "ein", "ist", "von", "den"],
    "es": ["el", "los", "las", "que", "por", "con", "para", "una", "del", "y"],
}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def search_rank(text: Column, terms: list[str], mode: str) -> Column:
    """Hits of the terms per token, null where the AND / OR query does not match."""
    wanted = text_array([t.lower() for t in terms])

    def score(all_tokens: Column) -> Column:
        hits = F.size(F.filter(all_tokens, lambda t: F.array_contains(wanted, t)))
        found = F.size(F.array_intersect(all_tokens, wanted))
        need = len(set(terms)) if mode == "and" else 1
        return F.when(found >= need, hits.cast("double") / F.size(all_tokens))

    return let(tokens(text), score)


def may_match(text: Column, terms: list[str], mode: str) -> Column:
    """Cheap substring filter that never loses a match."""
    lowered = F.lower(text)
    if mode == "and":
        condition = F.lit(True)
        for term in terms:
            condition = condition & lowered.contains(term.lower())
        return condition
    return contains_any(lowered, [t.lower() for t in terms])


def feature_scores(text: Column, page_count: Column) -> dict[str, Column]:
    """Keyword, structure, dollar, date and page-count scores, each 0..1."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    best = F.greatest(
        count_contained(lowered, fv.LEASE_KEYWORDS),
        count_contained(lowered, fv.INVOICE_KEYWORDS),
        count_contained(lowered, fv.ADDENDUM_KEYWORDS),
    )
    lines = F.split(lowered, "\n")
    filled = F.size(F.filter(lines, lambda line: strip(line) != ""))
    tabular = F.exists(F.slice(lines, 1, 20), lambda line: line.rlike(r"\||\t|\s{3,}"))
    dollars = F.regexp_count(lowered, F.lit(r"\$[\d,]+\.?\d*"))
    numeric = lowered.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}")
    named = lowered.rlike(
        r"(january|february|march|april|may|june|july|august|september|october|november|december)"
        r"\s+\d{1,2},?\s+\d{4}"
    )
    return {
        "keyword_score": F.least(F.lit(1.0), best / float(len(fv.LEASE_KEYWORDS))),
        "structure_score": F.least(
            F.lit(1.0),
            F.least(F.lit(1.0), filled / 50.0) + F.when(tabular, 0.2).otherwise(0.0),
        ),
        "dollar_score": F.when(dollars >= 3, 1.0).when(dollars == 2, 0.7).when(dollars == 1, 0.4).otherwise(0.0),
        "date_score": F.when(numeric & named, 1.0).when(numeric | named, 0.5).otherwise(0.0),
        "page_score": F.when(page_count.between(5, 15), 1.0)
        .when(page_count.between(3, 20), 0.7)
        .when(page_count.between(1, 25), 0.4)
        .otherwise(0.2),
    }


def rule_type(text: Column, page_count: Column, filename: Column) -> Column:
    """struct(type, confidence): the best of the lease, invoice and addendum scores, in that order
    on ties. Uses ``date_score`` and ``dollar_score`` columns of the same frame."""
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(0.0)

    lease = (
        points(lowered.contains("lease"), 0.4)
        + points(contains_any(lowered, ["term:", "monthly rent"]), 0.3)
        + points(page_count.between(5, 15), 0.2)
        + points(F.col("date_score") > 0.5, 0.1)
    )
    named = contains_any(F.lower(F.coalesce(filename, F.lit(""))), fv.MOVE_OUT_FILE_PATTERNS)
    invoice = (
        points(named, 1.0)
        + points(lowered.contains("invoice"), 0.4)
        + points(contains_any(lowered, ["balance due", "total", "statement"]), 0.3)
        + points(F.col("dollar_score") > 0.5, 0.2)
        + points(page_count.between(1, 5), 0.1)
    )
    addendum = (
        points(lowered.contains("addendum"), 0.4)
        + points(lowered.contains("security deposit waiver"), 0.3)
        + points(lowered.contains("enrollment"), 0.2)
        + points(page_count <= 3, 0.1)
    )
    scores = F.struct(lease.alias("l"), invoice.alias("i"), addendum.alias("a"))
    return let(
        scores,
        lambda s: F.struct(
            F.when((s["l"] >= s["i"]) & (s["l"] >= s["a"]), "lease")
            .when(s["i"] >= s["a"], "invoice")
            .otherwise("addendum")
            .alias("type"),
            F.least(F.lit(1.0), F.greatest(s["l"], s["i"], s["a"])).alias("confidence"),
        ),
    )


def final_type(ml: Column, rule: Column, ocr_confidence: Column) -> Column:
    """Model if certain after the OCR factor, else rules if certain, else unknown."""
    factor = F.least(F.lit(1.0), ocr_confidence / 100.0)
    scaled = ml["confidence"] * factor
    limit = fv.TYPE_CONFIDENCE_THRESHOLD

    def result(kind: Column, confidence: Column, fallback: bool) -> Column:
        return F.struct(
            kind.alias("type"), confidence.alias("confidence"), F.lit(fallback).alias("fallback_used")
        )

    return (
        F.when(F.coalesce(scaled >= limit, F.lit(False)), result(ml["type"], scaled, False))
        .when(rule["confidence"] >= limit, result(rule["type"], rule["confidence"], True))
        .otherwise(
            result(
                F.lit("unknown"),
                F.greatest(rule["confidence"], F.coalesce(ml["confidence"], F.lit(0.0))),
                True,
            )
        )
    )


def word_count(text: Column) -> Column:
    trimmed = strip(text)
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def text_confidence(text: Column) -> Column:
    """Extraction confidence from word count and character variety."""

    def score(t: Column) -> Column:
        words = word_count(t)
        variety = F.size(F.array_distinct(F.split(F.lower(t), ""))) / F.length(t).cast("double")
        return (
            F.when(F.length(t) < 10, 0.0)
            .when(words < 10, 30.0)
            .otherwise(
                F.least(
                    F.lit(100.0), F.least(F.lit(85.0), 50.0 + (words / 10.0) * 2) + variety * 10
                )
            )
        )

    return let(strip(F.coalesce(text, F.lit(""))), score)


def quality(text: Column, page_count: Column) -> dict[str, Column]:
    """Blank pages, pages to review, table and form hints."""
    present = F.coalesce(text, F.lit("")) != ""
    pages = F.split(text, "\n\n")
    thin = F.filter(
        F.transform(pages, lambda p, i: F.when(word_count(p) < 10, i + 1)), lambda i: i.isNotNull()
    )
    none = F.array().cast("array<int>")
    return {
        "pages_needing_review": F.when(present, thin).otherwise(none),
        "blank_page_count": F.when(present, F.size(thin)).otherwise(page_count),
        "table_detected": F.coalesce(present & text.rlike(r"\||\t"), F.lit(False)),
        "form_detected": F.coalesce(
            present & contains_any(F.lower(text), ["form", "field", "checkbox"]), F.lit(False)
        ),
    }


def review_reasons(kind: Column, confidence: Column, ocr_confidence: Column) -> Column:
    """Why a person should look at a document; uses the ``quality`` columns of the frame."""
    blank, pages = F.col("blank_page_count"), F.size("pages_needing_review")

    def note(condition: Column, text: Column) -> Column:
        return F.when(condition, text)

    return F.array_compact(
        F.array(
            note(
                confidence < fv.TYPE_CONFIDENCE_THRESHOLD,
                F.format_string("Low classification confidence: %.2f", confidence),
            ),
            note(ocr_confidence < 50.0, F.format_string("Low OCR confidence: %.1f%%", ocr_confidence)),
            note(blank > 0, F.concat(F.lit("Blank pages detected: "), blank.cast("string"))),
            note(kind == "unknown", F.lit("Document type could not be determined")),
            note(pages > 0, F.concat(F.lit("Pages needing review: "), pages.cast("string"))),
        )
    )


def is_rtl(language: Column) -> Column:
    return F.coalesce(F.lower(language).isin(fv.RTL_LANGUAGES), F.lit(False))


def guess_language(text: Column) -> Column:
    """Language with the most function words present; null for short text or no evidence."""
    words = F.split(F.lower(text), r"[\s.,;:!?]+")

    def pick(found: Column) -> Column:
        scores = F.array_max(
            F.array(
                *[
                    F.struct(
                        F.size(F.array_intersect(found, text_array(stop))).alias("n"),
                        F.lit(-i).alias("rank"),
                        F.lit(code).alias("code"),
                    )
                    for i, (code, stop) in enumerate(STOP_WORDS.items())
                ]
            )
        )
        return let(scores, lambda best: F.when(best["n"] > 0, best["code"]))

    return F.when(F.length(strip(text)) >= 10, let(words, pick))


def file_facts(name: Column, content: Column) -> dict[str, Column]:
    """SHA-256, size, size check and MIME type by extension."""
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    types = F.create_map(*[F.lit(x) for pair in fv.MIME_TYPES.items() for x in pair])
    size = F.octet_length(content)
    return {
        "file_hash": F.sha2(content, 256),
        "file_size_bytes": size.cast("bigint"),
        "size_ok": size <= fv.MAX_FILE_SIZE_BYTES,
        "guessed_mime": F.coalesce(
            F.try_element_at(types, extension), F.lit("application/octet-stream")
        ),
    }
