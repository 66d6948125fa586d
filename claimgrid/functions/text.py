"""Strings, dates, money and small lookups as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrid.rules import fixed_values as fv

MONEY = "decimal(12,2)"
WIDE_MONEY = "decimal(28,2)"


def normalize_description(text: Column) -> Column:
    """Lower-case, every run of other characters to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def sql_text(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values: Iterable[str]) -> Column:
    """A constant ``array<string>``, parsed once instead of built literal by literal."""
    return F.expr("cast(array(" + ", ".join(sql_text(v) for v in values) + ") as array<string>)")


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of all conditions as a balanced tree, which keeps generated code shallow."""
    level = list(conditions)
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [reduce(lambda left, right: left | right, pair) for pair in pairs]
    return level[0]


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """Any phrase occurs as a substring.

    A phrase that holds an earlier one ('carpet cleaning' holds 'cleaning') cannot add a match and
    is left out; byte search beats a regular expression here.
    """
    kept: list[str] = []
    for phrase in sorted(set(phrases), key=len):
        if not any(shorter in phrase for shorter in kept):
            kept.append(phrase)
    return any_of(text.contains(phrase) for phrase in kept)


def contained(text: Column, phrases: Iterable[str]) -> Column:
    """The phrases that occur in the text, in their own order."""
    return F.filter(text_array(phrases), lambda phrase: F.contains(text, phrase))


def count_contained(text: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases occur in the text."""
    return F.size(contained(text, phrases))


def matches_any_phrase(
    text: Column, phrases: Iterable[str], limit: int = fv.WORD_BOUNDARY_MAX_LENGTH
) -> Column:
    """Whole-word match for short phrases ('pet' is not in 'carpet'), substring for longer ones."""
    short = [p for p in phrases if len(p) <= limit]
    found = contains_any(text, [p for p in phrases if len(p) > limit])
    if short:
        whole_word = text.rlike(r"\b(" + "|".join(re.escape(p) for p in short) + r")\b")
        found = found | (contains_any(text, short) & whole_word)
    return found


def phrase_flags(lowered: Column) -> dict[str, Column]:
    """The nine phrase flags of a lower-cased, non-null description."""
    flags = {}
    for flag, phrases in fv.PHRASES.items():
        if flag in fv.WORD_BOUNDARY_FLAGS:
            flags[flag] = matches_any_phrase(lowered, phrases)
        else:
            flags[flag] = contains_any(lowered, phrases)
    return flags


def after_lease_end(charge_date: Column, lease_end: Column) -> Column:
    """Charge after the lease ended; unreadable or missing dates never flag."""
    charge = F.try_to_timestamp(charge_date.cast("string"))
    end = F.try_to_timestamp(lease_end.cast("string"))
    return F.coalesce(charge > end, F.lit(False))


def parse_date(text: Column) -> Column:
    """``m/d/yy``, ``m/d/yyyy`` or ``yyyy-m-d``; two-digit years 69-99 belong to the 1900s."""
    trimmed = F.trim(text)
    short = F.try_to_timestamp(
        F.when(trimmed.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), trimmed), F.lit("M/d/yy")
    ).cast("date")
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    full = F.try_to_timestamp(
        F.when(trimmed.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), trimmed), F.lit("M/d/yyyy")
    ).cast("date")
    iso = F.try_to_timestamp(
        F.when(trimmed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), trimmed), F.lit("yyyy-M-d")
    ).cast("date")
    return F.coalesce(short, full, iso)


def parse_currency(text: Column) -> Column:
    """Dollar text to money; blank or unreadable is 0."""
    cleaned = F.regexp_replace(F.trim(text), "[$,]", "")
    return F.coalesce(cleaned.try_cast(MONEY), F.lit(0).cast(MONEY))


def normalize_status(text: Column) -> Column:
    """approve when the text says posted or approve, otherwise deny."""
    lowered = F.lower(F.trim(text))
    approved = lowered.contains("posted") | lowered.contains("approve")
    return F.when(F.coalesce(approved, F.lit(False)), "approve").otherwise("deny")


def build_property_id(address: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """``street-city-state-zip5`` without the blank parts; a stable fallback when all are blank."""
    street = F.regexp_replace(F.regexp_replace(address, " ", "_"), "[,#]", "")
    parts = [street, city, state, F.split(zip_code, "-")[0]]
    joined = F.concat_ws("-", *[F.when(part != "", part) for part in parts])
    fallback = F.concat(F.lit("PROP-"), (F.crc32(F.lit("unknown").cast("binary")) % 10000).cast("string"))
    return F.when(joined == "", fallback).otherwise(joined)


def build_policy_id(policy: Column) -> Column:
    trimmed = F.trim(F.coalesce(policy, F.lit("")))
    return F.concat(F.lit("POL-"), F.when(trimmed == "", "UNKNOWN").otherwise(trimmed))


def text_preview(text: Column, length: int = 100) -> Column:
    return F.left(text, F.lit(length))


def extract_tracking(filename: Column, folder: Column) -> Column:
    """Tracking number: a numeric folder wins, then four filename forms in order."""

    def group(text: Column, pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        return F.when(found != "", found)

    return F.coalesce(
        group(F.trim(folder), r"^(\d+)$"),
        group(filename, r"(?i)CLM[_-]?(\d+)"),
        group(filename, r"(\d{4,})"),
        group(filename, r"(?i)Claim[_-]?(\d+)"),
        group(filename, r"^(\d+)$"),
    )


def money(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return column.cast(WIDE_MONEY)


def as_double(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return column.cast("double")
