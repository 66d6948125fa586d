"""Tolerant JSON reading, line-item shapes and response validation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS_SCHEMA = "critical array<string>, warnings array<string>, info array<string>"
MISSING_SCHEMA = "fields array<string>, needs_user_input boolean"
ITEM_SCHEMA = (
    "array<struct<description:string,amount:double,reason:string,"
    "line_item:struct<description:string,amount:double,quantity:int,unit_price:double>,"
    "analysis:struct<reasoning:string,reason:string,confidence:double,"
    "should_be_included:boolean,is_normal_wear_tear:boolean,is_covered_by_addendum:boolean>,"
    "is_rent:boolean,is_cleaning:boolean,is_repair:boolean,is_damage:boolean>>"
)


def safe_json(text: Column, schema: str, default: Column | None = None) -> Column:
    """Parsed JSON; null, bad or empty text gives the default."""
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return parsed if default is None else F.coalesce(parsed, default)


def line_items(text: Column) -> Column:
    """A line-item array, empty for null or bad text."""
    usable = F.when(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("["), text)
    return F.coalesce(
        F.from_json(usable, ITEM_SCHEMA), F.from_json(F.lit("[]"), ITEM_SCHEMA)
    )


def flag_lists(text: Column) -> Column:
    """All flags, critical first, then warnings, then info."""
    flags = F.from_json(text, FLAGS_SCHEMA)
    empty = F.array().cast("array<string>")
    return F.concat(
        F.coalesce(flags["critical"], empty),
        F.coalesce(flags["warnings"], empty),
        F.coalesce(flags["info"], empty),
    )


def missing_fields(text: Column) -> Column:
    return F.coalesce(
        F.from_json(text, MISSING_SCHEMA)["fields"], F.array().cast("array<string>")
    )


def normalized_item(item: Column, override_reason: Column | None = None) -> Column:
    """(description, amount, reason) of either item shape; an override's reason comes first."""

    def filled(value: Column) -> Column:
        return F.when(value != "", value)

    nested = item["line_item"].isNotNull()
    analysis = item["analysis"]
    reason = F.when(
        nested & analysis.isNotNull(),
        F.coalesce(filled(analysis["reasoning"]), filled(analysis["reason"])),
    ).otherwise(item["reason"])
    if override_reason is not None:
        reason = F.coalesce(filled(override_reason), reason)
    return F.struct(
        F.coalesce(
            F.when(nested, item["line_item"]["description"]).otherwise(item["description"]),
            F.lit(""),
        ).alias("description"),
        F.coalesce(
            F.when(nested, item["line_item"]["amount"]).otherwise(item["amount"]), F.lit(0.0)
        ).alias("amount"),
        reason.alias("reason"),
    )


def strip_fences(text: Column) -> Column:
    """JSON inside a code fence (a json-tagged one first), else the text itself; '' gives null."""
    trimmed = F.trim(text)
    tagged = F.regexp_extract(trimmed, "(?s)```json(.*?)(?:```|$)", 1)
    plain = F.regexp_extract(trimmed, "(?s)```(.*?)(?:```|$)", 1)
    inner = (
        F.when(trimmed.contains("```json"), tagged)
        .when(trimmed.contains("```"), plain)
        .otherwise(trimmed)
    )
    cleaned = F.regexp_replace(inner, r"^\s+|\s+$", "")
    return F.when(cleaned != "", cleaned)


def parse_repaired(text: Column) -> Column:
    """Variant of the text, retried with single quotes turned into double quotes."""
    return F.coalesce(
        F.try_parse_json(text), F.try_parse_json(F.replace(text, F.lit("'"), F.lit('"')))
    )


BOOLEAN_FIELDS = [
    "should_be_included", "is_normal_wear_tear", "is_covered_by_addendum",
    "is_covered_by_other_insurance",
]
REQUIRED_FIELDS = ["line_item_number", *BOOLEAN_FIELDS, "confidence", "reasoning", "addendum_reference"]


def _kind(value: Column) -> Column:
    """Variant type name without precision."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def _boolean(value: Column) -> Column:
    lowered = F.lower(F.try_variant_get(value, "$", "string"))
    kind = _kind(value)
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when((kind == "STRING") & lowered.isin("true", "1", "yes"), True)
        .when((kind == "STRING") & lowered.isin("false", "0", "no"), False)
    )


def _field_errors(entry: Column, position: Column) -> Column:
    prefix = F.concat(F.lit("Analysis "), position.cast("string"), F.lit(": "))

    def get(name: str) -> Column:
        return F.try_variant_get(entry, "$." + name, "variant")

    def error(condition: Column, text: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.concat(prefix, F.lit(text)))

    errors = []
    for name in REQUIRED_FIELDS:
        errors.append(error(get(name).isNull(), f"Missing required field '{name}'"))
    number = get("line_item_number")
    integral = _kind(number).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    errors.append(error(number.isNotNull() & ~integral, "'line_item_number' must be integer"))
    errors.append(
        error(
            integral & (F.try_variant_get(number, "$", "bigint") != position),
            "'line_item_number' is out of sequence",
        )
    )
    for name in BOOLEAN_FIELDS:
        errors.append(
            error(get(name).isNotNull() & _boolean(get(name)).isNull(), f"'{name}' must be boolean")
        )
    confidence = get("confidence")
    level = F.try_variant_get(confidence, "$", "double")
    errors.append(error(confidence.isNotNull() & level.isNull(), "'confidence' must be number"))
    errors.append(
        error(~level.between(0.0, 1.0), "'confidence' must be between 0.0 and 1.0")
    )
    for name in ("reasoning", "addendum_reference"):
        value = get(name)
        errors.append(
            error(value.isNotNull() & (_kind(value) != "STRING"), f"'{name}' must be string")
        )
    errors.append(
        error(
            (_kind(get("reasoning")) == "STRING")
            & (F.trim(F.try_variant_get(entry, "$.reasoning", "string")) == ""),
            "'reasoning' must be non-empty string",
        )
    )
    return F.array_compact(F.array(*errors))


def response_errors(response: Column, expected: Column) -> Column:
    """All validation errors of one model response; an empty array means it is valid."""
    body = strip_fences(response)
    parsed = parse_repaired(body)
    analyses = F.try_variant_get(parsed, "$.line_item_analyses", "variant")
    entries = F.try_variant_get(parsed, "$.line_item_analyses", "array<variant>")
    text = F.array().cast("array<string>")
    count = F.when(
        F.size(entries) != expected,
        F.concat(
            F.lit("Expected "), expected.cast("string"), F.lit(" analyses, got "),
            F.size(entries).cast("string"),
        ),
    )
    per_entry = F.flatten(
        F.transform(
            entries,
            lambda entry, i: F.when(
                _kind(entry) == "OBJECT", _field_errors(entry, i + 1)
            ).otherwise(
                F.array(
                    F.concat(
                        F.lit("Analysis "), (i + 1).cast("string"), F.lit(": Must be an object")
                    )
                )
            ),
        )
    )
    return (
        F.when(body.isNull(), F.array(F.lit("No JSON content found in response")))
        .when(parsed.isNull(), F.array(F.lit("Invalid JSON")))
        .when(analyses.isNull(), F.array(F.lit("Missing 'line_item_analyses' field")))
        .when(entries.isNull(), F.array(F.lit("'line_item_analyses' must be an array")))
        .otherwise(F.concat(F.array_compact(F.array(count)), F.coalesce(per_entry, text)))
    )


def analysis_rows(response: Column) -> Column:
    """Typed analyses of a valid response, with string booleans coerced."""
    entries = F.try_variant_get(
        parse_repaired(strip_fences(response)), "$.line_item_analyses", "array<variant>"
    )
    return F.transform(
        entries,
        lambda entry: F.struct(
            F.try_variant_get(entry, "$.line_item_number", "int").alias("line_no"),
            *[
                _boolean(F.try_variant_get(entry, "$." + name, "variant")).alias(name)
                for name in BOOLEAN_FIELDS
            ],
            F.try_variant_get(entry, "$.confidence", "double").alias("confidence"),
            F.try_variant_get(entry, "$.reasoning", "string").alias("reasoning"),
            F.try_variant_get(entry, "$.addendum_reference", "string").alias("addendum_reference"),
        ),
    )
