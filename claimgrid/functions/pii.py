"""Personal data in text: counts, positions, overlap resolution and redaction, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrid.functions.amounts import let
from claimgrid.rules import fixed_values as fv

FOUND = "array<struct<start:int,rank:double,order:int,stop:int,kind:string,value:string,confidence:double>>"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, r"[-\s]", "")
    if kind == "ssn":
        return (
            (F.length(digits) == 9)
            & ~digits.rlike("^(000|666)")
            & (F.substring(digits, 4, 2) != "00")
            & (F.substring(digits, 6, 4) != "0000")
        )
    if kind == "credit_card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "bank_account":
        return F.length(value).between(8, 17) & ~value.rlike("^0+$")
    return F.lit(True)


def pii_counts(text: Column) -> dict[str, Column]:
    """Valid matches per kind, before overlaps are resolved."""
    return {
        kind: F.size(
            F.filter(
                F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _validator(kind)
            )
        )
        for kind, pattern, _ in fv.PII_PATTERNS
    }


def _validator(kind: str):
    def check(value: Column) -> Column:
        return _valid(kind, value)

    return check


def _matches(text: Column, order: int, kind: str, pattern: str, confidence: float) -> Column:
    """Valid matches with offsets: one fold over the gaps between matches."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = (acc["at"] + F.length(pair["gap"])).cast("int")
        stop = (begin + F.length(pair["hit"])).cast("int")
        entry = F.struct(
            begin.alias("start"),
            F.lit(-confidence).alias("rank"),
            F.lit(order).alias("order"),
            stop.alias("stop"),
            F.lit(kind).alias("kind"),
            pair["hit"].alias("value"),
            F.lit(confidence).alias("confidence"),
        )
        return F.struct(
            stop.alias("at"),
            F.when(_valid(kind, pair["hit"]), F.concat(acc["out"], F.array(entry)))
            .otherwise(acc["out"])
            .alias("out"),
        )

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(
        hits,
        lambda h: F.when(
            F.size(h) > 0,
            F.reduce(
                F.zip_with(
                    F.slice(F.split(text, pattern), F.lit(1), F.size(h)),
                    h,
                    lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")),
                ),
                start,
                step,
                lambda acc: acc["out"],
            ),
        ).otherwise(F.array().cast(FOUND)),
    )


def detect(text: Column) -> Column:
    """Detections by position; of two overlapping ones the more confident stays.

    Walks by (start, confidence) and looks at the first overlap only.
    """
    every = F.array_sort(
        F.concat(
            *[
                _matches(text, i, kind, pattern, confidence)
                for i, (kind, pattern, confidence) in enumerate(fv.PII_PATTERNS)
            ]
        )
    )

    def step(kept: Column, x: Column) -> Column:
        clash = F.get(
            F.filter(kept, lambda e: (x["start"] < e["stop"]) & (x["stop"] > e["start"])),
            F.lit(0),
        )
        return (
            F.when(clash.isNull(), F.concat(kept, F.array(x)))
            .when(
                x["confidence"] > clash["confidence"],
                F.concat(F.filter(kept, lambda e: e != clash), F.array(x)),
            )
            .otherwise(kept)
        )

    return F.array_sort(F.reduce(every, F.array().cast(FOUND), step))


def redact(text: Column, detections: Column, mode: str = "REDACT") -> Column:
    """Text with detections replaced: [REDACTED], [KIND: REDACTED] or up to 20 stars."""
    mode = mode.upper()
    if mode not in ("REDACT", "TAG", "MASK", "NONE"):
        raise ValueError(f"invalid redaction mode: {mode}")
    if mode == "NONE":
        return text

    def replacement(d: Column) -> Column:
        if mode == "TAG":
            return F.concat(F.lit("["), F.upper(d["kind"]), F.lit(": REDACTED]"))
        if mode == "MASK":
            return F.repeat(F.lit("*"), F.least(F.lit(20), d["stop"] - d["start"]))
        return F.lit("[REDACTED]")

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), d["start"] - acc["at"]))
        return F.struct(
            F.greatest(acc["at"], d["stop"]).alias("at"),
            F.concat(acc["out"], gap, replacement(d)).alias("out"),
        )

    done = F.reduce(
        detections,
        start,
        step,
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(detections) > 0, done).otherwise(text)
