"""Amounts in free text as one Column expression, evaluated branch by branch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrid.functions.text import any_of
from claimgrid.rules import fixed_values as fv

NUMBER = "decimal(18,4)"
RESULT = "struct<amount:decimal(18,4),confidence:double,is_negative:boolean,method:string>"
WHITESPACE = " \t\n\r\f\x0b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def _number(text: Column) -> Column:
    """The number in a matched group. An empty group is no match: it must not reach the cast, whose
    failure costs far more than the match."""
    return let(
        text, lambda v: F.when(v != "", F.replace(v, F.lit(","), F.lit("")).try_cast(NUMBER))
    )


def _result(amount: Column, confidence: float, negative: Column, method: str) -> Column:
    return F.struct(
        amount.cast(NUMBER).alias("amount"),
        F.lit(confidence).alias("confidence"),
        negative.alias("is_negative"),
        F.lit(method).alias("method"),
    )


def _pair(text: Column, pattern: str) -> Column:
    return F.struct(
        _number(F.regexp_extract(text, pattern, 1)).alias("a"),
        _number(F.regexp_extract(text, pattern, 2)).alias("b"),
    )


def parse_amount(text: Column, base: Column | None = None, strict_sign: bool = False) -> Column:
    """The first branch that succeeds: TBD, percentage of ``base``, range, formula, euro, then the
    standard patterns by confidence. Null when nothing parses.

    A standard amount is negative when the text holds '(' anywhere, starts with '-', or matches a
    negative form; ``strict_sign`` accepts only ``($x)`` and ``-$x``.
    """
    no = F.lit(False)

    def standard(t: Column) -> Column:
        branches = []
        for pattern, confidence, method in sorted(
            fv.STANDARD_AMOUNT_PATTERNS, key=lambda entry: -entry[1]
        ):
            if strict_sign:
                negative = t.rlike(r"\(\$\s*[\d,]+\.\d{2}\)") | t.rlike(r"-\s*\$\s*[\d,]")
            elif method.startswith("negative"):
                negative = F.lit(True)
            else:
                negative = t.contains("(") | t.startswith("-")

            def found(v: Column, neg=None, conf=None, name=None) -> Column:
                return F.when(
                    v.isNotNull(), _result(F.when(neg, -v).otherwise(v), conf, neg, name)
                )

            branches.append(
                let(
                    _number(F.regexp_extract(t, pattern, 1)),
                    _bind(found, negative, confidence, method),
                )
            )
        return F.coalesce(*branches)

    def resolve(t: Column) -> Column:
        # A byte search for a sign the pattern needs spares most texts the pattern.
        to_be_named = F.when(t.rlike(fv.TBD_PATTERN), _result(F.lit(0), 0.0, no, "tbd_flag"))
        choices = []
        if base is not None:
            percent = _number(F.regexp_extract(t, fv.PERCENT_PATTERN, 1))
            choices.append(
                F.when(
                    t.contains("%"),
                    let(
                        percent,
                        lambda p: F.when(
                            p.isNotNull() & base.isNotNull(),
                            _result(base.cast(NUMBER) * p / 100, 0.85, no, "percentage_calculation"),
                        ),
                    ),
                )
            )
        choices += [
            F.when(
                any_of(t.contains(sign) for sign in "-–—"),
                let(
                    _pair(t, fv.RANGE_PATTERN),
                    lambda r: F.when(
                        (r["a"] != 0) & (r["b"] != 0) & (r["a"] <= r["b"]),
                        _result((r["a"] + r["b"]) / 2, 0.75, no, "range_midpoint"),
                    ),
                ),
            ),
            F.when(
                any_of(t.contains(sign) for sign in "×xX*"),
                let(
                    _pair(t, fv.FORMULA_PATTERN),
                    lambda r: F.when(
                        r["a"].isNotNull() & (r["b"] != 0),
                        _result(r["a"] * r["b"], 0.9, no, "formula_calculation"),
                    ),
                ),
            ),
            F.when(
                t.contains("€"),
                let(
                    _number(F.translate(F.regexp_extract(t, fv.EURO_PATTERN, 1), ",.", ".")),
                    lambda e: F.when(
                        e.isNotNull(),
                        _result(
                            e * F.lit(fv.EURO_RATE).cast("decimal(3,2)"), 0.7, no, "euro_conversion"
                        ),
                    ),
                ),
            ),
            standard(t),
        ]
        return F.when(
            t != "", F.coalesce(to_be_named, F.when(t.rlike("[0-9]"), F.coalesce(*choices)))
        )

    return let(strip(text), resolve)


def _bind(body, negative: Column, confidence: float, method: str) -> Callable[[Column], Column]:
    def bound(v: Column) -> Column:
        return body(v, negative, confidence, method)

    return bound


def extract_all_amounts(text: Column) -> Column:
    """One result per line whose amount has a confidence above 0.5."""
    parsed = F.transform(
        F.split(text, "\n"),
        lambda line: F.struct(parse_amount(line).alias("result"), strip(line).alias("original_text")),
    )
    return F.filter(parsed, lambda x: x["result"]["confidence"] > 0.5)


def amount_problem(amount: Column) -> Column:
    """Why an amount is not acceptable, or null."""
    size = F.abs(amount)
    return (
        F.when(amount == 0, "Amount is zero")
        .when(size > 10000, F.concat(F.lit("Amount exceeds maximum: $"), size.cast("string")))
        .when(
            size < F.lit("0.01").cast("decimal(4,2)"),
            F.concat(F.lit("Amount below minimum: $"), size.cast("string")),
        )
    )
