"""A versioned item ruleset: loaded from YAML or built from the fixed values."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from claimgrid.rules import fixed_values as fv


@dataclass(frozen=True)
class Category:
    name: str
    confidence: float
    patterns: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    examples: tuple[str, ...] = ()
    boost_above: float | None = None
    boost: float = 0.0

    @property
    def status(self) -> str:
        return status_of(self.name)


@dataclass(frozen=True)
class RuleSet:
    version: str
    categories: tuple[Category, ...]
    special_rules: tuple[dict, ...] = ()
    thresholds: dict = field(default_factory=lambda: dict(fv.THRESHOLDS))
    approval_bias: bool = True

    def phrases(self) -> list[tuple[str, str, float]]:
        """(normalised example, category, confidence); a repeated example keeps its last owner."""
        found: dict[str, tuple[str, float]] = {}
        for category in self.categories:
            for example in category.examples:
                found[normalize_text(example)] = (category.name, category.confidence)
        return [(phrase, name, conf) for phrase, (name, conf) in found.items()]


def status_of(name: str) -> str:
    """Status by prefix, so a rule that names a category where a status belongs still works."""
    lowered = name.lower()
    for status in ("ineligible", "eligible"):
        if lowered.startswith(status):
            return status
    return "ambiguous"


def normalize_text(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def default_ruleset() -> RuleSet:
    """The ruleset shipped with the package."""
    return load_ruleset(str(Path(__file__).with_name("default_rules.yaml")))


def load_ruleset(path: str) -> RuleSet:
    """Read and validate a rules YAML file; raises ``ValueError`` listing every problem."""
    with open(path, encoding="utf-8") as handle:
        raw = yaml.safe_load(handle) or {}
    problems = ruleset_problems(raw)
    if problems:
        raise ValueError("; ".join(problems))
    categories = []
    for entry in raw["categories"]:
        keywords = entry.get("keywords") or {}
        threshold = entry.get("amount_threshold") or {}
        categories.append(
            Category(
                name=entry["name"],
                confidence=float(entry.get("confidence", 85)),
                patterns=tuple(entry.get("patterns") or ()),
                positive=tuple(keywords.get("positive") or ()),
                negative=tuple(keywords.get("negative") or ()),
                examples=tuple(entry.get("examples") or ()),
                boost_above=threshold.get("above"),
                boost=float(threshold.get("confidence_boost", 0)),
            )
        )
    return RuleSet(
        str(raw["version"]),
        tuple(categories),
        tuple(raw.get("special_rules") or ()),
        {**fv.THRESHOLDS, **(raw.get("threshold_rules") or {})},
        bool(raw.get("approval_bias", True)),
    )


def ruleset_problems(raw: dict) -> list[str]:
    problems = [
        f"missing required key '{key}'"
        for key in ("version", "categories", "threshold_rules")
        if key not in raw
    ]
    if "version" in raw and not re.fullmatch(r"\d+\.\d+(\.\d+)?", str(raw["version"])):
        problems.append(f"bad version '{raw['version']}'")
    for entry in raw.get("categories") or []:
        name = str(entry.get("name", ""))
        if not re.fullmatch(r"[A-Z][A-Z_]*", name):
            problems.append(f"bad category name '{name}'")
        if not 0 <= float(entry.get("confidence", 85)) <= 100:
            problems.append(f"confidence of '{name}' is outside 0..100")
        for pattern in entry.get("patterns") or []:
            try:
                re.compile(pattern)
            except re.error as error:
                problems.append(f"pattern of '{name}' does not compile: {error}")
    return problems


def ruleset_df(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """One row per pattern, keyword and example; bounded by the rules file, so safe to broadcast."""
    rows = []
    for order, category in enumerate(rules.categories):
        for kind, texts in (
            ("pattern", category.patterns),
            ("positive", category.positive),
            ("negative", category.negative),
            ("example", category.examples),
        ):
            for position, text in enumerate(texts):
                rows.append(
                    (rules.version, order, category.name, category.status,
                     category.confidence, kind, position, text)
                )
    schema = (
        "rule_version string, category_order int, category string, status string, "
        "confidence double, kind string, position int, text string"
    )
    return spark.createDataFrame(rows, schema)
