"""Registered queries: operator calls over the claims-model views, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from claimgrid.sources.views import Tables, oracle


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register a query; ``covers`` names the inventory ids it exercises."""

    def register(build: Callable[[Tables], DataFrame]):
        label = name or build.__name__
        if label in REGISTRY:
            raise ValueError(f"duplicate query {label}")
        REGISTRY[label] = Query(label, build, oracle(sql) if sql else None, covers)
        return build

    return register


def load_all() -> dict[str, Query]:
    from claimgrid.catalog import (  # noqa: F401
        decisions,
        documents,
        evaluation,
        invoices,
        items,
        lifecycle,
        relational,
        service,
        storage,
        streams,
    )

    return REGISTRY


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return load_all()[name].build(Tables(spark, folder))
