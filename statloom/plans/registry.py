"""All registered queries, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .base import Query

MODULES = ("windows", "aggregates", "filters", "joins", "inference", "scalars", "distributions", "models", "sources", "bundles", "catalog", "effects")


def registered() -> list[Query]:
    return [q for m in MODULES for q in import_module(f".{m}", __package__).QUERIES]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["i6_split_vs_baseline"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.name: (lambda spark, sf_dir, run=q.run: run(ship(spark), sf_dir)) for q in registered()}


def oracle_sql() -> dict[str, str]:
    return {q.name: q.sql for q in registered() if q.sql}
