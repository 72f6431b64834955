"""A registered query and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, so that two engines' last digits compare."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _beta_sql(x: str, a: str, b: str) -> str:
    """Regularised incomplete beta function in SQL, by its power series on the side where it converges fast."""
    swap = f"({x}) > (({a}) + 1) / (({a}) + ({b}) + 2)"
    series = "list_sum(list_transform(range(0, 2500), lambda n: exp(lgamma(p + q + n) - lgamma(p + q) - lgamma(p + 1 + n) + lgamma(p + 1) + n * ln(z))))"
    share = f"CASE WHEN z <= 0 THEN 0.0 ELSE exp(p * ln(z) + q * ln(1 - z) + lgamma(p + q) - lgamma(p) - lgamma(q)) / p * {series} END"
    return f"(SELECT CASE WHEN swap THEN 1 - {share} ELSE {share} END FROM (SELECT CASE WHEN {swap} THEN {b} ELSE {a} END AS p, CASE WHEN {swap} THEN {a} ELSE {b} END AS q, CASE WHEN {swap} THEN 1 - ({x}) ELSE {x} END AS z, {swap} AS swap) AS s)"


def t_tail_sql(t: str, df: str) -> str:
    """Two-sided p value of Student's t in SQL."""
    return _beta_sql(f"({df}) / (({df}) + ({t}) * ({t}))", f"({df}) / 2.0", "0.5")


def normal_tail_sql(z: str) -> str:
    """P(|Z| > |z|) in SQL, by the power series of the incomplete gamma function."""
    x = f"(({z}) * ({z}) / 2)"
    return f"CASE WHEN ({z}) = 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 600), lambda n: exp((n + 0.5) * ln({x}) - {x} - lgamma(n + 1.5)))) END"
