"""Predicates on histories, and what each of several filters costs.

A filter is a named boolean column; a null result counts as false. Scope filters make the
baseline, the others the split.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    name: str
    test: Column
    importance: int = 50


def one_of(col: str, values: Sequence) -> Column:
    return F.col(col).isin(list(values))


def in_range(col: str, low=None, high=None) -> Column:
    """Inclusive bounds, either may be missing; a null value is outside."""
    if low is not None and high is not None and low > high:
        raise ValueError(f"{col}: {low} is above {high}")
    test = F.col(col).isNotNull()
    if low is not None:
        test = test & (F.col(col) >= low)
    return test if high is None else test & (F.col(col) <= high)


def weekday_in(date: str, days: Sequence[str]) -> Column:
    return F.date_format(date, "EEEE").isin(list(days))


def month_in(date: str, months: Sequence[int]) -> Column:
    return F.month(date).isin(list(months))


def same_text(col: str, text: str) -> Column:
    """Equality that ignores case and outer white space."""
    return F.lower(F.trim(col)) == text.strip().lower()


def last_seasons(df: DataFrame, season: str, n: int) -> DataFrame:
    """Rows of the last n seasons of the whole table, not of each subject."""
    latest = df.agg(F.max(season).alias("__latest"))
    return df.crossJoin(F.broadcast(latest)).where(F.col(season) > F.col("__latest") - n).drop("__latest")


def passing(filters: Sequence[Filter]) -> Column:
    test = F.lit(True)
    for f in filters:
        test = test & F.coalesce(f.test, F.lit(False))
    return test


def of_context(context: Mapping[str, object], rules: Mapping[str, Callable], given: Sequence[Filter] = ()) -> list[Filter]:
    """A future game's known circumstances as filters on the past; a given filter of the same name stays instead."""
    have = {f.name for f in given}
    return [*given, *(Filter(name, rules[name](value)) for name, value in context.items() if value is not None and name not in have)]


def last_rows(df: DataFrame, by: str, n: int, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Each subject's newest n rows; apply it after every other filter."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def impact(df: DataFrame, by: Sequence[str], filters: Sequence[Filter]) -> DataFrame:
    """A row a group and filter: rows with it alone, rows if it is dropped, and rows with all. One pass over df."""
    flags = {f.name: F.coalesce(f.test, F.lit(False)) for f in filters}
    count = lambda test: F.sum(F.when(test, 1).otherwise(0))

    def without(name: str | None) -> Column:
        test = F.lit(True)
        for k, c in flags.items():
            if k != name:
                test = test & c
        return test

    agg = [count(without(None)).alias("n_all")]
    for name, c in flags.items():
        agg += [count(c).alias(f"alone_{name}"), count(without(name)).alias(f"drop_{name}")]
    wide = df.groupBy(*by).agg(*agg)
    rows = F.array(*[F.struct(F.lit(f.name).alias("filter"), F.lit(f.importance).alias("importance"), F.col(f"alone_{f.name}").alias("n_alone"), F.col(f"drop_{f.name}").alias("n_if_dropped")) for f in filters])
    return wide.select(*by, "n_all", F.explode(rows).alias("x")).select(*by, "n_all", "x.*")


def suggest_drop(impacts: DataFrame, by: Sequence[str], enough: int = 5) -> DataFrame:
    """(by, filter) for groups with fewer than `enough` rows: the least important filter whose removal gives enough, else the one that gives most."""
    few = impacts.where(F.col("n_all") < enough)
    reach = F.col("n_if_dropped") >= enough
    order = Window.partitionBy(*by).orderBy(F.when(reach, 0).otherwise(1), F.when(reach, F.col("importance")).otherwise(-F.col("n_if_dropped")), "filter")
    return few.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(*by, "n_all", "filter", "n_if_dropped")


def mostly_missing(df: DataFrame, cols: Sequence[str], most: float = 0.2) -> list[str]:
    """The columns that are null in more than a share of the rows; one aggregate, one row to the driver."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if (row[c] or 0) > most]
