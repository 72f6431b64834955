"""Projections of future events from a fitted rate: scenarios, exposure nodes, the mixture's distribution, and its split into contributions.

Everything about an event is in its row: scenarios times nodes are an array, the distribution a mixture over it, and a
coalition of context groups a column of the model with the other groups' features at neutral values. So a projection
needs no shuffle, whatever the number of events, scenarios or groups.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import distributions as dist
from .inference import effective_n
from .models import shapley


def residual_table(df: DataFrame, bucket: str, residual: str, levels: Sequence[float], least: int = 200, exact: bool = False) -> DataFrame:
    """(bucket, n, q): quantiles of the residuals in each bucket; buckets of fewer than `least` rows take those of all rows.

    Quantiles are Spark's mergeable sketches, or exact ones where asked for (a bucket's distinct values then meet in one task).
    """
    q = F.percentile(residual, F.array(*[F.lit(float(x)) for x in levels])) if exact else F.percentile_approx(residual, [float(x) for x in levels], 10_000)
    own = df.where(F.col(residual).isNotNull() & F.col(bucket).isNotNull())
    by = own.groupBy(bucket).agg(F.count("*").alias("n"), q.alias("q"))
    pooled = own.agg(q.alias("all"))
    return by.crossJoin(F.broadcast(pooled)).select(bucket, "n", F.when(F.col("n") >= least, F.col("q")).otherwise(F.col("all")).alias("q"))  # one row


def exposure_nodes(predicted: Column, residuals: Column, floor: float = 0.0) -> Column:
    """Array of equally likely exposures: the prediction plus each residual quantile, at least `floor`."""
    return F.transform(residuals, lambda r: F.greatest(predicted + r, F.lit(float(floor))))


def scenario_nodes(home: Column, rate_home: Column, rate_away: Column, exposures: Column, multiplier: Column | float = 1.0) -> Column:
    """Array of (weight, mean): every exposure in the known scenario, or in both at one half where `home` is null."""
    m = multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    case = lambda w, r: F.struct(F.lit(w).alias("w"), r.cast("double").alias("r"))
    sides = F.when(home.isNull(), F.array(case(0.5, rate_home), case(0.5, rate_away))).otherwise(F.array(case(1.0, F.when(home, rate_home).otherwise(rate_away))))
    n = F.size(exposures)
    return F.flatten(F.transform(sides, lambda s: F.transform(exposures, lambda e: F.struct((s["w"] / n).alias("weight"), (s["r"] * e * m).alias("mean")))))


def mixture_mean(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(0.0), lambda t, n: t + n["weight"] * n["mean"])


def project(df: DataFrame, nodes: str, alpha: Column, line: Column | None = None, level: float = 0.9) -> DataFrame:
    """df with mean, median, lo, hi of the mixture, and over, under, push of a line (by default the floor of the mean, and a half).

    The support reaches as far as the row's own largest mean needs it, and the distribution's sum is one.
    """
    d = df.withColumn("mean", mixture_mean(F.col(nodes)))
    d = d.withColumn("__of", dist.mixture_summary(F.col(nodes), alpha, F.floor("mean") + 0.5 if line is None else line, level))
    return d.select(*df.columns, "mean", *[F.col(f"__of.{c}").alias(c) for c in ("median", "lo", "hi", "over", "under", "push")])


def mean_interval(mean: Column, alpha: Column, games: Column, exposure: Column, exposure_sd: Column, halflife: float = 20.0, level: float = 0.95) -> tuple[Column, Column]:
    """Confidence interval of the mean: the count's relative variance at fixed exposure and the exposure's own, both over the effective number of games."""
    n = F.greatest(effective_n(games, halflife), F.lit(1.0))
    small = F.lit(1e-9)
    count = (mean + alpha * mean * mean) / F.pow(F.greatest(mean, small), 2) / n
    spread = F.coalesce(F.pow(exposure_sd / F.greatest(exposure, small), 2) / n, F.lit(0.0))
    half = NormalDist().inv_cdf(0.5 + level / 2) * F.sqrt(count + spread) * mean
    return F.greatest(mean - half, F.lit(0.0)), mean + half


def contributions(df: DataFrame, groups: Mapping[str, Mapping[str, Column]], predict: Callable[[Mapping[str, Column]], Column], halves: Mapping[str, str] | None = None) -> DataFrame:
    """df with projection, neutral, and phi_<group>: exact Shapley shares of projection - neutral in at most six groups.

    groups: neutral values of each group's features. predict: the model's expectation as a column, with some features
    replaced. halves: groups (with the 0/1 feature) whose neutral state is both values at one half instead.
    """
    halves = dict(halves or {})
    names = [*groups, *halves]

    def value(on: frozenset) -> Column:
        own = {c: v for g, cols in groups.items() if g not in on for c, v in cols.items()}
        off = [halves[g] for g in halves if g not in on]
        cases = [dict(zip(off, bits, strict=True)) for bits in itertools.product((1.0, 0.0), repeat=len(off))]
        return sum((predict({**own, **{c: F.lit(b) for c, b in case.items()}}) / len(cases) for case in cases), F.lit(0.0))

    sets = {frozenset(c): None for k in range(len(names) + 1) for c in itertools.combinations(names, k)}
    out = df.withColumn("projection", value(frozenset(names))).withColumn("neutral", value(frozenset()))
    return shapley(out, names, {s: value(s) for s in sets})
