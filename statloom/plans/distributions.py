"""Queries of the count distributions (M rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions as m
from ..operators.projection import residual_table
from ..sources.roles import EVENT_HISTORY_SQL, event_history
from .base import Query, rounded

E = EVENT_HISTORY_SQL
TOP = 60


def _pmf(s, d, alpha: float):
    g = event_history(s, d).groupBy("subject", "level").agg((F.avg("exposure") / 10).alias("mean"), (F.max("event_id") % 12).alias("y"))
    return g.withColumn("pmf", m.normalised(m.count_pmf(F.col("mean"), F.lit(alpha), TOP)))


def m1(s, d):
    p = _pmf(s, d, 0.0)
    return rounded(p.select("subject", "level", F.posexplode("pmf").alias("k", "p")), 8)


def m1_nb(s, d):
    p = _pmf(s, d, 0.25)
    return rounded(p.select("subject", "level", F.posexplode("pmf").alias("k", "p")), 8)


def m2(s, d):
    p = _pmf(s, d, 0.0).select("subject", F.posexplode("pmf").alias("k", "p"))
    mix = p.groupBy("subject", "k").agg(F.avg("p").alias("p"))
    return rounded(mix, 8)


def m3(s, d):
    lo, hi = m.interval(F.col("pmf"), 0.9)
    return _pmf(s, d, 0.0).select("subject", "level", m.quantile(F.col("pmf"), 0.5).cast("long").alias("median"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def m4(s, d):
    over, under, push = m.over_under_push(F.col("pmf"), F.lit(5))
    return rounded(_pmf(s, d, 0.25).select("subject", "level", over.alias("over"), under.alias("under"), push.alias("push")))


def m5(s, d):
    return rounded(_pmf(s, d, 0.0).select("subject", "level", m.pmf_mean(F.col("pmf")).alias("mean"), m.log_score(F.col("pmf"), F.col("y")).alias("log_score")))


def m7(s, d):
    c = m.cdf(F.col("pmf"))
    return rounded(_pmf(s, d, 0.25).select("subject", "level", F.element_at(c, F.col("y").cast("int") + 1).alias("cdf")))


def m13(s, d):
    h = event_history(s, d)
    base = h.groupBy("level").agg(F.avg("value").alias("pred"))
    r = h.join(F.broadcast(base), "level").withColumn("bucket", F.least(F.floor(F.col("exposure") / 20), F.lit(4)).cast("long")).withColumn("resid", F.col("value") - F.col("pred"))
    levels = [0.1, 0.25, 0.5, 0.75, 0.9]
    use = residual_table(r, "bucket", "resid", levels, exact=True)
    return rounded(use.select("bucket", "n", *[F.element_at("q", i + 1).alias(f"q{int(x * 100)}") for i, x in enumerate(levels)]), 4)


_P = f"""(WITH g AS (SELECT subject, level, avg(exposure) / 10 AS mean, max(event_id) % 12 AS y FROM {E} GROUP BY ALL), k AS (SELECT unnest(range(0, {TOP + 1})) AS k),
 r AS (SELECT *, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM g CROSS JOIN k) SELECT subject, level, mean, y, k, p / sum(p) OVER (PARTITION BY subject, level) AS p FROM r)"""
_NB = f"""(WITH g AS (SELECT subject, level, avg(exposure) / 10 AS mean, max(event_id) % 12 AS y FROM {E} GROUP BY ALL), k AS (SELECT unnest(range(0, {TOP + 1})) AS k),
 r AS (SELECT *, exp(lgamma(k + 4) - lgamma(4) - lgamma(k + 1) + 4 * ln(1 / (1 + 0.25 * mean)) + k * ln(0.25 * mean / (1 + 0.25 * mean))) AS p FROM g CROSS JOIN k) SELECT subject, level, mean, y, k, p / sum(p) OVER (PARTITION BY subject, level) AS p FROM r)"""
_C = f"(SELECT *, sum(p) OVER (PARTITION BY subject, level ORDER BY k) AS c FROM {_P})"

QUERIES = [
    Query("m1_poisson_pmf", m1, f"SELECT subject, level, CAST(k AS INTEGER) AS k, round(p, 8) AS p FROM {_P}"),
    Query("m1_negative_binomial_pmf", m1_nb, f"SELECT subject, level, CAST(k AS INTEGER) AS k, round(p, 8) AS p FROM {_NB}"),
    Query("m2_mixture_pmf", m2, f"SELECT subject, CAST(k AS INTEGER) AS k, round(avg(p), 8) AS p FROM {_P} GROUP BY ALL"),
    Query("m3_quantiles", m3, f"SELECT subject, level, min(k) FILTER (c >= 0.5 - 1e-12) AS median, min(k) FILTER (c >= 0.05 - 1e-12) AS lo, min(k) FILTER (c >= 0.95 - 1e-12) AS hi FROM {_C} GROUP BY ALL"),
    Query("m4_over_under", m4, f"SELECT subject, level, round(sum(p) FILTER (k > 5), 6) AS over, round(sum(p) FILTER (k < 5), 6) AS under, round(sum(p) FILTER (k = 5), 6) AS push FROM {_NB} GROUP BY ALL"),
    Query("m5_moments_log_score", m5, f"SELECT subject, level, round(sum(k * p), 6) AS mean, round(ln(greatest(sum(p) FILTER (k = y), 1e-12)), 6) AS log_score FROM {_P} GROUP BY ALL"),
    Query("m7_cdf", m7, f"SELECT subject, level, round(sum(p) FILTER (k <= y), 6) AS cdf FROM {_NB} GROUP BY ALL"),
    Query("m13_residual_table", m13, f"""WITH r AS (SELECT least(exposure // 20, 4) AS bucket, value - avg(value) OVER (PARTITION BY level) AS x FROM {E}), l AS (SELECT quantile_cont(x, [0.1, 0.25, 0.5, 0.75, 0.9]) AS a FROM r), b AS (SELECT bucket, count(*) AS n, quantile_cont(x, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM r GROUP BY 1),
      u AS (SELECT bucket, n, CASE WHEN n >= 200 THEN q ELSE a END AS u FROM b CROSS JOIN l) SELECT CAST(bucket AS BIGINT) AS bucket, n, {', '.join(f'round(u[{i + 1}], 4) AS q{q}' for i, q in enumerate((10, 25, 50, 75, 90)))} FROM u"""),
]
