"""Queries of the inference operators (I rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import ERFC, normal_pvalue_column, normal_two_sided
from ..operators import aggregates as a
from ..operators import inference as i
from ..operators import windows as w
from ..sources.roles import DUEL_HISTORY_SQL, EVENT_HISTORY_SQL, ORDER_HISTORY_SQL, duel_history, event_history, order_history
from .base import Query, normal_tail_sql, rounded, t_tail_sql

E, O, D = EVENT_HISTORY_SQL, ORDER_HISTORY_SQL, DUEL_HISTORY_SQL


def _split(s, d):
    return a.split_stats(event_history(s, d), ["subject"], F.col("level") == "purchase", "value")


def _t(df):
    c = F.col
    t, dof = i.welch(c("split_mean"), c("split_std"), c("split_n"), c("rest_mean"), c("rest_std"), c("rest_n"))
    return df.withColumn("t", t).withColumn("df", dof)


def i1(s, d):
    return rounded(_t(_split(s, d)).select("subject", "t", "df"))


def i2(s, d):
    c = F.col
    return rounded(_split(s, d).select("subject", i.welch_p(c("split_mean"), c("split_std"), c("split_n"), c("rest_mean"), c("rest_std"), c("rest_n")).alias("p")))


def i5(s, d):
    """F20 and I5: difference, percent, z, and the estimate shrunk with a given variance between groups."""
    x = _split(s, d)
    raw, pct = i.difference(F.col("split_mean"), F.col("base_mean"))
    z = i.z_score(F.col("split_mean"), F.col("base_mean"), F.col("base_std"), F.col("split_n"))
    weight = i.shrink_weight(F.col("split_n"), F.col("base_std") * F.col("base_std"), F.when(F.col("subject") % 5 != 0, 25.0))
    return rounded(x.select("subject", raw.alias("diff"), pct.alias("pct"), z.alias("z"), weight.alias("weight"), i.shrunk(F.col("split_mean"), F.col("base_mean"), weight).alias("shrunk")))


def _tau(s, d):
    h = event_history(s, d)
    g = h.groupBy("subject", "level").agg(F.count("value").alias("n"), F.avg("value").alias("m"))
    within = h.groupBy("subject").agg(F.var_samp("value").alias("within"))
    return i.prior_variance(g.join(within, "subject"), ["subject"], "m", "n", "within").drop("league")


def i4(s, d):
    return rounded(_tau(s, d))


def i6(s, d):
    x = _t(_split(s, d)).join(_tau(s, d), "subject", "left")
    raw, pct = i.difference(F.col("split_mean"), F.col("base_mean"))
    wt = i.shrink_weight(F.col("split_n"), F.col("base_std") * F.col("base_std"), F.col("tau2"))
    x = x.withColumn("weight", wt)
    return rounded(x.select(
        "subject", F.col("split_n").alias("n"), F.col("split_mean").alias("mean"), F.col("base_mean").alias("baseline"), F.col("base_n").alias("n_baseline"), raw.alias("diff"), pct.alias("pct"),
        i.z_score(F.col("split_mean"), F.col("base_mean"), F.col("base_std"), F.col("split_n")).alias("z"), "t", "df", "tau2", "weight", i.shrunk(F.col("split_mean"), F.col("base_mean"), F.col("weight")).alias("shrunk"),
        i.confidence_label(F.col("split_n")).alias("confidence"),
    ))


def i3(s, d):
    return i.bootstrap_ci(event_history(s, d).select("subject", "event_id", "level", "value"), "subject", F.col("level") == "purchase", "value")


def _change(s, d):
    h = order_history(s, d)
    return a.period_changes(h, ["subject"], F.month("d") <= 6, F.month("d") > 6, "value")


def i7(s, d):
    c = _change(s, d)
    low, high = F.col("diff") - 1.959963984540054 * F.col("se"), F.col("diff") + 1.959963984540054 * F.col("se")
    return rounded(c.select("subject", "diff", "se", low.alias("low"), high.alias("high"), (F.col("diff") > 0).alias("improved")), 3)


def i7_p(s, d):
    return rounded(_change(s, d).select("subject", normal_pvalue_column(F.try_divide("diff", "se")).alias("p")))


def i8(s, d):
    c = _change(s, d).withColumn("p", F.round(normal_two_sided(F.try_divide("diff", "se")), 9))
    return rounded(w.wide_q_values(c, "p", "subject").select("subject", "p", "q_value"))


def i9(s, d):
    c = _change(s, d).where("se > 0").withColumn("n", 1 / (F.col("se") * F.col("se"))).withColumn("one", F.lit(1.0)).withColumn("all", F.lit(1))
    x = c.join(F.broadcast(i.prior_variance(c, ["all"], "diff", "n", "one")), "all")  # one row
    wt = i.shrink_weight(F.col("n"), F.lit(1.0), F.col("tau2"))
    return rounded(x.select("subject", wt.alias("weight"), i.shrunk(F.col("diff"), F.col("league"), wt).alias("shrunk")), 4)


def i10(s, d):
    h = event_history(s, d).withColumn("back", w.recent_rank("subject"))
    views = F.array(*[F.struct(F.lit(k).alias("view"), t.alias("m")) for k, t in (("all", F.lit(True)), ("last_10", F.col("back") <= 10), ("last_20", F.col("back") <= 20))])
    g = h.select("subject", "value", "exposure", F.explode(views).alias("v")).where("v.m").groupBy("subject", F.col("v.view").alias("view"))
    return rounded(g.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.try_divide(F.sum("value"), F.sum("exposure")) * 36).alias("per_36")))


def i11(s, d):
    return rounded(i.within(order_history(s, d), ["subject"], ["value"]).select("event_id", "value_w"), 3)


def _design(s, d):
    h = event_history(s, d)
    return h.select("subject", "value", F.col("home").cast("double").alias("home"), F.col("exposure").cast("double").alias("minutes"), *[(F.col("level") == x).cast("double").alias(x) for x in ("purchase", "click")])


def i12(s, d):
    t = i.fixed_effects(_design(s, d), "subject", "value", ["minutes"])
    return rounded(s.createDataFrame(t[["variable", "coef", "n", "groups"]]))


def i13(s, d):
    return rounded(_design(s, d).agg(*[F.avg(c).alias(c) for c in ("home", "minutes", "purchase", "click")]))


def i14(s, d):
    levels = ["click", "error", "purchase", "signup", "view"]
    h = event_history(s, d).where(F.col("level").isin(levels))
    t = i.fixed_effects(h.select("subject", "value", *i.deviation_columns("level", levels, "view")), "subject", "value", levels[:-1])
    return rounded(s.createDataFrame(i.with_omitted(t, levels[:-1], "view")))


def i15(s, d):
    return s.createDataFrame(i.fixed_effects(_design(s, d), "subject", "value", ["home", "minutes", "purchase", "click"]))


def i16(s, d):
    h = order_history(s, d).withColumn("x", F.date_diff("d", F.lit("1995-01-01").cast("date")) / 365.25)
    return rounded(i.trend(h, "subject", "x", "value").select("subject", "n", "slope", "intercept", "residual_std"), 3)


def i18(s, d):
    h = event_history(s, d).withColumn("a", F.abs(F.col("value") - w.lagged_mean("value", "subject", 5))).withColumn("b", F.abs(F.col("value") - w.lagged_mean("value", "subject", 20))).where("a IS NOT NULL")
    return i.paired_bootstrap(h, "subject", "a", "b")


def i19(s, d):
    t = a.pair_sums(duel_history(s, d), ["subject", "position"], "value", "exposure")
    t = t.select("subject", "position", F.try_divide("s", "m").alias("r"), (1 / F.nullif(a.ratio_variance(), F.lit(0.0))).alias("n")).withColumn("one", F.lit(1.0)).where("n IS NOT NULL")
    x = t.join(F.broadcast(i.prior_variance(t, ["position"], "r", "n", "one")), "position")  # a row a position
    wt = i.shrink_weight(F.col("n"), F.lit(1.0), F.col("tau2"))
    return rounded(x.select("subject", "position", F.greatest(i.shrunk(F.col("r"), F.col("league"), wt) / F.col("league"), F.lit(0.05)).alias("multiplier")), 5)


def i20(s, d):
    return rounded(event_history(s, d).groupBy("subject").agg(F.count("*").alias("n")).select("subject", i.effective_n(F.col("n"), 10).alias("n_eff")))


_SP = f"""(SELECT subject, avg(value) FILTER (level = 'purchase') AS m1, stddev_samp(value) FILTER (level = 'purchase') AS s1, count(value) FILTER (level = 'purchase') AS n1,
 avg(value) FILTER (level <> 'purchase') AS m2, stddev_samp(value) FILTER (level <> 'purchase') AS s2, count(value) FILTER (level <> 'purchase') AS n2, avg(value) AS m, stddev_samp(value) AS sd, count(value) AS n FROM {E} GROUP BY subject)"""
_WELCH = f"""(SELECT *, CASE WHEN n1 >= 2 AND n2 >= 2 AND s1 * s1 / n1 + s2 * s2 / n2 > 0 THEN (m1 - m2) / sqrt(s1 * s1 / n1 + s2 * s2 / n2) END AS t,
 CASE WHEN n1 >= 2 AND n2 >= 2 AND s1 * s1 / n1 + s2 * s2 / n2 > 0 THEN pow(s1 * s1 / n1 + s2 * s2 / n2, 2) / (pow(s1 * s1 / n1, 2) / (n1 - 1) + pow(s2 * s2 / n2, 2) / (n2 - 1)) END AS df FROM {_SP})"""
_TAU = f"""(SELECT subject, CASE WHEN count(*) >= 3 THEN greatest(0, var_samp(m) - avg(w / n)) END AS tau2 FROM (SELECT subject, level, count(value) AS n, avg(value) AS m FROM {E} GROUP BY ALL) JOIN (SELECT subject, var_samp(value) AS w FROM {E} GROUP BY 1) USING (subject) GROUP BY subject)"""
_CH = f"""(SELECT *, a - b AS diff, sqrt(sb * sb + sa * sa) AS se FROM (SELECT subject, avg(value) FILTER (month(d) <= 6) AS b, avg(value) FILTER (month(d) > 6) AS a, stddev_samp(value) FILTER (month(d) <= 6) / sqrt(count(value) FILTER (month(d) <= 6)) AS sb,
 stddev_samp(value) FILTER (month(d) > 6) / sqrt(count(value) FILTER (month(d) > 6)) AS sa FROM {O} GROUP BY subject) WHERE a IS NOT NULL AND b IS NOT NULL)"""

#: The exponent of the normal tail, as a sum of powers.
_POLY = " + ".join(f"({c} * pow(t, {k}))" for k, c in enumerate(ERFC))

QUERIES = [
    Query("i1_welch", i1, f"SELECT subject, round(t, 6) AS t, round(df, 6) AS df FROM {_WELCH}"),
    Query("i2_welch_p", i2, f"""SELECT subject, round(CASE WHEN n1 >= 2 AND n2 >= 2 AND s1 = 0 AND s2 = 0 THEN CASE WHEN m1 = m2 THEN 1.0 ELSE 0.0 END WHEN t IS NOT NULL THEN {t_tail_sql("t", "df")} END, 6) AS p FROM {_WELCH}"""),
    Query("i5_shrunk_estimate", i5, f"""WITH a AS (SELECT subject, avg(value) FILTER (level = 'purchase') AS m, count(value) FILTER (level = 'purchase') AS n, avg(value) AS b, stddev_samp(value) AS s FROM {E} GROUP BY 1),
      w AS (SELECT *, CASE WHEN n <= 0 THEN 0.0 WHEN s * s <= 0 THEN 1.0 WHEN subject % 5 = 0 THEN 0.0 ELSE 25.0 / (25.0 + s * s / n) END AS w FROM a)
      SELECT subject, round(m - b, 6) AS diff, round(CASE WHEN b <> 0 THEN (m - b) / abs(b) * 100 END, 6) AS pct, round(CASE WHEN n >= 1 AND s > 0 THEN (m - b) / (s / sqrt(n)) END, 6) AS z, round(w, 6) AS weight, round(b + w * (m - b), 6) AS shrunk FROM w"""),
    Query("i3_bootstrap_ci", i3),
    Query("i4_prior_variance", i4, f"SELECT subject, round(tau2, 6) AS tau2 FROM {_TAU}"),
    Query("i6_split_vs_baseline", i6, f"""WITH x AS (SELECT *, CASE WHEN n1 <= 0 THEN 0.0 WHEN sd * sd <= 0 THEN 1.0 WHEN tau2 IS NULL OR tau2 <= 0 THEN 0.0 ELSE tau2 / (tau2 + sd * sd / n1) END AS w FROM {_WELCH} LEFT JOIN {_TAU} USING (subject))
      SELECT subject, n1 AS n, round(m1, 6) AS mean, round(m, 6) AS baseline, n AS n_baseline, round(m1 - m, 6) AS diff, round(CASE WHEN m <> 0 THEN (m1 - m) / abs(m) * 100 END, 6) AS pct, round(CASE WHEN n1 >= 1 AND sd > 0 THEN (m1 - m) / (sd / sqrt(n1)) END, 6) AS z,
       round(t, 6) AS t, round(df, 6) AS df, round(tau2, 6) AS tau2, round(w, 6) AS weight, round(m + w * (m1 - m), 6) AS shrunk, CASE WHEN n1 >= 25 THEN 'high' WHEN n1 >= 10 THEN 'medium' ELSE 'low' END AS confidence FROM x"""),
    Query("i7_change_interval", i7, f"SELECT subject, round(diff, 3) AS diff, round(se, 3) AS se, round(diff - 1.959963984540054 * se, 3) AS low, round(diff + 1.959963984540054 * se, 3) AS high, diff > 0 AS improved FROM {_CH}"),
    Query("i7_change_p", i7_p, f"SELECT subject, round(CASE WHEN z IS NOT NULL THEN {normal_tail_sql('z')} END, 6) AS p FROM (SELECT subject, diff / nullif(se, 0) AS z FROM {_CH})"),
    Query("i8_q_values", i8, f"""WITH z AS (SELECT subject, abs(diff / nullif(se, 0)) / sqrt(2.0) AS z FROM {_CH}), t AS (SELECT subject, z, 1 / (1 + z / 2) AS t FROM z), x AS (SELECT subject, round(t * exp({_POLY} - z * z), 9) AS p FROM t), r AS (SELECT *, count(p) OVER () AS m, row_number() OVER (ORDER BY p NULLS LAST, subject) AS r FROM x)
      SELECT subject, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 6) AS q_value FROM r"""),
    Query("i9_shrunk_changes", i9, f"""WITH c AS (SELECT subject, diff, 1 / (se * se) AS n FROM {_CH} WHERE se > 0), g AS (SELECT CASE WHEN count(*) >= 3 THEN greatest(0, var_samp(diff) - avg(1 / n)) END AS tau2, avg(diff) AS league FROM c),
      x AS (SELECT *, CASE WHEN tau2 IS NULL OR tau2 <= 0 THEN 0.0 ELSE tau2 / (tau2 + 1 / n) END AS w FROM c CROSS JOIN g) SELECT subject, round(w, 4) AS weight, round(league + w * (diff - league), 4) AS shrunk FROM x"""),
    Query("i10_detail_views", i10, f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, event_id DESC) AS b FROM {E}), v(view, k) AS (VALUES ('all', 1000000000), ('last_10', 10), ('last_20', 20))
      SELECT subject, view, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value) / sum(exposure) * 36, 6) AS per_36 FROM h JOIN v ON b <= k GROUP BY ALL"""),
    Query("i11_within", i11, f"SELECT event_id, round(value - avg(value) OVER (PARTITION BY subject), 3) AS value_w FROM {O}"),
    Query("i12_fixed_effects", i12, f"""WITH x AS (SELECT subject, value - avg(value) OVER p AS y, exposure - avg(exposure) OVER p AS x, count(*) OVER p AS k FROM {E} WINDOW p AS (PARTITION BY subject))
      SELECT 'minutes' AS variable, round(sum(x * y) / sum(x * x), 6) AS coef, count(*) AS n, count(DISTINCT subject) AS groups FROM x WHERE k > 1"""),
    Query("i13_design_columns", i13, f"SELECT round(avg(CASE WHEN home THEN 1.0 ELSE 0 END), 6) AS home, round(avg(exposure), 6) AS minutes, round(avg(CASE WHEN level = 'purchase' THEN 1.0 ELSE 0 END), 6) AS purchase, round(avg(CASE WHEN level = 'click' THEN 1.0 ELSE 0 END), 6) AS click FROM {E}"),
    Query("i14_omitted_level", i14),
    Query("i15_variable_effects", i15),
    Query("i16_linear_trend", i16, f"""WITH h AS (SELECT subject, (d - DATE '1995-01-01') / 365.25 AS x, value AS y FROM {O})
      SELECT subject, count(*) AS n, round(CASE WHEN regr_sxx(y, x) > 0 THEN regr_slope(y, x) END, 3) AS slope, round(CASE WHEN regr_sxx(y, x) > 0 THEN regr_intercept(y, x) END, 3) AS intercept,
       round(CASE WHEN count(*) >= 3 AND regr_sxx(y, x) > 0 THEN sqrt(greatest(0, regr_syy(y, x) - regr_slope(y, x) * regr_slope(y, x) * regr_sxx(y, x)) / (count(*) - 2)) END, 3) AS residual_std FROM h GROUP BY subject"""),
    Query("i18_paired_bootstrap", i18),
    Query("i19_pair_multipliers", i19, f"""WITH g AS (SELECT subject, position, count(*) AS k, sum(value) AS s, sum(exposure) AS m, sum(value * value) AS s2, sum(value * exposure) AS sm, sum(exposure * exposure) AS m2 FROM {D} GROUP BY ALL),
      t AS (SELECT subject, position, s / m AS r, 1 / nullif(greatest(0, s2 - 2 * (s / m) * sm + (s / m) * (s / m) * m2) / (m * m), 0) AS n FROM g), u AS (SELECT * FROM t WHERE n IS NOT NULL),
      p AS (SELECT position, CASE WHEN count(*) >= 3 THEN greatest(0, var_samp(r) - avg(1 / n)) END AS tau2, avg(r) AS league FROM u GROUP BY position),
      x AS (SELECT *, CASE WHEN tau2 IS NULL OR tau2 <= 0 THEN 0.0 ELSE tau2 / (tau2 + 1 / n) END AS w FROM u JOIN p USING (position)) SELECT subject, position, round(greatest((league + w * (r - league)) / league, 0.05), 5) AS multiplier FROM x"""),
    Query("i20_effective_n", i20, f"SELECT subject, round(pow((1 - pow(pow(0.5, 0.1), n)) / (1 - pow(0.5, 0.1)), 2) / ((1 - pow(pow(0.5, 0.2), n)) / (1 - pow(0.5, 0.2))), 6) AS n_eff FROM (SELECT subject, count(*) AS n FROM {E} GROUP BY 1)"),
]
