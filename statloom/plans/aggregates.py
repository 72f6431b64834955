"""Queries of the aggregations (A, T rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..operators import windows as w
from ..sources.roles import DUEL_HISTORY_SQL, EVENT_HISTORY_SQL, ORDER_HISTORY_SQL, duel_history, event_history, order_history
from .base import Query, rounded

E, O, D = EVENT_HISTORY_SQL, ORDER_HISTORY_SQL, DUEL_HISTORY_SQL


def a1(s, d):
    return rounded(event_history(s, d).groupBy("subject").agg(*a.sample_stats("value", "exposure")))


def a2(s, d):
    return rounded(duel_history(s, d).groupBy("subject").agg(*a.ratio_stats("part", "value")))


def a3(s, d):
    return rounded(a.split_stats(event_history(s, d), ["subject"], F.col("level") == "purchase", "value"))


def a4(s, d):
    return rounded(a.level_splits(event_history(s, d), "subject", "level", "value").withColumn("var", F.round("var", 9)).withColumn("rest_var", F.round("rest_var", 9)), 9)


def a5(s, d):
    return rounded(event_history(s, d).groupBy("subject").agg(*a.hit_rates("value", F.lit(50.0))))


def a6(s, d):
    t = duel_history(s, d).groupBy("opponent", "season", "position").agg(F.sum("value").alias("value"), F.sum("exposure").alias("exposure"))
    return rounded(t, 2)


def a7(s, d):
    return rounded(duel_history(s, d).groupBy("opponent").agg(a.weighted_mean("value", "exposure").alias("mean_value")), 8)


def a8(s, d):
    h = event_history(s, d)
    source = F.when(F.col("exposure") >= 70, "best").when(F.col("exposure") >= 30, "proxy").otherwise("fallback")
    return h.groupBy(source.alias("source")).agg(F.count("*").alias("n"))


def a11(s, d):
    return rounded(duel_history(s, d).groupBy("subject").agg(*a.ratio_with_error("part", "value"), F.avg("value").alias("mean"), F.try_divide(F.stddev_samp("value"), F.sqrt(F.count("value").cast("double"))).alias("mean_se")), 5)


def _changes(s, d, by):
    h = order_history(s, d)
    return a.period_changes(h, by, F.month("d") <= 6, F.month("d") > 6, "value")


def a12(s, d):
    return rounded(_changes(s, d, ["subject", "season"]), 4)


def a13(s, d):
    return rounded(a.averaged_changes(_changes(s, d, ["subject", "season"]), ["subject"]), 6)


def a14(s, d):
    own = _changes(s, d, ["subject", "season"]).select("subject", "season", "diff")
    league = _changes(s, d, ["season"]).select("season", F.col("diff").alias("league_diff"))
    return rounded(own.join(F.broadcast(league), "season").withColumn("adjusted", F.col("diff") - F.col("league_diff")), 4)


def a15(s, d):
    return a.stints(order_history(s, d), "subject", "level", "season")


def a16(s, d):
    h = order_history(s, d)
    last = F.max_by("level", F.struct("ts", "event_id"))
    return h.groupBy("subject").agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.count("*").alias("games"), last.alias("last_level"))


def a17(s, d):
    h = order_history(s, d)
    eras = h.groupBy("subject", "level").agg(F.min("season").alias("first"), F.max("season").alias("last"))
    hist = eras.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("first", "last", "level"))).alias("h"))
    return hist.select("subject", F.concat_ws(";", F.transform("h", lambda x: F.concat_ws(":", x["level"], x["first"], x["last"]))).alias("history"))


def a18(s, d):
    return a.modal_value(event_history(s, d), "subject", "level")


def a19(s, d):
    t = a.pair_sums(duel_history(s, d), ["subject", "position"], "value", "exposure")
    return rounded(t.select("subject", "position", "k", F.try_divide("s", "m").alias("ratio"), a.ratio_variance().alias("var")), 4)


def a20(s, d):
    return rounded(order_history(s, d).groupBy("season").agg(F.avg("value").alias("mean"), F.min("d").alias("opener")), 4)


def a21(s, d):
    return rounded(a.churn(event_history(s, d), "subject", ["level"], "d", F.lit("2024-01-22").cast("date"), "exposure", 14))


def a22(s, d):
    h = order_history(s, d).withColumn("month", F.month("d"))
    own = h.groupBy("subject", "month").agg(*a.mean_with_error("value"))
    # the league's curve, scaled to each subject's own mean
    month = h.groupBy("month").agg(F.avg("value").alias("lm"))
    mean = h.groupBy("subject").agg(F.avg("value").alias("sm"))
    league = h.agg(F.avg("value").alias("la"))
    j = own.join(F.broadcast(month), "month").join(mean, "subject").crossJoin(F.broadcast(league))
    return rounded(j.select("subject", "month", "n", "value", "se", (F.col("lm") * F.col("sm") / F.col("la")).alias("league_curve")), 4)


def _forecast(s, d):
    h = event_history(s, d).withColumn("pred", w.lagged_mean("value", "subject", 20)).where("pred IS NOT NULL")
    h = h.withColumn("p", F.percent_rank().over(Window.partitionBy("level").orderBy("value", "event_id")))
    return h.withColumn("outcome", (F.col("exposure") >= 50).cast("double")).withColumn("lo", F.col("pred") - 40).withColumn("hi", F.col("pred") + 40)


_F_SQL = f"""(SELECT *, percent_rank() OVER (PARTITION BY level ORDER BY value, event_id) AS p, CASE WHEN exposure >= 50 THEN 1.0 ELSE 0.0 END AS outcome, pred - 40 AS lo, pred + 40 AS hi
 FROM (SELECT *, avg(value) OVER (PARTITION BY subject ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS pred FROM {E}) WHERE pred IS NOT NULL)"""


def a23(s, d):
    return rounded(_forecast(s, d).groupBy("level").agg(*a.point_scores("pred", "value"), *a.probability_scores("p", "outcome"), *a.interval_scores("lo", "hi", "value")))


def a24(s, d):
    return rounded(a.calibration_bins(_forecast(s, d), "p", "outcome", by=["level"]))


def a24_ece(s, d):
    return rounded(a.calibration_error(a.calibration_bins(_forecast(s, d), "p", "outcome", by=["level"]), ["level"]))


def a25(s, d):
    return rounded(_forecast(s, d).groupBy("level").agg(*[a.pinball("value", "pred", q).alias(f"pinball_{int(q * 100)}") for q in (0.1, 0.5, 0.9)]))


def a26(s, d):
    t = _forecast(s, d)
    return rounded(t.rollup("season").agg(*a.point_scores("pred", "value"), F.count("*").alias("n")))


def a28(s, d):
    out = None
    for t in ("orders", "lineitem", "events", "customer"):
        own = s.read.parquet(f"{d}/{t}.parquet").agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def a29(s, d):
    h = event_history(s, d)
    tests = {"purchase": F.col("level") == "purchase", "home": F.col("home"), "late": F.col("season") >= 1}
    marks = F.array(*[F.struct(F.lit(k).alias("filter"), F.coalesce(v, F.lit(False)).alias("m")) for k, v in tests.items()])
    long = h.select("subject", "value", F.explode(marks).alias("x"))
    g = long.groupBy("subject", F.col("x.filter").alias("filter")).agg(F.count(F.when(F.col("x.m"), F.col("value"))).alias("n"), F.avg(F.when(F.col("x.m"), F.col("value"))).alias("mean"), F.avg("value").alias("base"))
    return rounded(g.select("subject", "filter", "n", (F.col("mean") - F.col("base")).alias("effect")))


def t1(s, d):
    c = _changes(s, d, ["subject"]).where("n_before >= 3 AND n_after >= 3")
    return rounded(c.select("subject", "diff").orderBy(F.desc("diff"), "subject").limit(25), 4)


def t4(s, d):
    h = order_history(s, d)
    r = F.row_number().over(Window.partitionBy("subject", "season").orderBy(F.desc("value"), "event_id"))
    return h.withColumn("r", r).where("r = 1").select("subject", "season", "event_id")


def t5(s, d):
    h = order_history(s, d)
    top = h.groupBy("subject", "position").agg(F.max(F.struct("ts", "event_id", "value")).alias("x"))
    return top.select("subject", "position", F.col("x.event_id").alias("event_id"))


def t6(s, d):
    h = event_history(s, d).withColumn("back", w.recent_rank("subject")).where("back <= 20")
    return h.groupBy("subject").agg((F.floor(F.avg("value")) + 0.5).cast("double").alias("line"))


P = "month(d) <= 6"
_CH = """SELECT {by}, count(value) FILTER (month(d) <= 6) AS n_before, count(value) FILTER (month(d) > 6) AS n_after, avg(value) FILTER (month(d) <= 6) AS before, avg(value) FILTER (month(d) > 6) AS after,
 stddev_samp(value) FILTER (month(d) <= 6) / sqrt(count(value) FILTER (month(d) <= 6)) AS se_before, stddev_samp(value) FILTER (month(d) > 6) / sqrt(count(value) FILTER (month(d) > 6)) AS se_after FROM {h} GROUP BY {by}"""


def _ch(by: str) -> str:
    return f"(SELECT *, after - before AS diff, sqrt(se_before * se_before + se_after * se_after) AS se FROM ({_CH.format(by=by, h=O)}) WHERE n_before > 0 AND n_after > 0)"


def _stats(prefix: str, where: str) -> str:
    f = f"FILTER ({where})"
    return f"count(value) {f} AS {prefix}n, round(avg(value) {f}, 6) AS {prefix}mean, round(quantile_cont(value, 0.5) {f}, 6) AS {prefix}median, round(stddev_samp(value) {f}, 6) AS {prefix}std"


QUERIES = [
    Query("a1_sample_stats", a1, f"SELECT subject, {_stats('', 'true')}, round(sum(value) / sum(exposure) * 36, 6) AS rate FROM {E} GROUP BY subject"),
    Query("a2_pooled_ratio", a2, f"SELECT subject, round(sum(part) / sum(value) * 100, 6) AS pooled, round(avg(CASE WHEN value > 0 THEN part / value END) * 100, 6) AS mean_of_rows FROM {D} GROUP BY subject"),
    Query("a3_split_rest_base", a3, f"SELECT subject, {_stats('split_', chr(39).join(['level = ', 'purchase', '']))}, {_stats('rest_', chr(39).join(['level <> ', 'purchase', '']))}, {_stats('base_', 'true')} FROM {E} GROUP BY subject"),
    Query("a4_level_splits", a4, f"""SELECT a.subject, a.level, a.n, round(a.m, 9) AS mean, round(a.v, 9) AS var, count(b.value) AS rest_n, round(avg(b.value), 9) AS rest_mean, round(var_samp(b.value), 9) AS rest_var
      FROM (SELECT subject, level, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM {E} GROUP BY ALL) a LEFT JOIN {E} b ON a.subject = b.subject AND a.level <> b.level GROUP BY a.subject, a.level, a.n, a.m, a.v"""),
    Query("a5_hit_rates", a5, f"SELECT subject, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS over, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0 END), 6) AS under, round(avg(CASE WHEN value = 50 THEN 1.0 ELSE 0 END), 6) AS push FROM {E} GROUP BY subject"),
    Query("a6_group_totals", a6, f"SELECT opponent, season, position, round(sum(value), 2) AS value, round(sum(exposure), 2) AS exposure FROM {D} GROUP BY ALL"),
    Query("a7_weighted_mean", a7, f"SELECT opponent, round(sum(value * exposure) / sum(exposure), 8) AS mean_value FROM {D} GROUP BY opponent"),
    Query("a8_source_counts", a8, f"SELECT CASE WHEN exposure >= 70 THEN 'best' WHEN exposure >= 30 THEN 'proxy' ELSE 'fallback' END AS source, count(*) AS n FROM {E} GROUP BY 1"),
    Query("a11_ratio_error", a11, f"""WITH g AS (SELECT subject, count(*) AS n, sum(part) / sum(value) AS r, sum(value) AS v, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS mean_se,
       sum(part * part) AS nn, sum(part * value) AS nd, sum(value * value) AS dd FROM {D} GROUP BY subject)
      SELECT subject, n, round(r * 100, 5) AS value, round(CASE WHEN n > 1 THEN sqrt(greatest(0, nn - 2 * r * nd + r * r * dd) * n / (n - 1)) / v END * 100, 5) AS se, round(mean, 5) AS mean, round(mean_se, 5) AS mean_se FROM g"""),
    Query("a12_period_changes", a12, f"SELECT subject, season, n_before, n_after, round(before, 4) AS before, round(after, 4) AS after, round(se_before, 4) AS se_before, round(se_after, 4) AS se_after, round(diff, 4) AS diff, round(se, 4) AS se FROM {_ch('subject, season')}"),
    Query("a13_averaged_changes", a13, f"""SELECT subject, count(*) AS seasons, round(avg(diff), 6) AS diff, round(sqrt(sum(coalesce(se * se, 0))) / count(*), 6) AS se, round(sum(diff / (se * se)) FILTER (se > 0) / sum(1 / (se * se)) FILTER (se > 0), 6) AS weighted_diff,
      round(1 / sqrt(sum(1 / (se * se)) FILTER (se > 0)), 6) AS weighted_se, CAST(sum(CASE WHEN diff > 0 THEN 1 ELSE 0 END) AS BIGINT) AS improved FROM {_ch('subject, season')} GROUP BY subject"""),
    Query("a14_league_adjusted", a14, f"SELECT x.subject, x.season, round(x.diff, 4) AS diff, round(y.diff, 4) AS league_diff, round(x.diff - y.diff, 4) AS adjusted FROM {_ch('subject, season')} x JOIN {_ch('season')} y ON x.season = y.season"),
    Query("a15_stints", a15, f"SELECT subject, level, min(season) AS first_season, max(season) AS last_season, count(*) AS games FROM {O} GROUP BY ALL"),
    Query("a16_subject_lookup", a16, f"SELECT subject, min(season) AS first_season, max(season) AS last_season, count(*) AS games, arg_max(level, (ts, event_id)) AS last_level FROM {O} GROUP BY subject"),
    Query("a17_era_history", a17, f"""WITH e AS (SELECT subject, level, min(season) AS f, max(season) AS l FROM {O} GROUP BY ALL)
      SELECT subject, string_agg(level || ':' || f || ':' || l, ';' ORDER BY f, l, level) AS history FROM e GROUP BY subject"""),
    Query("a18_modal_level", a18, f"WITH c AS (SELECT subject, level, count(*) AS n FROM {E} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, level) AS r FROM c) SELECT subject, level AS mode FROM r WHERE r = 1"),
    Query("a19_pair_ratio_variance", a19, f"""WITH g AS (SELECT subject, position, count(*) AS k, sum(value) AS s, sum(exposure) AS m, sum(value * value) AS s2, sum(value * exposure) AS sm, sum(exposure * exposure) AS m2 FROM {D} GROUP BY ALL)
      SELECT subject, position, k, round(s / m, 4) AS ratio, round(greatest(0, s2 - 2 * (s / m) * sm + (s / m) * (s / m) * m2) / (m * m), 4) AS var FROM g"""),
    Query("a20_season_means", a20, f"SELECT season, round(avg(value), 4) AS mean, min(d) AS opener FROM {O} GROUP BY season"),
    Query("a21_churn", a21, f"""WITH x AS (SELECT *, d > DATE '2024-01-22' AS aft, d <= DATE '2024-01-08' AS early FROM {E}), h AS (SELECT level, bool_or(early) AS has FROM x GROUP BY level),
      k AS (SELECT DISTINCT level, subject FROM x JOIN h USING (level) WHERE CASE WHEN has THEN early ELSE NOT aft END)
      SELECT x.level, round(sum(CASE WHEN k.subject IS NULL THEN exposure ELSE 0 END) / sum(exposure), 6) AS churn FROM x LEFT JOIN k ON x.level = k.level AND x.subject = k.subject WHERE aft GROUP BY x.level"""),
    Query("a22_monthly_trend", a22, f"""WITH h AS (SELECT *, CAST(month(d) AS INTEGER) AS month FROM {O}), m AS (SELECT month, avg(value) AS lm FROM h GROUP BY month), s AS (SELECT subject, avg(value) AS sm FROM h GROUP BY subject), l AS (SELECT avg(value) AS la FROM h),
      o AS (SELECT subject, month, count(value) AS n, avg(value) AS v, stddev_samp(value) / sqrt(count(value)) AS se FROM h GROUP BY ALL)
      SELECT o.subject, o.month, n, round(v, 4) AS value, round(se, 4) AS se, round(lm * sm / la, 4) AS league_curve FROM o JOIN m USING (month) JOIN s USING (subject) CROSS JOIN l"""),
    Query("a23_backtest_scores", a23, f"""SELECT level, round(avg(abs(pred - value)), 6) AS mae, round(sqrt(avg((pred - value) * (pred - value))), 6) AS rmse, round(avg((p - outcome) * (p - outcome)), 6) AS brier,
      round(avg(-(outcome * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - outcome) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) AS log_loss, round(avg(CASE WHEN value BETWEEN lo AND hi THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(hi - lo), 6) AS width FROM {_F_SQL} GROUP BY level"""),
    Query("a24_calibration_bins", a24, f"SELECT level, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(outcome), 6) AS actual FROM {_F_SQL} GROUP BY ALL"),
    Query("a24_calibration_error", a24_ece, f"SELECT level, round(sum(n * abs(p - o)) / sum(n), 6) AS ece FROM (SELECT level, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS p, avg(outcome) AS o FROM {_F_SQL} GROUP BY ALL) GROUP BY level"),
    Query("a25_pinball", a25, f"SELECT level, {', '.join(f'round(avg(greatest({q} * (value - pred), ({q} - 1) * (value - pred))), 6) AS pinball_{int(q * 100)}' for q in (0.1, 0.5, 0.9))} FROM {_F_SQL} GROUP BY level"),
    Query("a26_backtest_summary", a26, f"SELECT season, round(avg(abs(pred - value)), 6) AS mae, round(sqrt(avg((pred - value) * (pred - value))), 6) AS rmse, count(*) AS n FROM {_F_SQL} GROUP BY ROLLUP (season)"),
    Query("a28_fingerprint", a28, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("orders", "lineitem", "events", "customer"))),
    Query("a29_filter_effects", a29, f"""WITH l AS (SELECT subject, value, unnest([{{'f': 'purchase', 'm': level = 'purchase'}}, {{'f': 'home', 'm': home}}, {{'f': 'late', 'm': season >= 1}}]) AS x FROM {E})
      SELECT subject, x.f AS filter, count(value) FILTER (x.m) AS n, round(avg(value) FILTER (x.m) - avg(value), 6) AS effect FROM l GROUP BY subject, x.f"""),
    Query("t1_leaderboard", t1, f"SELECT subject, round(diff, 4) AS diff FROM {_ch('subject')} WHERE n_before >= 3 AND n_after >= 3 ORDER BY diff DESC, subject LIMIT 25".replace("ORDER BY diff DESC", "ORDER BY after - before DESC")),
    Query("t4_best_row", t4, f"SELECT subject, season, event_id FROM (SELECT *, row_number() OVER (PARTITION BY subject, season ORDER BY value DESC, event_id) AS r FROM {O}) WHERE r = 1"),
    Query("t5_newest_row", t5, f"SELECT subject, position, arg_max(event_id, (ts, event_id)) AS event_id FROM {O} GROUP BY ALL"),
    Query("t6_default_line", t6, f"SELECT subject, floor(avg(value)) + 0.5 AS line FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, event_id DESC) AS r FROM {E}) WHERE r <= 20 GROUP BY subject"),
]
