"""Queries of the window operators (W rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as w
from ..sources.roles import EVENT_HISTORY_SQL, ORDER_HISTORY_SQL, event_history, order_history, table
from .base import Query, rounded

E, O = EVENT_HISTORY_SQL, ORDER_HISTORY_SQL


def w1(s, d):
    h = event_history(s, d)
    return rounded(h.select("event_id", *[w.lagged_mean("value", "subject", n).alias(f"mean_{n}") for n in (5, 10, 20)]))


def w2(s, d):
    h = w.lagged_ewm(event_history(s, d), "subject", ["value"], 10)
    return rounded(h.select("event_id", "value_ewm"))


def w3(s, d):
    h = event_history(s, d)
    return rounded(h.select("event_id", w.lagged_sum("value", ["subject", "season"]).alias("sum_before"), w.season_to_date("value", "exposure", ["subject", "season"]).alias("rate_before")), 9)


def w4(s, d):
    h = order_history(s, d).withColumn("one", F.lit(1))
    return rounded(h.select("event_id", w.cumulative_rate("value", "one", ["subject", "season"]).alias("running"), w.game_number(["subject", "season"]).alias("n")))


def w5(s, d):
    from pyspark.sql import Window

    # a level's running rate, shrunk by `prior` units to the league's running rate (ties of time included), relative to it
    t = event_history(s, d).groupBy("level", "d").agg(F.sum("value").alias("v"), F.sum("exposure").alias("e"))
    own = Window.partitionBy("level").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    league = Window.orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    day = t.groupBy("d").agg(F.sum("v").alias("v"), F.sum("e").alias("e")).select("d", (F.sum("v").over(league) / F.sum("e").over(league)).alias("rate"))  # a row a day
    t = t.select("level", "d", F.sum("v").over(own).alias("v"), F.sum("e").over(own).alias("e")).join(day, "d")
    return rounded(t.select("level", "d", ((F.col("v") + 500 * F.col("rate")) / (F.col("e") + 500) / F.col("rate")).alias("factor")))


def w6(s, d):
    h = order_history(s, d).withColumn("days", w.days_since_previous("subject")).withColumn("season_days", w.days_since_previous(["subject", "season"]))
    rest = w.rest_features(F.col("season_days"))
    return h.select("event_id", F.col("days").cast("long").alias("days"), rest["rest_days"].cast("long").alias("rest_days"), rest["back_to_back"].alias("back_to_back"))


def w7(s, d):
    h = event_history(s, d)
    return h.select("event_id", w.game_number(["subject", "season"]).cast("long").alias("game_number"), w.prior_count("subject").cast("long").alias("prior"))


def w8(s, d):
    h = w.lagged_ewm(event_history(s, d), "subject", ["value", "exposure"], 5)
    h = h.withColumn("recent", w.lagged_mean("value", "subject", 5)).withColumn("long", w.lagged_mean("value", "subject", 20))
    return rounded(h.select("event_id", F.try_divide("value_ewm", "exposure_ewm").alias("rate_ewm"), (F.col("recent") - F.col("long")).alias("trend"), w.lagged_mean("exposure", "subject", 10).alias("minutes_10"), w.season_to_date("value", "exposure", ["subject", "season"]).alias("std_rate")), 9)


def w9(s, d):
    h = order_history(s, d)
    t = h.groupBy("level", "season", "d").agg(F.sum("value").alias("own"), F.count("*").alias("event_id")).withColumn("ts", F.col("d"))
    return rounded(t.select("level", "d", w.lagged_mean("own", "level", 7, ["ts"]).alias("mean_7"), w.lagged_sum("own", ["level", "season"], ["ts"]).alias("season_sum")))


def w10(s, d):
    h = order_history(s, d).where("position <> 'P'").withColumn("back", w.recent_rank(["subject", "season"]))
    return h.select("event_id", F.when(F.col("back") <= 5, "after").otherwise("before").alias("period"))


def w11(s, d):
    h = order_history(s, d)
    return w.longest_gap(h, "subject", "d", 3, 400, F.lit(True)).select("subject", "before", "after", F.col("gap").cast("long").alias("gap"))


def w12(s, d):
    from pyspark.sql import Window  # noqa: F401

    h = order_history(s, d)
    mid = w.middle_date(h.select("season", "d"), "season", "d")
    cut = h.join(mid, "season").groupBy("season", "middle").agg(F.max(F.when(F.col("d") <= F.col("middle"), F.col("d"))).alias("last_before"), F.min(F.when(F.col("d") > F.col("middle"), F.col("d"))).alias("first_after"))
    return cut


def w13(s, d):
    return w.season_calendar(order_history(s, d).select("season", "d"))


def w14(s, d):
    """Nations of a region as the teams of a league with two seats; a large order is a win."""
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    games = j.select(F.year("o_orderdate").alias("season"), F.col("n_regionkey").alias("league"), F.col("n_nationkey").alias("team"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") > 150_000).alias("win"))
    return w.standings_flags(games, 2, 2)


def w15(s, d):
    h = event_history(s, d).withColumn("line", F.coalesce(w.lagged_mean("value", "subject", 20), F.lit(50.0)))
    return rounded(w.climatology(h, ["subject", "level"], "value", "line").select("event_id", "share_over"))


def w16(s, d):
    return rounded(w.own_dispersion(event_history(s, d), "subject", "exposure", 0.3).select("event_id", "alpha"))


def w17(s, d):
    return rounded(order_history(s, d).select("event_id", w.trailing_mean("value", "subject", 10).alias("trailing")), 7)


def _p_values(s, d):
    t = event_history(s, d).groupBy("level", "subject").agg(F.avg("value").alias("m"))
    return t.withColumn("p", F.when(F.col("subject") % 7 != 0, F.round(F.abs(F.sin("m")), 9)))


_P_SQL = f"(SELECT level, subject, CASE WHEN subject % 7 <> 0 THEN round(abs(sin(avg(value))), 9) END AS p FROM {E} GROUP BY level, subject)"


def w18(s, d):
    return rounded(w.add_steps(_p_values(s, d), w.holm("p", "level", "subject")).select("level", "subject", "p_holm"))


def w19(s, d):
    return rounded(w.add_steps(_p_values(s, d), w.benjamini_hochberg("p", "level", "subject")).select("level", "subject", "q_value"))


def w21(s, d):
    h = event_history(s, d).withColumn("one", F.lit(1)).withColumn("avg", w.season_to_date("value", "one", ["subject", "season"])).withColumn("n", w.prior_count(["subject", "season"]))
    half, whole = w.synthetic_line(F.col("avg"), F.lit(50.0), F.col("n"))
    return h.select("event_id", half.cast("double").alias("line"), whole.cast("double").alias("whole_line"))


def w22(s, d):
    return w.with_segments(order_history(s, d), "subject", 60).select("event_id", F.col("segment").cast("long").alias("segment"))


def j6(s, d):
    o = order_history(s, d)
    right = o.where("position = 'F'").groupBy("subject", "ts").agg(F.max("value").alias("last_value"))
    return w.as_of_join(o.select("subject", "ts", "event_id"), right, ["subject"], ["last_value"]).select("event_id", "last_value")


def w20(s, d):
    h = w.as_of(event_history(s, d), ["subject", "level"], "value", "last_before")
    return h.select("event_id", "last_before")


S = "PARTITION BY subject ORDER BY ts, event_id"
QUERIES = [
    Query("w1_lagged_mean", w1, f"SELECT event_id, {', '.join(f'round(avg(value) OVER ({S} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS mean_{n}' for n in (5, 10, 20))} FROM {E}"),
    Query("w2_lagged_ewm", w2, f"""WITH a AS (SELECT *, count(value) OVER ({S} ROWS UNBOUNDED PRECEDING) AS i FROM {E})
      SELECT event_id, round(sum(value * pow(2.0, i / 10.0)) OVER b / sum(pow(2.0, i / 10.0)) OVER b, 6) AS value_ewm FROM a WINDOW b AS ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    Query("w3_season_to_date", w3, f"""SELECT event_id, round(coalesce(sum(value) OVER b, 0), 9) AS sum_before, round(CASE WHEN sum(exposure) OVER b > 0 THEN sum(value) OVER b / sum(exposure) OVER b END, 9) AS rate_before
      FROM {E} WINDOW b AS (PARTITION BY subject, season ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    Query("w4_cumulative_rate", w4, f"SELECT event_id, round(avg(value) OVER b, 6) AS running, CAST(row_number() OVER b AS INTEGER) AS n FROM {O} WINDOW b AS (PARTITION BY subject, season ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"),
    Query("w5_shrunk_factor", w5, f"""WITH t AS (SELECT level, d, sum(value) AS v, sum(exposure) AS e FROM {E} GROUP BY level, d),
      y AS (SELECT d, sum(sum(v)) OVER (ORDER BY d) / sum(sum(e)) OVER (ORDER BY d) AS rate FROM t GROUP BY d),
      c AS (SELECT level, d, sum(v) OVER b AS v, sum(e) OVER b AS e FROM t WINDOW b AS (PARTITION BY level ORDER BY d ROWS UNBOUNDED PRECEDING))
      SELECT level, d, round((v + 500 * rate) / (e + 500) / rate, 6) AS factor FROM c JOIN y USING (d)"""),
    Query("w6_rest_days", w6, f"""WITH a AS (SELECT event_id, d - lag(d) OVER ({S}) AS days, d - lag(d) OVER (PARTITION BY subject, season ORDER BY ts, event_id) AS sd FROM {O})
      SELECT event_id, days, sd - 1 AS rest_days, coalesce(sd = 1, false) AS back_to_back FROM a"""),
    Query("w7_game_number", w7, f"SELECT event_id, row_number() OVER (PARTITION BY subject, season ORDER BY ts, event_id) AS game_number, row_number() OVER ({S}) - 1 AS prior FROM {E}"),
    Query("w8_history_block", w8, f"""WITH a AS (SELECT *, count(value) OVER ({S} ROWS UNBOUNDED PRECEDING) AS i, count(exposure) OVER ({S} ROWS UNBOUNDED PRECEDING) AS j FROM {E})
      SELECT event_id, round((sum(value * pow(2.0, i / 5.0)) OVER b / sum(pow(2.0, i / 5.0)) OVER b) / nullif(sum(exposure * pow(2.0, j / 5.0)) OVER b / sum(pow(2.0, j / 5.0)) OVER b, 0), 9) AS rate_ewm,
       round(avg(value) OVER ({S} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) - avg(value) OVER ({S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 9) AS trend,
       round(avg(exposure) OVER ({S} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 9) AS minutes_10,
       round(CASE WHEN sum(exposure) OVER c > 0 THEN sum(value) OVER c / sum(exposure) OVER c END, 9) AS std_rate
      FROM a WINDOW b AS ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c AS (PARTITION BY subject, season ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    Query("w9_group_history", w9, f"""WITH t AS (SELECT level, season, d, sum(value) AS own FROM {O} GROUP BY level, season, d)
      SELECT level, d, round(avg(own) OVER (PARTITION BY level ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS mean_7,
       round(coalesce(sum(own) OVER (PARTITION BY level, season ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS season_sum FROM t"""),
    Query("w10_last_n_period", w10, f"SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY subject, season ORDER BY ts DESC, event_id DESC) <= 5 THEN 'after' ELSE 'before' END AS period FROM {O} WHERE position <> 'P'"),
    Query("w11_longest_gap", w11, f"""WITH a AS (SELECT DISTINCT subject, d FROM {O}), b AS (SELECT *, lag(d) OVER (PARTITION BY subject ORDER BY d) AS before FROM a),
      c AS (SELECT *, d - before AS gap, row_number() OVER (PARTITION BY subject ORDER BY d - before DESC, d) AS r FROM b WHERE d - before BETWEEN 3 AND 400)
      SELECT subject, before, d AS after, gap FROM c WHERE r = 1"""),
    Query("w12_midseason_split", w12, f"""WITH a AS (SELECT season, d, row_number() OVER (PARTITION BY season ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY season) AS n FROM {O}), m AS (SELECT season, d AS middle FROM a WHERE r = n // 2)
      SELECT season, middle, max(d) FILTER (d <= middle) AS last_before, min(d) FILTER (d > middle) AS first_after FROM {O} JOIN m USING (season) GROUP BY season, middle"""),
    Query("w13_season_calendar", w13, f"""WITH a AS (SELECT DISTINCT season, d FROM {O}), b AS (SELECT *, lag(d) OVER (PARTITION BY season ORDER BY d) AS before FROM a),
      c AS (SELECT season, before, row_number() OVER (PARTITION BY season ORDER BY d - before DESC, d) AS r FROM b WHERE d - before BETWEEN 3 AND 8 AND month(d) BETWEEN 1 AND 3),
      x AS (SELECT season, d, row_number() OVER (PARTITION BY season ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY season) AS n FROM {O}), m AS (SELECT season, d AS middle FROM x WHERE r = n // 2),
      e AS (SELECT season, min(d) AS opener, max(d) AS last FROM {O} GROUP BY season)
      SELECT e.season, opener, last, coalesce(before, middle) AS split_date, CASE WHEN before IS NULL THEN 'middle' ELSE 'gap' END AS source FROM e LEFT JOIN c ON c.season = e.season AND c.r = 1 JOIN m ON m.season = e.season"""),
    Query("w14_standings", w14, """WITH g AS (SELECT year(o_orderdate) AS season, n_regionkey AS league, n_nationkey AS team, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice > 150000 AS INTEGER) AS win FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
      t AS (SELECT season, league, team, count(*) AS total FROM g GROUP BY ALL), ds AS (SELECT DISTINCT season, date FROM g), y AS (SELECT season, league, team, date, sum(win) AS w, count(*) AS n FROM g GROUP BY ALL),
      r AS (SELECT t.season, t.league, t.team, ds.date, coalesce(sum(y.w) OVER p, 0) AS w, total - coalesce(sum(y.n) OVER p, 0) AS rest FROM t JOIN ds USING (season) LEFT JOIN y ON y.season = t.season AND y.league = t.league AND y.team = t.team AND y.date = ds.date
        WINDOW p AS (PARTITION BY t.season, t.league, t.team ORDER BY ds.date ROWS UNBOUNDED PRECEDING)),
      k AS (SELECT a.*, (SELECT count(*) FROM t WHERE t.season = a.season AND t.league = a.league) AS teams FROM r a),
      b AS (SELECT a.season, a.team, a.date, any_value(a.w) AS w, any_value(a.rest) AS rest, any_value(a.teams) AS teams, list_sort(list(o.w), 'DESC')[2] AS bar, count(*) FILTER (o.w + o.rest >= a.w) AS can
        FROM k a JOIN k o ON o.season = a.season AND o.league = a.league AND o.date = a.date AND o.team <> a.team GROUP BY a.season, a.team, a.date),
      f AS (SELECT season, team, 'eliminated' AS status, date, rest FROM b WHERE teams > 2 AND w + rest < bar UNION ALL SELECT season, team, 'clinched', date, rest FROM b WHERE teams > 2 AND can <= 1),
      x AS (SELECT *, row_number() OVER (PARTITION BY season, team, status ORDER BY date) AS i FROM f)
      SELECT season, team, status, date, CAST(rest AS BIGINT) AS games_left FROM x WHERE i = 1 AND rest >= 2"""),
    Query("w15_climatology", w15, f"""WITH a AS (SELECT *, coalesce(avg(value) OVER ({S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 50.0) AS line FROM {E})
      SELECT x.event_id, round(coalesce(avg(CASE WHEN y.value > x.line THEN 1.0 ELSE 0.0 END) FILTER (y.event_id IS NOT NULL), 0.5), 6) AS share_over
      FROM a x LEFT JOIN a y ON x.subject = y.subject AND x.level = y.level AND (y.ts < x.ts OR y.ts = x.ts AND y.event_id < x.event_id) GROUP BY x.event_id"""),
    Query("w16_own_dispersion", w16, f"""WITH a AS (SELECT event_id, avg(exposure) OVER b AS m, avg(exposure * exposure) OVER b AS s, least(row_number() OVER ({S}) - 1, 40) AS n FROM {E} WINDOW b AS ({S} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING))
      SELECT event_id, round((n * coalesce(CASE WHEN m * m <> 0 THEN greatest(0.0, (s - m * m - m) / (m * m)) ELSE CASE WHEN m IS NULL THEN NULL ELSE 0.0 END END, 0.3) + 20.0 * 0.3) / (n + 20.0), 6) AS alpha FROM a"""),
    Query("w17_trailing_mean", w17, f"SELECT event_id, round(avg(value) OVER ({S} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 7) AS trailing FROM {O}"),
    Query("w18_holm", w18, f"""WITH a AS (SELECT *, count(p) OVER (PARTITION BY level) AS m, row_number() OVER (PARTITION BY level ORDER BY p NULLS LAST, subject) AS r FROM {_P_SQL})
      SELECT level, subject, round(CASE WHEN p IS NOT NULL THEN least(1.0, max(CASE WHEN p IS NOT NULL THEN p * (m - r + 1) END) OVER (PARTITION BY level ORDER BY r ROWS UNBOUNDED PRECEDING)) END, 6) AS p_holm FROM a"""),
    Query("w19_bh", w19, f"""WITH a AS (SELECT *, count(p) OVER (PARTITION BY level) AS m, row_number() OVER (PARTITION BY level ORDER BY p NULLS LAST, subject) AS r FROM {_P_SQL})
      SELECT level, subject, round(CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / r) OVER (PARTITION BY level ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 6) AS q_value FROM a"""),
    Query("w20_as_of_value", w20, f"SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY subject, level ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_before FROM {E}"),
    Query("w21_synthetic_line", w21, f"""WITH a AS (SELECT event_id, avg(value) OVER b AS m, row_number() OVER (PARTITION BY subject, season ORDER BY ts, event_id) - 1 AS n FROM {E} WINDOW b AS (PARTITION BY subject, season ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      c AS (SELECT event_id, round(CASE WHEN n >= 5 THEN m ELSE 50.0 END, 9) AS base FROM a) SELECT event_id, floor(base) + 0.5 AS line, round_even(base, 0) AS whole_line FROM c"""),
    Query("w22_gap_segments", w22, f"""WITH a AS (SELECT *, CASE WHEN d - lag(d) OVER ({S}) > 60 THEN 1 ELSE 0 END AS cut FROM {O})
      SELECT event_id, CAST(sum(cut) OVER ({S} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM a"""),
    Query("j6_as_of_join", j6, f"""WITH r AS (SELECT subject, ts, max(value) AS last_value FROM {O} WHERE position = 'F' GROUP BY subject, ts)
      SELECT l.event_id, r.last_value FROM {O} l ASOF LEFT JOIN r ON l.subject = r.subject AND l.ts > r.ts"""),
]
