"""Queries of the filters (P rows of the inventory) and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators import joins as j
from ..operators import windows as w
from ..sources.roles import DUEL_HISTORY_SQL, EVENT_HISTORY_SQL, ORDER_HISTORY_SQL, duel_history, event_history, order_history, table
from .base import Query, rounded

E, O, D = EVENT_HISTORY_SQL, ORDER_HISTORY_SQL, DUEL_HISTORY_SQL


def _kept(df, *tests):
    return df.where(f.passing([f.Filter(str(i), t) for i, t in enumerate(tests)])).groupBy("subject").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _kept_sql(h, where):
    return f"SELECT subject, count(*) AS n, round(sum(value), 2) AS total FROM {h} WHERE {where} GROUP BY subject"


def p1(s, d):
    return _kept(f.last_seasons(order_history(s, d), "season", 2))


def p1_range(s, d):
    return _kept(order_history(s, d), f.in_range("season", 1996, 1998))


def p2(s, d):
    return _kept(event_history(s, d), f.one_of("level", ["purchase", "click"]))


def p5(s, d):
    return _kept(event_history(s, d), f.in_range("exposure", 20, 60))


def p9(s, d):
    h = order_history(s, d)
    return _kept(h, f.same_text("level", " 1-URGENT ") | f.same_text("level", "5-low"))


def p11(s, d):
    return _kept(order_history(s, d), f.weekday_in("d", ["Monday", "Friday"]), f.month_in("d", [1, 2, 12]))


def p12(s, d):
    h = order_history(s, d).withColumn("gap", w.days_since_previous("subject"))
    return _kept(h, f.in_range("gap", 5, 60))


def p13(s, d):
    h = event_history(s, d).withColumn("b2b", F.coalesce(w.days_since_previous("subject") == 1, F.lit(False)))
    return _kept(h, F.col("b2b"))


def p16(s, d):
    h = event_history(s, d).where(F.col("level") == "purchase")
    return _kept(f.last_rows(h, "subject", 10))


def _tests():
    return [f.Filter("purchase", F.col("level") == "purchase", 90), f.Filter("home", F.col("home"), 20), f.Filter("long", F.col("exposure") >= 70, 40), f.Filter("late", F.col("season") >= 2, 60)]


def p17(s, d):
    return f.impact(event_history(s, d), ["subject"], _tests())


def p18(s, d):
    return f.suggest_drop(f.impact(event_history(s, d), ["subject"], _tests()), ["subject"])


def p20(s, d):
    h = event_history(s, d).where("exposure > 0")
    return j.newest(h, ["subject", "d"], ["exposure", "event_id"]).select("subject", "d", "event_id")


def p21(s, d):
    li, o = table(s, d, "lineitem"), table(s, d, "orders").where("o_orderstatus <> 'P'")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"], "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def p22(s, d):
    h = order_history(s, d).withColumn("rule", F.year("d") - F.when(F.month("d") < 10, 1).otherwise(0))
    return h.where("season <> rule").groupBy(F.month("d").alias("month")).agg(F.count("*").alias("n"))


def p23(s, d):
    h = event_history(s, d).select(F.when(F.col("exposure") > 50, 1).alias("a"), F.when(F.col("exposure") > 5, 1).alias("b"), "value")
    gone = f.mostly_missing(h, ["a", "b", "value"])
    return s.createDataFrame([(c, c in gone) for c in ("a", "b", "value")], "name string, dropped boolean")


def p26(s, d):
    h = order_history(s, d)
    asked = h.select("subject").distinct().withColumn("level", F.when(F.col("subject") % 2 == 0, "1-URGENT").otherwise("5-LOW"))
    have = h.groupBy("subject", "level").agg(F.max(F.struct("ts", "event_id")).alias("t"))
    bad = asked.join(have, ["subject", "level"], "left_anti").withColumnRenamed("level", "asked")
    return bad.join(have.groupBy("subject").agg(F.max_by("level", "t").alias("instead")), "subject")


def p27(s, d):
    h = event_history(s, d).withColumn("prior", w.prior_count("subject"))
    return _kept(h, F.col("season") >= 2, F.col("prior") >= 5)


def p7(s, d):
    h = event_history(s, d)
    mate = h.where("subject = 3").select(F.col("level"), F.col("d")).distinct()
    return _kept(h.join(mate, ["level", "d"], "left_semi"))


def p7_out(s, d):
    h = event_history(s, d)
    roster = h.select("subject", F.col("d").alias("game"), F.col("level").alias("team"), "season")
    out = j.teammates_out(h.withColumn("game", F.col("d")).withColumn("team", F.col("level")), roster, 3, "game", "team", "season", "subject")
    return _kept(out)


def p3(s, d):
    """Rows of games with enough shared time with opponent 7, or in the same game where a game has no times."""
    h = event_history(s, d)
    shared = h.where("subject = 7").groupBy("d").agg(F.sum("exposure").alias("shared"))
    timed = h.groupBy("d").agg((F.avg("exposure") > 50).alias("timed"))
    x = h.join(F.broadcast(shared), "d", "left").join(F.broadcast(timed), "d")  # a row a day
    return _kept(x.where("subject <> 7"), F.when(F.col("timed"), F.col("shared") >= 60).otherwise(F.col("shared").isNotNull()))


def p6(s, d):
    return _kept(duel_history(s, d), f.one_of("position", ["R", "A"]))


def p8(s, d):
    return _kept(order_history(s, d), f.one_of("position", ["F"]))


def p10(s, d):
    return _kept(event_history(s, d), F.col("home") == F.lit(True))


def p15(s, d):
    return _kept(event_history(s, d), f.in_range("exposure", 30))


def p19(s, d):
    return _kept(order_history(s, d), f.in_range("season", 1994), f.one_of("position", ["F", "O"]))


def p25(s, d):
    context = {"opponent": ["purchase"], "home": True, "rest": None, "minutes": 20}
    given = [f.Filter("minutes", f.in_range("exposure", 40))]
    made = f.of_context(context, {"opponent": lambda v: f.one_of("level", v), "home": lambda v: F.col("home") == v, "rest": lambda v: f.in_range("exposure", v, v), "minutes": lambda v: f.in_range("exposure", v)}, given)
    return _kept(event_history(s, d), *[x.test for x in made])


def u1(s, d):
    li = table(s, d, "lineitem")
    parts = F.explode(F.array(F.struct(F.lit("part").alias("role"), F.col("l_partkey").alias("ref")), F.struct(F.lit("supplier").alias("role"), F.col("l_suppkey").alias("ref"))))
    return li.select(parts.alias("x")).groupBy("x.role", "x.ref").agg(F.count("*").alias("n"))


def u2(s, d):
    h = order_history(s, d)
    ahead = h.groupBy("subject").agg(F.max("ts").alias("ts")).select("subject", F.lit(2_000_000_000).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("ts"))
    both = h.select("subject", "event_id", "ts", "value").unionByName(ahead, allowMissingColumns=True)
    return rounded(both.withColumn("form", w.lagged_mean("value", "subject", 5)).where("event_id = 2000000000").select("subject", "form"), 4)


def u3(s, d):
    h = event_history(s, d)
    return h.where("season >= 2").select("subject", "exposure").distinct().join(h.where("season < 2").select("subject", "exposure").distinct(), ["subject", "exposure"], "left_anti")


def u4(s, d):
    h = order_history(s, d)
    a = h.where("season <= 1997").groupBy("subject").agg(F.collect_set("level").alias("a"))
    b = h.where("season > 1997").groupBy("subject").agg(F.collect_set("level").alias("b"))
    both = F.array_sort(F.array_union("a", F.coalesce("b", F.array().cast("array<string>"))))
    return a.join(b, "subject", "left").select("subject", F.concat_ws(",", both).alias("levels"))


_IMPACT = f"""(WITH h AS (SELECT subject, level = 'purchase' AS a, home AS b, exposure >= 70 AS c, season >= 2 AS e FROM {E}),
 g AS (SELECT subject, count(*) FILTER (a AND b AND c AND e) AS n_all, count(*) FILTER (a) AS fa, count(*) FILTER (b) AS fb, count(*) FILTER (c) AS fc, count(*) FILTER (e) AS fe,
  count(*) FILTER (b AND c AND e) AS da, count(*) FILTER (a AND c AND e) AS db, count(*) FILTER (a AND b AND e) AS dc, count(*) FILTER (a AND b AND c) AS de FROM h GROUP BY subject)
 SELECT subject, n_all, 'purchase' AS filter, 90 AS importance, fa AS n_alone, da AS n_if_dropped FROM g UNION ALL SELECT subject, n_all, 'home', 20, fb, db FROM g
 UNION ALL SELECT subject, n_all, 'long', 40, fc, dc FROM g UNION ALL SELECT subject, n_all, 'late', 60, fe, de FROM g)"""

QUERIES = [
    Query("p1_last_seasons", p1, _kept_sql(O, f"season > (SELECT max(season) FROM {O}) - 2")),
    Query("p1_season_range", p1_range, _kept_sql(O, "season BETWEEN 1996 AND 1998")),
    Query("p2_one_of", p2, _kept_sql(E, "level IN ('purchase', 'click')")),
    Query("p3_shared_floor", p3, _kept_sql(f"""(SELECT h.*, m.shared, t.timed FROM {E} h LEFT JOIN (SELECT d, sum(exposure) AS shared FROM {E} WHERE subject = 7 GROUP BY d) m USING (d) JOIN (SELECT d, avg(exposure) > 50 AS timed FROM {E} GROUP BY d) t USING (d))""", "subject <> 7 AND CASE WHEN timed THEN shared >= 60 ELSE shared IS NOT NULL END")),
    Query("p6_opponent_position", p6, _kept_sql(D, "position IN ('R', 'A')")),
    Query("p8_own_position", p8, _kept_sql(O, "position = 'F'")),
    Query("p10_home_away", p10, _kept_sql(E, "home")),
    Query("p15_least_minutes", p15, _kept_sql(E, "exposure >= 30")),
    Query("p19_analysis_rows", p19, _kept_sql(O, "season >= 1994 AND position IN ('F', 'O')")),
    Query("p25_context_filters", p25, _kept_sql(E, "exposure >= 40 AND level = 'purchase' AND home")),
    Query("p5_numeric_range", p5, _kept_sql(E, "exposure BETWEEN 20 AND 60")),
    Query("p7_teammate_in", p7, f"SELECT subject, count(*) AS n, round(sum(value), 2) AS total FROM {E} h WHERE EXISTS (SELECT 1 FROM {E} m WHERE m.subject = 3 AND m.level = h.level AND m.d = h.d) GROUP BY subject"),
    Query("p7_teammate_out", p7_out, f"""SELECT subject, count(*) AS n, round(sum(value), 2) AS total FROM {E} h WHERE EXISTS (SELECT 1 FROM {E} m WHERE m.subject = 3 AND m.level = h.level AND m.season = h.season)
      AND NOT EXISTS (SELECT 1 FROM {E} m WHERE m.subject = 3 AND m.level = h.level AND m.d = h.d) GROUP BY subject"""),
    Query("p9_same_text", p9, _kept_sql(O, "lower(trim(level)) IN ('1-urgent', '5-low')")),
    Query("p11_weekday_month", p11, _kept_sql(O, "dayname(d) IN ('Monday', 'Friday') AND month(d) IN (1, 2, 12)")),
    Query("p12_rest_range", p12, _kept_sql(f"(SELECT *, d - lag(d) OVER (PARTITION BY subject ORDER BY ts, event_id) AS gap FROM {O})", "gap BETWEEN 5 AND 60")),
    Query("p13_back_to_back", p13, _kept_sql(f"(SELECT *, d - lag(d) OVER (PARTITION BY subject ORDER BY ts, event_id) AS gap FROM {E})", "gap = 1")),
    Query("p16_last_n_rows", p16, _kept_sql(f"(SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, event_id DESC) AS r FROM {E} WHERE level = 'purchase')", "r <= 10")),
    Query("p17_filter_impact", p17, f"SELECT * FROM {_IMPACT}"),
    Query("p18_suggest_drop", p18, f"""SELECT subject, n_all, filter, n_if_dropped FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN n_if_dropped >= 5 THEN 0 ELSE 1 END,
      CASE WHEN n_if_dropped >= 5 THEN importance ELSE -n_if_dropped END, filter) AS r FROM {_IMPACT} WHERE n_all < 5) WHERE r = 1"""),
    Query("p20_one_row_a_key", p20, f"SELECT subject, d, event_id FROM (SELECT *, row_number() OVER (PARTITION BY subject, d ORDER BY exposure DESC, event_id DESC) AS r FROM {E} WHERE exposure > 0) WHERE r = 1"),
    Query("p21_known_parents", p21, "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1"),
    Query("p22_season_audit", p22, f"SELECT CAST(month(d) AS INTEGER) AS month, count(*) AS n FROM {O} WHERE season <> year(d) - CASE WHEN month(d) < 10 THEN 1 ELSE 0 END GROUP BY 1"),
    Query("p23_sparse_controls", p23, f"""SELECT 'a' AS name, avg(CASE WHEN exposure > 50 THEN 0.0 ELSE 1 END) > 0.2 AS dropped FROM {E} UNION ALL SELECT 'b', avg(CASE WHEN exposure > 5 THEN 0.0 ELSE 1 END) > 0.2 FROM {E} UNION ALL SELECT 'value', avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) > 0.2 FROM {E}"""),
    Query("p26_impossible_requests", p26, f"""WITH a AS (SELECT DISTINCT subject, CASE WHEN subject % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS asked FROM {O})
      SELECT a.subject, asked, arg_max(o.level, (o.ts, o.event_id)) AS instead FROM a JOIN {O} o ON a.subject = o.subject WHERE NOT EXISTS (SELECT 1 FROM {O} x WHERE x.subject = a.subject AND x.level = a.asked) GROUP BY a.subject, asked"""),
    Query("p27_test_mask", p27, _kept_sql(f"(SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts, event_id) - 1 AS prior FROM {E})", "season >= 2 AND prior >= 5")),
    Query("u1_union_of_parts", u1, "SELECT 'part' AS role, l_partkey AS ref, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'supplier', l_suppkey, count(*) FROM lineitem GROUP BY ALL"),
    Query("u2_future_rows", u2, f"SELECT subject, round(avg(value), 4) AS form FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, event_id DESC) AS r FROM {O}) WHERE r <= 5 GROUP BY subject"),
    Query("u3_set_difference", u3, f"SELECT DISTINCT subject, exposure FROM {E} WHERE season >= 2 EXCEPT SELECT subject, exposure FROM {E} WHERE season < 2"),
    Query("u4_alias_union", u4, f"SELECT subject, string_agg(DISTINCT level, ',' ORDER BY level) AS levels FROM {O} GROUP BY subject HAVING min(season) <= 1997"),
]
