"""Queries of catalogues and of the remaining filters and notes (X, P, F, A, T rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as c
from ..functions.special import t_quantile_column
from ..operators import aggregates as a
from ..operators import filters as f
from ..operators import inference as i
from ..operators import joins as j
from ..operators import windows as w
from ..session import staged
from ..sources.roles import DUEL_HISTORY_SQL, EVENT_HISTORY_SQL, ORDER_HISTORY_SQL, duel_history, event_history, order_history, table
from .base import Query, rounded, t_tail_sql

E, O, D = EVENT_HISTORY_SQL, ORDER_HISTORY_SQL, DUEL_HISTORY_SQL


def _box(s, d):
    """Order lines in the columns of a box score."""
    q = F.col("l_quantity")
    flag = lambda x: F.when(F.col("l_returnflag") == x, q).otherwise(0)
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("subject"), q.alias("pts"), flag("A").alias("ast"), flag("N").alias("reb"), flag("R").alias("stl"), F.col("l_linenumber").alias("blk"), F.lit(1).alias("tov"), F.lit(1).alias("pf"), flag("A").alias("fgm"), q.alias("fga"), flag("R").alias("fg3m"), (q / 2).alias("fg3a"), flag("N").alias("ftm"), flag("N").alias("fta"), (q / 4).alias("minutes"))


def x1(s, d):
    st = c.player_stats()
    return rounded(_box(s, d).groupBy("subject").agg(*[st[n].pooled().alias(n) for n in ("points", "stocks", "pra", "fg_pct", "ft_pct", "efg_pct", "ts_pct")]))


def x1_rows(s, d):
    st = c.player_stats()
    return rounded(_box(s, d).groupBy("subject").agg(*[F.avg(st[n].per_row()).alias(n) for n in ("pra", "ft_pct", "ts_pct")]))


def f18(s, d):
    known = {"1 urgent": "urgent", "2 high": "high", "3 medium": "medium", "5 low": "low"}
    return table(s, d, "orders").select("o_orderkey", c.canonical(F.col("o_orderpriority"), known).alias("stat"))


_TEXTS = sorted(c.spelled("team"))


def f18_spellings(s, d):
    """Every spelling of a team's statistics in turn, in capitals and with a plural, by the order's number."""
    n = F.col("o_orderkey") % len(_TEXTS) + 1
    text = F.concat(F.upper(F.element_at(F.array(*[F.lit(x) for x in _TEXTS]), n.cast("int"))), F.when(F.col("o_orderstatus") == "F", F.lit("s ")).when(F.col("o_orderstatus") == "P", F.lit(" nonsense")).otherwise(F.lit("")))
    return table(s, d, "orders").select("o_orderkey", c.canonical_stat(text, "team").alias("stat"))


def x1_teams(s, d):
    """A side of an order as a team's game: its lines with odd or even numbers against the others."""
    li = table(s, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("side")).agg(F.sum("l_quantity").alias("score"), F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0)).alias("fgm"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)).alias("fta"), F.max("l_suppkey").alias("subject"))
    t = j.with_opponent(li, "l_orderkey", "side", ["score"]).withColumnRenamed("opp_score", "allowed").withColumn("fga", F.col("score")).withColumn("win", (F.col("score") > F.col("allowed")).cast("int"))
    st = c.team_stats()
    names = ("team_score", "opponent_score", "total_points", "margin", "win_pct", "fg_pct", "ts_pct")
    return rounded(t.groupBy("subject").agg(F.count("*").alias("n"), *[st[x].pooled().alias(x) for x in names]))


def p4(s, d):
    h = event_history(s, d).select("event_id", "subject", "d", "level", "exposure")
    o = event_history(s, d)
    m = o.where("exposure >= 60 AND level = 'purchase'").groupBy("d", "level").agg(F.max(F.when(F.col("subject") % 5 == 0, F.col("exposure"))).cast("double").alias("m"), F.lit(True).alias("hm"))
    k = o.where("season = 1").groupBy("d").agg(F.max(F.when(F.col("subject") % 5 == 0, F.col("value"))).alias("k"), F.lit(True).alias("hk"))
    g = o.where("subject % 5 = 0").select("d").distinct().withColumn("same", F.lit(True))
    j = h.join(m, ["d", "level"], "left").join(k, "d", "left").join(g, "d", "left")
    faced, by = c.defender_evidence(F.col("subject"), F.col("m"), F.coalesce("hm", F.lit(False)), F.col("k"), F.coalesce("hk", F.lit(False)), F.coalesce("same", F.lit(False)), 90.0, 95.0)
    return j.select("event_id", faced.alias("faced"), by.alias("decided_by"))


def p14(s, d):
    h = order_history(s, d)
    kind = F.when(F.col("position") == "F", "regular").when(F.col("position") == "O", "playoffs").otherwise("play_in")
    h = h.withColumn("kind", kind)
    tests = [f.Filter("regular", ~F.col("kind").isin("playoffs", "play_in")), f.Filter("weekday", F.dayofweek("d").between(2, 6)), f.Filter("large", F.col("value") >= 50_000)]
    return h.where(f.passing(tests)).groupBy("subject").agg(F.count("*").alias("n"))


def p24(s, d):
    # the population of a league-wide model: scope filters only, subjects with two rows at least
    h = f.last_seasons(event_history(s, d), "season", 2)
    return h.groupBy("subject").agg(F.count("*").alias("n")).where("n >= 2")


def a9(s, d):
    h = duel_history(s, d)
    on = h.where("position = 'R'").groupBy("subject").agg(F.sum("value").alias("v"), F.sum("exposure").alias("m"), F.countDistinct("event_id").alias("games"))
    full = h.groupBy("subject").agg(F.sum("value").alias("tv"), F.sum("exposure").alias("tm"))
    return rounded(on.join(full, "subject").select("subject", "games", (F.try_divide("v", "m") * 36).alias("shared_rate"), (F.try_divide("tv", "tm") * 36).alias("full_rate")), 4)


def a27(s, d):
    return rounded(duel_history(s, d).where("season <= 1998").groupBy("position").agg(F.avg("exposure").alias("size")))


def t2(s, d):
    h = order_history(s, d)
    return rounded(a.period_changes(h, ["level"], F.month("d") <= 6, F.month("d") > 6, "value").select("level", "n_before", "n_after", "diff").orderBy(F.desc("diff"), "level"), 4)


def t3(s, d):
    h = order_history(s, d)
    day = F.date_format("d", "EEEE")
    return rounded(h.groupBy(day.alias("level"), (F.weekday("d") + 1).cast("long").alias("place")).agg(F.avg("value").alias("mean")).orderBy("place"), 4)


def f21(s, d):
    g = event_history(s, d).groupBy("subject").agg(F.count(F.when(F.col("level") == "purchase", 1)).alias("n"), F.avg("value").alias("m"))
    p = F.when(F.col("subject") % 4 != 0, F.abs(F.sin("m")))
    return g.select("subject", i.confidence_label(F.col("n")).alias("label"), i.verdict(p, F.col("m") - 50, F.col("m") + 50).alias("verdict"))


def f22(s, d):
    h = order_history(s, d)
    first = h.groupBy("subject").agg(F.min("season").alias("season"), F.min("d").alias("d"))
    draft = F.when(F.col("subject") % 3 != 0, 1980 + F.col("subject") % 25)
    return first.select("subject", F.coalesce(draft < 1995, (F.col("subject") % 40) >= 24).alias("began_before"))


def i17(s, d):
    h = order_history(s, d).withColumn("x", F.date_diff("d", F.lit("1995-01-01").cast("date")) / 365.25)
    g = i.trend(h, "subject", "x", "value").where("n >= 3 AND sxx > 0").join(h.groupBy("subject").agg(F.avg("x").alias("mx")), "subject")
    g = staged(g, "trends")
    # t depends on the number of rows alone: one a number, of which a table of N rows has fewer than sqrt(2 N)
    t = g.select("n").distinct().withColumn("t", t_quantile_column(0.95, (F.col("n") - 2).cast("double")))
    g = g.join(F.broadcast(t), "n").withColumn("at", F.explode(F.array(*[F.lit(float(k)) for k in (6.75, 7.0, 7.25)])))
    fit = F.col("intercept") + F.col("slope") * F.col("at")
    lever = 1 / F.col("n") + (F.col("at") - F.col("mx")) * (F.col("at") - F.col("mx")) / F.col("sxx")
    half, wide = F.col("t") * F.col("residual_std") * F.sqrt(lever), F.col("t") * F.col("residual_std") * F.sqrt(1 + lever)
    return rounded(g.select("subject", F.col("at").cast("string").alias("at"), fit.alias("fit"), (fit - half).alias("low"), (fit + half).alias("high"), (fit - wide).alias("predict_low"), (fit + wide).alias("predict_high")), 1)


def j10(s, d):
    h = duel_history(s, d)
    keys = h.where("subject % 10 = 1").select("event_id").distinct()
    return h.where("subject % 10 <> 1").join(keys, "event_id", "left_semi").groupBy("event_id").agg(F.count("*").alias("n"))


def j11(s, d):
    h = event_history(s, d)
    team = h.groupBy("level", "d").agg(F.sum("value").alias("team_value")).where("team_value > 100")
    bio = h.groupBy("subject").agg(F.max(F.when(F.col("level") == "error", F.col("exposure"))).alias("height"))
    return rounded(h.join(team, ["level", "d"]).join(bio, "subject", "left").select("event_id", "team_value", "height"), 2)


def a10(s, d):
    t = event_history(s, d).groupBy("d", "subject").agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b"))
    return t.groupBy("d").agg(F.sum(F.col("b") - F.col("a")).alias("present"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("persons"))


def f9(s, d):
    o = order_history(s, d)
    opener = o.groupBy("season").agg(F.min("d").alias("opener"))
    j = o.join(F.broadcast(opener), "season").withColumn("days", w.days_since_previous("subject"))
    return j.select("event_id", (F.col("position") == "O").alias("is_playoff"), F.when(F.dayofweek("d").isin(1, 7), "away").otherwise("home").alias("venue"), (F.col("d") == F.col("opener")).alias("opening_day"))


_BOX = """(SELECT l_suppkey AS subject, l_quantity AS pts, CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END AS ast, CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END AS reb, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS stl, l_linenumber AS blk FROM lineitem)"""

QUERIES = [
    Query("x1_stat_catalog", x1, f"""SELECT subject, round(avg(pts), 6) AS points, round(avg(stl + blk), 6) AS stocks, round(avg(pts + reb + ast), 6) AS pra, round(sum(ast) / sum(pts) * 100, 6) AS fg_pct, round(sum(reb) / nullif(sum(reb), 0) * 100, 6) AS ft_pct,
      round(sum(ast + 0.5 * stl) / sum(pts) * 100, 6) AS efg_pct, round(sum(pts) / sum(2 * (pts + 0.44 * reb)) * 100, 6) AS ts_pct FROM {_BOX} GROUP BY subject"""),
    Query("x1_per_row_stats", x1_rows, f"SELECT subject, round(avg(pts + reb + ast), 6) AS pra, round(avg(CASE WHEN reb > 0 THEN reb / reb * 100 END), 6) AS ft_pct, round(avg(pts / (2 * (pts + 0.44 * reb)) * 100), 6) AS ts_pct FROM {_BOX} GROUP BY subject"),
    Query("f18_canonical_name", f18, "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS stat FROM orders"),
    Query("f18_stat_spellings", f18_spellings, f"""WITH t AS (SELECT o_orderkey, o_orderstatus AS f, {_TEXTS!r}[o_orderkey % {len(_TEXTS)} + 1] AS w FROM orders), m AS (SELECT unnest({_TEXTS!r}) AS w, unnest({[c.spelled("team")[x] for x in _TEXTS]!r}) AS stat),
      k AS (SELECT o_orderkey, w || CASE f WHEN 'F' THEN 's' WHEN 'P' THEN 'nonsense' ELSE '' END AS w FROM t) SELECT o_orderkey, coalesce(a.stat, b.stat) AS stat FROM k LEFT JOIN m a ON a.w = k.w LEFT JOIN m b ON b.w = regexp_replace(k.w, 's+$', '')"""),
    Query("x1_team_stats", x1_teams, """WITH t AS (SELECT l_orderkey, l_linenumber % 2 AS side, sum(l_quantity) AS score, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS fgm, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS fta, max(l_suppkey) AS subject FROM lineitem GROUP BY 1, 2),
      g AS (SELECT a.*, b.score AS allowed FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.side <> b.side) SELECT subject, count(*) AS n, round(avg(score), 6) AS team_score, round(avg(allowed), 6) AS opponent_score, round(avg(score + allowed), 6) AS total_points, round(avg(score - allowed), 6) AS margin,
      round(100 * avg(CASE WHEN score > allowed THEN 1.0 ELSE 0 END), 6) AS win_pct, round(100 * sum(fgm) / sum(score), 6) AS fg_pct, round(100 * sum(score) / sum(2 * (score + 0.44 * fta)), 6) AS ts_pct FROM g GROUP BY subject"""),
    Query("p4_named_opponent", p4, f"""WITH m AS (SELECT d, level, max(exposure) FILTER (subject % 5 = 0) AS m FROM {E} WHERE exposure >= 60 AND level = 'purchase' GROUP BY ALL), k AS (SELECT d, max(value) FILTER (subject % 5 = 0) AS k FROM {E} WHERE season = 1 GROUP BY d), g AS (SELECT DISTINCT d FROM {E} WHERE subject % 5 = 0)
      SELECT event_id, CASE WHEN m.d IS NOT NULL THEN coalesce(m.m, 0) >= 90 WHEN k.d IS NOT NULL THEN coalesce(k.k, 0) >= 95 ELSE g.d IS NOT NULL END AS faced, CASE WHEN m.d IS NOT NULL THEN 'matchups' WHEN k.d IS NOT NULL THEN 'on_court' ELSE 'same_game' END AS decided_by
      FROM {E} h LEFT JOIN m ON h.d = m.d AND h.level = m.level LEFT JOIN k ON h.d = k.d LEFT JOIN g ON h.d = g.d"""),
    Query("p14_kinds_and_minimum", p14, f"SELECT subject, count(*) AS n FROM {O} WHERE position = 'F' AND isodow(d) <= 5 AND value >= 50000 GROUP BY subject"),
    Query("p24_population", p24, f"SELECT subject, count(*) AS n FROM {E} WHERE season > (SELECT max(season) FROM {E}) - 2 GROUP BY subject HAVING count(*) >= 2"),
    Query("a9_shared_summary", a9, f"""WITH o AS (SELECT subject, sum(value) AS v, sum(exposure) AS m, count(DISTINCT event_id) AS games FROM {D} WHERE position = 'R' GROUP BY 1), t AS (SELECT subject, sum(value) AS tv, sum(exposure) AS tm FROM {D} GROUP BY 1)
      SELECT subject, games, round(v / m * 36, 4) AS shared_rate, round(tv / tm * 36, 4) AS full_rate FROM o JOIN t USING (subject)"""),
    Query("a10_presence", a10, f"SELECT d, CAST(sum(b - a) AS BIGINT) AS present, count(*) FILTER (b > a) AS persons FROM (SELECT d, subject, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM {E} GROUP BY ALL) GROUP BY d"),
    Query("a27_neutral_values", a27, f"SELECT position, round(avg(exposure), 6) AS size FROM {D} WHERE season <= 1998 GROUP BY position"),
    Query("t2_group_table", t2, f"""SELECT level, count(value) FILTER (month(d) <= 6) AS n_before, count(value) FILTER (month(d) > 6) AS n_after, round(avg(value) FILTER (month(d) > 6) - avg(value) FILTER (month(d) <= 6), 4) AS diff FROM {O} GROUP BY level"""),
    Query("t3_natural_order", t3, f"SELECT dayname(d) AS level, isodow(d) AS place, round(avg(value), 4) AS mean FROM {O} GROUP BY ALL"),
    Query("f9_game_context", f9, f"SELECT event_id, position = 'O' AS is_playoff, CASE WHEN isodow(d) >= 6 THEN 'away' ELSE 'home' END AS venue, d = min(d) OVER (PARTITION BY season) AS opening_day FROM {O}"),
    Query("f21_labels", f21, f"""WITH g AS (SELECT subject, count(*) FILTER (level = 'purchase') AS n, avg(value) AS m FROM {E} GROUP BY 1), p AS (SELECT *, CASE WHEN subject % 4 <> 0 THEN abs(sin(m)) END AS p FROM g)
      SELECT subject, CASE WHEN n >= 25 THEN 'high' WHEN n >= 10 THEN 'medium' ELSE 'low' END AS label, CASE WHEN p IS NULL THEN 'unknown' WHEN p < 0.05 AND (m - 50 > 0 OR m + 50 < 0) THEN 'significant' ELSE 'not significant' END AS verdict FROM p"""),
    Query("f22_began_before_data", f22, f"SELECT DISTINCT subject, CASE WHEN subject % 3 <> 0 THEN 1980 + subject % 25 < 1995 ELSE subject % 40 >= 24 END AS began_before FROM {O}"),
    Query("i17_trend_bands", i17, f"""WITH RECURSIVE h AS (SELECT subject, (d - DATE '1995-01-01') / 365.25 AS x, value AS y FROM {O}),
      g AS (SELECT subject, count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, sqrt(greatest(0, regr_syy(y, x) - regr_slope(y, x) * regr_slope(y, x) * regr_sxx(y, x)) / (count(*) - 2)) AS r FROM h GROUP BY 1 HAVING count(*) >= 3 AND regr_sxx(y, x) > 0),
      q AS (SELECT DISTINCT n, CAST(0.0 AS DOUBLE) AS lo, CAST(16.0 AS DOUBLE) AS hi, 0 AS i FROM g UNION ALL SELECT n, CASE WHEN over THEN (lo + hi) / 2 ELSE lo END, CASE WHEN over THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM (SELECT *, {t_tail_sql('(lo + hi) / 2', 'n - 2')} > 0.05 AS over FROM q WHERE i < 45)),
      t AS (SELECT n, (lo + hi) / 2 AS t FROM q WHERE i = 45), f AS (SELECT *, a + b * at_x AS fit, 1.0 / n + (at_x - mx) * (at_x - mx) / sxx AS l FROM g JOIN t USING (n) CROSS JOIN (VALUES (6.75), (7.0), (7.25)) v(at_x))
      SELECT subject, CAST(CAST(at_x AS DOUBLE) AS VARCHAR) AS at, round(fit, 1) AS fit, round(fit - t * r * sqrt(l), 1) AS low, round(fit + t * r * sqrt(l), 1) AS high, round(fit - t * r * sqrt(1 + l), 1) AS predict_low, round(fit + t * r * sqrt(1 + l), 1) AS predict_high FROM f"""),
    Query("j10_opponent_rows", j10, f"SELECT event_id, count(*) AS n FROM {D} WHERE subject % 10 <> 1 AND event_id IN (SELECT event_id FROM {D} WHERE subject % 10 = 1) GROUP BY event_id"),
    Query("j11_with_context", j11, f"""WITH t AS (SELECT level, d, sum(value) AS tv FROM {E} GROUP BY ALL HAVING sum(value) > 100), b AS (SELECT subject, max(exposure) FILTER (level = 'error') AS h FROM {E} GROUP BY 1)
      SELECT event_id, round(tv, 2) AS team_value, h AS height FROM {E} e JOIN t ON e.level = t.level AND e.d = t.d LEFT JOIN b ON e.subject = b.subject"""),
]
