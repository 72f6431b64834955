"""Queries of whole bundles: raw files to processed tables, matchup records, aliases, kept parameters, given lines.

The raw files are written from the given tables first, in the form in which they would arrive: a game is a day and
a nation, its box score the lines of that day's orders, a supplier a person.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as i
from ..operators import models as m
from ..operators import windows as w
from ..session import shared_folder, staged
from ..sources import bundle as b
from ..sources import registry as reg
from ..sources import tables as t
from ..sources.roles import ORDER_HISTORY_SQL, order_history, table
from .base import Query, rounded

O = ORDER_HISTORY_SQL


def _lines(s, d):
    """(game_id, home_id, away_id, date, person_id, home, quantity, number) of every line of an order."""
    o = table(s, d, "orders").join(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("n")), F.col("o_custkey") == F.col("c_custkey"))
    day = F.dayofyear("o_orderdate")
    o = o.select("o_orderkey", (20_000_000 + F.year("o_orderdate") % 100 * 100_000 + day * 25 + F.col("n")).alias("game_id"), F.col("n").alias("home_id"), ((F.col("n") + 1 + day % 24) % 25).alias("away_id"), F.col("o_orderdate").alias("date"))
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("person_id"), (F.col("l_suppkey") % 2).alias("home"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("number"))
    return o.join(li, "o_orderkey")


def _csv(df, name, folder):
    """df as the raw file of that name: its columns by their raw names, the declared ones that it lacks empty."""
    file, types = b.RAW[name]
    have = set(df.columns)
    df.select(*[F.col(b.snake(c)).alias(c) if b.snake(c) in have else F.lit(None).cast("string").alias(c) for c in types]).write.option("header", True).csv(f"{folder}/{file}")


def _raw(s, d):
    """The raw bundle, from files written of the given tables."""
    folder, li = shared_folder(s, "raw"), staged(_lines(s, d), "lines")  # five files are made of them
    text = lambda day: F.date_format(day, "yyyy-MM-dd HH:mm:ss").alias("game_date_time_est")
    box = li.groupBy("game_id", "person_id", "home").agg(F.sum("quantity").alias("points"), F.count("*").cast("double").alias("assists"), F.sum("number").cast("string").alias("num_minutes"), text(F.min("date")))
    _csv(box, "player_stats", folder)
    side = F.when(F.col("home") == 1, F.col("home_id")).otherwise(F.col("away_id"))
    team = li.groupBy("game_id", "home", side.alias("team_id")).agg(F.sum("quantity").alias("team_score"), F.count("*").cast("double").alias("num_minutes"), text(F.min("date")))
    team = staged(team, "team")
    _csv(team, "team_stats", folder)
    _csv(team.select("game_id", "team_id", F.col("num_minutes").alias("possessions"), (F.col("team_score") / F.col("num_minutes") * 100).alias("offensive_rating")), "team_advanced", folder)
    games = staged(li.select("game_id", "home_id", "away_id", "date").distinct(), "games")
    _csv(games.select("game_id", F.col("home_id").alias("hometeam_id"), F.col("away_id").alias("awayteam_id"), text(F.col("date"))).distinct(), "games", folder)
    _csv(table(s, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("last_name"), F.col("s_acctbal").alias("body_weight_lbs")), "players", folder)
    _csv(table(s, d, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team_name"), F.lit(1946).alias("season_founded"), F.lit(2100).alias("season_active_till")), "team_histories", folder)
    games.select(F.col("game_id").alias("gameId"), F.concat(F.lit("Hall "), "home_id").alias("arenaName"), F.lit(None).cast("string").alias("arenaCity")).distinct().write.option("header", True).csv(f"{folder}/Schedule.csv")
    return b.load_raw(s, folder, ["Schedule.csv", "ScheduleOfNoSeason.csv"])


def s1(s, d):
    path = f"{shared_folder(s, 'csv')}/customer.csv"
    table(s, d, "customer").write.option("header", True).csv(path)
    return t.typed_csv(s, path, {"c_custkey": "long", "c_name": "string", "c_acctbal": "double", "c_nationkey": "int"})


def s2(s, d):
    out = None
    for name, df in _raw(s, d).items():
        own = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(len(df.columns)).alias("width"))
        out = own if out is None else out.unionByName(own)
    return out


def s5(s, d):
    raw = _raw(s, d)
    box = raw["player_stats"].select("game_id", "person_id", "home", F.col("playerteam_id").alias("team_id"), "points")
    return t.rosters(box, b.game_table(raw), raw["games"].where("hometeam_id = 3 OR awayteam_id = 3")).select("game_id", "person_id", "team_id", "season", "points")


def _records(s, d):
    """A matchup record an order: its lines of odd number against those of even number, both ways."""
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("p"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))).alias("all"))
    of = lambda k: F.filter("all", lambda v: v.n % 2 == k)
    minutes = lambda a, v: F.concat(a.n.cast("string"), F.lit(":"), F.lpad((v.q.cast("int") % 60).cast("string"), 2, "0"))
    against = lambda a, k: F.transform(of(k), lambda v: F.struct(v.p.alias("personId"), F.struct(minutes(a, v).alias("matchupMinutes"), a.q.alias("partialPossessions"), v.q.alias("playerPoints")).alias("statistics")))
    side = lambda k: F.struct(F.lit(k).alias("teamId"), F.transform(of(k), lambda a: F.struct(a.p.alias("personId"), F.lit("").alias("position"), against(a, 1 - k).alias("matchups"))).alias("players"))
    path = shared_folder(s, "matchups")
    whole = F.struct(F.struct(F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("gameId"), side(1).alias("homeTeam"), side(0).alias("awayTeam")).alias("boxScoreMatchups"))
    li.select(F.to_json(whole).alias("value")).write.option("compression", "gzip").text(path)
    return t.read_raw_matchups(s, path, lines=True)


def s6(s, d):
    return t.matchups(_records(s, d)).select("game_id", "team_id", "off_person_id", "def_team_id", "def_person_id", "seconds", "partial_possessions", "player_points", "assists")


def s7(s, d):
    bio = table(s, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("weight"))
    return t.all_matchups(_records(s, d), bio).select("game_id", "season", "kind", "off_person_id", "def_person_id", "def_weight", "seconds")


def s8(s, d):
    path = f"{shared_folder(s, 'aliases')}/aliases.csv"
    c = table(s, d, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("St. "), "c_name", F.lit("-Jr")).alias("alias"))
    rows.write.option("header", True).csv(path)
    return t.aliases(s, path, "id", "alias")


def s10(s, d):
    folder = shared_folder(s, "bundle")
    made = b.assemble(_raw(s, d))
    t.write_tables(made, folder)
    p = b.load_bundle(s, folder, list(made))
    people = p["players"].select("person_id", "name", "games", F.col("last_team").alias("team_id"))
    return people.join(p["teams"].select("team_id", F.col("eras")[0]["name"].alias("team")), "team_id")


def s11(s, d):
    path = f"{shared_folder(s, 'sink')}/part.parquet"
    t.shrunk(table(s, d, "part")).write.option("compression", "zstd").parquet(path)
    return s.read.parquet(path).select("p_partkey", "p_brand", F.typeof("p_retailprice").alias("kept_as"), F.round("p_retailprice", 0).cast("double").alias("price"))


def s14(s, d):
    return t.write_tables(b.assemble(_raw(s, d)), shared_folder(s, "bundle")).select("name", "rows", "columns", (F.col("bytes") > 0).alias("has_bytes"))


def s15(s, d):
    p = b.assemble(_raw(s, d))["player_games"]
    cols = ["points_last5", "points_last20", "assists_last10", "minutes_last5", "team_pre_offensive_rating", "opp_pre_offensive_rating"]
    return rounded(p.select("game_id", "person_id", "team_id", "season", "kind", "points", "minutes", "weight_lbs", "starter", "prior_games", F.col("days_since_last").cast("long").alias("days_since_last"), F.col("team_pre_games").cast("long").alias("team_pre_games"), *cols))


def s15_teams(s, d):
    t = b.assemble(_raw(s, d))["team_games"]
    return rounded(t.select("game_id", "team_id", "opp_team_id", "season", "team_score", F.col("pre_games").cast("long").alias("pre_games"), "pre_offensive_rating", "team_score_last10", "opp_team_score_last5"))


def s15_calendar(s, d):
    return b.assemble(_raw(s, d))["season_calendar"].select("season", "opener", "last", "games")


def s17(s, d):
    h = order_history(s, d).withColumn("x", F.date_diff("d", F.lit("1995-01-01").cast("date")) / 365.25)
    folder = shared_folder(s, "parameters")
    fitted = i.trend(h, "subject", "x", "value")
    reg.save(s, folder, "v1", {"trend": fitted.withColumn("slope", F.lit(0.0))})
    reg.save(s, folder, "v2", {"trend": fitted})
    return rounded(reg.load(s, folder).tables["trend"].select("subject", (F.col("intercept") + 2 * F.col("slope")).alias("at_two")), 2)


def s17_models(s, d):
    """A version with a pipeline, an archived boosted model and its data's fingerprint, found again by the fingerprint; its rates scored by both."""
    h = order_history(s, d).withColumn("y", F.floor(F.col("value") / 50_000)).withColumn("prior", w.prior_count("subject").cast("double"))
    folder = shared_folder(s, "registry")
    facts = reg.fingerprint({"orders": h, "customer": table(s, d, "customer")})
    glm = m.poisson_rate(h.withColumn("one", F.lit(1.0)), "y", ["prior"], "one")
    boosted = m.boosted_rate(h, "y", ["prior"], rounds=2)
    levels = h.groupBy("season").agg(F.avg("y").alias("mean"))
    reg.save(s, folder, "2001", {"levels": levels.where("mean < 0")}, {"glm": glm}, facts={"orders": 0})
    reg.save(s, folder, "2002", {"levels": levels}, {"glm": glm, "boosted": boosted}, archived=["boosted"], facts=facts)
    reg.save(s, folder, "2003", {"levels": levels.where("mean < 0")}, {"glm": glm}, facts={"orders": 1})
    v = reg.load(s, folder, facts=facts, archive=True)
    same = m.predict_rate(v.models["glm"], h.withColumn("one", F.lit(1.0)), "one").withColumn("a", F.col("expected")).withColumn("b", m.rate_column(glm)).withColumn("c", v.models["boosted"].column()).withColumn("e", boosted.column())
    fits = same.groupBy("season").agg((F.max(F.abs(F.col("a") - F.col("b"))) < 1e-9).alias("same_rates"), (F.max(F.abs(F.col("c") - F.col("e"))) < 1e-9).alias("same_trees"))
    return rounded(v.tables["levels"].join(fits, "season").select(F.lit(v.name).alias("version"), F.lit(v.facts["orders"]).alias("orders"), F.lit(v.facts["customer"]).alias("customers"), "season", "mean", "same_rates", "same_trees"))


def x3(s, d):
    """Lines as given where there are any, else from the subject's newest ten values."""
    h = order_history(s, d)
    given = table(s, d, "customer").select(F.col("c_custkey").alias("subject"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("given"))
    own = h.withColumn("r", w.recent_rank("subject")).where("r <= 10").groupBy("subject").agg((F.floor(F.round(F.avg("value"), 6)) + 0.5).alias("usual"))
    return own.join(given, "subject", "left").select("subject", F.coalesce("given", "usual").alias("line"), F.when(F.col("given").isNotNull(), "given").otherwise("recent").alias("decided_by"))


_SEASON = "(CASE WHEN {0} // 100000 % 100 >= 46 THEN 1900 ELSE 2000 END + {0} // 100000 % 100)"
_LINES = f"""l AS (SELECT 20000000 + year(o_orderdate) % 100 * 100000 + dayofyear(o_orderdate) * 25 + c_nationkey AS game_id, c_nationkey AS home_id, (c_nationkey + 1 + dayofyear(o_orderdate) % 24) % 25 AS away_id,
 o_orderdate AS ts, l_suppkey AS person_id, l_suppkey % 2 AS home, l_quantity AS quantity, l_linenumber AS number FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey),
 box AS (SELECT game_id, person_id, CASE WHEN home = 1 THEN home_id ELSE away_id END AS team_id, sum(quantity) AS points, CAST(count(*) AS DOUBLE) AS assists, sum(number) AS minutes, min(ts) AS ts FROM l GROUP BY ALL),
 g AS (SELECT DISTINCT game_id, home_id, away_id FROM l),
 team AS (SELECT game_id, CASE WHEN home = 1 THEN home_id ELSE away_id END AS team_id, sum(quantity) AS score, count(*) AS poss, min(ts) AS ts FROM l GROUP BY ALL),
 duel AS (SELECT a.*, o.team_id AS opp_id, o.score AS allowed, {_SEASON.format('a.game_id')} AS season FROM team a JOIN team o ON a.game_id = o.game_id AND a.team_id <> o.team_id),
 whole AS (SELECT team_id, season + 1 AS season, 100 * sum(score) / sum(poss) AS r FROM duel GROUP BY ALL),
 tg AS (SELECT duel.*, row_number() OVER w - 1 AS pre_games, coalesce(100 * sum(score) OVER b / sum(poss) OVER b, whole.r) AS pre_rating, avg(score) OVER (p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS score_10, avg(allowed) OVER (p ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS allowed_5
  FROM duel LEFT JOIN whole USING (team_id, season) WINDOW w AS (PARTITION BY team_id, season ORDER BY ts, game_id), b AS (PARTITION BY team_id, season ORDER BY ts, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p AS (PARTITION BY team_id ORDER BY ts, game_id)),
 pg AS (SELECT box.*, tg.season, tg.pre_games, tg.pre_rating, o.pre_rating AS opp_rating FROM box JOIN tg USING (game_id, team_id) JOIN tg o ON o.game_id = tg.game_id AND o.team_id = tg.opp_id WHERE minutes > 0)"""
_MATCHUPS = """m AS (SELECT a.l_orderkey AS game_id, a.l_linenumber % 2 AS team_id, a.l_suppkey AS off_person_id, b.l_linenumber % 2 AS def_team_id, b.l_suppkey AS def_person_id,
 CAST(a.l_linenumber * 60 + CAST(floor(b.l_quantity) AS INTEGER) % 60 AS DOUBLE) AS seconds, a.l_quantity AS partial_possessions, b.l_quantity AS player_points FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 2 <> b.l_linenumber % 2)"""

QUERIES = [
    Query("s1_typed_csv", s1, "SELECT c_custkey, c_name, c_acctbal, CAST(c_nationkey AS INTEGER) AS c_nationkey FROM customer"),
    Query("s2_raw_bundle", s2, f"""WITH {_LINES} SELECT 'player_stats' AS name, count(*) AS n, 32 AS width FROM box UNION ALL SELECT 'team_stats', count(*), 24 FROM team UNION ALL SELECT 'team_advanced', count(*), 16 FROM team
      UNION ALL SELECT 'games', count(*), 13 FROM g UNION ALL SELECT 'players', count(*), 12 FROM supplier UNION ALL SELECT 'team_histories', count(*), 7 FROM nation UNION ALL SELECT 'schedules', count(*), 3 FROM g"""),
    Query("s5_rosters", s5, f"WITH {_LINES} SELECT game_id, person_id, team_id, CAST({_SEASON.format('game_id')} AS INTEGER) AS season, points FROM box WHERE game_id IN (SELECT game_id FROM g WHERE home_id = 3 OR away_id = 3)"),
    Query("s6_matchup_records", s6, f"WITH {_MATCHUPS} SELECT *, CAST(NULL AS DOUBLE) AS assists FROM m"),
    Query("s7_all_matchups", s7, f"""WITH {_MATCHUPS}, y AS (SELECT *, game_id // 100000 % 100 AS yy, game_id // 10000000 AS k FROM m)
      SELECT game_id, CAST(CASE WHEN yy >= 46 THEN 1900 + yy ELSE 2000 + yy END AS INTEGER) AS season, CASE k WHEN 1 THEN 'preseason' WHEN 2 THEN 'regular' END AS kind, off_person_id, def_person_id, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS def_weight, seconds
      FROM y LEFT JOIN supplier ON s_suppkey = def_person_id"""),
    Query("s8_alias_csv", s8, "SELECT c_custkey AS id, 'st ' || lower(c_name) || ' jr' AS alias FROM customer"),
    Query("s10_processed_bundle", s10, f"""WITH {_LINES}, p AS (SELECT person_id, count(*) AS games, arg_max(team_id, (ts, game_id)) AS team_id FROM pg GROUP BY 1)
      SELECT person_id, s_name AS name, games, team_id, n_name AS team FROM p JOIN supplier ON s_suppkey = person_id JOIN nation ON n_nationkey = team_id"""),
    Query("s11_shrunk_sink", s11, "SELECT p_partkey, p_brand, 'float' AS kept_as, CAST(round(CAST(p_retailprice AS FLOAT), 0) AS DOUBLE) AS price FROM part"),
    Query("s14_build_report", s14, f"""WITH {_LINES} SELECT 'games' AS name, count(*) AS rows, 9 AS columns, true AS has_bytes FROM g UNION ALL SELECT 'team_games', count(*), 63, true FROM tg UNION ALL SELECT 'player_games', count(*), 66, true FROM pg
      UNION ALL SELECT 'players', count(DISTINCT person_id), 6, true FROM pg UNION ALL SELECT 'teams', count(DISTINCT team_id), 5, true FROM tg UNION ALL SELECT 'season_calendar', count(DISTINCT season), 6, true FROM tg"""),
    Query("s15_assembled", s15, f"""WITH {_LINES} SELECT game_id, person_id, team_id, CAST(season AS INTEGER) AS season, 'regular' AS kind, points, CAST(minutes AS DOUBLE) AS minutes, s_acctbal AS weight_lbs, false AS starter,
      CAST(row_number() OVER w - 1 AS INTEGER) AS prior_games, CAST(CAST(ts AS DATE) - lag(CAST(ts AS DATE)) OVER w AS BIGINT) AS days_since_last, CAST(pre_games AS BIGINT) AS team_pre_games, round(avg(points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS points_last5,
      round(avg(points) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS points_last20, round(avg(assists) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS assists_last10, round(avg(minutes) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS minutes_last5,
      round(pre_rating, 6) AS team_pre_offensive_rating, round(opp_rating, 6) AS opp_pre_offensive_rating FROM pg JOIN supplier ON s_suppkey = person_id WINDOW w AS (PARTITION BY person_id ORDER BY ts, game_id)"""),
    Query("s15_team_games", s15_teams, f"""WITH {_LINES} SELECT game_id, team_id, opp_id AS opp_team_id, CAST(season AS INTEGER) AS season, score AS team_score, CAST(pre_games AS BIGINT) AS pre_games, round(pre_rating, 6) AS pre_offensive_rating,
      round(score_10, 6) AS team_score_last10, round(allowed_5, 6) AS opp_team_score_last5 FROM tg"""),
    Query("s15_calendar", s15_calendar, f"""WITH {_LINES}, u AS (SELECT DISTINCT game_id, CAST(min(ts) OVER (PARTITION BY game_id) AS DATE) AS d FROM l), y AS (SELECT *, {_SEASON.format('game_id')} AS season FROM u), a AS (SELECT DISTINCT season, d FROM y), q AS (SELECT *, lag(d) OVER (PARTITION BY season ORDER BY d) AS before FROM a),
      k AS (SELECT season, min(d) AS opener, max(d) AS last FROM a GROUP BY 1) SELECT CAST(season AS INTEGER) AS season, opener, last, (SELECT count(*) FROM y WHERE y.season = k.season) AS games FROM k"""),
    Query("s17_kept_parameters", s17, f"""WITH x AS (SELECT subject, value AS y, date_diff('day', DATE '1995-01-01', d) / 365.25 AS x FROM {O}),
      f AS (SELECT subject, CASE WHEN regr_sxx(y, x) > 0 THEN regr_slope(y, x) END AS b, CASE WHEN regr_sxx(y, x) > 0 THEN regr_intercept(y, x) END AS a FROM x GROUP BY 1) SELECT subject, round(a + 2 * b, 2) AS at_two FROM f"""),
    Query("s17_model_registry", s17_models, f"""WITH n AS (SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers)
      SELECT '2002' AS version, CAST(any_value(orders) AS INTEGER) AS orders, CAST(any_value(customers) AS INTEGER) AS customers, season, round(avg(floor(value / 50000)), 6) AS mean, true AS same_rates, true AS same_trees FROM {O} CROSS JOIN n GROUP BY season"""),
    Query("x3_line_provider", x3, f"""WITH r AS (SELECT subject, value, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, event_id DESC) AS r FROM {O}), u AS (SELECT subject, floor(round(avg(value), 6)) + 0.5 AS usual FROM r WHERE r <= 10 GROUP BY 1)
      SELECT subject, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, usual) AS line, CASE WHEN c_acctbal > 0 THEN 'given' ELSE 'recent' END AS decided_by FROM u LEFT JOIN customer ON c_custkey = subject"""),
]
