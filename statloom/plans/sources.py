"""Queries of the sources, sinks (S rows) and lineups (G rows) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineups
from ..session import shared_folder
from ..sources import tables as t
from ..sources.roles import EVENT_HISTORY_SQL, event_history, table
from .base import Query, rounded

E = EVENT_HISTORY_SQL


def s3(s, d):
    c = table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("arena"))
    later = table(s, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.col("c_name").alias("arena"), F.col("c_acctbal").alias("more"))
    return t.stacked_last(s, [c, later], "c_custkey", "c_custkey long, arena string, city string")


def s4(s, d):
    return t.prefixed(table(s, d, "part"), "p_type", ["STANDARD", "PROMO"], ["p_partkey", "p_type"])


def s9(s, d):
    return t.picked(table(s, d, "orders").withColumn("fine", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") > 1000)), {"id": ["order_id", "o_orderkey"], "price": ["o_totalprice", "price"]}, "fine")


def s12(s, d):
    o = table(s, d, "orders").withColumn("season", F.year("o_orderdate")).withColumn("flag", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"))
    return t.slim(o, t.Slim(["o_orderkey", "o_custkey", "season"], {"o_custkey": "int"}, ["o_orderkey"], "flag"), 1996)


def s13(s, d):
    games = table(s, d, "orders").select(F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").alias("season"), F.col("o_custkey").alias("home_id"), F.lit(-1).cast("long").alias("away_id"))
    box = table(s, d, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("person_id"))
    people = table(s, d, "supplier").select(F.col("s_suppkey").alias("person_id"), "s_name")
    made = t.sample_of_team({"box": box, "people": people}, games, 7, [1996, 1997, 1998])
    return made["people"].select(F.lit("people").alias("part"), F.col("person_id").alias("id")).unionByName(made["box"].select(F.lit("box").alias("part"), F.col("game_id").alias("id")))


def s18(s, d):
    games = table(s, d, "orders").select(((F.col("o_orderkey") % 4 + 1) * 10_000_000 + F.col("o_orderkey")).alias("game_id"), F.col("o_orderdate").alias("ts"), F.year("o_orderdate").alias("season"))
    return t.work_list(games, games.where("game_id % 5 = 0"), [2, 4], F.lit("2000-01-01").cast("timestamp"), 1996, 1999).select("game_id", F.col("season").cast("long").alias("season"))


def _lineup(s, d):
    """Ten-user games: a day's events of ten users in two teams; clicks come in, errors leave, all else acts."""
    h = event_history(s, d).withColumn("game_id", F.date_diff("d", F.lit("2024-01-01").cast("date")).cast("long") * 1_000_000_000 + F.floor(F.col("subject") / 10)).withColumn("team_id", F.col("subject") % 2)
    sec = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 30.0
    kind = F.when(F.col("level") == "click", "in").when(F.col("level") == "error", "out").otherwise("act")
    e = h.select("game_id", (F.floor(sec / 720) + 1).cast("int").alias("period"), sec.alias("t"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("subject").alias("person_id"), "team_id", F.lit(None).cast("array<long>").alias("candidates"))
    r = h.groupBy("game_id", "team_id", F.col("subject").alias("person_id")).agg(F.sum("exposure").cast("double").alias("minutes"), (F.min("event_id") % 4 == 0).alias("starter"))
    return e, r


def g3(s, d):
    return rounded(lineups.person_totals(lineups.stints(*_lineup(s, d))))


def g3_pairs(s, d):
    return rounded(lineups.pair_time(lineups.stints(*_lineup(s, d))))


def g4(s, d):
    """Whom a line's text may mean among the parts on its side of the order: by full name, by a brand that a play spells, or by the last word."""
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("game_id"), (F.col("l_linenumber") % 2).cast("long").alias("team_id"), F.col("l_partkey").alias("person_id"), "l_returnflag")
    p = table(s, d, "part").select(F.col("p_partkey").alias("person_id"), "p_name", "p_brand")
    j = lines.join(p, "person_id")
    roster = j.select("game_id", "team_id", "person_id", F.substring_index("p_name", " ", 1).alias("first_name"), F.substring_index("p_name", " ", -1).alias("last_name")).distinct()
    plays = j.where("l_returnflag = 'R'").select("game_id", "person_id", F.col("p_brand").alias("player_name"))
    said = F.when(F.col("l_returnflag") == "A", F.upper("p_name")).when(F.col("l_returnflag") == "R", F.concat(F.lit(" "), F.col("p_brand"), F.lit("."))).otherwise(F.concat(F.lit("J.  "), F.substring_index("p_name", " ", -1)))
    mentions = j.select("game_id", "team_id", said.alias("name")).distinct()
    out = lineups.with_candidates(mentions, lineups.name_index(roster, plays))
    return out.select("game_id", "team_id", "name", F.size("candidates").alias("n"), F.when(F.size("candidates") == 1, F.element_at("candidates", 1)).alias("person_id"), F.element_at("candidates", 1).alias("smallest"))


def s16(s, d):
    e, r = _lineup(s, d)
    return lineups.on_court(lineups.stints(e, r), r)


def s16_incremental(s, d):
    """Three builds into one folder: all seasons, then none, then the last one after its events have changed; rows as they stand at the end."""
    e, r = _lineup(s, d)
    season = F.floor(F.col("game_id") / 10_000_000_000).cast("int")  # ten days
    e, r, folder = e.withColumn("season", season), r.withColumn("season", season), shared_folder(s, "on-court")
    last = e.agg(F.max("season")).first()[0]
    later = e.withColumn("t", F.when(F.col("season") == last, F.col("t") + 0.5).otherwise(F.col("t")))
    runs = [(k, n) for k, events in enumerate((e, e, later), 1) for n in lineups.build_on_court(events, r, folder)]
    built = s.createDataFrame(runs, "run int, season int")
    rows = s.read.parquet(f"{folder}/on_court").groupBy("season").agg((F.count("*") > 0).alias("has_rows"))
    return built.join(rows, "season").select("run", "season", "has_rows")


QUERIES = [
    Query("s3_stacked_schedules", s3, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS arena, CAST(NULL AS VARCHAR) AS city FROM customer"),
    Query("s4_prefix_scan", s4, "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'STANDARD%' OR p_type LIKE 'PROMO%'"),
    Query("s9_loose_columns", s9, "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0 AND o_totalprice > 1000"),
    Query("s12_slim_export", s12, "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) >= 1996"),
    Query("s13_team_sample", s13, """WITH g AS (SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND year(o_orderdate) IN (1996, 1997, 1998)), b AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM g))
      SELECT 'people' AS part, s_suppkey AS id FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM b) UNION ALL SELECT 'box', l_orderkey FROM b"""),
    Query("s18_work_list", s18, """WITH g AS (SELECT (o_orderkey % 4 + 1) * 10000000 + o_orderkey AS game_id, o_orderdate AS ts, year(o_orderdate) AS season FROM orders)
      SELECT game_id, season FROM g WHERE game_id // 10000000 IN (2, 4) AND ts < TIMESTAMP '2000-01-01' AND season BETWEEN 1996 AND 1999 AND game_id % 5 <> 0"""),
    Query("g4_name_index", g4, """WITH j AS (SELECT l_orderkey AS game_id, CAST(l_linenumber % 2 AS BIGINT) AS team_id, l_partkey AS person_id, l_returnflag AS f, p_name, p_brand, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', -1) AS z FROM lineitem JOIN part ON p_partkey = l_partkey),
      i AS (SELECT DISTINCT game_id, team_id, person_id, unnest([z, a || ' ' || z]) AS key FROM j UNION SELECT j.game_id, j.team_id, j.person_id, lower(p_brand) FROM j WHERE (game_id, person_id) IN (SELECT game_id, person_id FROM j WHERE f = 'R')),
      m AS (SELECT DISTINCT game_id, team_id, CASE f WHEN 'A' THEN upper(p_name) WHEN 'R' THEN ' ' || p_brand || '.' ELSE 'J.  ' || z END AS name FROM j), k AS (SELECT *, trim(regexp_replace(replace(lower(name), '.', ''), '\\s+', ' ', 'g')) AS key FROM m),
      e AS (SELECT k.game_id, k.team_id, name, list(DISTINCT person_id) AS c FROM k JOIN i USING (game_id, team_id, key) GROUP BY ALL), n AS (SELECT k.game_id, k.team_id, name, list(DISTINCT person_id) AS c FROM k JOIN i ON k.game_id = i.game_id AND k.team_id = i.team_id AND split_part(k.key, ' ', -1) = split_part(i.key, ' ', -1) GROUP BY ALL),
      u AS (SELECT game_id, team_id, name, coalesce(e.c, n.c) AS c FROM m LEFT JOIN e USING (game_id, team_id, name) LEFT JOIN n USING (game_id, team_id, name))
      SELECT game_id, team_id, name, CAST(len(c) AS INTEGER) AS n, CASE WHEN len(c) = 1 THEN c[1] END AS person_id, list_min(c) AS smallest FROM u"""),
    Query("g3_lineups", g3),
    Query("g3_pair_time", g3_pairs),
    Query("s16_on_court", s16),
    Query("s16_incremental", s16_incremental, f"""WITH g AS (SELECT DISTINCT CAST((d - DATE '2024-01-01') // 10 AS INTEGER) AS season FROM {E}) SELECT 1 AS run, season, true AS has_rows FROM g UNION ALL SELECT 3, max(season), true FROM g"""),
]
