"""A hand-made game with known stints, and round trips of sources and sinks."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from statloom.operators import lineups
from statloom.sources import tables

HOME, AWAY, GAME = 100, 200, 21500001
PLAYS = "game_id long, period int, clock string, seq long, action string, sub_type string, description string, person_id string, team_id long, result string, in_person_id string"


def play(period, clock, seq, action, desc, person, team, sub="", result=None, came=None):
    return (GAME, period, clock, seq, action, sub, desc, person, team, result, came)


def legacy(sub="SUB: Home6 FOR Home1"):
    return [
        play(1, "PT11M00.00S", 1, "Made Shot", "Home1 26' 3PT Jump Shot (3 PTS) (Home2 1 AST)", "1", HOME, result="Made"),
        play(1, "PT06M00.00S", 2, "Substitution", sub, "1", HOME),
        play(1, "PT03M00.00S", 3, "Free Throw", "MISS Home6 Free Throw 1 of 2", "6", HOME),
        play(1, "PT01M00.00S", 5, "Foul", "Away11 T.FOUL", "11", AWAY, sub="Technical"),
    ]


def roster(spark):
    rows = [(GAME, HOME, p, "F", f"Home{p}", p != 6, 30.0) for p in range(1, 7)] + [(GAME, AWAY, p, "F", f"Away{p}", True, 48.0) for p in range(11, 16)]
    return spark.createDataFrame(rows, "game_id long, team_id long, person_id long, first_name string, last_name string, starter boolean, minutes double")


def rebuilt(spark, plays):
    return lineups.stints(lineups.events_of_plays(spark.createDataFrame(plays, PLAYS), roster(spark)), roster(spark))


def seconds(st):
    return {r["person_id"]: r["seconds"] for r in lineups.person_totals(st).collect()}


def test_shared_time_of_a_small_game(spark):
    st = rebuilt(spark, legacy()).cache()
    s = seconds(st)
    assert s[1] == 360 and s[6] == 360 and s[2] == 720 and s[11] == 720
    pairs = {(r["person_id"], r["opponent_id"]): r["seconds"] for r in lineups.pair_time(st).collect()}
    assert pairs[1, 11] == pairs[11, 1] == 360 and len(pairs) == 60
    assert lineups.full_share(st).first()["share"] == 1.0
    stats = spark.createDataFrame([(GAME, HOME, 1, 60.0, 3), (GAME, HOME, 6, 540.0, 1)], "game_id long, team_id long, person_id long, t double, pts int")
    got = {(r["person_id"], r["opponent_id"]): r["pts"] for r in lineups.stats_against(st, stats, ["pts"]).collect()}
    assert got[1, 11] == 3 and got[6, 15] == 1 and len(got) == 10
    box = spark.createDataFrame([(GAME, p, m) for p, m in [(1, 6.0), (6, 6.0), *((p, 12.0) for p in (2, 3, 4, 11, 12, 13, 14)), (5, 20.0), (15, 12.0)]], "game_id long, person_id long, minutes double")
    flag = {(r["person_id"], r["opponent_id"]): r["reliable"] for r in lineups.on_court(st, box).collect()}
    assert flag[1, 11] and not flag[5, 11]


def test_a_missing_name_is_filled_back(spark):
    st = rebuilt(spark, legacy("SUB:  FOR Home1"))
    assert seconds(st)[6] == 360 and max(r["repaired"] for r in st.collect()) >= 1


def test_starters_of_a_later_period(spark):
    more = [*legacy(), play(2, "PT10M00.00S", 10, "Rebound", "Home6 REBOUND", "6", HOME)]
    second = rebuilt(spark, more).where("period = 2").collect()
    assert {r["person_id"] for r in second if r["team_id"] == HOME} == {2, 3, 4, 5, 6}
    assert {r["person_id"] for r in second if r["team_id"] == AWAY} == set(range(11, 16))


def test_someone_who_acts_as_a_sixth_sends_the_longest_unseen_off(spark):
    st = rebuilt(spark, [play(1, "PT11M00.00S", i, "Rebound", "r", str(i), HOME) for i in (1, 2, 3, 4)] + [play(1, "PT06M00.00S", 9, "Rebound", "r", "6", HOME)])
    s = seconds(st)
    assert s[5] == 360 and s[6] == 360 and s[1] == 720


def test_namesakes_are_told_apart_by_who_is_on_the_floor(spark):
    # Home1 and Home6 are both called Smith: the one on the bench comes in, the one on the floor assists
    r = roster(spark).withColumn("last_name", F.when(F.col("person_id").isin(1, 6), "Smith").otherwise(F.col("last_name")))
    plays = [
        play(1, "PT11M00.00S", 1, "Made Shot", "Home2 Layup (2 PTS) (Smith 1 AST)", "2", HOME, result="Made"),
        play(1, "PT06M00.00S", 2, "Substitution", "SUB: Smith FOR Home3", "3", HOME),
        play(1, "PT05M00.00S", 3, "Substitution", "SUB: Home3 FOR Smith", "1", HOME),
        play(1, "PT04M00.00S", 4, "Made Shot", "Home2 Layup (4 PTS) (R. Smith 1 AST)", "2", HOME, result="Made"),
    ]
    events = lineups.events_of_plays(spark.createDataFrame(plays, PLAYS), r)
    named = {x["seq"]: (x["kind"], x["person_id"], x["candidates"]) for x in events.collect()}
    assert named[5] == ("act", None, [1, 6]) and named[7] == ("in", None, [1, 6]) and named[14] == ("act", None, [1, 6])
    st = lineups.stints(events, r)
    s = seconds(st)
    assert (s[1], s[3], s[6]) == (420, 660, 360) and max(x["repaired"] for x in st.collect()) == 0


def test_spellings_of_the_games_own_plays(spark):
    r = roster(spark)
    plays = spark.createDataFrame([(*play(1, "PT11M00.00S", 1, "Rebound", "r", "6", HOME), "The Rocket"), (*play(1, "PT06M00.00S", 2, "Substitution", "SUB: the  rocket FOR Home1", "1", HOME), None), (*play(1, "PT05M00.00S", 3, "Substitution", "SUB: Big Home1 FOR Nobody", "0", HOME), None)], PLAYS + ", player_name string")
    index = lineups.name_index(r, plays)
    said = spark.createDataFrame([(GAME, HOME, n) for n in ("ROCKET", "the. rocket", "F. Home2", "Home2", "nobody", "", None)], "game_id long, team_id long, name string")
    got = {x["name"]: x["candidates"] for x in lineups.with_candidates(said, index).collect()}
    assert got == {"ROCKET": [6], "the. rocket": [6], "F. Home2": [2], "Home2": [2], "nobody": None, "": None, None: None}
    events = {x["seq"]: x["person_id"] for x in lineups.events_of_plays(plays, r).collect()}
    assert (events[7], events[10], events[9]) == (6, 1, None)


def test_a_place_fallen_open_and_a_sixth(spark):
    places = lineups._opened([1, 2, 3, 4], 0.0, set())
    found, repairs = lineups.moved(places, [(5.0, "act", 1, None, False), (10.0, "act", 9, None, False), (20.0, "out", 2, None, True), (30.0, "act", 7, None, False), (40.0, "in", 8, None, False), (50.0, "act", 1, None, True), (60.0, "in", 6, None, False)], 100.0)
    # 9 had the fifth place from the start, 7 that of 2 since it fell open; 3 was not seen for longest, then 1 must have left
    assert sorted(found) == [(1, 0.0, 60.0), (2, 0.0, 20.0), (3, 0.0, 40.0), (4, 0.0, 100.0), (6, 60.0, 100.0), (7, 20.0, 100.0), (8, 40.0, 100.0), (9, 0.0, 100.0)] and repairs == 4


def test_typed_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,minutes,when,extra,score\n1,22:29,2024-01-02 03:04:05+00:00,x,1.5\n2,bad,,y,NaN\n3.0,24.5,2024-13-01 00:00:00,z,oops\n")
    df = tables.typed_csv(spark, str(p), {"id": "long", "minutes": "string", "when": "timestamp", "score": "double"})
    rows = df.orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3] and [r["score"] for r in rows] == [1.5, None, None]
    assert rows[0]["when"].isoformat() == "2024-01-02T03:04:05" and rows[2]["when"] is None
    with pytest.raises(ValueError):
        tables.typed_csv(spark, str(p), {"nope": "long"})


def test_schedules_stack_and_the_last_wins(spark):
    a = spark.createDataFrame([(1, "old"), (2, "two")], "game_id long, arena string")
    b = spark.createDataFrame([(1, "new", "x")], "game_id long, arena string, more string")
    out = tables.stacked_last(spark, [a, b], "game_id", "game_id long, arena string, city string")
    assert {(r["game_id"], r["arena"], r["city"]) for r in out.collect()} == {(1, "new", None), (2, "two", None)}
    assert tables.stacked_last(spark, [], "game_id", "game_id long").count() == 0


def test_matchup_json(spark, tmp_path):
    side = lambda t, p, d: {"teamId": t, "players": [{"personId": p, "position": "", "matchups": [{"personId": d, "statistics": {"matchupMinutes": "0:42", "partialPossessions": 2.5, "playerPoints": 3, "matchupFieldGoalsMade": 1}}]}]}
    with gzip.open(tmp_path / "g.json.gz", "wt") as f:
        f.write(json.dumps({"boxScoreMatchups": {"gameId": "0022300001", "homeTeam": side(1, 10, 20), "awayTeam": side(2, 20, 10)}}))
    raw = tables.read_raw_matchups(spark, str(tmp_path))
    bio = spark.createDataFrame([(20, 80.0), (20, 80.0)], "person_id long, height double")
    rows = {(r["off_person_id"], r["def_person_id"]): r for r in tables.all_matchups(raw, bio).collect()}
    one = rows[10, 20]
    assert set(rows) == {(10, 20), (20, 10)} and one["seconds"] == 42 and one["partial_possessions"] == 2.5 and one["field_goals_made"] == 1
    assert (one["team_id"], one["def_team_id"], one["season"], one["off_position"], one["def_height"], rows[20, 10]["def_height"]) == (1, 2, 2023, None, 80.0, None)
    assert len(tables.MATCHUP_STATS) == 21


def test_alias_file_with_comments(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# curated by hand\nid,alias\n7,St. John-Smith\n# a note,x\n8,\n7,st john smith\n")
    assert [tuple(r) for r in tables.aliases(spark, str(tmp_path / "a.csv"), "id", "alias").collect()] == [(7, "st john smith")]


def test_parameters_by_version(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from statloom.operators import boosting, models
    from statloom.sources import registry

    d = spark.createDataFrame([(float(i % 7), float(i % 3), 1.0) for i in range(60)], "x double, y double, e double")
    glm, tree = models.poisson_rate(d, "y", ["x"], "e"), boosting.fit(d, "y", ["x"], rounds=2, least=5)
    for version, v in (("v1", 1.0), ("v2", 2.0)):
        registry.save(spark, str(tmp_path), version, {"coef": spark.createDataFrame([(v,)], "v double")}, {"glm": glm, "tree": tree}, archived=["tree"], facts={"d": int(v)})
    new = registry.load(spark, str(tmp_path))
    assert (new.name, new.tables["coef"].first()["v"], new.facts, list(new.models)) == ("v2", 2.0, {"d": 2}, ["glm"]) and isinstance(new.models["glm"], PipelineModel)
    old = registry.load(spark, str(tmp_path), facts={"d": 1}, archive=True)
    assert old.name == "v1" and registry.load(spark, str(tmp_path), "v1").tables["coef"].first()["v"] == 1.0
    got = d.select(old.models["tree"].column().alias("a"), tree.column().alias("b")).collect()
    assert old.models["tree"].rounds == 2 and all(r["a"] == r["b"] for r in got)
    # a version whose writing broke off, before its entry or within it, is never read
    spark.createDataFrame([(3.0,)], "v double").write.parquet(str(tmp_path / "versions" / "v3-half" / "tables" / "coef"))
    (tmp_path / "manifest" / "_temporary" / "77").mkdir(parents=True)
    (tmp_path / "manifest" / "_temporary" / "77" / "part-0.parquet").write_bytes(b"PAR1 half")
    assert registry.load(spark, str(tmp_path)).name == "v2"
    registry.save(spark, str(tmp_path), "v1", {"coef": spark.createDataFrame([(7.0,)], "v double")})
    assert registry.load(spark, str(tmp_path), "v1").tables["coef"].first()["v"] == 7.0 and registry.load(spark, str(tmp_path)).name == "v1"
    for bad in ({"version": "v3"}, {"facts": {"d": 9}}):
        with pytest.raises(ValueError):
            registry.load(spark, str(tmp_path), **bad)


def test_only_changed_seasons_are_built_again(spark, tmp_path):
    def shifted(season):
        e = lineups.events_of_plays(spark.createDataFrame(legacy(), PLAYS), roster(spark))
        return e.withColumn("game_id", F.col("game_id") + season * 100_000).withColumn("season", F.lit(2015 + season))

    def at(season):
        return roster(spark).withColumn("game_id", F.col("game_id") + season * 100_000).withColumn("season", F.lit(2015 + season))

    events, people, folder = shifted(0).unionByName(shifted(1)), at(0).unionByName(at(1)), str(tmp_path / "court")
    assert lineups.build_on_court(events, people, folder) == [2015, 2016]
    first = {(r["game_id"], r["person_id"], r["opponent_id"]): r["seconds"] for r in spark.read.parquet(f"{folder}/on_court").collect()}
    files = sorted((tmp_path / "court" / "on_court").glob("season=2015/*.parquet"))
    assert len(first) == 120 and lineups.build_on_court(events, people, folder) == []
    changed = events.where("NOT (season = 2016 AND kind = 'in')")
    assert lineups.build_on_court(changed, people, folder) == [2016]
    assert sorted((tmp_path / "court" / "on_court").glob("season=2015/*.parquet")) == files
    assert {r["season"]: r["n"] for r in spark.read.parquet(f"{folder}/on_court").groupBy("season").agg(F.count("*").alias("n")).collect()} == {2015: 60, 2016: 60}
    assert lineups.build_on_court(changed, people.withColumn("minutes", F.when(F.col("season") == 2015, 6.0).otherwise(F.col("minutes"))), folder) == [2015]
    assert lineups.build_on_court(changed.limit(0), people.limit(0), str(tmp_path / "none")) == []


def test_slim_export(spark, tmp_path):
    df = spark.createDataFrame([(3, 1995, 1.0, True), (1, 2020, 2.0, True), (2, 1996, 3.0, True), (4, 2021, 4.0, None)], "game_id long, season int, v double, ok boolean")
    spec = tables.Slim(["game_id", "season", "v"], {"v": "float", "season": "short"}, ["game_id"], "ok")
    report = tables.write_slim(df, spec, str(tmp_path / "s"), 1996).first()
    back = spark.read.parquet(str(tmp_path / "s"))
    assert report["rows"] == 2 and [r["game_id"] for r in back.orderBy("game_id").collect()] == [1, 2]
    assert dict(back.dtypes) == {"game_id": "bigint", "season": "smallint", "v": "float"}
    with pytest.raises(ValueError):
        tables.slim(df, tables.Slim(["gone"]))


def test_tables_round_trip_and_samples(spark, tmp_path):
    games = spark.createDataFrame([(20000001, 2020, 1, 2), (20000002, 2021, 3, 4)], "game_id long, season int, home_id long, away_id long")
    box = spark.createDataFrame([(20000001, 7, 1, None), (20000002, 8, 0, None)], "game_id long, person_id long, home int, team_id long")
    people = spark.createDataFrame([(7, "a"), (8, "b")], "person_id long, name string")
    made = tables.sample_of_team({"box": box, "people": people}, games, 1, [2020])
    assert [r["person_id"] for r in made["people"].collect()] == [7]
    assert {r["person_id"]: r["team_id"] for r in tables.rosters(box, games).collect()} == {7: 1, 8: 4}
    report = {r["name"]: r["rows"] for r in tables.write_tables({"box": box, "people": people}, str(tmp_path)).collect()}
    assert report == {"box": 2, "people": 2}
    todo = tables.work_list(games.withColumn("ts", F.lit("2020-01-01").cast("timestamp")), games.where("season = 2021"), [2], F.lit("2024-01-01").cast("timestamp"), 2019, 2022)
    assert [r["game_id"] for r in todo.collect()] == [20000001]


def test_loose_columns_and_prefixes(spark):
    df = spark.createDataFrame([("0022", 1, True), ("0042", 2, None)], "gameId string, ptsA int, reliable boolean")
    assert tables.picked(df, {"game_id": ["game_id", "gameId"], "pts": ["pts", "ptsA"]}, "reliable").collect() == [("0022", 1)]
    with pytest.raises(ValueError):
        tables.picked(df, {"x": ["a", "b"]})
    assert tables.prefixed(df, "gameId", ["004"], ["ptsA"]).collect() == [(2,)]
