"""All raw tables as one bundle, the processed tables made of them, and parameters kept between runs.

A bundle is a dict of lazy DataFrames by name: nothing is read before a query asks for it, and each query
reads only its columns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import windows as w
from ..operators.aggregates import modal_value
from ..operators.joins import newest, with_opponent
from ..session import staged
from .tables import rosters, stacked_last, typed_csv


def _columns(long: str, double: str = "", string: str = "") -> dict[str, str]:
    return {c: kind for kind, names in (("long", long), ("double", double), ("string", string)) for c in names.split()}


# Files and columns of the box-score dataset, as they are named there.
_SHOTS = "fieldGoalsAttempted fieldGoalsMade threePointersAttempted threePointersMade freeThrowsAttempted freeThrowsMade"
_BOX = f"assists blocks steals {_SHOTS} reboundsDefensive reboundsOffensive reboundsTotal foulsPersonal turnovers"
_ADVANCED = """offensiveRating defensiveRating netRating pace possessions effectiveFieldGoalPercentage trueShootingPercentage teamTurnoverPercentage
offensiveReboundPercentage freeThrowAttemptRate opponentEffectiveFieldGoalPercentage opponentTurnoverPercentage opponentOffensiveReboundPercentage opponentFreeThrowAttemptRate"""
RAW = {
    "player_stats": ("PlayerStatistics.csv", _columns("personId gameId win home playerteamId opponentteamId", f"points {_BOX} plusMinusPoints", "firstName lastName gameDateTimeEst playerteamCity playerteamName opponentteamCity opponentteamName gameType numMinutes startingPosition")),
    "team_stats": ("TeamStatistics.csv", _columns("gameId teamId opponentTeamId home win", f"teamScore opponentScore {_BOX} numMinutes", "gameDateTimeEst gameType")),
    "team_advanced": ("TeamStatisticsExtended.csv", _columns("gameId teamId", _ADVANCED)),
    "games": ("Games.csv", _columns("gameId hometeamId awayteamId", "homeScore awayScore", "gameDateTimeEst hometeamCity hometeamName awayteamCity awayteamName gameType arenaName arenaCity")),
    "players": ("Players.csv", _columns("personId guard forward center draftYear draftRound draftNumber", "heightInches bodyWeightLbs", "firstName lastName birthDate")),
    "team_histories": ("TeamHistories.csv", _columns("teamId seasonFounded seasonActiveTill", "", "teamCity teamName teamAbbrev league")),
}
SCHEDULE = _columns("gameId", "", "arenaName arenaCity")
# End of fixed values.


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def _named(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(snake(c)) for c in df.columns])


def load_raw(spark: SparkSession, folder: str, schedules: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The raw tables below folder with typed columns in snake case; schedule files that don't exist are left out."""
    out = {name: _named(typed_csv(spark, f"{folder}/{file}", types)) for name, (file, types) in RAW.items()}
    found = []
    for file in schedules:
        try:
            found.append(_named(typed_csv(spark, f"{folder}/{file}", SCHEDULE)))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    out["schedules"] = stacked_last(spark, found, "game_id", "game_id long, arena_name string, arena_city string")
    return out


def game_table(raw: Mapping[str, DataFrame]) -> DataFrame:
    """A row a game: time, season, kind, both sides, and the arena, from the schedules where the games lack it."""
    g = newest(raw["games"], ["game_id"], ["game_date_time_est"])
    plan = raw["schedules"].select("game_id", F.col("arena_name").alias("__a"), F.col("arena_city").alias("__c"))
    g = g.join(plan, "game_id", "left")
    ts = x.zoneless_timestamp(F.col("game_date_time_est"))
    return g.select(
        "game_id", ts.alias("ts"), F.to_date(ts).alias("d"), x.season_of_id(F.col("game_id")).alias("season"), x.resolved_kind(F.col("game_id"), F.col("game_type")).alias("kind"),
        F.col("hometeam_id").alias("home_id"), F.col("awayteam_id").alias("away_id"), F.coalesce("arena_name", "__a").alias("arena"), F.coalesce("arena_city", "__c").alias("arena_city"),
    )


#: Statistics of which the processed tables hold rolling means, and over how many earlier games.
TEAM_ROLLING = ("team_score", "opp_team_score", "assists", "rebounds_total", "three_pointers_made", "turnovers")
PLAYER_ROLLING = ("points", "assists", "rebounds_total", "three_pointers_made", "steals", "blocks", "turnovers", "minutes")
RECENT = (5, 10, 20)


def rolling(stats: Sequence[str], by: str, sizes: Sequence[int] = RECENT, order: Sequence[str] = ("ts", "game_id")) -> list:
    """Columns <stat>_last<n>: all have one partitioning and order, so they are one sort."""
    return [w.lagged_mean(c, by, n, order).alias(f"{c}_last{n}") for c in stats for n in sizes]


def team_table(raw: Mapping[str, DataFrame], games: DataFrame) -> DataFrame:
    """A row a team and game: box score, the opponent's score, advanced statistics, rest, ratings and rolling means from before the game."""
    box = [snake(c) for c in _BOX.split()]
    t = newest(raw["team_stats"], ["game_id", "team_id"], ["num_minutes", "team_score"]).select("game_id", "team_id", "home", "win", "team_score", *box)
    advanced = newest(raw["team_advanced"], ["game_id", "team_id"], ["possessions", "offensive_rating"])
    t = t.join(games.select("game_id", "ts", "d", "season", "kind"), "game_id").join(advanced, ["game_id", "team_id"], "left")
    t = with_opponent(t, "game_id", "team_id", ["team_score"])
    order, by = ["ts", "game_id"], ["team_id", "season"]
    t = w.before_or_last_season(t, "team_id", "season", ["offensive_rating", "defensive_rating", "pace"], "possessions", order=order)
    rest = w.rest_features(w.days_since_previous(by, "d", order))
    return t.select("*", *[c.alias(n) for n, c in rest.items()], *rolling(TEAM_ROLLING, "team_id"))


def player_table(raw: Mapping[str, DataFrame], games: DataFrame, teams: DataFrame) -> DataFrame:
    """A row a person and game played, of several the one with most minutes: box score, the team's context, age, position group, and the person's own past."""
    box = ["points", *[snake(c) for c in _BOX.split()], "plus_minus_points"]
    started = F.nullif(F.col("starting_position"), F.lit(""))
    p = raw["player_stats"].select("person_id", "game_id", "home", F.col("playerteam_id").alias("team_id"), started.alias("started_at"), started.isNotNull().alias("starter"), x.minutes(F.col("num_minutes")).alias("minutes"), *box)
    p = newest(p.where("minutes > 0"), ["person_id", "game_id"], ["minutes", "points"])
    p = rosters(p, games).where("team_id IS NOT NULL").drop("season")
    context = teams.select("game_id", "team_id", "ts", "d", "season", "kind", "win", "opp_team_id", F.col("pre_games").alias("team_pre_games"), *[F.col(f"pre_{c}").alias(f"team_pre_{c}") for c in ("offensive_rating", "defensive_rating", "pace")])
    p = p.join(context, ["game_id", "team_id"])
    theirs = teams.select("game_id", F.col("team_id").alias("opp_team_id"), *[F.col(f"pre_{c}").alias(f"opp_pre_{c}") for c in ("offensive_rating", "defensive_rating", "pace")])
    p = p.join(theirs, ["game_id", "opp_team_id"], "left")
    people = newest(raw["players"], ["person_id"], ["draft_year"])
    usual = modal_value(p.withColumn("started_at", F.substring("started_at", 1, 1)), "person_id", "started_at")
    bio = people.join(usual, "person_id", "left").select("person_id", "height_inches", F.col("body_weight_lbs").alias("weight_lbs"), F.try_to_timestamp(F.col("birth_date")).alias("born"), x.position_group(F.col("guard"), F.col("forward"), F.col("center"), F.col("mode")).alias("position"))
    p = p.join(bio, "person_id", "left").withColumn("age", x.age_years(F.col("born"), F.col("ts"))).drop("born")
    order = ["ts", "game_id"]
    return p.select("*", w.prior_count("person_id", order).alias("prior_games"), w.days_since_previous("person_id", "d", order).alias("days_since_last"), *rolling(PLAYER_ROLLING, "person_id"))


def assemble(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every processed table of a raw bundle: games, team_games, player_games, players, teams, season_calendar.

    The tables of games and of teams' games are written at once: every other one is made of them, and a written table's size lets
    joins send them to the players' rows, many times as many, which then aren't dealt anew.
    """
    games = staged(game_table(raw), "games")
    teams = staged(team_table(raw, games), "teams")
    people = player_table(raw, games, teams)
    names = newest(raw["players"], ["person_id"], ["draft_year"]).select("person_id", F.concat_ws(" ", "first_name", "last_name").alias("name"))
    span = people.groupBy("person_id").agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.count("*").alias("games"), F.max_by("team_id", F.struct("ts", "game_id")).alias("last_team"))
    eras = raw["team_histories"].groupBy("team_id").agg(F.sort_array(F.collect_set(F.struct(F.col("season_founded").alias("first"), F.col("season_active_till").alias("last"), F.concat_ws(" ", "team_city", "team_name").alias("name")))).alias("eras"))
    played = teams.groupBy("team_id").agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.count("*").alias("games"))
    played_dates = games.select("season", "d").where("d IS NOT NULL")
    count = games.groupBy("season").agg(F.count("*").alias("games"))
    return {
        "games": games,
        "team_games": teams,
        "player_games": people,
        "players": span.join(names, "person_id", "left"),
        "teams": played.join(eras, "team_id", "left"),
        "season_calendar": w.season_calendar(played_dates).join(count, "season"),
    }


def load_bundle(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The processed tables below folder, lazily."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
