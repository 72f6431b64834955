"""Sources and sinks: typed CSV, play-by-play Parquet, nested JSON, and slim exports with a manifest."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clock_seconds, kind_of_id, normalized_alias, season_of_id
from ..operators.joins import newest


def typed_csv(spark: SparkSession, path: str | Sequence[str], types: Mapping[str, str]) -> DataFrame:
    """The declared columns of CSV files with a header, by their declared types; nothing is inferred.

    A declared column that a file lacks is an error; a value that doesn't parse is null, and so is NaN.
    """
    raw = spark.read.option("header", True).csv(path if isinstance(path, str) else list(path))
    missing = [c for c in types if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return raw.select(*[_typed(F.col(f"`{c}`"), t).alias(c) for c, t in types.items()])


def _typed(c: Column, kind: str) -> Column:
    if kind == "string":
        return c
    if kind == "timestamp":
        return F.try_to_timestamp(F.substring(c, 1, 19))
    if kind in ("double", "float"):
        x = c.try_cast(kind)
        return F.when(~F.isnan(x), x)
    if kind in ("long", "bigint", "int"):
        return F.coalesce(c.try_cast(kind), F.floor(c.try_cast("double")).cast(kind))
    return c.try_cast(kind)


def stacked_last(spark: SparkSession, tables: Sequence[DataFrame], key: str, schema: str) -> DataFrame:
    """Tables of differing columns in one, a row a key: that of the last table that has it. None given: an empty table."""
    want = T._parse_datatype_string(schema)
    if not tables:
        return spark.createDataFrame([], want)
    out = None
    for i, t in enumerate(tables):
        own = t.select(*[F.col(f.name).cast(f.dataType) if f.name in t.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields], F.lit(i).alias("__i"))
        out = own if out is None else out.unionByName(own)
    return newest(out, [key], ["__i"]).drop("__i")


def prefixed(df: DataFrame, id_col: str, prefixes: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """cols of the rows whose id begins with one of the prefixes; both reach the Parquet scan."""
    test = F.lit(False)
    for p in prefixes:
        test = test | F.col(id_col).startswith(p)
    return df.where(test).select(*cols)


def rosters(box: DataFrame, games: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Box-score rows with their game's season, their team id filled from the side they played for."""
    b = box.join(wanted.select("game_id").distinct(), "game_id", "left_semi") if wanted is not None else box
    j = b.join(games.select("game_id", "season", "home_id", "away_id"), "game_id", "left")
    side = F.when(F.col("home") == 1, F.col("home_id")).when(F.col("home") == 0, F.col("away_id"))
    return j.withColumn("team_id", F.coalesce("team_id", side)).drop("home_id", "away_id")


# A matchup's statistics under their names in the raw records.
MATCHUP_STATS = """partialPossessions playerPoints teamPoints matchupAssists matchupPotentialAssists matchupTurnovers matchupBlocks
matchupFieldGoalsMade matchupFieldGoalsAttempted matchupThreePointersMade matchupThreePointersAttempted matchupFreeThrowsMade
matchupFreeThrowsAttempted helpBlocks helpFieldGoalsMade helpFieldGoalsAttempted shootingFouls switchesOn
percentageDefenderTotalTime percentageOffensiveTotalTime percentageTotalTimeBothOn""".split()
# End of fixed values.
_STATS = ", ".join(f"{n}:double" for n in MATCHUP_STATS)
_SIDE = f"struct<teamId:long, players:array<struct<personId:long, position:string, matchups:array<struct<personId:long, statistics:struct<matchupMinutes:string, {_STATS}>>>>>>"
MATCHUP_SCHEMA = f"boxScoreMatchups struct<gameId:string, homeTeam:{_SIDE}, awayTeam:{_SIDE}>"


def matchups(raw: DataFrame) -> DataFrame:
    """Nested matchup records flattened: a row for an offensive player and each defender of the other side, with all statistics.

    Statistics keep their names in snake case, without `matchup`.
    """
    box = raw.select(F.col("boxScoreMatchups.gameId").cast("long").alias("game_id"), F.col("boxScoreMatchups.homeTeam").alias("h"), F.col("boxScoreMatchups.awayTeam").alias("a"))
    sides = box.select("game_id", F.explode(F.array(F.struct(F.col("h").alias("side"), F.col("a.teamId").alias("against")), F.struct(F.col("a").alias("side"), F.col("h.teamId").alias("against")))).alias("x"))
    players = sides.select("game_id", F.col("x.side.teamId").alias("team_id"), F.col("x.against").alias("def_team_id"), F.explode("x.side.players").alias("p"))
    rows = players.select("game_id", "team_id", F.col("p.personId").alias("off_person_id"), F.nullif(F.col("p.position"), F.lit("")).alias("off_position"), "def_team_id", F.explode("p.matchups").alias("m"))
    stats = [F.col(f"m.statistics.{n}").alias(re.sub(r"(?<=[a-z])(?=[A-Z])", "_", n).lower().removeprefix("matchup_")) for n in MATCHUP_STATS]
    return rows.select("game_id", "team_id", "off_person_id", "off_position", "def_team_id", F.col("m.personId").alias("def_person_id"), clock_seconds(F.col("m.statistics.matchupMinutes")).alias("seconds"), *stats)


def all_matchups(raw: DataFrame, bio: DataFrame) -> DataFrame:
    """matchups() with season and kind of game from its id, and the defender's columns of bio (person_id, ...), a row a person."""
    known = bio.dropDuplicates(["person_id"])
    known = known.select(*[F.col(c).alias(f"def_{c}") for c in known.columns])
    m = matchups(raw).withColumn("season", season_of_id(F.col("game_id"))).withColumn("kind", kind_of_id(F.col("game_id")))
    return m.join(known, "def_person_id", "left")


def read_raw_matchups(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON files, also gzipped ones: one record (a game) a file, or a record a line."""
    return spark.read.schema(MATCHUP_SCHEMA).option("multiLine", not lines).json(path)


def aliases(spark: SparkSession, path: str, id_col: str, text_col: str) -> DataFrame:
    """(id, alias) from a CSV with # comments, aliases normalised."""
    raw = spark.read.option("header", True).option("comment", "#").csv(path)
    return raw.select(F.col(id_col).try_cast("long").alias("id"), normalized_alias(F.col(text_col)).alias("alias")).where("alias <> ''").distinct()


def picked(df: DataFrame, wanted: Mapping[str, Sequence[str]], reliable: str | None = None) -> DataFrame:
    """Columns under the first of their candidate names; an error where none exists. Unreliable rows go."""
    cols = []
    for name, candidates in wanted.items():
        found = next((c for c in candidates if c in df.columns), None)
        if found is None:
            raise ValueError(f"none of {', '.join(candidates)} for {name}")
        cols.append(F.col(found).alias(name))
    kept = df.where(F.coalesce(F.col(reliable), F.lit(False))) if reliable and reliable in df.columns else df
    return kept.select(*cols)


@dataclass(frozen=True)
class Slim:
    """What of a table goes into a slim export."""

    columns: Sequence[str]
    downcast: Mapping[str, str] = field(default_factory=dict)
    sort_by: Sequence[str] = ()
    keep_if_true: str | None = None


def slim(df: DataFrame, spec: Slim, start_season: int | None = None) -> DataFrame:
    """df cut to the spec; a missing column is an error, a null flag drops the row."""
    missing = [c for c in spec.columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    if start_season is not None and "season" in df.columns:
        df = df.where(F.col("season") >= start_season)
    if spec.keep_if_true:
        df = df.where(F.coalesce(F.col(spec.keep_if_true), F.lit(False)))
    return df.select(*[F.col(c).cast(spec.downcast[c]).alias(c) if c in spec.downcast else F.col(c) for c in spec.columns])


def write_slim(df: DataFrame, spec: Slim, path: str, start_season: int | None = None) -> DataFrame:
    """Write the slim table, ranged and sorted by its key, as zstd Parquet; returns its manifest row (path, rows)."""
    out = slim(df, spec, start_season)
    if spec.sort_by:
        out = out.repartitionByRange(*spec.sort_by).sortWithinPartitions(*spec.sort_by)
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)
    spark = df.sparkSession
    return spark.read.parquet(path).agg(F.lit(path).alias("path"), F.count("*").alias("rows"))


def shrunk(df: DataFrame) -> DataFrame:
    """Doubles as floats; low-cardinality text needs nothing, Parquet has dictionaries."""
    return df.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Write each table below folder as zstd Parquet with floats; (name, rows, columns, bytes) of what was written."""
    report = None
    for name, df in tables.items():
        path = f"{folder}/{name}.parquet"
        shrunk(df).write.mode("overwrite").option("compression", "zstd").parquet(path)
        size = df.sparkSession.read.format("binaryFile").load(path).agg(F.sum("length").alias("bytes"))
        own = df.sparkSession.read.parquet(path).agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns")).crossJoin(size)  # a row each
        report = own if report is None else report.unionByName(own)
    return report


def work_list(games: DataFrame, stored: DataFrame, kinds: Sequence[int], before: Column, first: int, last: int) -> DataFrame:
    """Played games of the kinds (first digit of the id) in a range of seasons that aren't stored yet, oldest first."""
    kind = F.floor(F.col("game_id") / 10_000_000)
    todo = games.where(kind.isin(list(kinds)) & (F.col("ts") < before) & F.col("season").between(first, last))
    return todo.join(stored.select("game_id"), "game_id", "left_anti").orderBy("ts", "game_id")


def sample_of_team(tables: Mapping[str, DataFrame], games: DataFrame, team: int, seasons: Sequence[int]) -> dict[str, DataFrame]:
    """Every table's rows of one team's games in some seasons; tables without game_id follow the people in those rows."""
    chosen = games.where(F.col("season").isin(list(seasons)) & ((F.col("home_id") == team) | (F.col("away_id") == team))).select("game_id")
    out = {n: t.join(chosen, "game_id", "left_semi") for n, t in tables.items() if "game_id" in t.columns}
    people = None
    for t in out.values():
        if "person_id" in t.columns:
            p = t.select("person_id")
            people = p if people is None else people.unionByName(p)
    for n, t in tables.items():
        if n not in out:
            out[n] = t.join(people.distinct(), "person_id", "left_semi") if people is not None and "person_id" in t.columns else t
    return out
