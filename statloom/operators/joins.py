"""Joins: lookups valid in a season, recovery of ids, opponents, fallbacks, overlaps and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row a key: the last by `order`."""
    desc = [F.desc(c) if isinstance(c, str) else c for c in order]
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*desc))).where("__r = 1").drop("__r")


def season_lookup(keys: DataFrame, history: DataFrame, key: str, season: str, first: str, last: str, cols: Sequence[str]) -> DataFrame:
    """keys with the history row valid in the season (first <= season <= last); of several, the one that began last.

    The range is unrolled to seasons, so the join is on equal keys.
    """
    years = history.withColumn("__y", F.explode(F.sequence(F.col(first), F.least(F.col(last), F.lit(2200)))))
    years = newest(years, [key, "__y"], [first, *cols]).select(F.col(key).alias("__k"), "__y", *cols)
    return keys.join(years, (keys[key] == years["__k"]) & (keys[season] == years["__y"]), "left").drop("__k", "__y")


def recover_ids(df: DataFrame, games: DataFrame, game: str, id_col: str, name_col: str) -> DataFrame:
    """df with null ids filled from the game's two sides (home_id, home_name, away_id, away_name) by name."""
    g = games.select(F.col(game).alias("__g"), "home_id", "home_name", "away_id", "away_name")
    j = df.join(g, df[game] == g["__g"], "left")
    found = F.when(F.col(name_col) == F.col("home_name"), F.col("home_id")).when(F.col(name_col) == F.col("away_name"), F.col("away_id"))
    return j.withColumn(id_col, F.coalesce(F.col(id_col), found)).select(*df.columns)


def with_opponent(df: DataFrame, game: str, side: str, cols: Sequence[str], prefix: str = "opp_") -> DataFrame:
    """Each row with the other sides' columns of the same game."""
    other = df.select(F.col(game).alias("__g"), F.col(side).alias(prefix + side), *[F.col(c).alias(prefix + c) for c in cols])
    return df.join(other, (df[game] == other["__g"]) & (df[side] != other[prefix + side])).drop("__g")


def side_sums(df: DataFrame, game: str, side: str, cols: Sequence[str]) -> DataFrame:
    """(game, side, cols): each column's sum over a game's side, a row a side.

    The rows of a game are sorted by side once, which later windows over the game share: a sort can go to disk and is all that
    a task holds, where aggregates would add a hash table of its sides each.
    """
    w = Window.partitionBy(game).orderBy(side)
    same = w.rangeBetween(Window.currentRow, Window.currentRow)
    first = F.row_number().over(w) == F.rank().over(w)
    return df.select(game, side, *[F.sum(c).over(same).alias(c) for c in cols], first.alias("__first")).where("__first").drop("__first")


def opponent_sums(df: DataFrame, game: str, side: str, cols: Sequence[str], prefix: str = "opp_") -> DataFrame:
    """(game, side, opponents, prefix + col): rows and sums of a game's other sides; sides without another one have no row.

    Windows over the game: its totals less the side's own, where a self-join would pair all sides.
    """
    own = side_sums(df.select(game, side, *cols, F.lit(1).alias("__n")), game, side, ["__n", *cols]).select(game, side, "__n", *[F.col(c).alias(f"__{c}") for c in cols])
    w = Window.partitionBy(game)
    rest = own.select(game, side, (F.sum("__n").over(w) - F.col("__n")).alias("opponents"), *[(F.coalesce(F.sum(f"__{c}").over(w), F.lit(0)) - F.coalesce(f"__{c}", F.lit(0))).alias(prefix + c) for c in cols])
    return rest.where("opponents > 0")


def first_known(df: DataFrame, sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str], cols: Sequence[str], needs: str) -> DataFrame:
    """df with cols from the first source that has a row with `needs` for the keys, and the source's name as `decided_by`."""
    out, choice = df, []
    for i, (name, source) in enumerate(sources):
        own = source.where(F.col(needs).isNotNull()).select(*keys, F.struct(F.lit(name).alias("decided_by"), *cols).alias(f"__s{i}"))
        out = out.join(own, list(keys), "left")
        choice.append(F.col(f"__s{i}"))
    return out.withColumn("__s", F.coalesce(*choice)).select(*df.columns, "__s.*")


def shared_time(segments: DataFrame, game: str, who: str, side: str, start: str, end: str) -> DataFrame:
    """(game, who, other, shared): overlapping time of members of different sides, both ways.

    Intervals of one game overlap where each starts before the other ends; the game is the join key.
    """
    a = segments.select(F.col(game).alias("game"), F.col(who).alias("who"), F.col(side).alias("__s"), F.col(start).alias("__a"), F.col(end).alias("__b"))
    b = segments.select(F.col(game).alias("__g"), F.col(who).alias("other"), F.col(side).alias("__s2"), F.col(start).alias("__a2"), F.col(end).alias("__b2"))
    j = a.join(b, (F.col("game") == F.col("__g")) & (F.col("__s") != F.col("__s2")) & (F.col("__a") < F.col("__b2")) & (F.col("__a2") < F.col("__b")))
    return j.groupBy("game", "who", "other").agg(F.sum(F.least("__b", "__b2") - F.greatest("__a", "__a2")).alias("shared"))


def compare_totals(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Full outer comparison of two tables' values: both, their difference, and whether it is within the tolerance."""
    a, b = left.select(*keys, F.col(value).alias("left_value")), right.select(*keys, F.col(value).alias("right_value"))
    j = a.join(b, list(keys), "full_outer")
    error = F.coalesce("left_value", F.lit(0.0)) - F.coalesce("right_value", F.lit(0.0))
    return j.withColumn("error", error).withColumn("reliable", F.abs(F.col("error")) <= tolerance)


def normalized(name: Column) -> Column:
    """Lower case, letters (of any script) and digits only, without apostrophes and dots, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "['\u2019.]", ""), r"[^\p{L}\p{N}]+", " "))


def _allowed(least: float, longest: Column) -> Column:
    """Most edits between two names, the longer one of `longest` letters, at a score of at least `least`."""
    return F.floor((1 - least) * longest + 1e-9).cast("int")


def _needed(least: float, n: Column, grams: int = 2) -> Column:
    """Pairs of letters that a name of n letters shares at least with any other of that score, whatever the other's length."""
    lengths = F.sequence(n, F.floor(n / least + 1e-9).cast("int"))
    return F.array_min(F.transform(lengths, lambda x: x - 1 - grams * _allowed(least, x)))


def similar_names(asked: DataFrame, known: DataFrame, least: float = 0.7) -> DataFrame:
    """(n, m, score) of all pairs of normalised names, from asked (n) and known (m), with 1 - edits / longer length of at least `least`.

    Exact: an edit touches two pairs of letters and moves others by one place, so similar names share pairs of letters at nearly
    the same place. Each name offers its rarest ones, as many as the bound needs; candidates meet on equal (pair of letters, place,
    length), where the asked name tries the places and lengths in reach, and edits are then counted. least is 0.7 or more; equal
    names of under three letters are found by equality.
    """
    if not 0.7 <= least <= 1:
        raise ValueError("least is between 0.7 and 1")
    a, k = asked.select("n").where("n <> ''").distinct(), known.select("m").where("m <> ''").distinct()
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.struct(F.substring(c, i, F.lit(2)).alias("g"), i.alias("i")))
    long = lambda d, c: d.where(F.length(c) >= 3).select(c, F.length(c).alias("l"), F.explode(grams(F.col(c))).alias("x")).select(c, "l", "x.g", "x.i")
    often = long(k, "m").groupBy("g").agg(F.count("*").alias("f"))

    def offered(d: DataFrame, c: str) -> DataFrame:
        """The rarest pairs of letters of each name: all but as many as it must share, and one."""
        rare = Window.partitionBy(c).orderBy(F.coalesce("f", F.lit(0)), "g", "i")
        r = long(d, c).join(often, "g", "left").withColumn("r", F.row_number().over(rare))
        return r.where(F.col("r") <= F.col("l") - 1 - _needed(least, F.col("l")) + 1).select(c, "l", "g", "i")

    tries = offered(a, "n").withColumn("l", F.explode(F.sequence(F.ceil(F.col("l") * least - 1e-9).cast("int"), F.floor(F.col("l") / least + 1e-9).cast("int")))).withColumn("d", F.floor((1 - least) * F.greatest("l", F.length("n")) + 1e-9).cast("int"))
    tries = tries.withColumn("i", F.explode(F.sequence(F.col("i") - F.col("d"), F.col("i") + F.col("d")))).select("n", "l", "g", "i")
    pairs = tries.join(offered(k, "m"), ["l", "g", "i"]).select("n", "m").distinct().unionByName(a.join(k, F.col("n") == F.col("m"))).distinct()
    score = F.when(F.col("n") == F.col("m"), F.lit(1.0)).otherwise(1 - F.levenshtein("n", "m") / F.greatest(F.length("n"), F.length("m")))
    return pairs.select("n", "m", F.round(score, 6).alias("score")).where(F.col("score") >= least)


def resolve_names(asked: DataFrame, known: DataFrame, text: str, name: str, id_col: str, weight: str, least: float = 0.7, gap: float = 0.1, ratio: float = 1.8, span: Sequence[str] | None = None) -> DataFrame:
    """(text, id, score, status) of each asked name: the best by edit distance, 1 where the normalised names are equal.

    All candidates of at least `least` are found. With span (first, last; columns of both tables, null for open) those whose
    span overlaps the asked one come alone if there are any. Ties go to the larger weight, then the smaller id. status is
    unique, clear (the next score is `gap` lower, or the next weight `ratio` times smaller) or ambiguous.
    """
    first, last = span or (None, None)
    era = lambda d, c, other: F.coalesce(F.col(c), F.lit(other)) if c else F.lit(other)
    a = asked.select(F.col(text).alias("text"), era(asked, first, -(1 << 30)).alias("__f"), era(asked, last, 1 << 30).alias("__l"), normalized(F.col(text)).alias("n")).distinct()
    k = known.select(F.col(id_col).alias("id"), F.col(weight).alias("weight"), era(known, first, -(1 << 30)).alias("__kf"), era(known, last, 1 << 30).alias("__kl"), normalized(F.col(name)).alias("m"))
    asks = Window.partitionBy("text", "__f", "__l")
    hits = a.join(similar_names(a, k, least), "n").join(k, "m")
    hits = hits.groupBy("text", "__f", "__l", "id", "weight", ((F.col("__kf") <= F.col("__l")) & (F.col("__f") <= F.col("__kl"))).alias("__in")).agg(F.max("score").alias("score"))
    hits = hits.withColumn("__any", F.max("__in").over(asks)).where("__in OR NOT __any")
    order = asks.orderBy(F.desc("score"), F.desc("weight"), "id")
    hits = hits.withColumn("__r", F.row_number().over(order)).withColumn("__next", F.lead("score").over(order)).withColumn("__weight", F.lead("weight").over(order))
    ahead = (F.col("score") - F.col("__next") >= gap - 1e-9) | (F.col("weight") >= ratio * F.greatest(F.col("__weight"), F.lit(1)))
    status = F.when(F.col("__next").isNull(), "unique").when(ahead, "clear").otherwise("ambiguous")
    return hits.where("__r = 1").select("text", *([F.col("__f").alias(first), F.col("__l").alias(last)] if span else []), "id", "score", status.alias("status"))


def resolve_venues(asked: DataFrame, venues: DataFrame, teams: DataFrame) -> DataFrame:
    """(text, season, team_id): whose venue a place is in a season, a row a team.

    First the venues (alias, team_id, first, last; null bounds are open) of that name: those of the season, or all of them
    where none is dated so. Else the teams (team_id, city, name) of that city, else those of that name or full name.
    """
    a = asked.select("text", "season", normalized(F.col("text")).alias("__n"))
    v = venues.select(normalized(F.col("alias")).alias("__n"), "team_id", F.coalesce("first", F.lit(0)).alias("__f"), F.coalesce("last", F.lit(9999)).alias("__l"))
    city, name = normalized(F.col("city")), normalized(F.col("name"))
    named = F.explode(F.array(F.struct(city.alias("n"), F.lit(2).alias("k")), F.struct(name.alias("n"), F.lit(3).alias("k")), F.struct(F.concat_ws(" ", city, name).alias("n"), F.lit(3).alias("k"))))
    t = teams.select("team_id", named.alias("x")).select(F.col("x.n").alias("__n"), "team_id", F.col("x.k").alias("__k"))
    dated = F.col("season").between(F.col("__f"), F.col("__l"))
    hits = a.join(v, "__n").select("text", "season", "team_id", F.when(dated, 0).otherwise(1).alias("__k")).unionByName(a.join(t, "__n").select("text", "season", "team_id", "__k"))
    best = F.min("__k").over(Window.partitionBy("text", "season"))
    return hits.withColumn("__b", best).where("__k = __b").select("text", "season", "team_id").distinct()


def keep_given(df: DataFrame, col: str, looked_up: Column) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), looked_up))


def teammates_out(df: DataFrame, roster: DataFrame, person: int, game: str, team: str, season: str, who: str) -> DataFrame:
    """Rows of games that `person` missed although on the team's roster that season."""
    on = roster.where(F.col(who) == person)
    return df.join(on.select(team, season).distinct(), [team, season], "left_semi").join(on.select(game, team).distinct(), [game, team], "left_anti")
