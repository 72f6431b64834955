"""Catalogues: named statistics as column expressions, and named variables of effects."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import normalized_alias


@dataclass(frozen=True)
class Stat:
    """A statistic: a value a row, or a ratio of two; direction 1 if more is better, else -1."""

    name: str
    value: Column
    denominator: Column | None = None
    scale: float = 1.0
    direction: int = 1
    rate: bool = True

    def per_row(self) -> Column:
        """The row's own value; null for a ratio without denominator."""
        if self.denominator is None:
            return self.value * self.scale
        return F.when(self.denominator > 0, self.value / self.denominator * self.scale)

    def pooled(self) -> Column:
        """Over a group: the mean, or the ratio of sums over rows that have both parts."""
        if self.denominator is None:
            return F.avg(self.value) * self.scale
        both = self.value.isNotNull() & self.denominator.isNotNull()
        return F.try_divide(F.sum(F.when(both, self.value)), F.sum(F.when(both, self.denominator))) * self.scale


def shooting(made: str, tried: str, name: str) -> Stat:
    return Stat(name, F.col(made), F.col(tried), 100.0, rate=False)


def player_stats() -> dict[str, Stat]:
    """Statistics over box-score columns pts, ast, reb, oreb, dreb, stl, blk, tov, pf, fgm, fga, fg3m, fg3a, ftm, fta, minutes, plus_minus."""
    c = F.col
    plain = {"points": "pts", "assists": "ast", "rebounds": "reb", "offensive_rebounds": "oreb", "defensive_rebounds": "dreb", "steals": "stl", "blocks": "blk", "threes": "fg3m", "threes_attempted": "fg3a", "fgm": "fgm", "fga": "fga", "ftm": "ftm", "fta": "fta", "plus_minus": "plus_minus"}
    out = {n: Stat(n, c(x)) for n, x in plain.items()}
    out |= {"turnovers": Stat("turnovers", c("tov"), direction=-1), "fouls": Stat("fouls", c("pf"), direction=-1), "minutes": Stat("minutes", c("minutes"), rate=False)}
    out |= {"stocks": Stat("stocks", c("stl") + c("blk")), "pra": Stat("pra", c("pts") + c("reb") + c("ast")), "pr": Stat("pr", c("pts") + c("reb")), "pa": Stat("pa", c("pts") + c("ast")), "ra": Stat("ra", c("reb") + c("ast"))}
    return out | _shares("pts") | {"efg_pct": Stat("efg_pct", c("fgm") + 0.5 * c("fg3m"), c("fga"), 100.0, rate=False)}


def _shares(points: str) -> dict[str, Stat]:
    out = {"fg_pct": shooting("fgm", "fga", "fg_pct"), "three_pct": shooting("fg3m", "fg3a", "three_pct"), "ft_pct": shooting("ftm", "fta", "ft_pct")}
    return out | {"ts_pct": Stat("ts_pct", F.col(points), 2 * (F.col("fga") + 0.44 * F.col("fta")), 100.0, rate=False)}


def team_stats() -> dict[str, Stat]:
    """Statistics of a team's game: the box-score columns, and score, allowed (the opponent's score), win (1 or 0), pace, possessions, ratings.

    None is a rate by minutes. The mean rating or pace is that of its column over games.
    """
    c = F.col
    own = lambda name, value, better=1, scale=1.0: Stat(name, value, None, scale, better, rate=False)
    plain = {"team_score": "score", "assists": "ast", "rebounds": "reb", "threes": "fg3m", "threes_attempted": "fg3a", "steals": "stl", "blocks": "blk", "pace": "pace", "possessions": "possessions", "off_rating": "off_rating", "net_rating": "net_rating"}
    worse = {"opponent_score": "allowed", "turnovers": "tov", "def_rating": "def_rating"}
    out = {n: own(n, c(x)) for n, x in plain.items()} | {n: own(n, c(x), -1) for n, x in worse.items()}
    out |= {"total_points": own("total_points", c("score") + c("allowed")), "margin": own("margin", c("score") - c("allowed")), "win_pct": own("win_pct", c("win"), 1, 100.0)}
    return out | _shares("score")


# Names of the statistics, and their everyday spellings, written without spaces and underscores.
PLAYER_NAMES = "points assists rebounds offensive_rebounds defensive_rebounds threes threes_attempted steals blocks stocks turnovers fouls minutes fgm fga ftm fta plus_minus pra pr pa ra fg_pct three_pct ft_pct efg_pct ts_pct"
TEAM_NAMES = "team_score opponent_score total_points margin assists rebounds threes threes_attempted steals blocks turnovers pace possessions off_rating def_rating net_rating win_pct fg_pct three_pct ft_pct ts_pct"
SPELLINGS = """
points: pts ppg point scoring
assists: ast apg assist dimes
rebounds: reb rpg rebound boards
threes: 3pm 3s threepointersmade 3pointers three
threes_attempted: 3pa
steals: stl spg
blocks: blk bpg
turnovers: tov to
minutes: min mpg mins
pra: pts+reb+ast p+r+a pointsreboundsassists
fg_pct: fg% fgpct fieldgoal%
three_pct: 3p% 3pt%
ft_pct: ft%
ts_pct: ts% ts trueshooting
efg_pct: efg%
plus_minus: +/- plusminus
team_score: teamscore teampoints
opponent_score: opponentscore pointsallowed
total_points: total
off_rating: ortg
def_rating: drtg
win_pct: win% winpct winpercentage wins record
net_rating: netrtg nrtg
"""
# End of fixed values.


def spelled(kind: str = "player") -> dict[str, str]:
    """Spelling to name, for the statistics of a kind of subject: player, or team, whose points are its score."""
    names = (TEAM_NAMES if kind == "team" else PLAYER_NAMES).split()
    known = {n.replace("_", ""): n for n in names}
    for line in SPELLINGS.strip().splitlines():
        name, words = line.split(": ")
        name = "team_score" if kind == "team" and name == "points" else name
        for word in [name.replace("_", ""), *words.split(), *(["points"] if name == "team_score" else [])]:
            if name in names:
                known.setdefault(word, name)
    return known


def canonical_stat(text: Column, kind: str = "player") -> Column:
    """The statistic that a text means ("PRA", "FG%", "ppg"); null for none. A plural means the same."""
    known = spelled(kind)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    key = F.regexp_replace(F.lower(text), "[^a-z0-9%+/-]", "")
    return F.coalesce(F.try_element_at(table, key), F.try_element_at(table, F.regexp_replace(key, "s+$", "")))


def canonical(text: Column, spellings: Mapping[str, str]) -> Column:
    """The statistic's name for an everyday spelling, null for an unknown one."""
    key, out = normalized_alias(text), None
    for k, v in spellings.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def defender_evidence(subject: Column, by_matchup: Column, has_matchups: Column, by_floor: Column, has_floor: Column, same_game: Column, least_possessions: float, least_minutes: float) -> tuple[Column, Column]:
    """(faced, decided by): whether a named opponent was faced, by the best source that covers the game.

    Matchups decide where the game and player have any, shared floor time where the game has any, else playing in the same game.
    """
    faced = F.when(has_matchups, F.coalesce(by_matchup, F.lit(0.0)) >= least_possessions).when(has_floor, F.coalesce(by_floor, F.lit(0.0)) >= least_minutes).otherwise(same_game)
    return faced, F.when(has_matchups, "matchups").when(has_floor, "on_court").otherwise("same_game")
