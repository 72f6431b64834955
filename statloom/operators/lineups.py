"""Who was on the floor when: stints from a game's event log, and what follows from them.

A stint is (game, team, person, start, end). What can be told of an event beforehand is a column: who
may be meant by a name, what a person's first event of the period is, whether the person's next one is coming in.
One small function then moves five places a team through a game's changes; everything after it (shared time,
stats while an opponent was on, totals, reliability) is joins and sums over stints.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..session import staged
from .joins import shared_time

UNIT = 5
#: Lengths of the periods of a game, and of those after its regular ones, in seconds.
PERIODS, PERIOD, EXTRA = 4, 720.0, 300.0
EVENTS = "game_id long, period int, t double, seq long, kind string, person_id long, team_id long, candidates array<long>"
STINTS = "game_id long, period int, team_id long, person_id long, start double, end double, repaired int"

_STINT_COLUMNS = [c.split()[0] for c in STINTS.split(", ")]


def name_index(roster: DataFrame, plays: DataFrame | None = None) -> DataFrame:
    """(game_id, team_id, person_id, key): the spellings by which a game's text may mean a person of its roster.

    Last name, first and last name, and each player_name that the game's own plays give for the person's id.
    """
    full = F.array(x.play_name(F.col("last_name")), x.play_name(F.concat_ws(" ", "first_name", "last_name")))
    keys = roster.select("game_id", "team_id", "person_id", F.explode(full).alias("key"))
    if plays is not None:
        said = plays.select("game_id", F.expr("try_cast(person_id AS bigint)").alias("person_id"), x.play_name(F.col("player_name")).alias("key"))
        keys = keys.unionByName(said.join(roster.select("game_id", "team_id", "person_id"), ["game_id", "person_id"]).select("game_id", "team_id", "person_id", "key"))
    return keys.where("key <> ''").distinct()


def with_candidates(mentions: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """mentions (game_id, team_id, name) with `candidates`: the sorted ids that the name may mean; null for none.

    Those with that spelling, or, where nobody has it, those of a spelling with the same last word.
    """
    last = lambda c: F.substring_index(c, " ", -1)
    people = F.sort_array(F.collect_set("person_id"))  # of one team of one game
    exact = index.groupBy("game_id", "team_id", F.col("key").alias("__key")).agg(people.alias("__exact"))
    near = index.groupBy("game_id", "team_id", last(F.col("key")).alias("__last")).agg(people.alias("__near"))
    m = mentions.withColumn("__key", x.play_name(F.col(name))).withColumn("__last", F.nullif(last(F.col("__key")), F.lit("")))
    m = m.join(exact, ["game_id", "team_id", "__key"], "left").join(near, ["game_id", "team_id", "__last"], "left")
    return m.withColumn("candidates", F.coalesce("__exact", "__near")).drop("__key", "__last", "__exact", "__near")


def events_of_plays(plays: DataFrame, roster: DataFrame) -> DataFrame:
    """Raw plays (game_id, period, clock, seq, action, sub_type, description, person_id, team_id, result, in_person_id) as events.

    A play gives up to three events from one scan: the acting person (an act, or an out for a substitution),
    who came in, and who assisted. Names resolve within the game and team; several matches stay as candidates for
    the walk to settle. A column player_name adds its spellings. A technical foul says nothing about who is on the floor.
    """
    action = F.lower(F.trim("action"))
    came, went = x.substitution(F.col("description"))
    helped = x.assist_name(F.col("description"))
    is_sub = action.startswith("sub")
    technical = F.lower(F.coalesce("sub_type", F.lit(""))).contains("technical")
    t = x.game_seconds(F.col("period"), x.iso_clock_seconds(F.col("clock")))
    number = lambda c: F.expr(f"CASE WHEN try_cast({c} AS bigint) > 0 THEN try_cast({c} AS bigint) END")
    part = lambda i, kind, person, name: F.struct(F.lit(i).alias("i"), kind.alias("kind"), person.alias("person_id"), name.alias("name"))
    nobody = F.lit(None).cast("long")
    parts = F.array(
        part(0, F.when(is_sub, "out").when(technical, None).otherwise("act"), number("person_id"), F.when(is_sub, went)),
        part(1, F.when(is_sub, "in"), number("in_person_id"), came),
        part(2, F.when(~is_sub & helped.isNotNull(), "act"), nobody, helped),
    )
    p = plays.select("game_id", "period", t.alias("t"), "seq", "team_id", F.inline(parts)).where("kind IS NOT NULL").withColumn("seq", F.col("seq") * 3 + F.col("i"))
    index = name_index(roster, plays if "player_name" in plays.columns else None)
    j = with_candidates(p, index)
    sole = F.when(F.size("candidates") == 1, F.element_at("candidates", 1))
    return j.select("game_id", "period", "t", "seq", "kind", F.coalesce("person_id", sole).alias("person_id"), "team_id", F.when(F.col("person_id").isNull(), F.col("candidates")).alias("candidates"))


@dataclass
class Place:
    """One of a team's five: who has it (None: open), since when, when last seen, and if that person's next event is coming in."""

    who: int | None
    since: float
    seen: float
    returns: bool = False


def moved(places: list[Place], changes: list[tuple], end: float) -> tuple[list[tuple], int]:
    """(stints, repairs) of one team in a period; places is left as it stands at the end.

    changes: (time, kind, person or None, candidates, the person's next event is coming in). A newcomer takes the place that
    has been open for longest; whoever acts without having come in had it since it fell open. Without an open place
    the one whose next event is coming in must have left unseen, else the one not seen for longest. A name that
    several could bear means the one of them on the bench for coming in, on the floor for anything else.
    """
    stints: list[tuple] = []
    repairs = 0

    def clear(place: Place, t: float) -> None:
        if t > place.since:
            stints.append((place.who, place.since, t))
        place.who, place.since = None, t

    for t, kind, person, candidates, returns in changes:
        held = {p.who: p for p in places if p.who is not None}
        if person is None and candidates:
            fit = [c for c in candidates if (c in held) != (kind == "in")]
            person = fit[0] if len(fit) == 1 else None
        if person is None:
            repairs += kind == "in"
            continue
        place = held.get(person)
        if place is not None:
            place.seen, place.returns = t, returns
            if kind == "out":
                clear(place, t)
            continue
        if kind == "out":
            continue
        repairs += kind == "act"
        free = min((p for p in places if p.who is None), key=lambda p: p.since, default=None)
        if free is None:
            free = min(places, key=lambda p: (not p.returns, p.seen, p.who))
            clear(free, t)
            free.since = t
            repairs += 1
        free.since = free.since if kind == "act" else t
        free.who, free.seen, free.returns = person, t, returns
    for place in places:
        if place.who is not None and end > place.since:
            stints.append((place.who, place.since, end))
    return stints, repairs


def _opened(starters: list[int], begin: float, returning: set[int]) -> list[Place]:
    """Places of a period's starters; fewer than five leave the rest open from its beginning."""
    some = [Place(p, begin, begin, p in returning) for p in starters]
    return some + [Place(None, begin, begin) for _ in range(UNIT - len(some))]


def _starters(first: list[tuple[str, int]], unit: list[int], minutes: dict[int, float]) -> list[int]:
    """Who starts a later period: those whose first event of it isn't coming in, in its order, then silent ones of the unit before, by minutes."""
    acting = [p for kind, p in first if kind != "in"]
    silent = sorted(set(unit) - {p for _, p in first}, key=lambda p: (-minutes.get(p, 0.0), p))
    return (acting[:UNIT] + silent)[:UNIT]


def _game(key: tuple, events: pa.Table, roster: pa.Table) -> pa.Table:
    rows: list[tuple] = []
    teams: dict[int, dict[int, tuple]] = {}
    for team, person, starter, minutes in zip(*(roster.column(c).to_pylist() for c in ("team_id", "person_id", "starter", "minutes")), strict=True):
        if team is not None and (minutes or 0) > 0:
            teams.setdefault(team, {})[person] = (starter, minutes)
    if events.num_rows and len(teams) == 2:
        columns = ("seq", "team_id", "period", "t", "kind", "person_id", "candidates", "opens", "returns")
        log = sorted(zip(*(events.column(c).to_pylist() for c in columns), strict=True), key=lambda e: e[0])
        periods = max(e[2] for e in log)
        for team, own in sorted(teams.items()):
            minutes = {p: m for p, (_, m) in own.items()}
            parts: list[list[tuple]] = [[] for _ in range(periods + 1)]
            for e in log:
                if e[1] == team and (e[5] is None or e[5] in own):
                    parts[e[2]].append(e[3:])
            unit = [p for p, (starter, _) in own.items() if starter]
            for period in range(1, periods + 1):
                begin, length = (PERIOD * (period - 1), PERIOD) if period <= PERIODS else (PERIODS * PERIOD + EXTRA * (period - PERIODS - 1), EXTRA)
                first = [(kind, p) for _, kind, p, _, opens, _ in parts[period] if opens]
                start = unit if period == 1 else _starters(first, unit, minutes)
                places = _opened(start, begin, {p for kind, p in first if kind == "in"})
                changes = [(t, kind, p, None if some is None else [c for c in some if c in own], returns) for t, kind, p, some, _, returns in parts[period]]
                found, repairs = moved(places, changes, begin + length)
                rows += [(key[0].as_py(), period, team, p, a, b, repairs) for p, a, b in found]
                unit = [p.who for p in places if p.who is not None]
    cols = list(zip(*rows, strict=True)) or [[]] * len(_STINT_COLUMNS)
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32())
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_STINT_COLUMNS)


def stints(events: DataFrame, roster: DataFrame) -> DataFrame:
    """Stints of every game; a game is one group, and a game is small. Games are shuffled once, for the columns and the walk."""
    e = events.select("game_id", "period", "t", "seq", "kind", "person_id", "team_id", "candidates").repartition("game_id")
    own = Window.partitionBy("game_id", "team_id", "period", "person_id").orderBy("seq")
    e = e.withColumn("opens", F.col("person_id").isNotNull() & (F.row_number().over(own) == 1)).withColumn("returns", F.coalesce(F.col("person_id").isNotNull() & (F.lead("kind").over(own) == "in"), F.lit(False)))
    # fresh columns: both sides may come from one table
    r = roster.select(*[F.col(c).alias(c) for c in ("game_id", "team_id", "person_id", "starter", "minutes")])
    return e.groupBy("game_id").cogroup(r.groupBy("game_id")).applyInArrow(_game, STINTS)


def pair_time(st: DataFrame) -> DataFrame:
    """(game_id, person_id, opponent_id, seconds) of shared floor time, both ways."""
    t = shared_time(st, "game_id", "person_id", "team_id", "start", "end")
    return t.select(F.col("game").alias("game_id"), F.col("who").alias("person_id"), F.col("other").alias("opponent_id"), F.col("shared").alias("seconds"))


def stats_against(st: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """Sums of each person's stat events (game_id, team_id, person_id, t, cols) while each opponent was on."""
    o = st.select(F.col("game_id").alias("g"), F.col("team_id").alias("ot"), F.col("person_id").alias("opponent_id"), "start", "end")
    j = stats.join(o, (stats["game_id"] == o["g"]) & (stats["team_id"] != o["ot"]) & (stats["t"] > o["start"]) & (stats["t"] <= o["end"]))
    return j.groupBy("game_id", "person_id", "opponent_id").agg(*[F.sum(c).alias(c) for c in cols])


def person_totals(st: DataFrame) -> DataFrame:
    return st.groupBy("game_id", "team_id", "person_id").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))


def full_share(st: DataFrame) -> DataFrame:
    """(game_id, share): of the game's time, that in which both teams have five on the floor."""
    marks = st.select("game_id", F.explode(F.array(F.struct(F.col("start").alias("t"), "team_id", F.lit(1).alias("n")), F.struct(F.col("end").alias("t"), "team_id", F.lit(-1).alias("n")))).alias("m")).select("game_id", "m.*")
    side = marks.groupBy("game_id").agg(F.min("team_id").alias("home"))
    one = marks.join(side, "game_id").groupBy("game_id", "t").agg(F.sum(F.when(F.col("team_id") == F.col("home"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("team_id") != F.col("home"), F.col("n")).otherwise(0)).alias("b"))
    w = Window.partitionBy("game_id").orderBy("t")
    run = one.select("game_id", F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b"), (F.lead("t").over(w) - F.col("t")).alias("d"))
    return run.groupBy("game_id").agg((F.sum(F.when((F.col("a") == UNIT) & (F.col("b") == UNIT), F.col("d")).otherwise(0.0)) / F.sum("d")).alias("share"))


def on_court(st: DataFrame, box: DataFrame, tolerance: float = 2.0, least_share: float = 0.95) -> DataFrame:
    """pair_time with `reliable`: both persons' rebuilt minutes fit the box score and the game was full enough."""
    st = staged(st, "stints")  # read three times
    t = person_totals(st).join(box.select("game_id", "person_id", "minutes"), ["game_id", "person_id"], "full_outer")
    fine = t.select("game_id", "person_id", (F.abs(F.coalesce(F.col("seconds") / 60, F.lit(0.0)) - F.coalesce("minutes", F.lit(0.0))) <= tolerance).alias("fine"))
    full = full_share(st).select("game_id", (F.col("share") >= least_share).alias("full"))
    p = pair_time(st).join(fine, ["game_id", "person_id"], "left").join(fine.select("game_id", F.col("person_id").alias("opponent_id"), F.col("fine").alias("fine2")), ["game_id", "opponent_id"], "left").join(full, "game_id", "left")
    ok = F.coalesce("fine", F.lit(False)) & F.coalesce("fine2", F.lit(False)) & F.coalesce("full", F.lit(False))
    return p.select("game_id", "person_id", "opponent_id", "seconds", ok.alias("reliable"))


def season_marks(events: DataFrame, roster: DataFrame) -> DataFrame:
    """(season, mark): a fingerprint of each season's events and roster, which a change, a missing or a doubled row alters."""
    rows = lambda d, kind: d.select("season", F.xxhash64(F.lit(kind), *[F.col(c).cast("string") for c in sorted(set(d.columns) - {"season"})]).alias("h"))
    both = rows(events, "event").unionByName(rows(roster, "roster"))
    return both.groupBy("season").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string")).alias("mark"))


def build_on_court(events: DataFrame, roster: DataFrame, folder: str, tolerance: float = 2.0, least_share: float = 0.95) -> list[int]:
    """Bring folder/on_court, a table by season, up to date with events and roster (both with season); the seasons built.

    Only seasons whose fingerprint isn't the kept one are read, rebuilt and overwritten, each as a partition of its own. Fingerprints
    are kept after the rows are written, so a build that breaks off is done again.
    """
    spark = events.sparkSession
    marks = season_marks(events, roster).withColumn("at", F.current_timestamp())
    try:
        kept = spark.read.schema("season int, mark string, at timestamp").parquet(f"{folder}/marks")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = None
    todo = marks
    if kept is not None:
        last = kept.groupBy("season").agg(F.max_by("mark", "at").alias("mark"))
        todo = marks.join(last, ["season", "mark"], "left_anti")
    todo = todo.collect()  # a row a season
    seasons = sorted(r["season"] for r in todo)
    if seasons:
        own = lambda d: d.where(F.col("season").isin(seasons))
        r = own(roster)
        built = on_court(stints(own(events), r), r, tolerance, least_share).join(r.select("game_id", "season").distinct(), "game_id")
        built.write.partitionBy("season").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/on_court")
        spark.createDataFrame([tuple(r) for r in todo], "season int, mark string, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/marks")
    return seasons
