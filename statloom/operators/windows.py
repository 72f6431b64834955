"""Window operators over a subject's time series.

Every one orders by a full key (time, then event id), so results don't depend on how rows
arrive, and all but the trailing ones see earlier rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ORDER = ("ts", "event_id")


def series(by: str | Sequence[str], order: Sequence[str] = ORDER) -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)


def lagged_mean(col: str, by: str | Sequence[str], n: int, order: Sequence[str] = ORDER) -> Column:
    """Mean of the n rows before this one; shorter histories count, nulls are skipped."""
    return F.avg(col).over(series(by, order).rowsBetween(-n, -1))


def lagged_ewm(df: DataFrame, by: str | Sequence[str], cols: Sequence[str], halflife: float, order: Sequence[str] = ORDER, suffix: str = "_ewm", ticks: int = 400) -> DataFrame:
    """Exponentially weighted means of the rows before this one, weights halving every `halflife` non-null rows.

    A row's weight is 2**(i / halflife) for its running number i among the column's non-null rows; only ratios count. Series are
    cut in blocks of `ticks` half-lives of rows with their own origin, and each block passes its two sums on, so the power
    never leaves the range of doubles. All columns share the blocks, and so three sorts, however many they are.
    """
    keys, kept = [by] if isinstance(by, str) else list(by), df.columns
    span = int(ticks * halflife)
    far = Window.unboundedPreceding
    run = series(by, order)
    at = {c: f"__{k}" for k, c in enumerate(cols)}
    df = df.select("*", F.floor((F.row_number().over(run) - 1) / span).alias("__b"), *[F.count(c).over(run.rowsBetween(far, 0)).alias(f"{x}i") for c, x in at.items()])
    block = Window.partitionBy(*keys, "__b").orderBy(*order)
    df = df.select("*", *[F.first(f"{x}i").over(block.rowsBetween(far, 0)).alias(f"{x}o") for x in at.values()])
    weight = {c: F.when(F.col(c).isNotNull(), F.pow(F.lit(2.0), (F.col(f"{x}i") - F.col(f"{x}o")) / halflife)) for c, x in at.items()}
    past, whole = block.rowsBetween(far, -1), block.rowsBetween(far, Window.unboundedFollowing)
    sums = lambda c, x, w, k: [F.sum(weight[c] * F.col(c)).over(w).alias(f"{x}n{k}"), F.sum(weight[c]).over(w).alias(f"{x}d{k}")]
    df = df.select("*", *[s for c, x in at.items() for s in (*sums(c, x, past, ""), *sums(c, x, whole, "t"))])
    # of the block before, its full sums moved to this block's origin; older ones weigh under 2**-ticks
    edge = Window.partitionBy(*keys).orderBy("__b").rangeBetween(-1, -1)
    before = lambda name: F.first(name).over(edge)
    df = df.select("*", *[before(f"{x}{k}").alias(f"{x}{k}p") for x in at.values() for k in ("nt", "dt", "o")])
    out = []
    for c, x in at.items():
        carry = F.pow(F.lit(2.0), (F.col(f"{x}op") - F.col(f"{x}o")) / halflife)
        part = lambda k: F.coalesce(F.col(f"{x}{k}"), F.lit(0.0)) + F.coalesce(F.col(f"{x}{k}tp") * carry, F.lit(0.0))  # noqa: E731, B023
        out.append(F.when(part("d") > 0, part("n") / part("d")).alias(c + suffix))
    return df.select(*kept, *out)


def lagged_sum(col: str, by: str | Sequence[str], order: Sequence[str] = ORDER) -> Column:
    """Sum of the rows before this one, nulls as 0; the first row has 0."""
    return F.coalesce(F.sum(F.coalesce(F.col(col), F.lit(0))).over(series(by, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")


def prior_count(by: str | Sequence[str], order: Sequence[str] = ORDER) -> Column:
    return (F.row_number().over(series(by, order)) - 1).cast("int")


def game_number(by: str | Sequence[str], order: Sequence[str] = ORDER) -> Column:
    return F.row_number().over(series(by, order)).cast("int")


def cumulative_rate(num: str, den: str, by: str | Sequence[str], scale: float = 1.0, order: Sequence[str] = ORDER) -> Column:
    """Running ratio of sums, this row included."""
    w = series(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.try_divide(F.sum(num).over(w), F.sum(den).over(w)) * scale


def season_to_date(num: str, den: str, by: Sequence[str], order: Sequence[str] = ORDER) -> Column:
    """Ratio of sums over the rows before this one; null where there is nothing to divide by."""
    w = series(by, order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(den).over(w)
    return F.when(total > 0, F.sum(num).over(w) / total)


def days_since_previous(by: str | Sequence[str], date: str = "d", order: Sequence[str] = ORDER) -> Column:
    return F.date_diff(F.col(date), F.lag(date).over(series(by, order)))


def rest_features(days: Column) -> dict[str, Column]:
    """Rest days and the back-to-back flag; a first row has unknown rest and is no back-to-back."""
    return {"rest_days": (days - 1).cast("int"), "back_to_back": F.coalesce(days == 1, F.lit(False))}


def trailing_mean(col: str, by: str | Sequence[str], n: int = 10, order: Sequence[str] = ORDER) -> Column:
    return F.avg(col).over(series(by, order).rowsBetween(-(n - 1), 0))


def with_segments(df: DataFrame, by: str | Sequence[str], max_gap_days: int, date: str = "d", order: Sequence[str] = ORDER) -> DataFrame:
    """df with `segment`: the number, from 0, of the run of rows without a gap of more than max_gap_days."""
    cut = F.when(days_since_previous(by, date, order) > max_gap_days, 1).otherwise(0)
    df = df.withColumn("__cut", cut)
    return df.withColumn("segment", F.sum("__cut").over(series(by, order).rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__cut")


def as_of(df: DataFrame, by: str | Sequence[str], col: str, alias: str, time: str = "ts") -> DataFrame:
    """df with the last non-null `col` of strictly earlier times of its group; rows of one time never see each other."""
    keys = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(time)).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn(alias, F.last(col, ignorenulls=True).over(w))


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], cols: Sequence[str], time: str = "ts") -> DataFrame:
    """left with right's newest row strictly before each left row's time, by keys. One sort, no inequality join."""
    value = F.struct(*[F.col(c) for c in cols])
    left = left.withColumn("__row", F.struct(*[F.col(c) for c in left.columns]))
    both = left.select(*by, time, "__row", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__v")).unionByName(
        right.select(*by, time, value.alias("__v")), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy(F.unix_micros(time)).rangeBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__row IS NOT NULL")
    return out.select("__row.*", *[F.col("__v")[c].alias(c) for c in cols])


def holm(p: str, family: str | Sequence[str], tie: str) -> list[tuple[str, Column]]:
    """Steps (name, column) that add `p_holm`: Holm's step-down adjustment; null p values stay out of the family."""
    keys = [family] if isinstance(family, str) else list(family)
    known = F.when(F.col(p).isNotNull(), 1)
    fam = Window.partitionBy(*keys)
    rank = fam.orderBy(F.col(p).asc_nulls_last(), tie)
    return [
        ("__m", F.count(known).over(fam)),
        ("__r", F.row_number().over(rank)),
        ("__q", F.when(F.col(p).isNotNull(), F.col(p) * (F.col("__m") - F.col("__r") + 1))),
        ("p_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("__q").over(rank.rowsBetween(Window.unboundedPreceding, 0))))),
    ]


def benjamini_hochberg(p: str, family: str | Sequence[str], tie: str) -> list[tuple[str, Column]]:
    """Steps (name, column) that add `q_value`. The least of the later rows is a running one from the end, as frames that reach to the end are quadratic."""
    keys = [family] if isinstance(family, str) else list(family)
    fam = Window.partitionBy(*keys)
    rank = fam.orderBy(F.col(p).asc_nulls_last(), tie)
    back = fam.orderBy(F.col(p).desc_nulls_first(), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return [
        ("__m", F.count(p).over(fam)),
        ("__r", F.row_number().over(rank)),
        ("__q", F.when(F.col(p).isNotNull(), F.col(p) * F.col("__m") / F.col("__r"))),
        ("q_value", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__q").over(back)))),
    ]


def wide_q_values(df: DataFrame, p: str, tie: str, buckets: int = 4096) -> DataFrame:
    """df with `q_value`, Benjamini and Hochberg's, of all rows as one family: ranked inside ranges of p, so no task has them all.

    What passes between the ranges are a count and a least value of each.
    """
    d = df.withColumn("__b", F.when(F.col(p).isNotNull(), F.least(F.floor(F.col(p) * buckets), F.lit(buckets - 1))).cast("int"))
    size = d.where("__b IS NOT NULL").groupBy("__b").agg(F.count("*").alias("__n"))
    below, whole = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    size = size.select("__b", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__m"))  # a row a range
    own = Window.partitionBy("__b").orderBy(F.col(p), tie)
    back = Window.partitionBy("__b").orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(F.broadcast(size), "__b", "left").withColumn("__q", F.col(p) * F.col("__m") / (F.col("__before") + F.row_number().over(own)))
    d = d.withColumn("__low", F.min("__q").over(back))
    later = d.where("__b IS NOT NULL").groupBy("__b").agg(F.min("__q").alias("__least"))
    later = later.select("__b", F.min("__least").over(Window.orderBy("__b").rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    d = d.join(F.broadcast(later), "__b", "left")
    q = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col("__low"), F.coalesce("__later", F.lit(1.0))))
    return d.withColumn("q_value", q).drop("__b", "__before", "__m", "__q", "__low", "__later")


def add_steps(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    for name, col in steps:
        df = df.withColumn(name, col)
    return df.drop(*[n for n, _ in steps if n.startswith("__")])


def _with_far(d: DataFrame, by: Sequence[str], value: str, line: str) -> DataFrame:
    """d with `__far`: how many values of the whole blocks `__b` before the row's own are above its line."""
    # runs (level, index) that end before the row's own block, and the runs that a row's value is part of
    last = F.max("__b").over(Window.partitionBy(*by))
    d = d.withColumn("__last", last)
    levels = F.when(F.col("__last") > 0, F.sequence(F.lit(0), F.floor(F.log2(F.col("__last"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    run = lambda k: F.call_function("shiftright", F.col("__b"), k)
    asks = F.transform(F.filter(levels, lambda k: run(k) % 2 == 1), lambda k: F.struct(k.alias("k"), (run(k) - 1).alias("r")))
    gives = F.transform(F.filter(levels, lambda k: run(k) % 2 == 0), lambda k: F.struct(k.alias("k"), run(k).alias("r")))
    far = d.where("__last > 0")
    ask = far.where(F.col(line).isNotNull()).select(*by, "__i", F.col(line).alias("__v"), F.lit(0).alias("__is"), F.explode(asks).alias("__x"))
    give = far.where(F.col(value).isNotNull()).select(*by, "__i", F.col(value).alias("__v"), F.lit(1).alias("__is"), F.explode(gives).alias("__x"))
    above = Window.partitionBy(*by, "__x").orderBy(F.desc("__v"), "__is").rowsBetween(Window.unboundedPreceding, 0)  # an ask stands before its equals
    both = ask.unionByName(give).withColumn("__over", F.sum("__is").over(above))
    found = both.where("__is = 0").groupBy(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(by)], F.col("__i").alias("__j")).agg(F.sum("__over").alias("__far"))
    same = F.col("__i") == F.col("__j")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{k}"))
    d = d.join(found, same, "left")
    return d


def climatology(df: DataFrame, by: Sequence[str], value: str, line: str, order: Sequence[str] = ORDER, block: int = 64) -> DataFrame:
    """df with `share_over`: the share of the group's earlier values above this row's line, 0.5 without any.

    Rows of the same `block` compare with each other. Whole blocks before it are cut in runs of 2**k blocks, as in the
    binary digits of their number, and each run is sorted once: n rows of a group make n log(n / block) rows, and a series
    of one block makes none. `order` tells rows of a group apart.
    """
    d = df.withColumn("__i", F.row_number().over(series(by, order)) - 1).withColumn("__b", F.floor(F.col("__i") / block))
    near = Window.partitionBy(*by, "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__near", F.collect_list(value).over(near))
    if df.groupBy(*by).count().where(F.col("count") > block).isEmpty():  # no series goes beyond its first block
        d = d.withColumn("__far", F.lit(0))
    else:
        d = _with_far(d, by, value, line)
    n = F.count(value).over(series(by, order).rowsBetween(Window.unboundedPreceding, -1))
    over = F.size(F.filter("__near", lambda v: v > F.col(line))) + F.coalesce("__far", F.lit(0))
    return d.withColumn("__n", n).withColumn("share_over", F.when(F.col("__n") > 0, over / F.col("__n")).otherwise(0.5)).select(*df.columns, "share_over")


def own_dispersion(df: DataFrame, by: str | Sequence[str], value: str, league: float, n: int = 40, prior: float = 20.0, order: Sequence[str] = ORDER) -> DataFrame:
    """df with `alpha`: method-of-moments overdispersion of the last n values, shrunk to the league's by `prior` rows."""
    w = series(by, order)
    last = w.rowsBetween(-n, -1)
    df = df.withColumn("__m", F.avg(value).over(last)).withColumn("__s", F.avg(F.col(value) * F.col(value)).over(last))
    df = df.withColumn("__n", F.least(F.row_number().over(w) - 1, F.lit(n)))
    raw = F.greatest(F.lit(0.0), F.try_divide(F.col("__s") - F.col("__m") * F.col("__m") - F.col("__m"), F.col("__m") * F.col("__m")))
    alpha = (F.col("__n") * F.coalesce(raw, F.lit(league)) + prior * league) / (F.col("__n") + prior)
    return df.withColumn("alpha", alpha).drop("__m", "__s", "__n")


def recent_rank(by: str | Sequence[str], order: Sequence[str] = ORDER) -> Column:
    """1 for a subject's newest row, 2 for the one before, ..."""
    keys = [by] if isinstance(by, str) else list(by)
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])).cast("int")


def standings_flags(games: DataFrame, seats: int, least_left: int = 0) -> DataFrame:
    """(season, team, status, date, games_left): the first date on which a team is eliminated, or has clinched a seat.

    games: (season, league, team, date, win), a row a team and game. Out is who can't reach the wins of the league's last
    seat any more with all games left; in is whom fewer than `seats` others can still reach. Leagues without more teams
    than seats have no flags. A season's grid has a row a team and date.
    """
    day = games.groupBy("season", "league", "team", "date").agg(F.sum(F.col("win").cast("int")).alias("w"), F.count("*").alias("n"))
    teams = day.groupBy("season", "league", "team").agg(F.sum("n").alias("total"))
    grid = teams.join(games.select("season", "date").distinct(), "season").join(day, ["season", "league", "team", "date"], "left")
    run = Window.partitionBy("season", "league", "team").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    g = grid.select("season", "league", "team", "date", F.coalesce(F.sum("w").over(run), F.lit(0)).alias("w"), (F.col("total") - F.coalesce(F.sum("n").over(run), F.lit(0))).alias("left"))
    all_of = Window.partitionBy("season", "league", "date")
    g = g.withColumn("seat", F.row_number().over(all_of.orderBy(F.desc("w"), "team"))).withColumn("teams", F.count("*").over(all_of))
    wins_at = lambda k: F.max(F.when(F.col("seat") == k, F.col("w"))).over(all_of)
    g = g.withColumn("bar", F.when(F.col("seat") <= seats, wins_at(seats + 1)).otherwise(wins_at(seats)))
    # how many can still have so many wins: those that sort at or above it
    reach = g.select("season", "league", "date", (F.col("w") + F.col("left")).alias("v"), F.lit(0).alias("ask"), F.lit(None).cast(g.schema["team"].dataType).alias("team"))
    asks = g.select("season", "league", "date", F.col("w").alias("v"), F.lit(1).alias("ask"), "team")
    above = Window.partitionBy("season", "league", "date").orderBy(F.desc("v")).rangeBetween(Window.unboundedPreceding, 0)
    can = reach.unionByName(asks).withColumn("can", F.sum(1 - F.col("ask")).over(above)).where("ask = 1").select("season", "league", "date", "team", (F.col("can") - 1).alias("can"))
    g = g.join(can, ["season", "league", "date", "team"]).where(F.col("teams") > seats)
    states = F.array(F.when(F.col("w") + F.col("left") < F.col("bar"), "eliminated"), F.when(F.col("can") <= seats - 1, "clinched"))
    flags = g.select("season", "team", "date", "left", F.explode(F.filter(states, lambda x: x.isNotNull())).alias("status"))
    first = flags.groupBy("season", "team", "status").agg(F.min(F.struct("date", "left")).alias("x"))
    return first.select("season", "team", "status", F.col("x.date").alias("date"), F.col("x.left").alias("games_left")).where(F.col("games_left") >= least_left)


def synthetic_line(average: Column, fallback: Column, prior: Column, least: int = 5) -> tuple[Column, Column]:
    """(half-point line, whole line): below the average's next half; the whole one rounds half to even."""
    base = F.round(F.when(prior >= least, average).otherwise(fallback), 9)  # an average a hair below a whole number is that number
    return F.floor(base) + 0.5, F.bround(base, 0)


def longest_gap(dates: DataFrame, by: str, date: str, low: int, high: int, window: Column) -> DataFrame:
    """(by, before, after): each group's longest gap of low..high days inside `window`, the earliest of equals."""
    d = dates.select(by, date).distinct()
    d = d.withColumn("before", F.lag(date).over(Window.partitionBy(by).orderBy(date))).withColumn("gap", F.date_diff(date, "before"))
    d = d.where(F.col("gap").between(low, high) & window)
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("gap"), date))
    return d.withColumn("__r", best).where("__r = 1").select(by, "before", F.col(date).alias("after"), "gap")


def middle_date(dates: DataFrame, by: str, date: str) -> DataFrame:
    """(by, middle): the date at half of each group's rows in order."""
    w = Window.partitionBy(by)
    d = dates.withColumn("__r", F.row_number().over(w.orderBy(date)) - 1).withColumn("__n", F.count("*").over(w))
    return d.where(F.col("__r") == F.floor(F.col("__n") / 2)).select(by, F.col(date).alias("middle"))


def season_calendar(dates: DataFrame, season: str = "season", date: str = "d", low: int = 3, high: int = 8, months: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(season, opener, last, split_date, source) of every season: split at its longest gap of `low` to `high` days in some months, else in the middle of its games."""
    gap = longest_gap(dates, season, date, low, high, F.month(date).isin(list(months)))
    ends = dates.groupBy(season).agg(F.min(date).alias("opener"), F.max(date).alias("last"))
    both = ends.join(gap, season, "left").join(middle_date(dates, season, date), season)
    return both.select(season, "opener", "last", F.coalesce("before", "middle").alias("split_date"), F.when(F.col("before").isNull(), "middle").otherwise("gap").alias("source"))


def before_or_last_season(df: DataFrame, by: str, season: str, values: Sequence[str], weight: str, prefix: str = "pre_", order: Sequence[str] = ORDER) -> DataFrame:
    """df with each value's weighted mean over the season's rows before this one, else over the whole season before, and `<prefix>games`.

    One sort a (by, season), and a join of season totals: a row a team and season.
    """
    w = series([by, season], order).rowsBetween(Window.unboundedPreceding, -1)
    both = lambda v, over: F.try_divide(F.sum(F.col(v) * F.col(weight)).over(over), F.sum(F.when(F.col(v).isNotNull(), F.col(weight))).over(over)) if over is not None else F.try_divide(F.sum(F.col(v) * F.col(weight)), F.sum(F.when(F.col(v).isNotNull(), F.col(weight))))
    last = df.groupBy(by, (F.col(season) + 1).alias(season)).agg(*[both(v, None).alias(f"__last_{v}") for v in values])
    now = df.select("*", F.count("*").over(w).alias(f"{prefix}games"), *[both(v, w).alias(f"__{v}") for v in values])
    out = now.join(last, [by, season], "left")
    return out.select(*df.columns, f"{prefix}games", *[F.coalesce(f"__{v}", f"__last_{v}").alias(prefix + v) for v in values])
