"""Aggregations over histories: all subjects in one pass, by conditional sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_stats(value: str, exposure: str | None = None, prefix: str = "", where: Column | None = None, per: float = 36.0) -> list[Column]:
    """n, mean, median, sample deviation and, with an exposure, the rate per `per` units of it; over rows where `where` holds."""
    v = F.col(value) if where is None else F.when(where, F.col(value))
    out = [F.count(v).alias(prefix + "n"), F.avg(v).alias(prefix + "mean"), F.percentile(v, 0.5).alias(prefix + "median"), F.stddev_samp(v).alias(prefix + "std")]
    if exposure:
        e = F.col(exposure) if where is None else F.when(where, F.col(exposure))
        out.append((F.try_divide(F.sum(v), F.sum(e)) * per).alias(prefix + "rate"))
    return out


def ratio_stats(num: str, den: str, scale: float = 100.0) -> list[Column]:
    """Pooled ratio of sums, and the mean of each row's own ratio where it has one."""
    both = F.col(num).isNotNull() & F.col(den).isNotNull()
    pooled = F.try_divide(F.sum(F.when(both, F.col(num))), F.sum(F.when(both, F.col(den)))) * scale
    own = F.avg(F.when(F.col(den) > 0, F.col(num) / F.col(den))) * scale
    return [pooled.alias("pooled"), own.alias("mean_of_rows")]


def split_stats(df: DataFrame, by: Sequence[str], mask: Column, value: str, exposure: str | None = None) -> DataFrame:
    """split_*, rest_* and base_* of sample_stats for every group; a null mask counts as false."""
    m = F.coalesce(mask, F.lit(False))
    return df.groupBy(*by).agg(*sample_stats(value, exposure, "split_", m), *sample_stats(value, exposure, "rest_", ~m), *sample_stats(value, exposure, "base_"))


def level_splits(df: DataFrame, subject: str, level: str, value: str) -> DataFrame:
    """A row a subject and level: the level's n, mean and variance, and those of all the subject's other rows.

    The rest comes from the subject's centred moments less the level's, so rows are read once.
    """
    v = F.col(value)
    own = df.groupBy(subject, level).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))
    # centred moments: what the others' have in common with the level's is taken out without large numbers
    w = Window.partitionBy(subject)
    c = F.coalesce(F.col("mean"), F.lit(0.0))
    own = own.withColumn("tn", F.sum("n").over(w)).withColumn("tm", F.try_divide(F.sum(F.col("n") * c).over(w), F.col("tn")))
    apart = F.col("n") * (c - F.col("tm")) * (c - F.col("tm"))
    own = own.withColumn("apart", apart).withColumn("tq", F.sum("m2").over(w) + F.sum("apart").over(w)).withColumn("rn", F.col("tn") - F.col("n"))
    own = own.withColumn("rm", F.try_divide(F.col("tn") * F.col("tm") - F.col("n") * c, F.col("rn")))
    rest = F.col("tq") - F.coalesce("m2", F.lit(0.0)) - F.col("apart") - F.col("rn") * (F.col("rm") - F.col("tm")) * (F.col("rm") - F.col("tm"))
    return own.select(
        subject, level, "n", "mean", F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)).alias("var"),
        F.col("rn").alias("rest_n"), F.col("rm").alias("rest_mean"), F.when(F.col("rn") > 1, F.greatest(F.lit(0.0), rest) / (F.col("rn") - 1)).alias("rest_var"),
    )


def hit_rates(value: str, line: Column) -> list[Column]:
    v = F.col(value)
    share = lambda c: F.avg(F.when(v.isNotNull(), F.when(c, 1.0).otherwise(0.0)))
    return [share(v > line).alias("over"), share(v < line).alias("under"), share(v == line).alias("push")]


def weighted_mean(value: str, weight: str) -> Column:
    """Mean by weight over rows that have a value."""
    have = F.col(value).isNotNull()
    return F.try_divide(F.sum(F.when(have, F.col(value) * F.col(weight))), F.sum(F.when(have, F.col(weight))))


def mean_with_error(value: str, where: Column | None = None) -> list[Column]:
    v = F.col(value) if where is None else F.when(where, F.col(value))
    return [F.count(v).alias("n"), F.avg(v).alias("value"), F.try_divide(F.stddev_samp(v), F.sqrt(F.count(v).cast("double"))).alias("se")]


def ratio_with_error(num: str, den: str, scale: float = 100.0, where: Column | None = None, prefix: str = "") -> list[Column]:
    """Pooled ratio with the linearised standard error, from five sums."""
    keep = F.col(num).isNotNull() & F.col(den).isNotNull()
    keep = keep if where is None else keep & where
    n, d = F.when(keep, F.col(num)), F.when(keep, F.col(den))
    r = F.try_divide(F.sum(n), F.sum(d))
    spread = F.sum(n * n) - 2 * r * F.sum(n * d) + r * r * F.sum(d * d)
    k = F.count(n).cast("double")
    error = F.when(k > 1, F.sqrt(F.greatest(F.lit(0.0), spread) * k / (k - 1)) / F.sum(d))
    return [F.count(n).alias(prefix + "n"), (r * scale).alias(prefix + "value"), (error * scale).alias(prefix + "se")]


def period_changes(df: DataFrame, by: Sequence[str], before: Column, after: Column, value: str) -> DataFrame:
    """n, value and se of each side and their difference for groups that have both sides."""
    b, a = F.when(before, F.col(value)), F.when(after, F.col(value))

    def se(x: Column) -> Column:
        return F.stddev_samp(x) / F.sqrt(F.count(x).cast("double"))

    out = df.groupBy(*by).agg(F.count(b).alias("n_before"), F.count(a).alias("n_after"), F.avg(b).alias("before"), F.avg(a).alias("after"), se(b).alias("se_before"), se(a).alias("se_after"))
    out = out.where("n_before > 0 AND n_after > 0").withColumn("diff", F.col("after") - F.col("before"))
    return out.withColumn("se", F.sqrt(F.col("se_before") * F.col("se_before") + F.col("se_after") * F.col("se_after")))


def averaged_changes(changes: DataFrame, by: Sequence[str], better: int = 1) -> DataFrame:
    """Equal-weight and precision-weighted averages of changes over their other key (seasons)."""
    k = F.count("diff").cast("double")
    w = F.when(F.col("se") > 0, 1 / (F.col("se") * F.col("se")))
    up = F.sum(F.when(F.col("diff") * better > 0, 1).otherwise(0))
    return changes.groupBy(*by).agg(
        F.count("diff").alias("seasons"), F.avg("diff").alias("diff"), (F.sqrt(F.sum(F.coalesce(F.col("se") * F.col("se"), F.lit(0.0)))) / k).alias("se"),
        F.try_divide(F.sum(w * F.col("diff")), F.sum(w)).alias("weighted_diff"), F.try_divide(F.lit(1.0), F.sqrt(F.sum(w))).alias("weighted_se"), up.alias("improved"),
    )


def point_scores(pred: str, y: str) -> list[Column]:
    e = F.col(pred) - F.col(y)
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")]


def probability_scores(p: str, outcome: str, eps: float = 1e-6) -> list[Column]:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    o = F.col(outcome)
    return [F.avg((F.col(p) - o) * (F.col(p) - o)).alias("brier"), F.avg(-(o * F.ln(q) + (1 - o) * F.ln(1 - q))).alias("log_loss")]


def interval_scores(lo: str, hi: str, y: str) -> list[Column]:
    inside = (F.col(y) >= F.col(lo)) & (F.col(y) <= F.col(hi))
    return [F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col(hi) - F.col(lo)).alias("width")]


def calibration_bins(df: DataFrame, p: str, outcome: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(outcome).alias("actual"))


def calibration_error(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("actual"))) / F.sum("n")).alias("ece"))


def pinball(y: str, q: str, level: float) -> Column:
    d = F.col(y) - F.col(q)
    return F.avg(F.greatest(level * d, (level - 1) * d))


def pair_sums(df: DataFrame, pair: Sequence[str], num: str, den: str) -> DataFrame:
    """Sums, squares and cross products of a pair's rows, for ratio variances."""
    n, d = F.col(num), F.col(den)
    return df.groupBy(*pair).agg(F.count("*").alias("k"), F.sum(n).alias("s"), F.sum(d).alias("m"), F.sum(n * n).alias("s2"), F.sum(n * d).alias("sm"), F.sum(d * d).alias("m2"))


def ratio_variance() -> Column:
    """Variance of s / m from pair_sums, by linearisation."""
    r = F.try_divide("s", "m")
    return F.try_divide(F.greatest(F.lit(0.0), F.col("s2") - 2 * r * F.col("sm") + r * r * F.col("m2")), F.col("m") * F.col("m"))


def churn(df: DataFrame, subject: str, team: Sequence[str], date: str, cut: Column, exposure: str, lookback_days: int = 21) -> DataFrame:
    """(team, churn): the share of exposure after `cut` by subjects without a row at least lookback_days before it.

    A team without any row that early takes all its rows before the cut as the early ones.
    """
    d = df.withColumn("__after", F.col(date) > cut).withColumn("__early", F.col(date) <= F.date_sub(cut, lookback_days))
    has = d.groupBy(*team).agg(F.max("__early").alias("__has"))
    d = d.join(has, list(team))
    early = d.where(F.when(F.col("__has"), F.col("__early")).otherwise(~F.col("__after"))).select(*team, F.col(subject).alias("__s")).distinct().withColumn("__known", F.lit(1))
    after = d.where("__after").withColumn("__s", F.col(subject)).join(early, [*team, "__s"], "left")
    return after.groupBy(*team).agg(F.try_divide(F.sum(F.when(F.col("__known").isNull(), F.col(exposure)).otherwise(0)), F.sum(exposure)).alias("churn"))


def stints(df: DataFrame, subject: str, team: str, season: str) -> DataFrame:
    return df.groupBy(subject, team).agg(F.min(season).alias("first_season"), F.max(season).alias("last_season"), F.count("*").alias("games"))


def modal_value(df: DataFrame, by: str, col: str) -> DataFrame:
    """(by, mode): the most frequent value, ties to the one that sorts first."""
    n = df.where(F.col(col).isNotNull()).groupBy(by, col).count()
    best = n.groupBy(by).agg(F.min(F.struct(-F.col("count"), F.col(col).alias("v"))).alias("b"))
    return best.select(by, F.col("b.v").alias("mode"))
