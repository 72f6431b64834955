"""Is a split different from its baseline? Tests, shrinkage, intervals and regressions for all groups at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import t_pvalue_column, t_two_sided
from ..session import staged


def difference(split: Column, base: Column) -> tuple[Column, Column]:
    """Raw difference, and percent of the baseline's size (null where that is 0)."""
    raw = split - base
    return raw, F.when(base != 0, raw / F.abs(base) * 100)


def z_score(split: Column, base: Column, base_std: Column, n: Column) -> Column:
    return F.when((n >= 1) & (base_std > 0), (split - base) / (base_std / F.sqrt(n.cast("double"))))


def welch(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> tuple[Column, Column]:
    """Welch's t and its degrees of freedom from means, deviations and counts; null below two rows a side or without spread."""
    a, b = s1 * s1 / n1, s2 * s2 / n2
    ok = (n1 >= 2) & (n2 >= 2) & (a + b > 0)
    return F.when(ok, (m1 - m2) / F.sqrt(a + b)), F.when(ok, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)))


def welch_p(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> Column:
    """Two-sided p of Welch's test; of two constant sides 1 if they are equal, else 0; null below two rows a side."""
    t, df = welch(m1, s1, n1, m2, s2, n2)
    still = (n1 >= 2) & (n2 >= 2) & (s1 == 0) & (s2 == 0)
    return F.when(still, F.when(m1 == m2, 1.0).otherwise(0.0)).otherwise(t_pvalue_column(t, df))


def prior_variance(groups: DataFrame, by: Sequence[str], mean: str, n: str, within: str) -> DataFrame:
    """(by, tau2, league): variance between group means beyond what their sizes explain (null below three groups, at least 0), and their mean."""
    have = F.col(mean).isNotNull() & (F.col(n) > 0)
    g = groups.where(have).groupBy(*by).agg(F.count("*").alias("__k"), F.var_samp(mean).alias("__v"), F.avg(F.col(within) / F.col(n)).alias("__w"), F.avg(mean).alias("league"))
    return g.select(*by, F.when(F.col("__k") >= 3, F.greatest(F.lit(0.0), F.col("__v") - F.col("__w"))).alias("tau2"), "league")


def shrink_weight(n: Column, within: Column, tau2: Column) -> Column:
    """Share of a group's own mean in its estimate: 1 without noise, 0 without spread between groups."""
    return F.when(n <= 0, 0.0).when(within <= 0, 1.0).when(tau2.isNull() | (tau2 <= 0), 0.0).otherwise(tau2 / (tau2 + within / n))


def shrunk(split: Column, base: Column, weight: Column) -> Column:
    return base + weight * (split - base)


def confidence_label(n: Column) -> Column:
    return F.when(n >= 25, "high").when(n >= 10, "medium").otherwise("low")


def verdict(p: Column, low: Column, high: Column) -> Column:
    sure = (p < 0.05) & ((low > 0) | (high < 0))
    return F.when(p.isNull(), "unknown").when(sure, "significant").otherwise("not significant")


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit numbers, by a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(float) / 2.0**64


#: Rows that a task adds up of a group at once; a group of more rows is dealt out in pieces.
PIECE = 200_000


def bootstrap_ci(df: DataFrame, by: str, mask: Column, value: str, reps: int = 2000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """(by, low, high) of split mean less baseline mean, by the Poisson bootstrap.

    Every row gets a Poisson(1) weight for each replicate, from a hash of the row, so replicates are sums. A group's rows
    meet in one task, which makes its interval, and nothing of its replicates moves. A group of more than PIECE rows is
    dealt out in pieces by its rows' hashes, and the sums of a piece are added to those of the others.
    """
    rows = df.where(F.col(value).isNotNull()).select(by, F.coalesce(mask, F.lit(False)).alias("__m"), F.col(value).cast("double").alias("__v"), F.xxhash64(F.lit(seed), *df.columns).alias("__h"))
    # a Poisson(1) weight is the number of these that a uniform number exceeds
    steps = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(12)])
    step = np.arange(reps, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    tail = (1 - level) / 2
    block = 256

    def sums(frame: pd.DataFrame) -> np.ndarray:
        """(4, reps): weighted number and sum of the split's rows, and of all rows."""
        m, v = frame["__m"].to_numpy(float), frame["__v"].to_numpy(float)
        h = frame["__h"].to_numpy(np.int64).view(np.uint64)
        x, total = np.stack((m, m * v, np.ones(len(v)), v)), np.zeros((4, reps))
        for a in range(0, len(v), block):
            for r in range(0, reps, block):
                w = np.searchsorted(steps, _uniform(h[a : a + block, None] + step[None, r : r + block]))
                total[:, r : r + block] += x[:, a : a + block] @ w.astype(float)
        return total

    def interval(frame: pd.DataFrame) -> pd.DataFrame:
        sn, sv, n, v = sums(frame)
        have = (sn > 0) & (n > 0)
        ends = np.quantile(sv[have] / sn[have] - v[have] / n[have], [tail, 1 - tail]) if have.any() else (None, None)
        return pd.DataFrame({by: frame[by].iloc[:1], "low": [ends[0]], "high": [ends[1]]})

    def partial(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: frame[by].iloc[:1], **{c: [x.tolist()] for c, x in zip(("sn", "sv", "n", "v"), sums(frame), strict=True)}})

    kind = df.schema[by].dataType.simpleString()
    large = rows.groupBy(by).agg(F.count("*").alias("__k")).where(F.col("__k") > PIECE)
    large = staged(large.select(F.col(by).alias("__g"), F.ceil(F.col("__k") / PIECE).alias("__k")), "large")  # one row for PIECE rows of the table at most
    ends = f"`{by}` {kind}, low double, high double"
    if large.isEmpty():
        return rows.groupBy(by).applyInPandas(interval, ends)
    dealt = rows.join(F.broadcast(large), rows[by].eqNullSafe(large["__g"]), "left")
    whole = dealt.where("__k IS NULL").select(*rows.columns).groupBy(by).applyInPandas(interval, ends)
    pieces = dealt.where("__k IS NOT NULL").withColumn("__k", F.pmod(F.xxhash64("__h"), F.col("__k"))).select(*rows.columns, "__k")
    packs = pieces.groupBy(by, "__k").applyInPandas(partial, f"`{by}` {kind}, sn array<double>, sv array<double>, n array<double>, v array<double>")
    one = packs.select(by, F.posexplode(F.arrays_zip("sn", "sv", "n", "v")).alias("i", "x"))
    rep = one.groupBy(by, "i").agg(*[F.sum(f"x.{c}").alias(c) for c in ("sn", "sv", "n", "v")])
    diff = F.try_divide("sv", "sn") - F.try_divide("v", "n")
    return whole.unionByName(rep.groupBy(by).agg(F.percentile(diff, tail).alias("low"), F.percentile(diff, 1 - tail).alias("high")))


def within(df: DataFrame, by: Sequence[str], cols: Sequence[str], suffix: str = "_w") -> DataFrame:
    """df with each column less its group's mean."""
    w = Window.partitionBy(*by)
    return df.select("*", *[(F.col(c) - F.avg(c).over(w)).alias(c + suffix) for c in cols])


def fixed_effects(df: DataFrame, group: str, y: str, xs: Sequence[str], level: float = 0.95) -> pd.DataFrame:
    """Least squares within groups, with errors clustered by group: a row a regressor.

    Rows with a null and groups of one row go. The rows are read once: a group's co-moments (k * k numbers, written) give
    the Gram matrix as one sum, and its score at the solution, whose outer products are a second one; only k * k numbers
    reach the driver. p values use the t distribution with one degree of freedom fewer than groups.
    """
    d = df.select(F.col(group).alias("__g"), *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate((*xs, y))]).dropna()
    k = len(xs)
    pairs = [(i, j) for i in range(k) for j in range(i, k + 1)]
    n_rows = F.count("*")
    own = d.groupBy("__g").agg(n_rows.alias("n"), *[(F.covar_pop(f"__{i}", f"__{j}") * n_rows).alias(f"c{i}_{j}") for i, j in pairs]).where("n > 1")
    own = staged(own, "moments")
    row = own.agg(F.sum("n").alias("n"), F.count("*").alias("g"), *[F.sum(f"c{i}_{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    n, g = int(row["n"] or 0), int(row["g"])
    cell = lambda i, j: row[f"c{min(i, j)}_{max(i, j)}"] or 0.0
    a = np.array([[cell(i, j) for j in range(k)] for i in range(k)], float)
    inv = np.linalg.pinv(a)
    beta = inv @ np.array([cell(i, k) for i in range(k)], float)
    score = [F.col(f"c{i}_{k}") - sum((F.col(f"c{min(i, j)}_{max(i, j)}") * float(beta[j]) for j in range(k)), F.lit(0.0)) for i in range(k)]
    meat = own.agg(*[F.sum(score[i] * score[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.array([[meat[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], float)
    factor = g / max(1, g - 1) * (n - 1) / max(1, n - k)
    cov = factor * inv @ m @ inv
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    df_t = np.full(k, float(max(1, g - 1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        tt = beta / se
    p = np.where(se > 0, t_two_sided(np.nan_to_num(tt), df_t), np.nan)
    out = pd.DataFrame({"variable": list(xs), "coef": beta, "se": se, "t": tt, "p": p, "n": n, "groups": g})
    out.attrs["cov"] = cov.tolist()
    return out


def deviation_columns(col: str, levels: Sequence[str], omitted: str) -> list[Column]:
    """Sum-to-zero coding: a column for each level but the omitted one, whose rows have -1 in all of them."""
    code = lambda x: F.when(F.col(col) == x, 1.0).when(F.col(col) == omitted, -1.0).when(F.col(col).isNotNull(), 0.0)
    return [code(x).alias(x) for x in levels if x != omitted]


def with_omitted(table: pd.DataFrame, terms: Sequence[str], omitted: str) -> pd.DataFrame:
    """A fixed_effects table with the omitted level's row: less the sum of the others', its error from their covariances."""
    at = [list(table["variable"]).index(t) for t in terms]
    cov = np.array(table.attrs["cov"], float)[np.ix_(at, at)]
    coef, se, groups = -float(table["coef"].to_numpy()[at].sum()), float(np.sqrt(max(0.0, cov.sum()))), int(table["groups"].iloc[0])
    t = coef / se if se > 0 else np.nan
    p = t_two_sided(np.array([t]), np.array([float(max(1, groups - 1))]))[0] if se > 0 else np.nan
    row = {"variable": omitted, "coef": coef, "se": se, "t": t, "p": p, "n": table["n"].iloc[0], "groups": groups}
    return pd.concat([table, pd.DataFrame([row])], ignore_index=True)


def trend(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, n, slope, intercept, sxx, residual_std) of a straight line for every group with a row.

    Slope and intercept are null where all rows stand at one place; residual_std is null below three rows too.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = d.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    line = F.col("sxx") > 0
    g = g.withColumn("slope", F.when(line, F.col("slope"))).withColumn("intercept", F.when(line, F.col("intercept")))
    rest = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")) / (F.col("n") - 2))
    return g.withColumn("residual_std", F.when(line & (F.col("n") >= 3), rest)).drop("syy")


def effective_n(n: Column, halflife: float) -> Column:
    """Effective sample size of exponential weights over n rows: (sum w)**2 / sum w**2 in closed form."""
    r = 0.5 ** (1 / halflife)
    s1 = (1 - F.pow(F.lit(r), n)) / (1 - r)
    s2 = (1 - F.pow(F.lit(r * r), n)) / (1 - r * r)
    return F.when(n > 0, s1 * s1 / s2).otherwise(0.0)


def paired_bootstrap(df: DataFrame, cluster: str, a: str, b: str, reps: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row (diff, low, high): mean of a - b, with whole clusters resampled by Poisson weights."""
    sums = df.groupBy(cluster).agg(F.sum(F.col(a) - F.col(b)).alias("s"), F.count("*").alias("n"))
    steps = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(12)])
    step = np.arange(reps, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def partial(batches):
        """The replicates' sums over a task's clusters, in arrays: two numbers a replicate leave a task."""
        total = np.zeros((2, reps))
        for frame in batches:
            h, own = frame["h"].to_numpy(np.int64).view(np.uint64), frame[["s", "n"]].to_numpy(float)
            for k in range(0, len(h), 1024):
                w = np.searchsorted(steps, _uniform(h[k : k + 1024, None] + step[None, :]))
                total += own[k : k + 1024].T @ w
        yield pd.DataFrame({"rep": np.arange(reps), "s": total[0], "n": total[1]})

    hashed = sums.select(F.xxhash64(F.lit(seed), F.col(cluster)).alias("h"), F.col("s").cast("double"), F.col("n").cast("double"))
    rep = hashed.mapInPandas(partial, "rep int, s double, n double").groupBy("rep").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("d"))
    tail = (1 - level) / 2
    whole = sums.agg((F.sum("s") / F.sum("n")).alias("diff"))
    return whole.crossJoin(F.broadcast(rep.agg(F.percentile("d", tail).alias("low"), F.percentile("d", 1 - tail).alias("high"))))
