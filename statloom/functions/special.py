"""Normal, Student-t and chi-square functions, which Spark SQL lacks.

Columns in, columns out, on the JVM: series and continued fractions as higher-order functions. The functions of
arrays are for small tables and for numbers inside a task.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(swap, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return beta_share(df / (df + t * t), df / 2, np.full_like(df, 0.5))


def t_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """Upper point t with P(|T| < t) = p, by bisection."""
    lo, hi = np.zeros_like(df), np.full_like(df, 1e4)
    for _ in range(80):
        mid = (lo + hi) / 2
        low = 1 - t_two_sided(mid, df) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x, float) / math.sqrt(2))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    inv = NormalDist().inv_cdf
    return np.array([inv(x) if 0 < x < 1 else (math.inf if x >= 1 else -math.inf) for x in np.asarray(p, float)])


#: Coefficients of a Chebyshev fit of ln(erfc(z) / t) + z * z in t = 1 / (1 + z / 2), with a relative error under 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|) for a standard normal Z, on the JVM, to a relative 1.2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = poly * t + c
    return t * F.exp(poly - x * x)


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0, on the JVM: Stirling's series eight places up, less the logarithm of the product in between (to 1e-12)."""
    y = x + 8
    i = 1 / y
    i2 = i * i
    series = i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188))))
    rise = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(rise)


def _steps(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def beta_share_column(x: Column, a: Column, b: Column, steps: int = 120) -> Column:
    """Regularised incomplete beta function on the JVM, by the continued fraction on the side where it converges fast.

    Convergents by the modified Lentz recurrence; once a step changes nothing, further ones don't either. Null for null.
    """
    one = lambda v: F.transform(F.array(v), lambda s: s)  # noqa: E731  bound once, used often
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def share(s: Column) -> Column:
        p, q, z = s["p"], s["q"], s["z"]
        d0 = 1 / safe(1 - (p + q) * z / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"), F.lit(0).alias("done"))

        def half(t: Column, num: Column) -> Column:
            return F.element_at(F.transform(F.array(F.struct((1 / safe(1 + num * t["d"])).alias("d"), safe(1 + num / t["c"]).alias("c"))), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (t["h"] * n["c"] * n["d"]).alias("h"), (F.abs(n["c"] * n["d"] - 1) < 1e-15).cast("int").alias("done"))), 1)

        def step(t: Column, m: Column) -> Column:
            m = m.cast("double")
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            return F.when(t["done"] == 1, t).otherwise(half(half(t, even), odd))

        front = F.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * F.ln(z) + q * F.ln(1 - z)) / p
        part = F.when(z <= 0, 0.0).when(z >= 1, 1.0).otherwise(front * F.aggregate(_steps(steps), start, step, lambda t: t["h"]))
        return F.when(s["swap"], 1 - part).otherwise(part)

    x, a, b = x.cast("double"), a.cast("double"), b.cast("double")
    swap = x > (a + 1) / (a + b + 2)
    s = F.struct(F.when(swap, b).otherwise(a).alias("p"), F.when(swap, a).otherwise(b).alias("q"), F.when(swap, 1 - x).otherwise(x).alias("z"), swap.alias("swap"))
    return F.element_at(F.transform(one(s), share), 1)


def gamma_tail_column(a: Column, x: Column, steps: int = 300) -> Column:
    """Upper regularised incomplete gamma function on the JVM: the series below a + 1, the continued fraction above."""
    a, x = a.cast("double"), x.cast("double")

    def tail(s: Column) -> Column:
        a, x = s["a"], s["x"]
        front = F.exp(a * F.ln(x) - x - lgamma(a))
        term = F.struct((1 / a).alias("t"), (1 / a).alias("s"))
        grow = lambda u, k: F.when(u["t"] < u["s"] * 1e-17, u).otherwise(F.transform(F.array(u["t"] * x / (a + k)), lambda t: F.struct(t.alias("t"), (u["s"] + t).alias("s")))[0])
        low = 1 - front * F.aggregate(_steps(steps), term, grow, lambda u: u["s"])
        b0 = x + 1 - a
        start = F.struct((1 / b0).alias("d"), F.lit(1e300).alias("c"), (1 / b0).alias("h"), F.lit(0).alias("done"))

        def step(t: Column, i: Column) -> Column:
            i = i.cast("double")
            an, bn = -i * (i - a), b0 + 2 * i
            new = F.struct((1 / (an * t["d"] + bn)).alias("d"), (bn + an / t["c"]).alias("c"))
            return F.when(t["done"] == 1, t).otherwise(F.transform(F.array(new), lambda n: F.struct(n["d"].alias("d"), n["c"].alias("c"), (t["h"] * n["c"] * n["d"]).alias("h"), (F.abs(n["c"] * n["d"] - 1) < 1e-16).cast("int").alias("done")))[0])

        high = front * F.aggregate(_steps(steps), start, step, lambda t: t["h"])
        return F.when(x <= 0, 1.0).when(x < a + 1, low).otherwise(high)

    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), x.alias("x"))), tail), 1)


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X > x) of a chi-square variable with df degrees of freedom."""
    return gamma_tail_column(df / 2, x / 2)


def t_pvalue_column(t: Column, df: Column) -> Column:
    """Two-sided p value of Student's t, on the JVM; null for null."""
    return beta_share_column(df / (df + t * t), df / 2, F.lit(0.5))


def t_quantile_column(level: float, df: Column, steps: int = 9) -> Column:
    """Upper point t with P(|T| < t) = level, on the JVM; null for null.

    Newton's steps from the normal point's expansion in 1 / df, which lies below: the tail is convex, so none goes too far.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2)

    def found(n: Column) -> Column:
        start = z + (z**3 + z) / (4 * n) + F.least(F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (n * n), F.lit(z))
        height = F.exp(lgamma((n + 1) / 2) - lgamma(n / 2) - 0.5 * F.ln(n * math.pi))
        step = lambda t, _: t + (t_pvalue_column(t, n) - (1 - level)) / (2 * height * F.pow(1 + t * t / n, -(n + 1) / 2))
        return F.aggregate(_steps(steps), start, step)

    return F.element_at(F.transform(F.array(df.cast("double")), lambda n: F.when(n.isNotNull(), found(n))), 1)


def normal_pvalue_column(z: Column) -> Column:
    """P(|Z| > |z|) for a standard normal Z, on the JVM, to a relative 1e-12; null for null."""
    return gamma_tail_column(F.lit(0.5), z * z / 2)


#: A rational start for the normal quantile in t = sqrt(-2 ln p), with an error under 4.5e-4.
START = ((2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308))


def normal_quantile_column(p: Column) -> Column:
    """The standard normal quantile of p, on the JVM, to about 1e-7; p is kept within 1e-12 of 0 and 1, null for null."""
    power = lambda t, cs: sum((c * F.pow(t, F.lit(float(i))) for i, c in enumerate(cs)), F.lit(0.0))

    def upper(q: Column) -> Column:
        t = F.sqrt(-2 * F.ln(q))
        step = lambda z, _: z + (normal_two_sided(z) / 2 - q) * math.sqrt(2 * math.pi) * F.exp(z * z / 2)
        return F.aggregate(_steps(3), t - power(t, START[0]) / power(t, START[1]), step)

    def both(x: Column) -> Column:
        tail = F.element_at(F.transform(F.array(F.greatest(F.least(x, 1 - x), F.lit(1e-12))), upper), 1)
        return F.when(x.isNotNull(), F.when(x < 0.5, -tail).otherwise(tail))

    return F.element_at(F.transform(F.array(p.cast("double")), both), 1)
