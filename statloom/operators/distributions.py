"""Count distributions as array columns: element k + 1 is the probability of k.

Poisson and negative binomial probabilities are higher-order functions with ln Gamma from
its series, so they stay on the JVM. Where a row needs only numbers of its distribution, `mixture_summary`
and `count_cdf` work batches of rows out as arrays, each probability from the one before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.special import lgamma


def count_pmf(mean: Column, alpha: Column, top: int | Column) -> Column:
    """Probabilities of 0..top, with variance mean + alpha * mean**2 (alpha 0: Poisson).

    Up to a fixed top each follows from the one before: copying short arrays takes half the time of ln Gamma for every count.
    """
    if isinstance(top, int) and top <= 100:
        r = F.try_divide(F.lit(1.0), alpha)
        p0 = F.when(alpha > 0, F.pow(1 / (1 + alpha * mean), r)).otherwise(F.exp(-mean))
        ratio = lambda k: F.when(alpha > 0, (k - 1 + r) / k * (alpha * mean / (1 + alpha * mean))).otherwise(mean / k)
        return F.aggregate(F.sequence(F.lit(1), F.lit(top)), F.array(p0.cast("double")), lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * ratio(k.cast("double")))))
    return mixture_pmf(F.array(F.struct(F.lit(1.0).alias("weight"), mean.cast("double").alias("mean"))), alpha, top)


def mixture_pmf(nodes: Column, alpha: Column, top: int | Column) -> Column:
    """Probabilities of 0..top of a mixture of counts: nodes is an array of structs (weight, mean). A mean of 0 has all at 0."""
    last = F.lit(top) if isinstance(top, int) else top.cast("int")
    # what doesn't depend on k is worked out once a node
    r = F.try_divide(F.lit(1.0), alpha)

    def fixed(n: Column) -> Column:
        m = F.greatest(n["mean"], F.lit(1e-300))
        share = F.ln(1 + alpha * m)
        head = F.when(alpha > 0, -lgamma(r) - r * share).otherwise(-m)
        slope = F.when(alpha > 0, F.ln(alpha * m) - share).otherwise(F.ln(m))
        return F.struct(n["weight"].alias("weight"), head.alias("head"), slope.alias("slope"))

    def at(own: Column) -> Column:
        def p(k: Column) -> Column:
            k = k.cast("double")
            level = F.when(alpha > 0, lgamma(k + r)).otherwise(0.0) - lgamma(k + 1)
            return F.element_at(F.transform(F.array(level), lambda c: F.aggregate(own, F.lit(0.0), lambda t, n: t + n["weight"] * F.exp(n["head"] + k * n["slope"] + c))), 1)

        return F.transform(F.sequence(F.lit(0), last), p)

    return F.element_at(F.transform(F.array(F.transform(nodes, fixed)), at), 1)


def support(mean: Column, alpha: Column, spread: float = 20.0) -> Column:
    """A last count that so many deviations beyond the mean leave less than about 1e-8 above."""
    return F.ceil(mean + spread * F.sqrt(mean + alpha * mean * mean) + 20).cast("int")


def normalised(pmf: Column) -> Column:
    """pmf over its sum, which is added up once and not for every element."""
    held = F.transform(F.array(pmf), lambda a: F.struct(a.alias("a"), F.aggregate(a, F.lit(0.0), lambda t, x: t + x).alias("t")))
    return F.element_at(F.transform(held, lambda s: F.transform(s["a"], lambda x: x / s["t"])), 1)


def cdf(pmf: Column) -> Column:
    run = F.aggregate(pmf, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.slice(run, 2, F.size(pmf))


def cdf_around(pmf: Column, y: Column) -> Column:
    """(below, at): the distribution function just below a count, and at it; 1 beyond the support."""
    upto = lambda p, n: F.aggregate(F.slice(p, F.lit(1), n), F.lit(0.0), lambda t, x: t + x)
    k = F.greatest(y.cast("int"), F.lit(0))
    both = F.transform(F.array(pmf), lambda p: F.struct(upto(p, k).alias("below"), upto(p, k + 1).alias("at")))
    return F.element_at(both, 1)


def quantile(pmf: Column, q: float) -> Column:
    """The smallest count whose distribution function reaches q."""
    state = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("k"), F.lit(-1).alias("found"))

    def step(s: Column, x: Column) -> Column:
        c = s["c"] + x
        hit = (s["found"] < 0) & (c >= q - 1e-12)
        return F.struct(c.alias("c"), (s["k"] + 1).alias("k"), F.when(hit, s["k"]).otherwise(s["found"]).alias("found"))

    return F.aggregate(pmf, state, step, lambda s: F.when(s["found"] < 0, s["k"] - 1).otherwise(s["found"]))


def pmf_of_quantiles(values: Column, levels: list[float], top: int) -> Column:
    """Probabilities of 0..top from an array of predicted quantiles at `levels`.

    The distribution function is linear between the sorted quantiles, 0 at -0.5, and 1 beyond the highest by twice its
    distance from the middle one (at least 1) and 1; k gets what lies between k - 0.5 and k + 0.5. All rows of an Arrow batch
    are worked out as one array. Null where values is null or holds one.
    """
    n = len(levels)
    ps = np.array([0.0, *levels, 1.0])
    edges = np.arange(top + 1) + 0.5

    def run(batch: pd.Series) -> pd.Series:
        known = [i for i, v in enumerate(batch) if v is not None and not np.isnan(np.asarray(v, float)).any()]
        out = pd.Series([None] * len(batch), dtype=object)
        if known:
            v = np.sort(np.stack([np.asarray(batch.iloc[i], float) for i in known]), axis=1)
            span = np.maximum(v[:, -1] - v[:, n // 2], 1.0)
            x = np.column_stack([np.full(len(v), -0.5), np.maximum(v, -0.5), v[:, -1] + 2 * span + 1])
            i = sum((x[:, k, None] <= edges[None, :]).astype(np.int64) for k in range(n + 2))  # points up to each edge
            beyond, i = i > n + 1, np.minimum(i, n + 1)
            lo, hi = np.take_along_axis(x, i - 1, axis=1), np.take_along_axis(x, i, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                at = np.where(beyond, 1.0, ps[i - 1] + (ps[i] - ps[i - 1]) * (edges - lo) / (hi - lo))
            mass = np.maximum(np.diff(at, axis=1, prepend=0.0), 0.0)
            total = mass.sum(axis=1, keepdims=True)
            mass = np.divide(mass, total, out=mass, where=total > 0)
            for row, k in enumerate(known):
                out[k] = mass[row]
        return out

    return F.pandas_udf(run, "array<double>")(values)


def interval(pmf: Column, level: float) -> tuple[Column, Column]:
    tail = (1 - level) / 2
    return quantile(pmf, tail), quantile(pmf, 1 - tail)


def _mass(pmf: Column, test) -> Column:
    return F.aggregate(F.transform(pmf, lambda x, k: F.when(test(k), x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def over_under_push(pmf: Column, line: Column) -> tuple[Column, Column, Column]:
    return _mass(pmf, lambda k: k > line), _mass(pmf, lambda k: k < line), _mass(pmf, lambda k: k == line)


def pmf_mean(pmf: Column) -> Column:
    return F.aggregate(F.transform(pmf, lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)


def log_score(pmf: Column, y: Column, floor: float = 1e-12) -> Column:
    p = F.coalesce(F.try_element_at(pmf, y.cast("int") + 1), F.lit(0.0))
    return F.ln(F.greatest(p, F.lit(floor)))


#: Most nodes of a piece of a batch, and most probabilities (rows x counts).
NODES, CELLS = 1 << 16, 1 << 20


def _ratios(mean: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ln p(0), ln x, r): p(k) = p(k - 1) * x * (k - 1 + r) / k, or x / k where alpha isn't above 0 (r is 0 there)."""
    m, some = np.maximum(mean, 1e-300), alpha > 0
    a = np.where(some, alpha, 1.0)
    share = np.log1p(a * m)
    return np.where(some, -share / a, -m), np.where(some, np.log(a * m) - share, np.log(m)), np.where(some, 1 / a, 0.0)


def _tops(mean: np.ndarray, alpha: np.ndarray, spread: float = 20.0) -> np.ndarray:
    """`support` of arrays."""
    return np.ceil(mean + spread * np.sqrt(mean + alpha * mean * mean) + 20).astype(np.int64)


def _mixtures(weight: np.ndarray, mean: np.ndarray, first: np.ndarray, alpha: np.ndarray, top: np.ndarray) -> np.ndarray:
    """(rows, largest top + 1) probabilities of mixtures, 0 beyond a row's top, with sum 1; first: where each row's nodes begin."""
    count = np.diff(np.append(first, len(mean)))
    head, slope, r = _ratios(mean, np.repeat(alpha, count))
    out = np.zeros((len(first), int(top.max()) + 1))
    low = head.min() < -600  # such a start leaves the range of doubles
    now, x = (head.copy(), slope) if low else (weight * np.exp(head), np.exp(slope))
    for k in range(out.shape[1]):
        if k:
            c = np.where(r > 0, k - 1 + r, 1.0) / k
            if low:
                now += slope + np.log(c)
            else:
                now *= x
                now *= c
        out[:, k] = np.add.reduceat(weight * np.exp(now) if low else now, first)
    out[np.arange(out.shape[1])[None, :] > top[:, None]] = 0.0
    return out / out.sum(axis=1, keepdims=True)


def _summaries(offsets: np.ndarray, weight: np.ndarray, mean: np.ndarray, alpha: np.ndarray, line: np.ndarray, level: float) -> dict[str, np.ndarray]:
    """median, lo, hi, over, under, push of every row's mixture; offsets: where its nodes begin and end."""
    n, start, size = len(alpha), offsets[:-1], np.diff(offsets)
    out = {c: np.zeros(n, np.int32 if c in ("median", "lo", "hi") else float) for c in ("median", "lo", "hi", "over", "under", "push")}
    if not n:
        return out
    top = _tops(np.maximum.reduceat(mean, start), alpha)
    order = np.argsort(top, kind="stable")  # rows of like supports together
    a = 0
    while a < n:
        b, nodes = a, 0
        while b < n and (b == a or (nodes + size[order[b]] <= NODES and (b - a + 1) * (top[order[b]] + 1) <= CELLS)):
            nodes += size[order[b]]
            b += 1
        rows = order[a:b]
        first = np.concatenate(([0], np.cumsum(size[rows])[:-1]))
        at = np.repeat(start[rows] - first, size[rows]) + np.arange(nodes)
        p = _mixtures(weight[at], mean[at], first, alpha[rows], top[rows])
        run, k = np.cumsum(p, axis=1), np.arange(p.shape[1])[None, :]
        for c, q in (("median", 0.5), ("lo", (1 - level) / 2), ("hi", 1 - (1 - level) / 2)):
            hit = run >= q - 1e-12
            out[c][rows] = np.where(hit.any(axis=1), hit.argmax(axis=1), top[rows])
        at = line[rows][:, None]
        for c, test in (("over", k > at), ("under", k < at), ("push", k == at)):
            out[c][rows] = np.where(test, p, 0.0).sum(axis=1)
        a = b
    return out


_SUMMARY = "struct<median int, lo int, hi int, over double, under double, push double>"


def mixture_summary(nodes: Column, alpha: Column, line: Column, level: float = 0.9) -> Column:
    """(median, lo, hi, over, under, push) of a mixture of counts over its whole `support`, its sum made one; see `mixture_pmf`.

    Null where nodes, one of them or alpha is null, or there are none; without a line nothing is over or under it.
    """

    @F.arrow_udf(_SUMMARY)
    def summary(nodes: pa.Array, alpha: pa.Array, line: pa.Array) -> pa.Array:
        flat = nodes.flatten()
        weight, mean = (np.asarray(flat.field(c).fill_null(np.nan).to_numpy(zero_copy_only=False), float) for c in ("weight", "mean"))
        size = nodes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        a = alpha.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        bad = np.bincount(np.repeat(np.arange(len(size)), size), weights=~np.isfinite(weight + mean), minlength=len(size)) > 0
        ok = (size > 0) & ~bad & np.isfinite(a)
        keep = np.repeat(ok, size)
        offsets = np.concatenate(([0], np.cumsum(size[ok]))).astype(np.int64)
        at = line.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        found, none = _summaries(offsets, weight[keep], mean[keep], a[ok], at[ok], level), pa.array(~ok)
        fields = []
        for c, x in found.items():
            whole = np.zeros(len(ok), x.dtype)
            whole[ok] = x
            fields.append(pa.array(whole))
        return pa.StructArray.from_arrays(fields, list(found), mask=none)

    return summary(nodes, alpha.cast("double"), line.cast("double"))


def count_cdf(mean: Column, alpha: Column, y: Column) -> Column:
    """(below, at): `cdf_around` of a count with variance mean + alpha * mean**2, from the probabilities up to y alone; null for null."""

    @F.arrow_udf("struct<below double, at double>")
    def around(mean: pa.Array, alpha: pa.Array, y: pa.Array) -> pa.Array:
        m, a, y = (x.fill_null(np.nan).to_numpy(zero_copy_only=False) for x in (mean, alpha, y))
        ok = np.isfinite(m) & np.isfinite(a) & np.isfinite(y)
        below, at = np.zeros(len(m)), np.zeros(len(m))
        rows = np.flatnonzero(ok)
        k = np.minimum(np.maximum(np.trunc(y[rows]), 0), _tops(m[rows], a[rows]) + 1).astype(np.int64)
        rows, k = rows[np.argsort(-k, kind="stable")], -np.sort(-k, kind="stable")  # the rows that go on stand first
        now, slope, r = _ratios(m[rows], a[rows])
        run, last = np.zeros(len(rows)), _tops(m[rows], a[rows])
        for j in range(int(k[0]) + 1 if len(k) else 0):
            n = int(np.searchsorted(-k, -j, side="right"))
            if j:
                now[:n] += slope[:n] + np.log(np.where(r[:n] > 0, j - 1 + r[:n], 1.0) / j)
            p = np.where(j <= last[:n], np.exp(now[:n]), 0.0)
            here = k[:n] == j
            below[rows[:n][here]] = run[:n][here]
            run[:n] += p
            at[rows[:n][here]] = run[:n][here]
        return pa.StructArray.from_arrays([pa.array(below), pa.array(at)], ["below", "at"], mask=pa.array(~ok))

    return around(mean.cast("double"), alpha.cast("double"), y.cast("double"))
