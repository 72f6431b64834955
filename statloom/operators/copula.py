"""Several counts together: correlations of their normal scores, and the chance that conditions on them all hold.

The counts of a row share its exposure, which is a mixture of nodes, and are joined by a normal copula: correlated normal
draws are turned into counts by each count's own distribution at the draw's node. Draws are a fixed low-discrepancy
lattice, the same for all rows, so a result depends neither on the batch nor on the partition; a batch of rows is worked on
as arrays.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most numbers (rows x draws x counts) of an array.
ROOM = 1 << 22


def correlations(df: DataFrame, by: str, cols: Sequence[str], n0: float = 50.0) -> DataFrame:
    """(by, n, rho): every group's correlations of all pairs of cols, row by row of the matrix, shrunk to the whole table's by n0 rows.

    One aggregate of sums over the rows that have all cols; groups without spread take the whole table's.
    """
    k = len(cols)
    pairs = list(itertools.combinations(range(k), 2))
    full = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))
    sums = [F.count("*").alias("n"), *[F.corr(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in pairs]]
    own = full.groupBy(by).agg(*sums)
    league = full.agg(*[F.corr(cols[i], cols[j]).alias(f"l{i}_{j}") for i, j in pairs])
    j = own.crossJoin(F.broadcast(league))  # one row
    shrunk = {}
    for a, b in pairs:
        all_ = F.coalesce(F.nanvl(f"l{a}_{b}", F.lit(0.0)), F.lit(0.0))
        shrunk[a, b] = (F.col("n") * F.coalesce(F.nanvl(F.col(f"r{a}_{b}"), all_), all_) + n0 * all_) / (F.col("n") + n0)
    cells = [F.lit(1.0) if a == b else shrunk[min(a, b), max(a, b)] for a in range(k) for b in range(k)]
    return j.select(by, "n", F.array(*cells).alias("rho"))


def factors(r: np.ndarray) -> np.ndarray:
    """(rows, k, k) lower triangular factors of the correlation matrices next to r: no eigenvalue under 1e-9, ones on the diagonal."""
    value, vector = np.linalg.eigh((r + np.swapaxes(r, 1, 2)) / 2)
    own = (vector * np.maximum(value, 1e-9)[:, None, :]) @ np.swapaxes(vector, 1, 2)
    size = np.sqrt(np.einsum("nii->ni", own))
    own = own / size[:, :, None] / size[:, None, :]
    return np.linalg.cholesky(own + 1e-12 * np.eye(r.shape[1]))


def _normal_table() -> tuple[np.ndarray, np.ndarray]:
    z = np.linspace(-8.5, 8.5, 34_001)
    return z, np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])


def _quantile(p: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Normal quantiles by interpolation, the upper half by symmetry; 0 and 1 are -9 and 9, beyond every draw."""
    z, cdf = table
    low = np.minimum(p, 1 - p)
    out = np.interp(low, cdf, z)
    return np.where(p <= 0, -9.0, np.where(p >= 1, 9.0, np.where(p <= 0.5, out, -out)))


def lattice(n: int, dims: int) -> np.ndarray:
    """(n, dims) evenly spread numbers in (0, 1): multiples of the powers of the root of x**(dims + 1) = x + 1."""
    root = 2.0
    for _ in range(60):
        root = (1 + root) ** (1 / (dims + 1))
    return (0.5 + np.arange(1, n + 1)[:, None] * (1 / root) ** np.arange(1, dims + 1)[None, :]) % 1.0


@dataclass(frozen=True)
class Condition:
    """The sum of the counts numbered `of` is over, or under, the line in column `line`."""

    of: tuple[int, ...]
    line: str
    over: bool = True


def _cdfs(mean: np.ndarray, alpha: np.ndarray, top: int) -> np.ndarray:
    """(.., top + 1) distribution functions of counts with variance mean + alpha * mean**2, by running sums of log ratios."""
    k = np.arange(1, top + 1)
    m, a = np.maximum(mean, 1e-300)[..., None], alpha[..., None]
    ratio = (m / k) * (1 + a * (k - 1)) / (1 + a * m)
    first = np.where(a > 0, -np.log1p(a * m) / np.where(a > 0, a, 1), -m)
    logs = np.concatenate([first, first + np.cumsum(np.log(ratio), axis=-1)], axis=-1)
    return np.minimum(np.cumsum(np.exp(logs), axis=-1), 1.0)


def joint_probability(df: DataFrame, weights: str, means: str, alphas: str, rho: str, conditions: Sequence[Condition], draws: int = 4096, alias: str = "joint") -> DataFrame:
    """df with the chance that all conditions hold.

    weights: array of a row's m node weights. means: array of m * k expectations, node by node. alphas: array of the k
    overdispersions. rho: array of the k * k correlations. Null in any of these, or in a line, gives null.
    """
    lines = list(dict.fromkeys(c.line for c in conditions))
    needed = [weights, means, alphas, rho, *lines]
    fixed: list = []

    def prepare(k: int) -> tuple[np.ndarray, np.ndarray, tuple]:
        if not fixed:
            table = _normal_table()
            u = lattice(draws, k + 1)
            fixed.append((u[:, 0], _quantile(u[:, 1:], table), table))
        return fixed[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, np.nan)
            ok = np.flatnonzero(np.logical_and.reduce([np.asarray(batch.column(c).is_valid()) for c in needed]))
            if len(ok):
                part = batch.take(pa.array(ok))
                a = np.stack(part.column(alphas).to_numpy(zero_copy_only=False)).astype(float)
                k = a.shape[1]
                pick, normal, table = prepare(k)
                sizes = np.array([len(x) for x in part.column(weights).to_pylist()])
                for m in np.unique(sizes):  # rows of as many nodes together
                    for lo in range(0, int((sizes == m).sum()), max(1, ROOM // (draws * k))):
                        rows = np.flatnonzero(sizes == m)[lo : lo + max(1, ROOM // (draws * k))]
                        own = part.take(pa.array(rows))
                        get = lambda c: np.stack(own.column(c).to_numpy(zero_copy_only=False)).astype(float)  # noqa: E731, B023
                        line = {c: own.column(c).to_numpy(zero_copy_only=False).astype(float) for c in lines}
                        out[ok[rows]] = _hits(get(weights), get(means).reshape(len(rows), m, k), a[rows], get(rho).reshape(-1, k, k), conditions, line, pick, normal, table)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64(), mask=np.isnan(out))], [*batch.schema.names, alias])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(alias, T.DoubleType())]))


def _hits(w: np.ndarray, mean: np.ndarray, alpha: np.ndarray, r: np.ndarray, conditions: Sequence[Condition], line: dict, pick: np.ndarray, normal: np.ndarray, table: tuple) -> np.ndarray:
    n, m, k = mean.shape
    edges = np.cumsum(w / w.sum(axis=1, keepdims=True), axis=1)
    kinds, kind = np.unique(edges, axis=0, return_inverse=True)
    node = np.stack([np.minimum(np.searchsorted(e, pick), m - 1) for e in kinds])[kind.ravel()]
    z = normal @ np.swapaxes(factors(r), 1, 2)  # (rows, draws, counts)
    most = float(mean.max(initial=0))
    widest = float(alpha.max(initial=0))
    top = int(math.ceil(most + 20 * math.sqrt(most + widest * most * most) + 20))
    cut = _quantile(_cdfs(mean, np.broadcast_to(alpha[:, None, :], mean.shape), top), table)  # (rows, nodes, counts, values)
    held = np.ones(z.shape[:2], bool)

    def count(s: int, row: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The draws' counts: how many cuts of the draw's row and node lie below it, by one search in all of them."""
        segment = row * m + node[row, draw]
        flat = (cut[:, :, s, :] + (np.arange(n * m) * 32.0).reshape(n, m, 1)).ravel()
        return np.minimum(np.searchsorted(flat, z[row, draw, s] + segment * 32.0) - segment * (top + 1), top)

    for c in sorted(conditions, key=lambda c: len(c.of)):  # those on one count are cheap; draws that fail them need no counting
        at = line[c.line]
        if len(c.of) == 1:  # a single count is compared where the draw is, without counting
            last = np.floor(at).astype(int) if c.over else np.ceil(at).astype(int) - 1
            own = np.where((last < 0)[:, None], -9.5, np.take_along_axis(cut[:, :, c.of[0], :], np.clip(last, 0, top)[:, None, None], axis=2)[:, :, 0])
            above = z[:, :, c.of[0]] > np.take_along_axis(own, node, axis=1)
            held &= above if c.over else ~above
        else:
            row, draw = np.nonzero(held)
            total = sum(count(s, row, draw) for s in c.of)
            held[row, draw] = total > at[row] if c.over else total < at[row]
    return held.mean(axis=1)
