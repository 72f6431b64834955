"""Centroid clustering whose assignments come from the threshold algorithm.

Each dimension keeps its centroids in a list sorted by their component. For a vector the
lists are walked outward from the vector's own value, nearest entries first, a group of
dimensions at a time; a centroid met for the first time is resolved exactly. The next
entries not yet walked are the frontier: a centroid met in no list is at least as far as
the sum of the frontier's squared differences, so the walk of a vector stops when that sum
strictly exceeds its best exact distance (at equality a smaller number could still tie).

Centroids are k x dims numbers: they are broadcast, and a round sends back exact sums and
counts, added up in Spark by (cluster, dimension). Vectors never move. A round that
changes no centroid ends the rounds, as all further ones would repeat it.

Vectors take part if they have exactly `dims` components, none null or non-finite; others
give no row. Components are floor(scale * x), and one beyond 62 bits is taken as the last
number that fits; sums and distances are exact, and a distance or inertia beyond a long is
given as the last long. Rows that repeat an id or a vector count each. A row without id
takes part and comes last where starting centroids are chosen; ties of the starting hash go
by the vector. With fewer than k vectors each one is a centroid. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage

_LIMIT, _LAST = float(1 << 62), (1 << 63) - 1
#: Rows of a batch that are walked together, and dimensions between two looks at the threshold.
_ROWS, _DIMS = 2048, 16
#: Above any difference of two components that is squared in 64 bits.
_FAR = 1 << 40


def eligible(vectors: DataFrame, dims: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, unscaled."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) == dims) & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """Whole components: 64-bit integers where squared distances fit, Python's integers else."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, dims)
    x = np.clip(x, -_LIMIT, _LIMIT).astype(np.int64)
    return x


def _fits(*parts: np.ndarray) -> bool:
    most = max((int(np.abs(p).max()) for p in parts if p.size), default=0)
    return all(p.dtype != object for p in parts) and (2 * most) ** 2 * parts[0].shape[1] < 1 << 63


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) for each row of v; ties go to the smaller number."""
    n, dims = v.shape
    k = len(c)
    plain = _fits(v, c)
    kind = np.int64 if plain else object
    v, c = v.astype(kind), c.astype(kind)
    far = np.array(_FAR if plain else 1 << 70, kind)
    order = np.argsort(c, axis=0, kind="stable")
    values = np.take_along_axis(c, order, axis=0)
    # the walk of a row and dimension has taken the entries between lo and hi
    hi = np.stack([np.searchsorted(values[:, j], v[:, j]) for j in range(dims)], axis=1)
    lo = hi - 1
    best, at = np.full(n, -1, kind), np.zeros(n, np.int64)
    known = np.zeros((n, k), bool)
    rows = np.arange(n)
    cols = np.arange(dims)

    def ahead(part: np.ndarray, own: slice) -> tuple[np.ndarray, np.ndarray]:
        """Differences to the next entries below and above."""
        j = cols[own][None, :]
        x = v[part][:, own]
        low, high = lo[part][:, own], hi[part][:, own]
        below = np.where(low >= 0, x - values[np.maximum(low, 0), j], far)
        above = np.where(high < k, values[np.minimum(high, k - 1), j] - x, far)
        return below, above

    while len(rows):
        for first in range(0, dims, _DIMS):
            own = slice(first, first + _DIMS)
            below, above = ahead(rows, own)
            left = below <= above
            taken = np.where(left, lo[rows][:, own], hi[rows][:, own])
            open_ = (taken >= 0) & (taken < k)
            number = order[np.clip(taken, 0, k - 1), cols[own][None, :]]
            met = np.zeros((len(rows), k), bool)
            r, d = np.nonzero(open_)
            met[r, number[r, d]] = True
            grid = np.ix_(rows, cols[own])
            lo[grid] -= left & open_
            hi[grid] += ~left & open_
            new = met & ~known[rows]
            known[rows] |= met
            for x in np.flatnonzero(new.any(axis=0)).tolist():
                some = rows[new[:, x]]
                far_off = v[some] - c[x][None, :]
                exact = (far_off * far_off).sum(axis=1)
                better = (best[some] < 0) | (exact < best[some]) | ((exact == best[some]) & (x < at[some]))
                best[some[better]], at[some[better]] = exact[better], x
            below, above = ahead(rows, slice(0, dims))
            frontier = np.minimum(below, above)
            reach = (np.minimum(frontier, far if not plain else 1 << 28) ** 2).sum(axis=1)
            done = known[rows].all(axis=1) | ((best[rows] >= 0) & (reach > best[rows]))
            rows = rows[~done.astype(bool)]
            if not len(rows):
                break
    return at, best


def _sums(vectors: DataFrame, c: np.ndarray, dims: int, scale: float) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (count, sums of components), of the vectors nearest to each centroid; at most k * (dims + 1) rows reach the driver."""
    sent = vectors.sparkSession.sparkContext.broadcast(c)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        total = np.zeros((len(c), dims + 1), object)
        for batch in batches:
            for x in _pieces(batch, dims, scale):
                at, _ = nearest(x, c)
                for k in np.unique(at).tolist():
                    own = x[at == k]
                    whole = own if np.abs(own).max() < (1 << 62) // len(own) else own.astype(object)
                    total[k, :dims] += whole.sum(axis=0).astype(object)
                    total[k, dims] += len(own)
        full = np.flatnonzero(total[:, dims]).tolist()
        cells = [(k, j, Decimal(int(total[k, j]))) for k in full for j in range(dims + 1)]
        cols = list(zip(*cells, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.decimal128(38, 0))], ["cluster", "dim", "total"])

    found = vectors.mapInArrow(add, "cluster int, dim int, total decimal(38,0)").groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect()
    out: dict[int, list[int]] = {}
    for r in found:
        out.setdefault(r["cluster"], [0] * (dims + 1))[r["dim"]] = int(r["total"])
    return {k: (x[dims], x[:dims]) for k, x in out.items()}


def _pieces(batch: pa.RecordBatch, dims: int, scale: float) -> Iterator[np.ndarray]:
    for lo in range(0, batch.num_rows, _ROWS):
        yield _matrix(batch.column("v").slice(lo, _ROWS), dims, scale)


def start(kept: DataFrame, k: int, dims: int, scale: float, seed: int) -> np.ndarray:
    """The k vectors of the smallest hashes of seed and id, in that order: k rows reach the driver."""
    name = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), "utf-8"), 256)
    rows = kept.withColumn("h", name).orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()
    flat = pa.array([r["v"] for r in rows], pa.list_(pa.float64()))
    return _matrix(flat, dims, scale) if rows else np.zeros((0, dims), np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part (see the module's text)."""
    spark = vectors.sparkSession
    kept = eligible(vectors, dims, id_col, vec_col)
    c = start(kept, k, dims, scale, seed)
    for _ in range(rounds):
        found = _sums(kept, c, dims, scale)
        moved = [[s // found[i][0] for s in found[i][1]] if i in found else [int(x) for x in row] for i, row in enumerate(c)]
        after = np.array(moved, np.int64).reshape(-1, dims)  # a mean lies between its parts, which fit
        if (after == c).all():
            break
        c = after
    sent = spark.sparkContext.broadcast(c)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = [np.zeros(0, np.int64)], [0][:0]
            for x in _pieces(batch, dims, scale):
                a, d = nearest(x, sent.value)
                at.append(a)
                far += [min(int(y), _LAST) for y in d]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.concatenate(at), pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    rows = stage(kept.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    long = lambda x: F.least(x, F.lit(_LAST).cast("decimal(38,0)")).cast("long")
    size = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))  # k rows
    every = size.agg(F.sum("s").cast("decimal(38,0)").alias("a"))
    names = spark.createDataFrame([(i, hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest()) for i, row in enumerate(c)], "cluster int, centroid_sha256 string")
    facts = size.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(every)).select("cluster", long(F.col("s")).alias("cluster_inertia"), long(F.col("a")).alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid
