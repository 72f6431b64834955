"""Exact top-k by inner product, by a three-phase uniform threshold.

The components are dealt to `nodes` groups; a node's score of a vector is the inner
product over its own components. Phase 1: every task lists, per query and node, the
vectors of the highest node scores, and resolves these few exactly; the k-th best of
all lists is a safe cutoff, since at least k vectors reach it. Phase 2: a vector that
reaches the cutoff must reach the uniform share of it at one node at least (node
scores are taken above the node's lowest), so each task looks at just those entries.
Phase 3: entries whose upper bound still reaches the cutoff are resolved exactly.
Queries go out in blocks of bounded bytes, one block after the other; candidates never
move.

Vectors that are null, empty or hold a null or non-finite component take no part, nor
do rows without id. Only vectors of a query's own length are compared with it. Rows that
repeat an id and a vector are one query and a candidate each; an id with two different
vectors is two queries, whose results come under one id. Rows with the query's id are not
candidates. Ties go to the smaller id. Scores are exact integers; one beyond 64 bits is
given as the last one that fits. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage

#: Sums below this are exact in doubles.
_EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)
_SCORES = "query int, node int, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as doubles, for the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(v, lambda x: x * F.lit(float(scale)))
    fine = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length of vector in the batch."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    size = np.diff(lists.offsets.to_numpy())
    at = np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield ids[rows], flat[at[rows][:, None] + np.arange(d)[None, :]]


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """q @ v.T as exact integers, in doubles where they hold them and Python's integers else."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if bound < _EXACT:
        return q @ v.T
    whole = np.vectorize(int, otypes=[object])
    return whole(q) @ whole(v).T if q.size and v.size else np.zeros((len(q), len(v)))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, ties to the smaller id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= cut)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _cut(total: int, nodes: int) -> list[slice]:
    n = min(nodes, total)
    edges = [total * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _rows(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    fit = [min(max(int(x), _LONG[0]), _LONG[1]) for x in cols[3]]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(fit, pa.int64())], ["query", "node", "vec_id", "score"])


def _merge(old: list, ids: np.ndarray, score: np.ndarray, k: int) -> list:
    if old:
        ids, score = np.concatenate([old[0][0], ids]), np.concatenate([old[0][1], score])
    keep = _best(score, ids, k)
    return [(ids[keep], score[keep])]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, nodes: int = 4, block_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest inner products.

    Both inputs are as quantised() gives them. block_bytes: about how many bytes of queries are broadcast at once.
    """
    spark = vectors.sparkSession
    asked = stage(queries.select("vec_id", "v").distinct(), "topk-queries")
    total = asked.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    key = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    found = None
    for b in range(blocks):
        own = _block(spark, vectors, asked.where(key == b).toPandas(), k, nodes)  # about block_bytes
        own = own if blocks == 1 else stage(own, "topk")
        found = own if found is None else found.unionByName(own)
    return found


def _block(spark, vectors: DataFrame, rows, k: int, nodes: int) -> DataFrame:
    """Results of the queries in rows (vec_id, v): a bounded number of them."""
    if not len(rows):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    names = rows["vec_id"].to_numpy(np.int64)
    size = rows["v"].map(len).to_numpy()
    #: by length of vector: (numbers of the queries, their ids, a matrix of them)
    by_size = {}
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        by_size[int(d)] = (at, names[at], np.floor(np.array(rows["v"].iloc[at].tolist(), np.float64).reshape(-1, d)))
    asked = spark.sparkContext.broadcast(by_size)

    def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
        """(queries, query ids, vector ids, queries' matrix, vectors' matrix, node scores) in bounded pieces."""
        for ids, v in _matrices(batch) if batch.num_rows else ():
            if v.shape[1] in asked.value:
                number, own, q = asked.value[v.shape[1]]
                for lo in range(0, len(ids), 1024):
                    some = v[lo : lo + 1024]
                    for first in range(0, len(own), 2048):
                        part = slice(first, first + 2048)
                        yield number[part].tolist(), own[part], ids[lo : lo + 1024], q[part], some, [_product(q[part, s], some[:, s]) for s in _cut(v.shape[1], nodes)]

    def resolved(per: list[np.ndarray], i: int, cols: np.ndarray) -> np.ndarray:
        """Exact scores of a query's chosen vectors only."""
        return reduce(np.add, [p[i, cols] for p in per])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1: the task's lists, their entries resolved (node -1), and the lowest score at each node."""
        found: dict[int, list] = {}
        lowest: dict[tuple[int, int], float] = {}
        for batch in batches:
            for number, own, ids, _, _, per in parts(batch):
                lows = [p.min(axis=1) for p in per]
                lists = [np.argpartition(p, max(0, p.shape[1] - k - 1), axis=1)[:, -(k + 1) :] for p in per]
                for i, q in enumerate(number):
                    for j, low in enumerate(lows):
                        lowest[q, j] = min(lowest.get((q, j), low[i]), low[i])
                    some = np.unique(np.concatenate([x[i] for x in lists]))
                    some = some[ids[some] != own[i]]
                    if len(some):
                        found[q] = _merge(found.get(q, []), ids[some], resolved(per, i, some), k)
        yield _rows([(q, -1, v, s) for q, [(ids, score)] in found.items() for v, s in zip(ids.tolist(), score.tolist(), strict=True)] + [(q, j, 0, low) for (q, j), low in lowest.items()])

    first = stage(vectors.mapInArrow(gather, _SCORES), "topk-lists")
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    cutoff = first.where("node = -1").withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query", "score").toPandas()
    lows = first.where("node >= 0").groupBy("query", "node").agg(F.min("score").alias("low")).toPandas()  # a row a query and node
    safe = np.full(len(names), -np.inf)
    safe[cutoff["query"].to_numpy(int)] = cutoff["score"].to_numpy(float)
    low = np.zeros((len(names), nodes))
    low[lows["query"].to_numpy(int), lows["node"].to_numpy(int)] = lows["low"].to_numpy(float)
    shared = spark.sparkContext.broadcast((safe, low))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases 2 and 3: the entries over the uniform threshold, those resolved that can still reach the cutoff."""
        safe, low = shared.value
        found: dict[int, list] = {}
        for batch in batches:
            for number, own, ids, _, _, per in parts(batch):
                m = len(per)
                base, reach = low[number, :m], safe[number]
                share = (reach - base.sum(axis=1)) / m
                # the tolerance covers the rounding of the division; it lets a few more entries in, never fewer
                limit = base + share[:, None] - 1e-6 * (1 + np.abs(base) + np.abs(np.where(np.isfinite(share), share, 0))[:, None])
                over = [p >= limit[:, j : j + 1] for j, p in enumerate(per)]
                rows, cols = np.nonzero(reduce(np.logical_or, over))
                if not len(rows):
                    continue
                # a node's score where it is over the threshold, else no more than the threshold
                bound = sum(np.where(o[rows, cols], p[rows, cols], np.minimum(p.max(axis=1)[rows], limit[rows, j])) for j, (o, p) in enumerate(zip(over, per, strict=True)))
                kept = bound >= reach[rows] - 1e-6 * (1 + np.abs(np.where(np.isfinite(reach), reach, 0)))[rows]
                rows, cols = rows[kept], cols[kept]
                edge = np.searchsorted(rows, np.arange(len(number) + 1))
                for i in np.unique(rows).tolist():
                    mine = cols[edge[i] : edge[i + 1]]
                    mine = mine[ids[mine] != own[i]]
                    if len(mine):
                        found[number[i]] = _merge(found.get(number[i], []), ids[mine], resolved(per, i, mine), k)
        yield _rows([(q, -1, v, s) for q, [(ids, score)] in found.items() for v, s in zip(ids.tolist(), score.tolist(), strict=True)])

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = vectors.mapInArrow(collect, _SCORES).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    called = spark.createDataFrame(rows.assign(query=np.arange(len(rows), dtype=np.int32))[["query", "vec_id"]].rename(columns={"vec_id": "query_id"}), "query int, query_id long")
    return top.join(F.broadcast(called), "query").select("query_id", "rank", "vec_id", "score")
