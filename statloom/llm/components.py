"""Connected components of an edge table, by alternating large and small stars.

First the edges are thinned where they lie: a task replaces those of a chunk by a star of each of the chunk's own
components, which connects the same nodes with fewer edges than nodes; and again as it reads what several tasks have
left, a chunk a task, as long as that halves them. Where a chunk holds all, nothing more is to be done. Each round points every node at the smallest node it can see; rounds are written to
the shared folder and number about the logarithm of the longest path. A node's
minimum is aggregated before its edges move, so a node with very many edges is no
hot spot beyond the join, which adaptive execution splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage

#: Edges that a task thins at a time.
CHUNK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) for every node but the smallest ones, of the graph with edges (a, b)."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        p, q = root[x], root[y]
        np.minimum.at(root, p, np.minimum(p, q))  # the root of the one is hung below the other's, if that is smaller
        np.minimum.at(root, q, np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[other], ids[root[other]]


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b that connect what those of `edges` connect; a task holds CHUNK of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        kept = 0  # edges in held that are thinned already
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            if sum(len(x) for x, _ in held) - kept >= CHUNK:
                own = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, kept = [own], len(own[0])
                if kept >= CHUNK:
                    yield _batch(*own)
                    held, kept = [], 0
        if held:
            yield _batch(*forest(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return edges.mapInArrow(run, "a long, b long")


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of edges (a, b) but the roots themselves; root is the smallest id of its component."""
    now = stage(thinned(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")), "edges")
    n = now.count()
    while True:
        tasks, before = max(1, math.ceil(n / CHUNK)), n
        now = stage(thinned(now.coalesce(tasks)), "edges")
        if tasks == 1:  # a chunk held all that was left
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        n = now.count()
        if n > before / 2:
            break
    now = stage(now.distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = stage(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = state
