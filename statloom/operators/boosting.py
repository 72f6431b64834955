"""Gradient boosting on histograms: Poisson counts with an offset, means, and several quantiles at once.

Features are put into at most `bins` bins by approximate quantiles (null is a bin of its own), and the
binned rows are written once, a batch of them as the bytes of its arrays, which cost no conversion a row when read. Rows in
the same bins always share a score, and the sums of the smooth losses over them follow from a few sums of their own (rows, y,
exposure, what of the deviance no score changes), so these losses write a row for all rows in the same bins: what a round costs
goes by the bins in use, not by the input's rows. Each level of a tree is one aggregate: tasks add up gradients and curvatures by
(model, node, feature, bin) over their rows, Spark adds up the tasks' cells, and the driver, which gets
models * nodes * features * bins cells whatever the input's size, picks the splits. All quantile levels grow their trees in
the same aggregates. Leaves of the smooth losses are Newton steps from the same sums; those of the
quantile loss are the residuals' quantile in the leaf, from Spark's mergeable quantile sketch. Scores are
brought up to date in the rows every few rounds, so a round costs the same late as early.

Rows of `valid` train nothing; their deviance is added up along with the next round's first level, and
the rounds end `patience` rounds after its lowest value, which decides how many trees stay.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Rounds between two updates of the scores in the rows.
REFRESH = 8
#: Arrays of the binned rows. Those of the smooth losses stand for n rows: y is their sum, o the log of their summed exposure, c their deviance's constant part.
_KIND = {"bins": np.uint8, "y": float, "o": float, "v": bool, "f": float}
_MERGED = _KIND | {"n": float, "c": float}
_CELL = "model int, node int, feature int, bin int, g double, h double, n long"


def _slopes(loss: str, y: np.ndarray, o: np.ndarray, f: np.ndarray, levels: np.ndarray, n: np.ndarray | None = None, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, curvature, deviance) of each row and model; of the smooth losses, summed over the n rows that a row stands for."""
    y = y[:, None]
    if loss == "poisson":
        o, n, c = o[:, None], n[:, None], c[:, None]
        mu = n * np.exp(np.minimum(f + o - np.log(n), 50))  # the bound is on a row's count, at the mean exposure
        return mu - y, mu, 2 * (np.where(y > 0, c - y * f, 0.0) - (y - mu))
    if loss == "squared":
        n, c = n[:, None], c[:, None]
        return n * f - y, n + np.zeros_like(f), c + n * (y / n - f) ** 2
    return np.where(y < f, 1 - levels, -levels), np.ones_like(f), np.maximum(levels * (y - f), (levels - 1) * (y - f))


@dataclass
class Tree:
    """A full binary tree for each model: rows whose bin is above `cut` go right; an unsplit node sends all left."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def node(self, model: int, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node, from 0 within its level, that each row is in `depth` steps down."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            at = 2 * at + 1 + (bins[rows, self.feature[model, at]] > self.cut[model, at])
        return at - (2**depth - 1)


def _raised(f: np.ndarray, trees: Sequence[Tree], bins: np.ndarray) -> np.ndarray:
    for t in trees:
        depth = int(math.log2(t.leaf.shape[1]))
        f = f + np.stack([t.leaf[m][t.node(m, bins, depth)] for m in range(f.shape[1])], axis=1)
    return f


@dataclass
class Boosted:
    """A fitted model. deviance: by round, from the constant on (of the validation rows, if any; of the others else)."""

    loss: str
    features: list[str]
    edges: list[np.ndarray]
    levels: list[float]
    base: np.ndarray
    trees: list[Tree] = field(default_factory=list)
    deviance: list[float] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return len(self.trees)

    def to_json(self) -> str:
        trees = [[t.feature.tolist(), t.cut.tolist(), t.leaf.tolist()] for t in self.trees]
        return json.dumps({"loss": self.loss, "features": self.features, "edges": [e.tolist() for e in self.edges], "levels": self.levels, "base": self.base.tolist(), "trees": trees, "deviance": self.deviance})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        d = json.loads(text)
        trees = [Tree(np.array(f, np.int64), np.array(c, np.int64), np.array(v, float)) for f, c, v in d["trees"]]
        return cls(d["loss"], d["features"], [np.array(e, float) for e in d["edges"]], d["levels"], np.array(d["base"], float), trees, d["deviance"])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(rows, models) from (rows, features) with NaN for null: raw scores, log rates of Poisson, quantiles in rising order."""
        f = _raised(np.tile(self.base, (len(x), 1)), self.trees, _binned(x, self.edges))
        return np.sort(f, axis=1) if self.loss == "quantile" else f

    def column(self, replaced: Mapping[str, Column] | None = None) -> Column:
        """The prediction: a rate (Poisson, to be multiplied by the exposure), a mean, or an array of sorted quantiles.

        replaced: columns that stand in for features of these names.
        """
        many = self.loss == "quantile"

        def run(*cols: pd.Series) -> pd.Series:
            f = self.scores(np.stack([c.to_numpy(float, na_value=np.nan) for c in cols], axis=1))
            return pd.Series(list(f)) if many else pd.Series(np.exp(f[:, 0]) if self.loss == "poisson" else f[:, 0])

        return F.pandas_udf(run, "array<double>" if many else "double")(*[(replaced or {}).get(c, F.col(c)).cast("double") for c in self.features])


def _binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for k, e in enumerate(edges):
        out[:, k] = np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(e, x[:, k]))
    return out


def _row(kinds: Mapping[str, type]) -> str:
    return ", ".join(f"{c} binary" for c in kinds)


def _arrays(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bins, y, o, v, f), and n and c of merged rows, of each batch of rows that was written."""
    for batch in batches:
        for i in range(batch.num_rows):
            bins, y, o, v, f, *sums = (np.frombuffer(batch.column(c)[i].as_buffer(), _MERGED[c]) for c in batch.schema.names)
            yield bins.reshape(-1, features), y, o, v, f.reshape(len(y), -1), *sums


def _packed(*arrays: np.ndarray) -> pa.RecordBatch:
    names = list(_MERGED)[: len(arrays)]
    return pa.RecordBatch.from_arrays([pa.array([a.astype(_MERGED[c], copy=False).tobytes()], pa.binary()) for a, c in zip(arrays, names, strict=True)], names)


def _prepare(d: DataFrame, features: Sequence[str], edges: list[np.ndarray], base: np.ndarray) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
            if b.num_rows:
                yield _packed(_binned(x, edges), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("__y", "__o", "__v")), np.tile(base, (b.num_rows, 1)))

    return d.mapInArrow(make, _row(_KIND))


def _merge(d: DataFrame, features: Sequence[str], edges: list[np.ndarray], base: np.ndarray, loss: str) -> DataFrame:
    """The binned rows of a smooth loss, those in the same bins as one. Bins travel as longs, eight features each."""
    count = len(features)
    keys = [f"__k{i}" for i in range(-(-count // 8))]

    def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
            wide = np.zeros((len(x), 8 * len(keys)), np.uint8)
            wide[:, :count] = _binned(x, edges)
            yield pa.RecordBatch.from_arrays([*[pa.array(k) for k in wide.view("<i8").T.copy()], *[b.column(c) for c in ("__y", "__o", "__v")]], [*keys, "__y", "__o", "__v"])

    rows = d.mapInArrow(bin_, ", ".join([*[f"{k} long" for k in keys], "__y double, __o double, __v boolean"]))
    y, o, n = F.col("__y"), F.col("__o"), F.count("*").cast("double")
    own = F.sum(F.when(y > 0, y * (F.ln(y) - o)).otherwise(0.0)) if loss == "poisson" else F.var_pop(y) * n
    # counts below 0 stay apart: their deviance has no logarithm
    sums = rows.groupBy(*keys, "__v", (y < 0).alias("__low")).agg(F.sum(y).alias("__y"), F.ln(F.sum(F.exp(o))).alias("__o"), n.alias("__n"), own.alias("__c"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y, o, v, n, c = (b.column(x).to_numpy(zero_copy_only=False) for x in ("__y", "__o", "__v", "__n", "__c"))
                wide = np.stack([b.column(k).to_numpy() for k in keys], axis=1).astype("<i8").view(np.uint8)
                yield _packed(wide[:, :count], y, o, v, np.tile(base, (b.num_rows, 1)), n, c)

    return sums.mapInArrow(pack, _row(_MERGED))


def _cells(table: DataFrame, loss: str, levels: np.ndarray, trees: list[Tree], tree: Tree, depth: int, width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, deviances): (3, model, node, feature, bin) of gradient, curvature and rows, and (2, model) deviance and rows by kind of row."""
    models, nodes = tree.leaf.shape[0], 2**depth

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, models, count, nodes * width))
        dev = np.zeros((2, models, 2))
        for bins, y, o, held, f, *merged in _arrays(batches, count):
            g, h, loss_of = _slopes(loss, y, o, _raised(f, trees, bins), levels, *merged)
            n = merged[0] if merged else np.ones(len(y))
            for kind in (0, 1):
                own = held == bool(kind)
                dev[kind, :, 0] += loss_of[own].sum(axis=0)
                dev[kind, :, 1] += n[own].sum()
            use = ~held
            bins, g, h, n = bins[use], g[use], h[use], n[use]
            for m in range(models):
                at = tree.node(m, bins, depth) * width
                for k in range(count):
                    cell = at + bins[:, k]
                    for i, w in enumerate((g[:, m], h[:, m], n)):
                        total[i, m, k] += np.bincount(cell, w, nodes * width)
        m, k, cell = np.nonzero(total[2])
        cols = [m, cell // width, k, cell % width, *total[:, m, k, cell]]
        kinds = [(i, j) for i in (0, 1) for j in range(models)]
        tail = [[j for _, j in kinds], [-1 - i for i, _ in kinds], [0] * len(kinds), [0] * len(kinds), [dev[i, j, 0] for i, j in kinds], [0.0] * len(kinds), [dev[i, j, 1] for i, j in kinds]]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b]), t, safe=False) for a, b, t in zip(cols, tail, types, strict=True)], ["model", "node", "feature", "bin", "g", "h", "n"])

    got = table.mapInArrow(add, _CELL).groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
    sums, dev = np.zeros((3, models, nodes, count, width)), np.zeros((2, models, 2))
    for node, own in got.groupby(got["node"] < 0):
        m, n, k, b = (own[c].to_numpy() for c in ("model", "node", "feature", "bin"))
        if node:
            dev[-1 - n, m, 0], dev[-1 - n, m, 1] = own["g"], own["n"]
        else:
            for i, c in enumerate(("g", "h", "n")):
                sums[i, m, n, k, b] = own[c]
    return sums, dev


def _split(sums: np.ndarray, least: int, l2: float) -> tuple[np.ndarray, ...]:
    """(feature, cut, (left, right) sums) of each model's and node's best split; cut 255 where none gains."""
    left = np.cumsum(sums, axis=-1)
    whole = left[:, :, :, :1, -1:]
    right = left[..., -1:] - left
    power = lambda s: s[0] ** 2 / (s[1] + l2)
    gain = power(left) + power(right) - power(whole)
    gain = np.where((left[2] >= least) & (right[2] >= least), gain, -np.inf)
    flat = gain.reshape(*gain.shape[:2], -1)
    best = flat.argmax(axis=-1)
    feature, cut = np.divmod(best, sums.shape[-1])
    ok = np.take_along_axis(flat, best[..., None], -1)[..., 0] > 1e-9
    m, n = np.indices(best.shape)
    low = np.where(ok, left[:, m, n, feature, cut], whole[:, :, :, 0, 0])
    return np.where(ok, feature, 0), np.where(ok, cut, 255), np.stack([low, np.where(ok, right[:, m, n, feature, cut], 0.0)], axis=-1)


def _leaf_quantiles(table: DataFrame, levels: list[float], trees: list[Tree], tree: Tree, depth: int, count: int) -> np.ndarray:
    """(model, leaf): the level's quantile of the residuals in each leaf."""
    models = len(levels)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, y, _, held, f in _arrays(batches, count):
            rest = (y[:, None] - _raised(f, trees, bins))[~held]
            bins = bins[~held]
            for m in range(models):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), m), pa.int32()), pa.array(tree.node(m, bins, depth), pa.int32()), pa.array(rest[:, m])], ["model", "leaf", "r"])

    own = table.mapInArrow(residuals, "model int, leaf int, r double").groupBy("model", "leaf").agg(F.percentile_approx("r", [float(x) for x in levels], 2000).alias("q"))
    out = np.zeros((models, 2**depth))
    for r in own.collect():
        out[r["model"], r["leaf"]] = r["q"][r["model"]]
    return out


def fit(train: DataFrame, y: str, features: Sequence[str], loss: str = "squared", levels: Sequence[float] = (), exposure: str | None = None, valid: Column | None = None, rounds: int = 60, depth: int = 3, bins: int = 32, rate: float = 0.1, patience: int = 5, least: int = 20, l2: float = 1.0) -> Boosted:
    """A boosted model of y. loss: squared, poisson (with log exposure as offset) or quantile (one model for each of `levels`).

    valid: which rows only decide how many rounds stay. Rows without y, or without positive exposure where one is named, are
    left out. A table without rows to train on raises ValueError.
    """
    if loss not in ("squared", "poisson", "quantile") or (loss == "quantile") != bool(levels) or not 1 < bins < 254:
        raise ValueError("loss is squared, poisson or quantile; only quantile has levels; 2 to 253 bins")
    features, levels = list(features), [float(x) for x in levels]
    o = F.ln(F.col(exposure).cast("double")) if exposure and loss == "poisson" else F.lit(0.0)
    d = train.where(F.col(y).isNotNull())
    if exposure:
        d = d.where(F.col(exposure) > 0)
    held = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(False)
    d = d.select(F.col(y).cast("double").alias("__y"), o.alias("__o"), held.alias("__v"), *[F.col(c).cast("double").alias(c) for c in features])
    some = [F.percentile_approx(c, [i / bins for i in range(1, bins)], 1000).alias(c) for c in features]
    first = F.percentile_approx("__y", levels, 2000) if levels else (F.ln(F.sum("__y") / F.sum(F.exp("__o"))) if loss == "poisson" else F.avg("__y"))
    facts = d.where("NOT __v").agg(*some, first.alias("__b"), F.count("*").alias("__n")).first()
    if not facts["__n"]:
        raise ValueError("no rows to train on")
    edges = [np.unique(np.array(facts[c] or [], float)) for c in features]
    base = np.atleast_1d(np.array(facts["__b"] if facts["__b"] is not None else -20.0, float))
    model = Boosted(loss, features, edges, levels, base)
    many, tau = len(base), np.array(levels or [0.5])
    binned = _prepare(d, features, edges, base) if loss == "quantile" else _merge(d, features, edges, base, loss)
    table, pending, width = staged(binned, "boosting"), [], max(len(e) for e in edges) + 2
    best, stop = 0, False
    for done in range(rounds + 1):
        tree = Tree(np.zeros((many, 2**depth - 1), np.int64), np.full((many, 2**depth - 1), 255, np.int64), np.zeros((many, 2**depth)))
        for level in range(depth):
            sums, dev = _cells(table, loss, tau, pending, tree, level, width, len(features))
            if not level:
                kind = dev[1] if dev[1, :, 1].any() else dev[0]
                model.deviance.append(float(kind[:, 0].sum() / kind[0, 1]))
                best = int(np.argmin(model.deviance))
                stop = done == rounds or done - best >= patience
                if stop:
                    break
            feature, cut, halves = _split(sums, least, l2)
            own = slice(2**level - 1, 2 ** (level + 1) - 1)
            tree.feature[:, own], tree.cut[:, own] = feature, cut
        if stop:
            break
        if loss == "quantile":
            leaf = _leaf_quantiles(table, levels, pending, tree, depth, len(features))
        else:
            leaf = (-halves[0] / (halves[1] + l2)).reshape(many, -1)
        tree.leaf = rate * np.where(np.isfinite(leaf), leaf, 0.0)
        model.trees.append(tree)
        pending.append(tree)
        if len(pending) == REFRESH:
            table, pending = staged(_updated(table, pending, len(features)), "boosting"), []
    model.trees = model.trees[:best]
    return model


def _updated(table: DataFrame, trees: list[Tree], count: int) -> DataFrame:
    trees = list(trees)

    def raise_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, y, o, v, f, *merged in _arrays(batches, count):
            yield _packed(bins, y, o, v, _raised(f, trees, bins), *merged)

    return table.mapInArrow(raise_, table.schema)
