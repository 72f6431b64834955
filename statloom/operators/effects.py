"""Effects of a catalogue of variables on several statistics: fixed-effects regressions, all in two passes.

A variable is a specification: which column, numeric, binary or categorical, against which reference level
or summing to zero, which controls it replaces. A pair of variable and statistic is a block: its own
regressors, its own complete rows. One pass adds up every block's cross products within subjects, a second one
the outer products of the subjects' score vectors at the found coefficients, so that errors are clustered by
subject. Rows are dealt by subject once, not at all where a window by subject has done so, and written as compressed arrays of whole
subjects, which all that follows reads; a subject with very many rows is cut into parts whose moments are added up first. What reaches
the driver is one matrix a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import normal_cdf
from ..session import staged

#: Rows of one subject from which it is cut into parts, and rows of an array operation.
HOT, BLOCK = 200_000, 1 << 13
#: Most levels of a categorical variable.
MOST_LEVELS = 500


@dataclass(frozen=True)
class Variable:
    """kind: numeric, binary or categorical. reference: the omitted level (the most frequent one where it doesn't occur).

    coding sum: levels are measured against their mean, not against one of them. replaces: controls that go when it is studied.
    individual: known only for rows with one named opponent.
    """

    name: str
    column: str
    kind: str = "numeric"
    unit: str = ""
    reference: str | None = None
    coding: str = "dummy"
    replaces: tuple[str, ...] = ()
    individual: bool = False


# Names, kinds, reference levels and replaced controls of the variables that users ask for.
CATALOGUE = {
    v.name: v
    for v in (
        Variable("home_away", "is_home", "binary", "at home against away", replaces=("is_home",)),
        Variable("back_to_back", "is_back_to_back", "binary", "second day in a row against other days", replaces=("rest_days",)),
        Variable("rest_days", "rest_days", unit="a day of rest more, up to three", replaces=("rest_days",)),
        Variable("rest_bucket", "rest_bucket", "categorical", "against one day of rest", "1", replaces=("rest_days",)),
        Variable("day_of_week", "day_name", "categorical", "against Wednesday", "Wednesday"),
        Variable("month", "month", "categorical", "against January", "01"),
        Variable("week_of_season", "week", unit="a week later in the season"),
        Variable("playoffs", "is_playoff", "binary", "playoffs against other games"),
        Variable("defender_height", "defender_height", unit="an inch of the defender's height", replaces=("opponent_height",), individual=True),
        Variable("defender_weight", "defender_weight", unit="ten pounds of the defender's weight", replaces=("opponent_height",), individual=True),
        Variable("defender_position", "defender_position", "categorical", "against guards as defenders", "G", replaces=("opponent_height",), individual=True),
        Variable("opponent_def_rating", "opponent_rating", unit="a point of the opponent's rating", replaces=("opponent_rating",)),
        Variable("opponent_pace", "opponent_pace", unit="a possession of the opponent's pace"),
        Variable("minutes", "minutes", unit="a minute more", replaces=("minutes",)),
        Variable("starter", "is_starter", "binary", "started against came in later"),
        Variable("age", "age", unit="a year older"),
        Variable("venue", "venue", "categorical", "against the mean of all venues", coding="sum"),
        Variable("altitude", "altitude", unit="a thousand feet of elevation"),
        Variable("denver", "is_highest", "binary", "at the highest venue against elsewhere"),
    )
}
#: Other names that a variable goes by.
ALSO = {"home": "home_away", "b2b": "back_to_back", "defender_height_bucket": "defender_height", "defender_weight_bucket": "defender_weight"}
PLAYER_CONTROLS = ("minutes", "is_home", "rest_days", "opponent_rating", "opponent_height")
TEAM_CONTROLS = ("is_home", "rest_days", "opponent_rating")
REST_CAP = 3
# (end of the fixed values)


def variable(name: str, catalogue: Mapping[str, Variable] = CATALOGUE) -> Variable:
    """The variable of a name or another name for it; ValueError where there is none."""
    found = catalogue.get(ALSO.get(name, name))
    if found is None:
        raise ValueError(f"unknown variable {name!r}; known: {', '.join(sorted(catalogue))}")
    return found


def rest_columns(rest: Column) -> dict[str, Column]:
    """rest_days (capped), rest_bucket and is_back_to_back of a number of days since the row before; null where it is."""
    capped = F.when(rest.isNotNull(), F.least(rest.cast("double"), F.lit(float(REST_CAP))))
    bucket = F.when(capped >= REST_CAP, f"{REST_CAP}+").when(capped.isNotNull(), capped.cast("int").cast("string"))
    return {"rest_days": capped, "rest_bucket": bucket, "is_back_to_back": (rest <= 1).cast("double")}


@dataclass(frozen=True)
class Terms:
    """A variable's regressors: names, and for a categorical one its levels, the omitted one last."""

    of: Variable
    names: tuple[str, ...]
    levels: tuple[str, ...] = ()

    @property
    def omitted(self) -> str | None:
        return self.levels[-1] if self.levels else None

    def matrix(self, x: np.ndarray) -> np.ndarray:
        """(rows, terms) of the column's values, for a categorical variable the places of its levels in sorted order; NaN stays NaN."""
        if not self.levels:
            return x[:, None]
        place = {level: float(i) for i, level in enumerate(sorted(self.levels))}
        out = (x[:, None] == np.array([place[level] for level in self.levels[:-1]])[None, :]).astype(float)
        if self.of.coding == "sum":
            out[x == place[self.levels[-1]]] = -1.0
        out[np.isnan(x)] = np.nan
        return out

    def columns(self) -> list[Column]:
        """The same regressors as columns of a table."""
        own = F.col(self.of.column)
        if not self.levels:
            return [own.cast("double").alias(self.names[0])]
        rest = F.when(own == self.omitted, -1.0 if self.of.coding == "sum" else 0.0).when(own.isNotNull(), 0.0)
        return [F.when(own == level, 1.0).otherwise(rest).alias(name) for name, level in zip(self.names, self.levels, strict=False)]


def compile_terms(df: DataFrame, variables: Sequence[Variable]) -> dict[str, Terms]:
    """The regressors of each variable, from the levels that the table has: one aggregate for all, a row a level."""
    names = [v for v in variables if v.kind == "categorical"]
    found: dict[str, list[tuple[str, int]]] = {v.name: [] for v in names}
    if names:
        pairs = F.explode(F.array(*[F.struct(F.lit(v.name).alias("v"), F.col(v.column).cast("string").alias("x")) for v in names]))
        for r in df.select(pairs.alias("p")).where("p.x IS NOT NULL").groupBy("p.v", "p.x").count().limit(MOST_LEVELS * len(names) + 1).collect():
            found[r["v"]].append((r["x"], r["count"]))
    return _compiled(variables, found)


def _compiled(variables: Sequence[Variable], found: Mapping[str, list[tuple[str, int]]]) -> dict[str, Terms]:
    """The regressors of each variable; found: a categorical one's levels and how often each occurs."""
    out = {}
    for v in variables:
        if v.kind != "categorical":
            out[v.name] = Terms(v, (v.name,))
            continue
        levels = sorted(found[v.name])
        if not 1 <= len(levels) <= MOST_LEVELS:
            raise ValueError(f"{v.name} has {len(levels)} levels; 1 to {MOST_LEVELS} are supported")
        every = [x for x, _ in levels]
        omitted = every[-1] if v.coding == "sum" else v.reference if v.reference in every else min(levels, key=lambda x: (-x[1], x[0]))[0]
        kept = [x for x in every if x != omitted]
        out[v.name] = Terms(v, tuple(f"{v.name}={x}" for x in kept), (*kept, omitted))
    return out


@dataclass(frozen=True)
class _Block:
    """Which of a row's numbers a variable takes: its own, the controls', the statistics'."""

    terms: Terms
    at: int
    controls: tuple[int, ...]
    ys: tuple[int, ...]

    @property
    def wide(self) -> int:
        return len(self.terms.names) + len(self.controls)

    def designs(self, z: np.ndarray, nan: np.ndarray) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(statistics with the same complete rows, these rows, their regressors and last the statistics); z is column by column."""
        known, same = ~nan[[self.at, *self.controls]].any(axis=0), {}
        for j, y in enumerate(self.ys):
            same.setdefault((known & ~nan[y]).tobytes(), []).append(j)
        for key, js in same.items():
            full = np.frombuffer(key, bool)
            if full.any():
                yield js, full, np.concatenate([self.terms.matrix(z[self.at][full]), z[[*self.controls, *[self.ys[j] for j in js]]][:, full].T], axis=1)


def _runs(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[tuple[pa.Table, str | None]]:
    """(rows of whole subjects, None), at least BLOCK at a time, or (some rows of a subject with more than `hot`, its key), from batches in order of g."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(whole: pa.Table, end: bool) -> Iterator[tuple[pa.Table, str | None]]:
        g = whole.column("g").to_pandas().to_numpy()
        heads = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        large = whole.column("n").to_numpy()[heads] > hot
        done = 0
        for k in np.flatnonzero(large):
            head, tail = int(heads[k]), int(heads[k + 1]) if k + 1 < len(heads) else len(g)
            if head > done:
                yield whole.slice(done, head - done), None
            yield whole.slice(head, tail - head), str(g[head])
            done = tail
        last = len(g) if end else max(done, int(heads[-1]))
        if last > done:
            yield whole.slice(done, last - done), None
        held[:] = whole.slice(last).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= BLOCK:
            yield from cut(pa.Table.from_batches(held).combine_chunks(), False)
            size = sum(b.num_rows for b in held)
    if size:
        yield from cut(pa.Table.from_batches(held).combine_chunks(), True)


_PACKS = "z binary, rows long, first array<long>, g string, nulls array<long>, levels array<struct<at: int, x: string, n: long>>"


def _packs(df: DataFrame, group: Column, cols: Sequence[Column], hot: int) -> DataFrame:
    """Arrays of whole subjects, column by column as such bytes shrink well, and the first row of each; of a subject with more than `hot` rows
    parts with its key. Strings are numbered within an array, whose levels go with it; so do its columns' numbers of nulls."""
    rows = df.select(group.alias("g"), *[c.alias(f"c{i}") for i, c in enumerate(cols)])
    width = len(cols)
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("g")))  # deals rows by subject, unless they lie so already

    def number(x: pa.Array) -> tuple[np.ndarray, list, list]:
        if not pa.types.is_string(x.type) and not pa.types.is_large_string(x.type):
            return x.to_numpy(zero_copy_only=False).astype(float), [], []
        x = x.dictionary_encode()
        codes = x.indices.to_numpy(zero_copy_only=False).astype(float)
        return codes, x.dictionary.to_pylist(), np.bincount(codes[~np.isnan(codes)].astype(int), minlength=len(x.dictionary)).tolist()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("z", pa.binary()), ("rows", pa.int64()), ("first", pa.list_(pa.int64())), ("g", pa.string()), ("nulls", pa.list_(pa.int64())), ("levels", pa.list_(pa.struct([("at", pa.int32()), ("x", pa.string()), ("n", pa.int64())])))])
        for t, key in _runs(batches, hot):
            g = t.column("g").to_pandas().to_numpy()
            own = [t.column(f"c{i}").combine_chunks() for i in range(width)]
            own = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in own]
            made = [number(x) for x in own]
            z = pa.compress(np.stack([x for x, _, _ in made]).tobytes(), "zstd", asbytes=True)
            levels = [{"at": i, "x": x, "n": n} for i, (_, names, counts) in enumerate(made) for x, n in zip(names, counts, strict=True)]
            yield pa.RecordBatch.from_pylist([{"z": z, "rows": len(g), "first": np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))).tolist(), "g": key, "nulls": [x.null_count for x in own], "levels": levels}], schema)

    return staged(rows.mapInArrow(pack, _PACKS), "packs", large=True)


def _unpacked(batches: Iterator[pa.RecordBatch], width: int, places: Mapping[int, Mapping[str, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, str | None]]:
    """(columns of rows, subject of each row, numbered from 0, key of the subject that this is a part of) of every written array.

    places: for a column of levels where each stands among all of them.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            first = batch.column("first")[i].values.to_numpy()
            packed = pa.CompressedInputStream(pa.BufferReader(batch.column("z")[i].as_buffer()), "zstd")
            z = np.frombuffer(packed.read(), float).reshape(width, -1).copy()
            local: dict[int, list[float]] = {at: [] for at in places}
            for level in batch.column("levels")[i].as_py():
                local[level["at"]].append(float(places[level["at"]][level["x"]]))
            for at, to in local.items():
                z[at] = np.array([*to, np.nan])[np.where(np.isnan(z[at]), len(to), z[at]).astype(int)]
            owner = np.zeros(z.shape[1], np.int64)
            owner[first[1:]] = 1
            yield z, np.cumsum(owner), batch.column("g")[i].as_py()


def _within(d: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows less their subject's mean, first rows, rows kept) of the subjects with two rows or more; owner is sorted."""
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    n = np.diff(np.append(first, len(owner)))
    keep = np.repeat(n > 1, n)
    d, n = d[keep], n[n > 1]
    first = np.cumsum(n) - n
    mean = np.add.reduceat(d, first, axis=0) / n[:, None] if len(n) else np.zeros((0, d.shape[1]))
    return d - np.repeat(mean, n, axis=0), first, d


def _packed(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x.ravel().tolist() for _, x in rows], pa.list_(pa.float64()))], ["block", "m"])


def _added(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, m): arrays added up element by element."""
    cell = parts.select(*keys, F.posexplode("m").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    return cell.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))


def _sums(packs: DataFrame, hot: DataFrame | None, blocks: list[_Block], width: int, places: Mapping[int, Mapping[str, int]], betas: list[np.ndarray] | None) -> list[np.ndarray]:
    """Each block's and statistic's total over subjects. Without betas: within cross products, then rows, subjects and sum of y; with: outer products of scores."""
    stats = len(blocks[0].ys)
    shapes = [b.wide + 1 for b in blocks for _ in range(stats)]

    def closed(k: int, inner: np.ndarray, n: int, y: float) -> np.ndarray:
        """A subject's share from its within cross products."""
        if betas is None:
            return np.concatenate([inner.ravel(), [n, 1, y]])
        s = inner[:-1, -1] - inner[:-1, :-1] @ betas[k]
        return np.outer(s, s).ravel()

    def zeros() -> list[np.ndarray]:
        return [np.zeros(p**2 + 3 if betas is None else (p - 1) ** 2) for p in shapes]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = zeros()
        for z, owner, _ in _unpacked(batches, width, places):
            nan = np.isnan(z)
            for k, b in enumerate(blocks):
                for js, full, d in b.designs(z, nan):
                    w, heads, kept = _within(d, owner[full])
                    if not len(w):
                        continue
                    x, gram = w[:, : b.wide], w.T @ w if betas is None else None
                    for i, j in enumerate(js, b.wide):
                        at = k * stats + j
                        if betas is None:
                            own = [*range(b.wide), i]
                            total[at] += np.concatenate([gram[np.ix_(own, own)].ravel(), [len(w), len(heads), kept[:, i].sum()]])
                        else:
                            s = np.add.reduceat(x * (w[:, i] - x @ betas[at])[:, None], heads, axis=0)
                            total[at] += (s.T @ s).ravel()
        yield _packed(list(enumerate(total)))

    parts = packs.where("g IS NULL").mapInArrow(fold, "block int, m array<double>")
    if hot is not None:

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = zeros()
            for batch in batches:
                for k, m in zip(batch.column("block").to_pylist(), batch.column("m").to_pylist(), strict=True):
                    p = shapes[k] + 1
                    m = np.array(m).reshape(p, p)
                    n = m[0, 0]
                    if n > 1:
                        total[k] += closed(k, m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / n, int(n), m[0, -1])
            yield _packed(list(enumerate(total)))

        parts = parts.unionByName(hot.select("block", "m").mapInArrow(close, "block int, m array<double>"))
    found = {r["block"]: np.array(r["m"]) for r in _added(parts, "block").collect()}
    return [found.get(k, x) for k, x in enumerate(zeros())]


def _moments(packs: DataFrame, blocks: list[_Block], width: int, places: Mapping[int, Mapping[str, int]]) -> DataFrame:
    """(g, block, m): sums of 1, regressors and statistic, and of their products, of the subjects that are cut into parts."""
    stats = len(blocks[0].ys)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give() -> pa.RecordBatch:
            made = _packed(list(total.items()))
            return pa.RecordBatch.from_arrays([pa.array([of] * len(total), pa.string()), *made.columns], ["g", "block", "m"])

        of, total = None, {}
        for z, _, g in _unpacked(batches, width, places):
            if total and g != of:  # the parts of a subject were written one after the other
                yield give()
                total = {}
            of, nan = g, np.isnan(z)
            for k, b in enumerate(blocks):
                for js, _, d in b.designs(z, nan):
                    d = np.concatenate([np.ones((len(d), 1)), d], axis=1)
                    gram = d.T @ d
                    for i, j in enumerate(js, b.wide + 1):
                        own = [*range(b.wide + 1), i]
                        total[k * stats + j] = total.get(k * stats + j, 0) + gram[np.ix_(own, own)]
        if total:
            yield give()

    return _added(packs.where("g IS NOT NULL").mapInArrow(part, "g string, block int, m array<double>"), "g", "block")


def effects(df: DataFrame, group: str, stats: Sequence[str], variables: Sequence[Variable] = tuple(CATALOGUE.values()), controls: Sequence[str] = PLAYER_CONTROLS, level: float = 0.95, most_missing: float = 0.2, hot: int = HOT) -> pd.DataFrame:
    """A row a variable, statistic and term: coef, se, low, high, p, own (a term of the variable, not a control), n, groups, r2, mean.

    Controls missing in more than `most_missing` of all rows are dropped; a row takes part in a block if it has all its
    numbers, a subject if it has two such rows. Terms that never vary within a subject give no row. With sum coding the
    omitted level's row is added. Intervals and p values are normal. Rows without group are left out.
    """
    base = list(dict.fromkeys([*controls, *[v.column for v in variables]]))
    coded = {v.column for v in variables if v.kind == "categorical"}
    cols = [*[F.col(c).cast("string" if c in coded else "double") for c in base], *[F.col(s).cast("double") for s in stats]]
    at = {c: i for i, c in enumerate(base)}
    packs = _packs(df.where(F.col(group).isNotNull()), F.col(group), cols, hot)
    missing = packs.agg(F.sum("rows").alias("all"), *[F.sum(F.col("nulls")[at[c]]).alias(f"c{at[c]}") for c in controls]).first()
    controls = [c for c in controls if (missing[f"c{at[c]}"] or 0) <= most_missing * (missing["all"] or 0)]
    levels: dict[int, list[tuple[str, int]]] = {at[c]: [] for c in coded}
    for r in packs.select(F.inline("levels")).groupBy("at", "x").agg(F.sum("n").alias("n")).limit(MOST_LEVELS * len(coded) + 1).collect():
        levels[r["at"]].append((r["x"], r["n"]))
    terms = _compiled(variables, {v.name: levels[at[v.column]] for v in variables if v.column in coded})
    places = {c: {x: i for i, (x, _) in enumerate(sorted(found))} for c, found in levels.items()}
    blocks, names = [], []
    for v in variables:
        own = [c for c in controls if c not in v.replaces and c != v.column]
        blocks.append(_Block(terms[v.name], at[v.column], tuple(at[c] for c in own), tuple(range(len(base), len(cols)))))
        names += [(blocks[-1], v, s, [*terms[v.name].names, *own]) for s in stats]
    cut = None
    if not packs.where("g IS NOT NULL").isEmpty():  # a subject in parts
        cut = staged(_moments(packs, blocks, len(cols), places), "moments")
    gram = _sums(packs, cut, blocks, len(cols), places, None)
    solved = [_solve(b, m) for (b, *_), m in zip(names, gram, strict=True)]
    meat = _sums(packs, cut, blocks, len(cols), places, [s[0] for s in solved])
    wide = NormalDist().inv_cdf(0.5 + level / 2)
    out = []
    for (b, v, stat, term), (beta, inverse, varies, n, g, r2, mean), m in zip(names, solved, meat, strict=True):
        k = int(varies.sum())
        factor = g / max(1, g - 1) * (n - 1) / max(1, n - k)
        cov = factor * inverse @ m.reshape(len(beta), len(beta)) @ inverse
        found = [(t, beta[i], cov[i, i], i < len(b.terms.names)) for i, t in enumerate(term) if varies[i]]
        if v.coding == "sum" and b.terms.levels:
            own = [i for i in range(len(b.terms.names)) if varies[i]]
            found.insert(len(own), (f"{v.name}={b.terms.omitted}", -beta[own].sum(), cov[np.ix_(own, own)].sum(), True))
        for t, coef, var, is_own in found:
            se = float(np.sqrt(max(0.0, var)))
            p = float(2 * normal_cdf(np.array([-abs(coef / se)]))[0]) if se > 0 else None
            out.append((v.name, stat, t, float(coef), se, float(coef - wide * se), float(coef + wide * se), p, bool(is_own), n, g, r2, mean))
    return pd.DataFrame(out, columns=["variable", "stat", "term", "coef", "se", "low", "high", "p", "own", "n", "groups", "r2", "mean"])


SCHEMA = "variable string, stat string, term string, coef double, se double, low double, high double, p double, own boolean, n long, groups long, r2 double, mean double"


def _solve(b: _Block, m: np.ndarray) -> tuple:
    """(coefficients, inverse of the cross products, which terms vary, rows, subjects, r2 within, mean)."""
    p = len(b.terms.names) + len(b.controls) + 1
    inner, (n, g, y) = m[: p * p].reshape(p, p), m[p * p :]
    a, c = inner[:-1, :-1], inner[:-1, -1]
    varies = np.diag(a) > 1e-12 * max(1.0, n)
    inverse = np.zeros_like(a)
    at = np.ix_(varies, varies)
    scale = np.sqrt(np.diag(a)[varies])
    inverse[at] = np.linalg.pinv(a[at] / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    beta = inverse @ c
    rest = inner[-1, -1] - 2 * beta @ c + beta @ a @ beta
    return beta, inverse, varies, int(n), int(g), float(1 - rest / inner[-1, -1]) if inner[-1, -1] > 0 else None, float(y / n) if n else None
