"""Boosting, effect catalogue, copula, projections and special functions: planted and known answers."""

import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from statloom import session
from statloom.functions import special
from statloom.operators import boosting, copula, effects, models, projection
from statloom.operators import distributions as dist


# ---- special functions


def test_tails_and_quantiles_on_the_jvm(spark):
    rows = [(float(t), float(d)) for t in (0, 1e-3, 0.5, -1.631555, 2.1, 12.7062047364, 50, 400) for d in (1, 2, 4.678526, 30, 300, 5000)] + [(None, 2.0)]
    out = spark.createDataFrame(rows, "t double, d double").select("t", "d", special.t_pvalue_column(F.col("t"), F.col("d")).alias("p"), special.lgamma(F.col("d")).alias("g"), special.normal_pvalue_column(F.col("t") / 4).alias("n"))
    assert not out.where("p IS NOT NULL OR n IS NOT NULL").isEmpty()
    for r in out.collect():
        if r["t"] is None:
            assert r["p"] is None and r["n"] is None
            continue
        assert r["p"] == pytest.approx(special.t_two_sided(np.array([r["t"]]), np.array([r["d"]]))[0], abs=1e-9)
        assert r["g"] == pytest.approx(math.lgamma(r["d"]), abs=1e-9)
        assert r["n"] == pytest.approx(math.erfc(abs(r["t"]) / 4 / math.sqrt(2)), rel=1e-9, abs=1e-12)
    q = spark.createDataFrame([(1.0, 12.7062047364), (5.0, 2.57058183661), (30.0, 2.04227245630), (None, None)], "d double, q double").select("q", special.t_quantile_column(0.95, F.col("d")).alias("got"))
    assert all(r["got"] == (None if r["q"] is None else pytest.approx(r["q"], abs=1e-7)) for r in q.collect())
    x = spark.createDataFrame([(3.841458820694124, 1.0, 0.05), (18.307038053275146, 10.0, 0.05), (0.0, 3.0, 1.0)], "x double, d double, p double")
    assert all(r["got"] == pytest.approx(r["p"], abs=1e-9) for r in x.select("p", special.chi_square_tail(F.col("x"), F.col("d")).alias("got")).collect())
    n = spark.createDataFrame([(p,) for p in (1e-9, 1e-4, 0.02425, 0.3, 0.5, 0.77, 0.999999)], "p double").select("p", special.normal_quantile_column(F.col("p")).alias("z"))
    assert all(r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-6) for r in n.collect())


def test_tails_need_no_python_worker(spark):
    d = spark.createDataFrame([(1.0, 2.0)], "t double, d double").select(special.t_pvalue_column(F.col("t"), F.col("d")), special.normal_pvalue_column(F.col("t")), special.t_quantile_column(0.9, F.col("d")), special.normal_quantile_column(F.col("t") / 3))
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()


# ---- boosting


@pytest.fixture(scope="module")
def world(spark):
    """Counts whose rate has an interaction, and a value whose spread grows; a feature has nulls."""
    r = np.random.default_rng(1)
    n = 5000
    x, k, e = r.uniform(0, 4, n), r.integers(0, 2, n).astype(float), r.uniform(5, 40, n)
    rate = np.exp(-2.0 + 0.6 * ((x > 2) & (k > 0)) - 0.9 * ((x < 1) & (k < 1)))
    rows = pd.DataFrame({"id": np.arange(n), "x": np.where(np.arange(n) % 19 == 0, np.nan, x), "k": k, "e": e, "y": r.poisson(rate * e).astype(float), "v": x + (0.5 + x) * r.normal(size=n)})
    df = spark.createDataFrame(rows).withColumn("x", F.nanvl("x", F.lit(None).cast("double"))).repartition(3).cache()
    return df.where("id % 5 <> 0"), df.where("id % 5 = 0")


def test_boosted_counts_beat_the_linear_model_on_an_interaction(world):
    train, test = world
    model = models.boosted_rate(train, "y", ["x", "k"], "e", valid=F.col("id") % 5 == 1, rounds=25, rate=0.2, patience=4)
    assert 3 <= model.rounds == int(np.argmin(model.deviance)) and model.deviance[model.rounds] < 0.9 * model.deviance[0]
    boosted = models.predict_boosted(model, test, "e").agg(models.mean_deviance(F.col("y"), F.col("expected"))).first()[0]
    glm = models.predict_rate(models.poisson_rate(train, "y", ["x", "k"], "e"), test, "e").agg(models.mean_deviance(F.col("y"), F.col("expected"))).first()[0]
    assert boosted < 0.95 * glm
    total = models.predict_boosted(model, test, "e").agg(F.sum("expected") / F.sum("y")).first()[0]
    assert total == pytest.approx(1, abs=0.05)


def test_boosted_quantiles_cover(world):
    train, test = world
    levels = [0.05, 0.5, 0.95]
    model = models.boosted_quantiles(train, "v", ["x", "k"], levels, valid=F.col("id") % 5 == 1, rounds=20, rate=0.25, patience=4)
    out = test.withColumn("q", model.column()).withColumn("in", ((F.col("v") > F.col("q")[0]) & (F.col("v") < F.col("q")[2])).cast("int")).collect()
    assert all(r["q"] == sorted(r["q"]) for r in out)
    assert np.mean([r["in"] for r in out]) == pytest.approx(0.9, abs=0.03)
    for low in (True, False):  # the spread grows threefold from one side to the other
        assert np.mean([r["in"] for r in out if r["x"] is not None and (r["x"] < 2) == low]) == pytest.approx(0.9, abs=0.05)
    loss = lambda q: np.mean([max(t * (r["v"] - x), (t - 1) * (r["v"] - x)) for r in out for t, x in zip(levels, q(r), strict=True)])
    flat = np.quantile([r["v"] for r in train.collect()], levels)
    assert loss(lambda r: r["q"]) < 0.9 * loss(lambda r: flat)


def test_boosting_without_signal_or_rows(spark):
    d = spark.createDataFrame([(float(i % 3), None if i % 2 else 1.0, float(i % 5)) for i in range(60)], "x double, nothing double, y double")
    model = boosting.fit(d, "y", ["nothing"], rounds=3)
    assert d.select(model.column().alias("p")).distinct().count() <= 2
    with pytest.raises(ValueError):
        boosting.fit(d.limit(0), "y", ["x"])
    with pytest.raises(ValueError):
        boosting.fit(d, "y", ["x"], loss="quantile")


@pytest.mark.parametrize("loss", ["poisson", "squared"])
def test_rows_in_the_same_bins_are_boosted_as_one(spark, monkeypatch, loss):
    """The rounds read a row for the bins in use, and their sums are those of the single rows."""
    r = np.random.default_rng(4)
    n = 3000
    rows = pd.DataFrame({"x": r.integers(0, 6, n).astype(float), "k": r.integers(0, 2, n).astype(float), "e": r.uniform(1, 9, n), "held": r.random(n) < 0.2})
    rows["y"] = r.poisson(rows["e"] * (0.2 + 0.3 * (rows["x"] > 2) * rows["k"])).astype(float)
    tables, read = [], boosting.staged
    monkeypatch.setattr(boosting, "staged", lambda df, name: tables.append(read(df, name)) or tables[-1])
    fit = lambda df, **more: boosting.fit(df, "y", ["x", "k"], loss, exposure="e" if loss == "poisson" else None, valid=F.col("held"), rounds=3, rate=0.3, **more)
    model = fit(spark.createDataFrame(rows).repartition(3))
    assert sum(len(b["y"]) // 8 for t in tables for b in t.collect()) <= 6 * 2 * 2
    x, y, o = rows[["x", "k"]].to_numpy(), rows["y"].to_numpy(), np.log(rows["e"].to_numpy())
    train, held = ~rows["held"].to_numpy(), rows["held"].to_numpy()

    def deviance(f):
        if loss == "squared":
            return np.mean((y - f)[held] ** 2)
        mu = np.exp(f + o)
        return np.mean(2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))[held])

    trees, f = model.trees, np.full(n, model.base[0])
    assert model.rounds == 3 and model.base[0] == pytest.approx(np.log(y[train].sum() / np.exp(o[train]).sum()) if loss == "poisson" else y[train].mean())
    bins = boosting._binned(x, model.edges)
    for i, tree in enumerate(trees):
        assert model.deviance[i] == pytest.approx(deviance(f), rel=1e-9)
        g, h = (np.exp(f + o) - y, np.exp(f + o)) if loss == "poisson" else (f - y, np.ones(n))
        leaf = tree.node(0, bins, 3)
        for at in np.unique(leaf[train]):
            own = train & (leaf == at)
            assert tree.leaf[0, at] == pytest.approx(-0.3 * g[own].sum() / (h[own].sum() + 1.0), rel=1e-9)
        f = f + tree.leaf[0][leaf]
    assert model.deviance[3] == pytest.approx(deviance(f), rel=1e-9)


def test_boosted_counts_on_more_features_than_a_long_holds(spark):
    """Ten features, one of which matters; counts below zero and nulls don't upset the sums."""
    rows = [(*[float((i * (k + 3)) % 7) if (i + k) % 11 else None for k in range(9)], float(i % 2), float(3 * (i % 2) + 1 - 3 * (i % 50 == 0))) for i in range(800)]
    names = [f"x{k}" for k in range(10)]
    d = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "y"])).withColumn("e", F.lit(1.0))
    model = boosting.fit(d, "y", names, "poisson", exposure="e", rounds=6, rate=0.5)
    assert {int(t.feature[0, 0]) for t in model.trees[:1]} == {9}
    own = d.groupBy("x9").agg(F.avg("y").alias("y"), F.avg(model.column()).alias("p")).collect()
    assert len(own) == 2 and all(r["p"] == pytest.approx(r["y"], abs=0.3) for r in own)


# ---- effects


def planted(seed=5):
    r = np.random.default_rng(seed)
    rows = []
    for p in range(24):
        talent = r.normal(20, 5)
        for g in range(50):
            home, minutes, rest, place = float(r.integers(0, 2)), float(r.normal(30, 6)), float(r.integers(0, 4)), "ABCD"[r.integers(0, 4)]
            y = talent + 3 * home + 0.5 * minutes + {"A": 2.0, "B": -1.0, "C": 0.0, "D": -1.0}[place] + r.normal(0, 2)
            rows.append((p, home, minutes, None if g % 10 == 0 else rest, place, None if g % 3 else 1.0, float(y), float(y * 2 + r.normal())))
    return pd.DataFrame(rows, columns=["p", "is_home", "minutes", "rest_days", "venue", "sparse", "y", "y2"])


KINDS = "p int, is_home double, minutes double, rest_days double, venue string, sparse double, y double, y2 double"
ASKED = [effects.variable("home"), effects.variable("minutes"), effects.variable("venue"), effects.Variable("place", "venue", "categorical", reference="B")]


def dense(frame, y, terms, controls):
    """The same regression with a dummy for every subject, and its clustered errors."""
    x = np.column_stack([*terms, *[frame[c].to_numpy(float) for c in controls]])
    ok = ~np.isnan(x).any(axis=1)
    g = frame["p"].to_numpy()[ok]
    full = np.column_stack([x[ok], (g[:, None] == np.unique(g)[None, :]).astype(float)])
    t = frame[y].to_numpy(float)[ok]
    beta = np.linalg.lstsq(full, t, rcond=None)[0]
    k = x.shape[1]
    w = x[ok] - np.array([x[ok][g == i].mean(axis=0) for i in g])
    u = t - full @ beta
    s = np.array([(w[g == i] * u[g == i][:, None]).sum(axis=0) for i in np.unique(g)])
    n, m = len(t), len(s)
    inv = np.linalg.inv(w.T @ w)
    return beta[:k], np.sqrt(np.diag(m / (m - 1) * (n - 1) / (n - k) * inv @ s.T @ s @ inv))


@pytest.mark.parametrize("hot", [10_000, 20])
def test_effects_equal_the_dense_regression(spark, hot):
    frame = planted()
    out = effects.effects(spark.createDataFrame([tuple(None if x != x else x for x in r) for r in frame.itertuples(index=False)], KINDS).repartition(3), "p", ["y", "y2"], ASKED, ("minutes", "is_home", "rest_days", "sparse"), hot=hot)
    assert set(out["variable"]) == {"home_away", "minutes", "venue", "place"} and "sparse" not in set(out["term"])
    codes = {"place": [(frame.venue == v).to_numpy(float) for v in "ACD"], "venue": [(frame.venue == v).to_numpy(float) - (frame.venue == "D").to_numpy(float) for v in "ABC"], "home_away": [frame.is_home.to_numpy()], "minutes": [frame.minutes.to_numpy()]}
    names = {"place": [f"place={v}" for v in "ACD"], "venue": [f"venue={v}" for v in "ABC"], "home_away": ["home_away"], "minutes": ["minutes"]}
    for v, y in itertools.product(codes, ("y", "y2")):
        controls = [c for c in ("minutes", "is_home", "rest_days") if c != {"home_away": "is_home"}.get(v, v)]
        beta, se = dense(frame, y, codes[v], controls)
        got = out[(out.variable == v) & (out.stat == y)].set_index("term")
        assert np.allclose(got.loc[[*names[v], *controls], "coef"], beta, rtol=1e-8, atol=1e-9)
        assert np.allclose(got.loc[[*names[v], *controls], "se"], se, rtol=1e-8)
    home = out[(out.term == "home_away") & (out.stat == "y")].iloc[0]
    assert home["coef"] == pytest.approx(3, abs=0.4) and home["p"] < 1e-6 and home["low"] < 3 < home["high"]
    venue = out[(out.variable == "venue") & out.own & (out.stat == "y")]
    assert len(venue) == 4 and venue["coef"].sum() == pytest.approx(0, abs=1e-9) and (venue["se"] > 0).all()


def test_effects_make_their_rows_once(spark):
    rows = [tuple(None if x != x else x for x in r) for r in planted().itertuples(index=False)]
    once, made = counted(spark, spark.createDataFrame(rows, KINDS).repartition(3))
    assert len(effects.effects(once, "p", ["y"], ASKED, ("minutes", "is_home"))) > 0
    assert made.value == len(rows)


def test_effects_deal_rows_by_subject_once(spark, monkeypatch):
    """Rows that lie by subject after a window aren't moved or sorted again, and only their arrays are written."""
    rows = [tuple(None if x != x else x for x in r) for r in planted().itertuples(index=False)]
    before = Window.partitionBy("p").orderBy("minutes")
    df = spark.createDataFrame(rows, KINDS).repartition(3).withColumn("rest_days", F.lag("rest_days").over(before))
    written, read = [], effects.staged
    monkeypatch.setattr(effects, "staged", lambda df, name, **how: written.append((name, df._jdf.queryExecution().executedPlan().toString())) or read(df, name, **how))
    assert len(effects.effects(df, "p", ["y"], ASKED, ("minutes", "is_home"))) > 0
    assert [name for name, _ in written] == ["packs"]
    assert written[0][1].count("Exchange hashpartitioning") == 1 and written[0][1].count("Sort [") == 1


def test_arrays_are_written_in_small_row_groups(spark, tmp_path, monkeypatch):
    """A hundred rows of a megabyte aren't one page or row group, which writer and reader would hold whole."""
    monkeypatch.setattr(session, "shared_folder", lambda spark, name: str(tmp_path / name))
    rows = spark.range(40).coalesce(1).mapInPandas(lambda frames: (pd.DataFrame({"z": [np.random.default_rng(i).bytes(1 << 20) for i in f.id]}) for f in frames), "z binary")
    assert session.staged(rows, "rows", large=True).count() == 40
    (file,) = (tmp_path / "rows").glob("*.parquet")
    assert pq.ParquetFile(file).num_row_groups >= 4


def test_effects_of_subjects_in_parts_and_whole(spark):
    """Subjects above `hot` beside ones below it, and levels that not every array has."""
    frame = planted()
    frame = frame[(frame.p % 3 > 0) | (frame.index % 50 < 12)]
    frame.loc[frame.p == 1, "venue"] = None
    df = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in frame.itertuples(index=False)], KINDS)
    one, parts = (effects.effects(df, "p", ["y", "y2"], ASKED, ("minutes", "is_home", "sparse"), hot=hot) for hot in (10_000, 20))
    assert set(one["variable"]) == {v.name for v in ASKED} and set(one["n"]) == {len(frame), int(frame.venue.notna().sum())}
    same = ["variable", "stat", "term", "own", "n", "groups"]
    assert one[same].equals(parts[same]) and np.allclose(one[["coef", "se", "r2", "mean"]], parts[["coef", "se", "r2", "mean"]], rtol=1e-9)


def test_effects_of_odd_tables(spark):
    none = effects.effects(spark.createDataFrame([], KINDS), "p", ["y"], ASKED[:2], ("minutes",))
    assert len(none) == 0
    one = effects.effects(spark.createDataFrame([(1, 1.0, 2.0, 1.0, "A", None, 3.0, None), (2, 0.0, 2.0, 1.0, "A", None, 3.0, None), (None, 0.0, 1.0, 1.0, "B", None, 2.0, 1.0)], KINDS), "p", ["y", "y2"], ASKED[:2], ())
    assert len(one) == 0
    with pytest.raises(ValueError):
        effects.variable("moon_phase")


def test_rest_columns(spark):
    d = spark.createDataFrame([(None,), (0,), (1,), (2,), (9,)], "r int")
    got = [tuple(r) for r in d.select(*effects.rest_columns(F.col("r")).values()).collect()]
    assert got == [(None, None, None), (0.0, "0", 1.0), (1.0, "1", 1.0), (2.0, "2", 0.0), (3.0, "3+", 0.0)]


# ---- copula


def joint(spark, weights, means, alphas, rho, conditions, **lines):
    cols = ["w", "m", "a", "r", *lines]
    df = spark.createDataFrame([(weights, means, alphas, [float(x) for row in rho for x in row], *lines.values()), (None, means, alphas, [1.0] * len(alphas) ** 2, *lines.values())], ", ".join(["w array<double>", "m array<double>", "a array<double>", "r array<double>", *[f"{c} double" for c in lines]]))
    out = copula.joint_probability(df.select(*cols), "w", "m", "a", "r", conditions).collect()
    assert [r["joint"] for r in out if r["w"] is None] == [None]
    return next(r["joint"] for r in out if r["w"] is not None)


def over(mean, alpha, line):
    r = 1 / alpha if alpha else None
    p = lambda k: math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) - r * math.log1p(alpha * mean) + k * math.log(alpha * mean / (1 + alpha * mean))) if alpha else math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
    return np.array([p(k) for k in range(300)]), 1 - sum(p(k) for k in range(math.floor(line) + 1))


C = copula.Condition


def test_joint_chances_without_dependence_are_products(spark):
    eye = np.eye(3)
    got = joint(spark, [1.0], [4.0, 6.0, 9.0], [0.0, 0.2, 0.1], eye, [C((0,), "x"), C((1,), "y"), C((2,), "z", False)], x=3.5, y=5.5, z=9.0)
    q = 1 - over(9, 0.1, 8)[1]
    assert got == pytest.approx(over(4, 0, 3.5)[1] * over(6, 0.2, 5.5)[1] * q, abs=0.006)
    # the exposure that all share makes them dependent: the mean of the nodes' products
    nodes = [(0.25, 2.0), (0.5, 4.0), (0.25, 8.0)]
    got = joint(spark, [w for w, _ in nodes], [x for _, m in nodes for x in (m, m + 1)], [0.0, 0.0], np.eye(2), [C((0,), "x"), C((1,), "y")], x=4.5, y=5.5)
    assert got == pytest.approx(sum(w * over(m, 0, 4.5)[1] * over(m + 1, 0, 5.5)[1] for w, m in nodes), abs=0.006)


def test_joint_chances_of_full_dependence_are_the_smallest(spark):
    got = joint(spark, [1.0], [4.0, 6.0], [0.0, 0.2], np.ones((2, 2)), [C((0,), "x"), C((1,), "y")], x=3.5, y=8.5)
    assert got == pytest.approx(min(over(4, 0, 3.5)[1], over(6, 0.2, 8.5)[1]), abs=0.003)
    against = joint(spark, [1.0], [4.0, 4.0], [0.0, 0.0], [[1, -1], [-1, 1]], [C((0,), "x"), C((1,), "y", False)], x=3.5, y=4.0)
    assert against == pytest.approx(1 - over(4, 0, 3.5)[1], abs=0.003)  # the rarer of the two implies the other


def test_sums_of_counts_are_convolutions(spark):
    a, b = over(3, 0, 0)[0], over(5, 0.2, 0)[0]
    total = np.convolve(a, b)
    got = joint(spark, [0.5, 0.5], [3.0, 5.0] * 2, [0.0, 0.2], np.eye(2), [C((0, 1), "x"), C((0, 1), "y", False)], x=6.5, y=12.0)
    assert got == pytest.approx(total[7:12].sum(), abs=0.005)


def test_only_draws_that_pass_single_conditions_are_counted(monkeypatch):
    looked = []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *k, **o: (looked.append(np.size(v)), search(a, v, *k, **o))[1])
    table = copula._normal_table()
    u = copula.lattice(4096, 3)
    line = {"one": np.array([9.5]), "all": np.array([12.5])}
    asked = [copula.Condition((0, 1), "all"), copula.Condition((0,), "one")]
    both = copula._hits(np.array([[0.5, 0.5]]), np.array([[[4.0, 5.0], [6.0, 5.0]]]), np.zeros((1, 2)), np.eye(2)[None], asked, line, u[:, 0], copula._quantile(u[:, 1:], table), table)
    assert 0 < both[0] < 0.1 and sum(looked) < 2 * 4096


def test_correlations_are_shrunk_and_repaired(spark):
    r = np.random.default_rng(2)
    z = r.normal(size=(400, 3)) @ np.array([[1, 0.5, 0.2], [0, 0.8, 0.1], [0, 0, 0.9]])
    df = spark.createDataFrame([(i % 3, *map(float, row)) for i, row in enumerate(z)] + [(9, 1.0, 2.0, 3.0), (8, None, 1.0, 1.0)], "g int, a double, b double, c double")
    out = {x["g"]: np.array(x["rho"]).reshape(3, 3) for x in copula.correlations(df, "g", ["a", "b", "c"]).collect()}
    every = np.corrcoef(np.vstack([z, [1, 2, 3]]).T)
    own = np.corrcoef(z[0::3].T)
    assert np.allclose(out[0], (134 * own + 50 * every) / 184, atol=1e-9) and np.allclose(out[9], every, atol=1e-9) and 8 not in out
    bad = np.array([[[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]]])
    f = copula.factors(bad)[0]
    assert np.allclose(np.diag(f @ f.T), 1, atol=1e-6) and np.linalg.eigvalsh(f @ f.T).min() > -1e-9
    assert np.allclose(copula.factors(every[None])[0] @ copula.factors(every[None])[0].T, every, atol=1e-6)


# ---- projections


def test_mixture_follows_the_mean_without_a_cut(spark):
    d = spark.createDataFrame([(1, None, 90.0, 30.0), (2, True, 0.5, 0.2)], "id int, home boolean, h double, a double")
    nodes = projection.scenario_nodes(F.col("home"), F.col("h"), F.col("a"), F.array(F.lit(0.5), F.lit(1.5)))
    out = {r["id"]: r for r in projection.project(d.withColumn("nodes", nodes), "nodes", F.lit(0.1)).collect()}
    cases = {1: [45, 135, 15, 45], 2: [0.25, 0.75]}
    for i, means in cases.items():
        pmf = np.mean([np.pad(over(m, 0.1, 0)[0], (0, 1700))[:2000] if m < 60 else [math.exp(math.lgamma(k + 10) - math.lgamma(10) - math.lgamma(k + 1) - 10 * math.log1p(0.1 * m) + k * math.log(0.1 * m / (1 + 0.1 * m))) for k in range(2000)] for m in means], axis=0)
        c = np.cumsum(pmf)
        assert out[i]["mean"] == pytest.approx(np.mean(means))
        assert [out[i][k] for k in ("median", "lo", "hi")] == [int(np.argmax(c >= q - 1e-12)) for q in (0.5, 0.05, 0.95)]
        assert out[i]["over"] == pytest.approx(1 - c[math.floor(np.mean(means))], abs=1e-6)
        assert out[i]["over"] + out[i]["under"] + out[i]["push"] == pytest.approx(1, abs=1e-9)


def test_pmf_equals_its_formula(spark):
    d = spark.createDataFrame([(3.0, 0.0), (3.0, 0.25), (0.0, 0.0), (40.0, 2.0)], "m double, a double").select("m", "a", dist.count_pmf(F.col("m"), F.col("a"), 60).alias("p"), dist.cdf_around(dist.count_pmf(F.col("m"), F.col("a"), 60), F.lit(4)).alias("c"))
    for r in d.collect():
        want = over(r["m"], r["a"], 0)[0][:61] if r["m"] else np.array([1.0] + [0.0] * 60)
        assert np.allclose(r["p"], want, atol=1e-11)
        assert r["c"]["at"] == pytest.approx(want[:5].sum()) and r["c"]["below"] == pytest.approx(want[:4].sum())


def test_numbers_of_distributions_equal_those_of_whole_ones(spark):
    rows = [(1, [(0.5, 4.0), (0.5, 0.0)], 0.2, 3.5, 2.0), (2, [(1.0, 1500.0)], 0.0, 1500.0, 1490.0), (3, [(0.2, 2.0), (0.3, 60.0), (0.5, 9.0)], 1.5, None, 4000.0), (4, None, 0.2, 1.5, -1.0), (5, [], 0.2, 1.5, 1.0), (6, [(1.0, 3.0)], None, 1.5, None), (7, [(0.5, None), (0.5, 1.0)], 0.1, 0.5, 1.9), (8, [(1.0, 7.0)], 1e-4, 7.0, 0.0)]
    d = spark.createDataFrame(rows, "id int, nodes array<struct<weight double, mean double>>, a double, line double, y double").repartition(2).withColumn("m", F.try_element_at("nodes", F.lit(1))["mean"])
    pmf = dist.normalised(dist.mixture_pmf(F.col("nodes"), F.col("a"), dist.support(F.array_max(F.transform("nodes", lambda n: n["mean"])), F.col("a"))))
    lo, hi = dist.interval(F.col("p"), 0.9)
    over, under, push = dist.over_under_push(F.col("p"), F.col("line"))
    cdf = dist.cdf_around(dist.count_pmf(F.col("m"), F.col("a"), dist.support(F.col("m"), F.col("a"))), F.col("y"))
    want = d.where("id IN (1, 2, 3, 8)").withColumn("p", pmf).select("id", dist.quantile(F.col("p"), 0.5).alias("median"), lo.alias("lo"), hi.alias("hi"), over.alias("over"), under.alias("under"), push.alias("push"), cdf["below"].alias("below"), cdf["at"].alias("at"))
    s, c = dist.mixture_summary(F.col("nodes"), F.col("a"), F.col("line")), dist.count_cdf(F.col("m"), F.col("a"), F.col("y"))
    got = {r["id"]: r for r in d.select("id", "m", "a", "y", s.alias("s"), c.alias("c")).collect()}
    assert len(got) == len(rows)
    for r in want.collect():
        own = got[r["id"]]["s"].asDict() | got[r["id"]]["c"].asDict()
        assert all(own[k] == pytest.approx(r[k], abs=1e-9) for k in own) and isinstance(own["median"], int)
    assert all(got[i]["s"] is None for i in (4, 5, 6, 7)) and all(got[i]["c"] is None for i in (4, 5, 6, 7))


def test_projections_make_no_array_of_a_whole_distribution(spark):
    d = spark.createDataFrame([(1, True, 5.0, 4.0)], "id int, home boolean, h double, a double")
    nodes = projection.scenario_nodes(F.col("home"), F.col("h"), F.col("a"), F.array(F.lit(0.5), F.lit(1.5)))
    plan = projection.project(d.withColumn("nodes", nodes), "nodes", F.lit(0.1))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan.lower()


def test_quantile_pmf_is_worked_out_in_batches(spark):
    df = spark.createDataFrame([([5.0, 2.0, 9.5],), ([0.0, 0.0, 0.0],), ([-3.0, -2.0, -1.0],), (None,)], "q array<double>").select(dist.pmf_of_quantiles(F.col("q"), [0.1, 0.5, 0.9], 30).alias("p"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()  # no loop of JVM lambdas a row
    a, b, c, none = (r["p"] for r in df.collect())
    cdf = np.interp(np.arange(31) + 0.5, [-0.5, 2.0, 5.0, 9.5, 9.5 + 2 * 4.5 + 1], [0, 0.1, 0.5, 0.9, 1.0])
    assert a == pytest.approx(np.diff(cdf, prepend=0.0), abs=1e-12)
    assert sum(b) == pytest.approx(1) and sum(c) == pytest.approx(1) and none is None


def test_contributions_add_up_and_know_an_additive_model(spark):
    d = spark.createDataFrame([(1.0, 2.0, 1.0), (5.0, -1.0, 0.0)], "a double, b double, home double")
    groups = {"a": {"a": F.lit(0.5)}, "b": {"b": F.lit(0.0)}}
    get = lambda own, c: own.get(c, F.col(c))
    plus = projection.contributions(d, groups, lambda own: 3 * get(own, "a") + 7 * get(own, "b") + 2 * get(own, "home"), {"side": "home"}).collect()
    for r in plus:
        assert (r["phi_a"], r["phi_b"], r["phi_side"]) == pytest.approx((3 * (r["a"] - 0.5), 7 * r["b"], 2 * (r["home"] - 0.5)))
    times = projection.contributions(d, groups, lambda own: F.exp(get(own, "a") / 9 + get(own, "b") + get(own, "home")), {"side": "home"}).collect()
    for r in times:
        assert r["phi_a"] + r["phi_b"] + r["phi_side"] == pytest.approx(r["projection"] - r["neutral"])


def test_rate_column_equals_the_model(world):
    train, test = world
    model = models.poisson_rate(train, "y", ["x", "k"], "e")
    out = models.predict_rate(model, test, "e").withColumn("mine", models.rate_column(model) * F.col("e")).select(F.max(F.abs(F.col("mine") / F.col("expected") - 1))).first()[0]
    assert out < 1e-9


def test_residual_table_pools_small_buckets(spark):
    d = spark.createDataFrame([(i % 3 if i < 900 else 7, float(i % 100)) for i in range(910)], "bucket int, resid double")
    out = {r["bucket"]: r for r in projection.residual_table(d, "bucket", "resid", [0.1, 0.9], exact=True).collect()}
    every = np.quantile([float(i % 100) for i in range(910)], [0.1, 0.9])
    assert out[7]["n"] == 10 and np.allclose(out[7]["q"], every) and not np.allclose(out[0]["q"], every) or out[0]["n"] == 300
    interval = projection.mean_interval(F.lit(10.0), F.lit(0.1), F.lit(40), F.lit(30.0), F.lit(5.0))
    low, high = d.limit(1).select(*interval).first()
    assert low < 10 < high and high - 10 == pytest.approx(10 - low)


# ---- names


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_all_similar_names_are_candidates(spark):
    import random

    from statloom.operators import joins

    r = random.Random(4)
    known = sorted({"".join(r.choice("abcde ") for _ in range(r.randrange(1, 16))).strip() or "a" for _ in range(150)})
    asked = set()
    for name in known:
        for _ in range(2):  # errors anywhere, the first letters too
            w = list(name)
            for _ in range(r.randrange(0, 4)):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randrange(2)] = r.choice(["", "x", "a"])
            asked.add("".join(w))
    got = joins.similar_names(spark.createDataFrame([(x,) for x in asked], "n string"), spark.createDataFrame([(x,) for x in known], "m string"))
    want = {(a, k) for a in asked for k in known if a and 1 - edits(a, k) / max(len(a), len(k)) >= 0.7 - 1e-9}
    assert {(x["n"], x["m"]) for x in got.collect()} == want and len(want) > 150
    with pytest.raises(ValueError):
        joins.similar_names(got.select("n"), got.select("m"), 0.5)


def test_names_by_era_and_weight(spark):
    from statloom.operators import joins

    known = spark.createDataFrame([(1, "Gary Payton", 1990, 2006, 1300), (2, "Gary Payton", 2016, None, 500), (3, "Gary Paytan", 1985, 1987, 3), (4, "Steph Curry", 2009, None, 900)], "id long, name string, first int, last int, games int")
    asked = spark.createDataFrame([("gary payton", None, None), ("gary payton", 2018, 2018), ("gary payton", 1950, 1951), ("xteph curry", None, None), ("nobody here", None, None)], "q string, first int, last int")
    out = {(x["text"], x["first"]): (x["id"], x["status"]) for x in joins.resolve_names(asked, known, "q", "name", "id", "games", span=("first", "last")).collect()}
    assert out == {("gary payton", -(1 << 30)): (1, "clear"), ("gary payton", 2018): (2, "unique"), ("gary payton", 1950): (1, "clear"), ("xteph curry", -(1 << 30)): (4, "unique")}


# ---- benchmark, choice, calibration, sides, resampled clusters


def test_benchmark_recovers_rating_and_home(spark):
    r = np.random.default_rng(7)
    rows = []
    for p in range(40):
        level = r.uniform(2, 12)
        for _ in range(60):
            rating, home = float(r.uniform(0.7, 1.3)), float(r.integers(0, 2))
            rows.append((p, float(level), rating, home, float(r.poisson(level * rating**1.5 * math.exp(0.1 * home)))))
    df = spark.createDataFrame([*rows, (99, None, 1.0, 1.0, 3.0)], "p int, form double, rating double, home double, y double")
    model = models.benchmark(df, "y", "form", "rating", "home")
    beta = model.stages[-1].coefficients.toArray()
    assert beta[0] == pytest.approx(1.5, abs=0.1) and beta[1] == pytest.approx(0.1, abs=0.04)
    out = models.predict_benchmark(model, df, "form", "rating", "home").where("p = 99").first()
    assert out["expected"] is None
    # the benchmark is the truth here, so it is chosen over the model without rating
    plain = (lambda t: models.poisson_rate(t, "y", ["home"], "form"), lambda fitted, t: models.predict_rate(fitted, t, "form"))
    full = (lambda t: models.benchmark(t, "y", "form", "rating", "home"), lambda fitted, t: models.predict_benchmark(fitted, t, "form", "rating", "home"))
    best, errors, _ = models.choose_model({"plain": plain, "benchmark": full}, df.where("p < 30"), df.where("p BETWEEN 30 AND 98"), "y")
    assert best == "benchmark" and errors["benchmark"] < errors["plain"]


def test_dispersion_of_planted_counts(spark):
    r = np.random.default_rng(3)
    m = r.uniform(2, 20, 6000)
    y = r.poisson(r.gamma(1 / 0.3, 0.3 * m))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, m, strict=True)], "y double, m double")
    assert models.dispersion(df, "y", "m") == pytest.approx(0.3, abs=0.03)


def counted(spark, df):
    """(df, a counter of the rows that are made of it)."""
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    return df.mapInPandas(count, df.schema), made


def test_fits_make_their_rows_once(spark):
    rows = [(i % 7, 0.1 + 0.1 * (i % 8), float(i % 3 == 0), float(i % 5), 1.0 + i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, p double, outcome double, y double, e double")
    once, made = counted(spark, df)
    models.choose_calibrator(once, "p", "outcome", "g", folds=2)
    assert made.value == 400
    once, made = counted(spark, df)
    models.poisson_rate(once, "y", ["p"], "e")
    assert made.value == 400


def test_a_benchmark_is_fitted_on_merged_rows(spark, monkeypatch):
    """Rows of like features are one row of the fit, whose coefficients are those of the single rows; all rows are made once."""
    r = np.random.default_rng(11)
    rows = [(float(r.uniform(2, 12)), [None, 0.8, 1.0, 1.25][i % 4], [None, 0.0, 1.0][i % 3]) for i in range(1200)]
    rows = [(f, o, h, float(r.poisson(f * (o or 1.0) * 1.2 ** (0.5 if h is None else h)))) for f, o, h in rows]
    df = spark.createDataFrame(rows, "form double, rating double, home double, y double")
    single = models.poisson_rate(models._benchmark_frame(df, "form", "rating", "home"), "y", ["__opp", "__home"], "form").stages[-1]
    once, made = counted(spark, df)
    tables, read = [], models.staged
    monkeypatch.setattr(models, "staged", lambda df, name: tables.append(read(df, name)) or tables[-1])
    fitted = models.benchmark(once, "y", "form", "rating", "home")
    assert made.value == 1200 and [t.count() for t in tables] == [9]
    assert fitted.stages[-1].coefficients.toArray() == pytest.approx(single.coefficients.toArray(), rel=1e-6)
    assert fitted.stages[-1].intercept == pytest.approx(single.intercept, rel=1e-5, abs=1e-8)
    # an unknown feature takes the median of the rows
    some = spark.createDataFrame([(1.0 + i % 2, 1.0 if i < 3 else 2.0 if i < 9 else None, float(1 + i % 3)) for i in range(12)], "e double, x double, y double")
    model = models.poisson_rate(some, "y", ["x"], "e", few=True)
    assert model.stages[0].surrogateDF.first()["x"] == 2.0
    with pytest.raises(Exception, match="non-?negative|negative"):
        models.poisson_rate(spark.createDataFrame([(1.0, 1.0, 5.0), (1.0, 1.0, -1.0)], "e double, x double, y double"), "y", ["x"], "e", few=True)


def test_calibrators_mend_planted_odds(spark):
    r = np.random.default_rng(5)
    p = r.uniform(0.02, 0.98, 4000)
    truth = 1 / (1 + np.exp(-(0.5 * np.log(p / (1 - p)) - 0.6)))
    df = spark.createDataFrame([(int(i % 80), float(a), float(r.random() < t)) for i, (a, t) in enumerate(zip(p, truth, strict=True))], "g int, p double, outcome double")
    kind, scores = models.choose_calibrator(df, "p", "outcome", "g", folds=2)
    assert kind == "platt" and scores["platt"] < scores["identity"] - 0.005 and scores["isotonic"] < scores["identity"]
    out = models.fit_platt(df, "p", "outcome")(df).collect()
    assert np.mean([abs(x["calibrated"] - t) for x, t in zip(sorted(out, key=lambda x: x["p"]), truth[np.argsort(p)], strict=True)]) < 0.03
    rising = [x["calibrated"] for x in models.fit_isotonic(df, "p", "outcome")(df).orderBy("p").collect()]
    assert rising == sorted(rising)


def test_normal_scores_of_true_distributions_are_normal(spark):
    r = np.random.default_rng(6)
    y = r.poisson(4.0, 4000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id long, y double").withColumn("c", dist.cdf_around(dist.count_pmf(F.lit(4.0), F.lit(0.0), 60), F.col("y")))
    z = np.array([x["z"] for x in models.pit_scores(df.withColumn("at", F.col("c.at")).withColumn("below", F.col("c.below")), "below", "at", ["id"]).collect()])
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05 and abs((z < -1.2815515).mean() - 0.1) < 0.02


def greedy(teams, games, least, low, high, seed):
    n = lambda a, b: games.get((a, b), 0)
    own = {seed}
    while True:
        more = {t for t in teams if t not in own and any(n(t, o) >= least for o in own)}
        if not more:
            break
        own |= more
    if not low * len(teams) <= len(own) <= high * len(teams):
        own = {seed}
        while len(own) < len(teams) // 2:
            own.add(max((t for t in teams if t not in own), key=lambda t: (sum(n(t, o) for o in own) / len(own), -t)))
    return own


def test_sides_of_a_league(spark):
    import random

    from statloom.operators import graph

    r = random.Random(8)
    rows, want = [], {}
    for season in range(4):
        games = {}
        for a, b in itertools.combinations(range(8), 2):
            # two halves that meet often within and once across; then leagues where all meet alike
            k = (4 if (a < 4) == (b < 4) else 1) if season == 0 else r.randrange(0, 6)
            games[a, b] = games[b, a] = k
        rows += [(season, a, b) for (a, b), k in games.items() for _ in range(k)]
        teams = sorted({a for (a, _), k in games.items() if k})
        want |= {(season, t): t in greedy(teams, games, 3, 0.35, 0.65, 0) for t in teams}
    got = {(x["season"], x["team"]): x["side"] == "seed" for x in graph.sides(spark.createDataFrame(rows, "season long, a long, b long"), 0, 3).collect()}
    assert got == want and {t for (s, t), own in want.items() if s == 0 and own} == {0, 1, 2, 3}


def test_resampled_clusters_cover_the_difference(spark):
    from statloom.operators import inference

    r = np.random.default_rng(9)
    rows = [(c, float(3 + u + r.normal()), float(2.5 + u + r.normal())) for c, u in enumerate(r.normal(0, 2, 60)) for _ in range(8)]
    out = inference.paired_bootstrap(spark.createDataFrame(rows, "c int, a double, b double"), "c", "a", "b", reps=600).first()
    d = np.array([a - b for _, a, b in rows])
    se = np.array([d[i * 8 : i * 8 + 8].mean() for i in range(60)]).std(ddof=1) / math.sqrt(60)
    assert out["diff"] == pytest.approx(d.mean()) and (out["high"] - out["low"]) == pytest.approx(2 * 1.96 * se, rel=0.25)


# ---- catalogues


def test_spellings_and_statistics(spark):
    from statloom.functions import catalog

    assert set(catalog.player_stats()) == set(catalog.PLAYER_NAMES.split()) and set(catalog.team_stats()) == set(catalog.TEAM_NAMES.split())
    asked = {"PRA": ("pra", None), "FG%": ("fg_pct", "fg_pct"), "ppg": ("points", "team_score"), "Dimes": ("assists", "assists"), "+/-": ("plus_minus", None), "Points Allowed": (None, "opponent_score"), "3-pointers": (None, None), "threes_attempted": ("threes_attempted", "threes_attempted"), "record": (None, "win_pct"), "": (None, None), "Points": ("points", "team_score"), "boards": ("rebounds", "rebounds")}
    got = {r["t"]: (r["p"], r["m"]) for r in spark.createDataFrame([(t,) for t in asked], "t string").select("t", catalog.canonical_stat(F.col("t")).alias("p"), catalog.canonical_stat(F.col("t"), "team").alias("m")).collect()}
    assert got == asked
    box = spark.createDataFrame([(30.0, 10.0, 20.0, 10.0, 4.0, 6.0), (10.0, 0.0, 0.0, 0.0, 2.0, 6.0)], "pts double, fgm double, fga double, fta double, ast double, reb double").withColumn("fg3m", F.lit(2.0))
    st = catalog.player_stats()
    rows = box.select(*[st[n].per_row().alias(n) for n in ("pra", "fg_pct", "ts_pct")]).orderBy(F.desc("pra")).collect()
    assert [r["pra"] for r in rows] == [40, 18] and [r["fg_pct"] for r in rows] == [50, None] and rows[0]["ts_pct"] == pytest.approx(30 / 48.8 * 100)
    pooled = box.agg(*[st[n].pooled().alias(n) for n in ("fg_pct", "ts_pct", "efg_pct")]).first()
    assert (pooled["fg_pct"], pooled["ts_pct"]) == (50, pytest.approx(40 / 48.8 * 100))
