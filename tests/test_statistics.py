"""Known answers, leakage and the queries that SQL can't express."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.functions import special
from statloom.operators import distributions, inference, joins, windows
from statloom.plans import registry

DATA = "/root/testdata/sf0.001"


def history(spark, values, by="a"):
    rows = [(s, i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), v) for s, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "subject string, event_id long, ts timestamp, value double")


def col(df, name):
    return [r[name] for r in df.orderBy("subject", "event_id").collect()]


def test_lagged_mean(spark):
    h = history(spark, {"1": [10.0, 20.0, 30.0, 40.0], "2": [100.0, 200.0]})
    assert col(h.withColumn("m", windows.lagged_mean("value", "subject", 2)), "m") == [None, 10, 15, 25, None, 100]


def test_lagged_ewm_known_answer_and_long_series(spark):
    h = windows.lagged_ewm(history(spark, {"1": [10.0, 20.0, None, 40.0]}), "subject", ["value"], 1)
    got = col(h, "value_ewm")
    assert got[0] is None and got[1] == 10 and got[2] == pytest.approx(25 / 1.5) and got[3] == got[2]
    r = random.Random(1)
    values = [r.random() * 100 for _ in range(2600)]
    got = col(windows.lagged_ewm(history(spark, {"1": values}), "subject", ["value"], 2.0), "value_ewm")
    want = pd.Series(values).ewm(halflife=2.0).mean().shift(1)
    assert np.allclose(np.array(got[1:], float), want.to_numpy()[1:], rtol=1e-9)


def test_history_features_do_not_see_their_own_row(spark):
    values = [float(x) for x in range(1, 30)]
    changed = values[:20] + [999.0] + values[21:]

    def features(v):
        h = windows.lagged_ewm(history(spark, {"1": v}), "subject", ["value"], 5)
        h = h.withColumn("m", windows.lagged_mean("value", "subject", 5)).withColumn("s", windows.lagged_sum("value", "subject"))
        return list(zip(col(h, "value_ewm"), col(h, "m"), col(h, "s"), strict=True))

    a, b = features(values), features(changed)
    assert a[:21] == b[:21] and a[21] != b[21]


def test_as_of_is_strictly_before(spark):
    rows = [("a", dt.datetime(2024, 1, 1), 1.0), ("a", dt.datetime(2024, 1, 1), 2.0), ("a", dt.datetime(2024, 1, 2), 3.0)]
    out = windows.as_of(spark.createDataFrame(rows, "k string, ts timestamp, v double"), "k", "v", "before").orderBy("v").collect()
    assert [r["before"] for r in out][:2] == [None, None] and out[2]["before"] in (1.0, 2.0)


def test_welch_known_answer(spark):
    split, rest = [10.0, 20.0, 30.0, 20.0], [25.0, 25.0, 30.0, 20.0, 30.0, 20.0, 35.0, 35.0]
    df = spark.createDataFrame([(True, x) for x in split] + [(False, x) for x in rest], "m boolean, v double")
    from statloom.operators.aggregates import split_stats

    row = split_stats(df.withColumn("k", F.lit(1)), ["k"], F.col("m"), "v")
    c = F.col
    t, dof = inference.welch(c("split_mean"), c("split_std"), c("split_n"), c("rest_mean"), c("rest_std"), c("rest_n"))
    got = row.select(t.alias("t"), dof.alias("df")).withColumn("p", special.t_pvalue_column(c("t"), c("df"))).first()
    assert got["t"] == pytest.approx(-1.631555, abs=1e-6) and got["df"] == pytest.approx(4.678526, abs=1e-6) and got["p"] == pytest.approx(0.16770, abs=1e-5)


def test_prior_variance_and_shrinkage_known_answer(spark):
    g = spark.createDataFrame([(1, 20.0, 4, 200 / 3), (1, 25.0, 6, 200 / 3), (1, 35.0, 2, 200 / 3)], "k int, m double, n int, w double")
    tau = inference.prior_variance(g, ["k"], "m", "n", "w").first()["tau2"]
    assert tau == pytest.approx(np.var([20, 25, 35], ddof=1) - np.mean([200 / 3 / n for n in (4, 6, 2)]))


def test_holm_known_answer(spark):
    df = spark.createDataFrame([(1, 1, 0.04), (1, 2, 0.01), (1, 3, None), (1, 4, 0.02)], "f int, i int, p double")
    out = windows.add_steps(df, windows.holm("p", "f", "i")).orderBy("i").collect()
    assert [r["p_holm"] and round(r["p_holm"], 9) for r in out] == [0.04, 0.03, None, 0.04]


def test_student_t_against_known_quantiles():
    for df, q in ((1, 12.7062047364), (5, 2.57058183661), (30, 2.04227245630)):
        assert special.t_two_sided(np.array([q]), np.array([float(df)]))[0] == pytest.approx(0.05, abs=1e-9)
        assert special.t_quantile(0.95, np.array([float(df)]))[0] == pytest.approx(q, abs=1e-6)
    assert special.normal_cdf(np.array([1.959963984540054]))[0] == pytest.approx(0.975)


def test_planted_regression(spark):
    r = np.random.default_rng(11)
    rows = []
    for p in range(20):
        talent = r.normal(20, 5)
        for _ in range(60):
            home, minutes = float(r.integers(0, 2)), float(r.normal(30, 6))
            rows.append((p, home, minutes, float(r.normal()), float(talent + 3 * home + 0.5 * minutes + r.normal(0, 2))))
    df = spark.createDataFrame(rows, "p int, home double, minutes double, noise double, y double")
    t = inference.fixed_effects(df, "p", "y", ["home", "minutes", "noise"]).set_index("variable")
    assert t.coef["home"] == pytest.approx(3, abs=0.3) and t.p["home"] < 1e-6
    assert t.coef["minutes"] == pytest.approx(0.5, abs=0.05)
    assert abs(t.coef["noise"]) < 3 * t.se["noise"]


def test_bootstrap_interval_holds_the_difference(spark):
    r = np.random.default_rng(3)
    rows = [(1, i, bool(i % 3 == 0), float(r.normal(10 + 2 * (i % 3 == 0), 2))) for i in range(400)]
    out = inference.bootstrap_ci(spark.createDataFrame(rows, "s int, i int, m boolean, v double"), "s", F.col("m"), "v", reps=400).first()
    v = np.array([x[3] for x in rows])
    m = np.array([x[2] for x in rows])
    assert out["low"] < v[m].mean() - v.mean() < out["high"] and 0.2 < out["high"] - out["low"] < 1.5


def test_bootstrap_of_pieces_and_odd_groups(spark, monkeypatch):
    rows = [(k % 7 or None, k, k % 3 == 0, float(k * 7919 % 101)) for k in range(700)] + [(50, 1, True, 2.0), (51, 2, False, 3.0), (52, 3, True, None), (53, 4, None, 1.0)]
    df = spark.createDataFrame(rows, "s int, i int, m boolean, v double").repartition(5)
    steps = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(12)])
    frame = df.where("v IS NOT NULL").select("*", F.xxhash64(F.lit(7), "s", "i", "m", "v").alias("h")).toPandas()
    want = {}
    for s, own in frame.groupby(frame["s"].fillna(-1)):
        h = own["h"].to_numpy(np.int64).view(np.uint64)
        w = np.searchsorted(steps, inference._uniform(h[:, None] + np.arange(300, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)))
        m, v = (own["m"] == True).to_numpy(bool), own["v"].to_numpy()  # noqa: E712  null is no
        with np.errstate(invalid="ignore", divide="ignore"):
            d = (w[m] * v[m, None]).sum(0) / w[m].sum(0) - (w * v[:, None]).sum(0) / w.sum(0)
        want[s] = np.quantile(d[np.isfinite(d)], [0.025, 0.975]) if np.isfinite(d).any() else [None, None]
    for size in (200_000, 30):
        monkeypatch.setattr(inference, "PIECE", size)
        got = {-1 if r["s"] is None else r["s"]: [r["low"], r["high"]] for r in inference.bootstrap_ci(df, "s", F.col("m"), "v", reps=300).collect()}
        assert set(got) == set(want)
        assert all(a == b or a == pytest.approx(b, abs=1e-9) for s in want for a, b in zip(got[s], want[s], strict=True))


def test_bootstrap_moves_no_replicates(spark):
    df = spark.createDataFrame([(k % 5, k, float(k)) for k in range(50)], "s int, i int, v double")
    plan = inference.bootstrap_ci(df, "s", F.col("i") % 2 == 0, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("wide", [False, True])
def test_q_values_by_running_least_ones(spark, wide):
    ps = [None if k % 17 == 0 else (k * 7919 % 401) / 401 for k in range(900)]  # with ties
    d = spark.createDataFrame([("a", k, p) for k, p in enumerate(ps)], "f string, k long, p double").repartition(3)
    out = windows.wide_q_values(d, "p", "k", buckets=16) if wide else windows.add_steps(d, windows.benjamini_hochberg("p", "f", "k"))
    got = {r["k"]: r["q_value"] for r in out.collect()}
    order = sorted((p, k) for k, p in enumerate(ps) if p is not None)
    least, want = 1.0, {}
    for r in range(len(order), 0, -1):
        least = want[order[r - 1][1]] = min(least, order[r - 1][0] * len(order) / r)
    assert len(got) == len(ps) and all(got[k] is None if p is None else got[k] == pytest.approx(want[k], abs=1e-12) for k, p in enumerate(ps))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("min(__q" in x and "unboundedfollowing" in x for x in plan.lower().splitlines())


def test_a_birth_date_may_be_the_mark_of_an_unknown_one(spark, tmp_path):
    day = dt.date(1900, 1, 1) + dt.timedelta(days=35_010)
    rows = [(1, 3501, day), (2, 3510, day), (3, 11, day)]
    spark.createDataFrame([(k, c, d, 1.0, "O", "1-URGENT") for k, c, d in rows], "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["event_id"]: r["age"] for r in registry.queries()["f6_age"](spark, str(tmp_path)).collect()}
    assert got == {1: pytest.approx(35_010 / 365.25, abs=1e-6), 2: None, 3: pytest.approx(110 / 365.25, abs=1e-6)}


@pytest.mark.parametrize("name", ["i16_linear_trend", "s17_kept_parameters"])
def test_every_subject_has_a_trend_row(spark, tmp_path, name):
    days = {1: [1], 2: [1, 31], 3: [1, 1, 1], 4: [1, 31, 61], 5: [5, 5]}
    rows = [(10 * c + k, c, dt.date(1995, 1, 1) + dt.timedelta(days=x), 100.0 * (k + 1), "O", "1-URGENT") for c, xs in days.items() for k, x in enumerate(xs)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["subject"]: r for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert set(got) == set(days)
    if name == "s17_kept_parameters":
        assert [got[c]["at_two"] is not None for c in days] == [False, True, False, True, False]
    else:
        assert [(got[c]["n"], got[c]["slope"] is not None, got[c]["residual_std"] is not None) for c in days] == [(1, False, False), (2, True, False), (3, False, False), (3, True, True), (2, False, False)]


def test_trend_bands_find_t_once_for_a_number_of_rows(spark, tmp_path):
    orders = [(i, i % 3, dt.datetime(1995, 1 + i % 12, 1 + i % 5), "1-URGENT", 10.0 + i % 7, "F") for i in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_totalprice double, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.queries()["i17_trend_bands"](spark, str(tmp_path))
    assert got.count() == 9
    assert "BroadcastHashJoin [n" in got._jdf.queryExecution().executedPlan().toString()  # t is joined by n, not worked out a subject


def test_opponent_sums_share_one_sort(spark):
    df = spark.createDataFrame([(1, 7, 1.0), (1, 7, 2.0), (1, 8, 4.0), (1, None, 8.0), (2, 7, 5.0), (3, 5, None), (3, 6, 1.0)], "g long, s long, x double").repartition(3)
    out = joins.opponent_sums(df, "g", "s", ["x"])
    assert {(r["g"], r["s"]): (r["opponents"], r["opp_x"]) for r in out.collect()} == {(1, 7): (2, 12.0), (1, 8): (3, 11.0), (1, None): (3, 7.0), (3, 5): (1, 1.0), (3, 6): (1, 0.0)}
    plan = joins.opponent_sums(joins.side_sums(df, "g", "s", ["x"]), "g", "s", ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Sort [") == 1


def test_pmf_sums(spark):
    df = spark.createDataFrame([(5.0,)], "m double").select(distributions.count_pmf(F.col("m"), F.lit(0.1), 60).alias("p"))
    p = np.array(df.first()["p"])
    k = np.arange(61)
    assert p.sum() == pytest.approx(1, abs=1e-6) and (p * k).sum() == pytest.approx(5, abs=1e-4)
    assert (p * k * k).sum() - 25 == pytest.approx(5 + 0.1 * 25, abs=1e-2)


@pytest.mark.parametrize("name", sorted(q.name for q in registry.registered() if not q.sql))
def test_queries_without_sql_run(spark, name):
    rows = registry.queries()[name](spark, DATA).collect()
    assert rows
    for r in rows:
        d = r.asDict()
        if "p" in d and d["p"] is not None:
            assert 0 <= d["p"] <= 1
        if "low" in d and d["low"] is not None:
            assert d["low"] <= d["high"]
        assert not any(isinstance(x, float) and math.isinf(x) for x in d.values())


def test_backtest_scores_are_those_of_each_candidate_alone(spark):
    from statloom.plans import models as plans

    f = plans._rated(spark, DATA)
    test, alone = f.where("season = 2"), {}
    for name, (fit, predict) in plans._CANDIDATES.items():
        alone[name] = predict(fit(f.where("season < 2")), test)
    alone["last_rows"] = test.withColumn("expected", F.col("recent") / 10)
    got = plans.m22(spark, DATA)
    assert got.columns == ["season", "model", "mae", "rmse", "brier", "log_loss", "n"]
    got = {r["model"]: r for r in got.collect()}
    assert set(got) == set(alone) and all(r["season"] == 2 for r in got.values())
    for name, t in alone.items():
        rows = t.where("form IS NOT NULL AND recent IS NOT NULL").toPandas()
        known = rows[rows["expected"].notna()]
        e, p, hit = known["expected"] - known["y"], 1 - np.exp(-np.maximum(known["expected"], 1e-6)), (known["y"] > 0).astype(float)
        r = got[name]
        assert r["n"] == len(rows) and r["mae"] == pytest.approx(e.abs().mean(), rel=1e-6) and r["rmse"] == pytest.approx(np.sqrt((e * e).mean()), rel=1e-6)
        assert r["brier"] == pytest.approx(((p - hit) ** 2).mean(), rel=1e-6)


def test_backtest_reads_the_last_season_once(spark):
    """The plan that scores the candidates has one scan of the frame, however many models there are."""
    from statloom.plans import models as plans

    plan = plans.m22(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("minutes#") and sum("Relation" in x and "minutes#" in x for x in plan.splitlines()) == 1


def test_the_omitted_level_does_not_depend_on_which_is_omitted(spark):
    from statloom.operators import inference as i

    rows = [(g, "abc"[(g * 7 + k * k) % 3], float((g * 31 + k * 17) % 23 + 5 * ((g * 7 + k * k) % 3))) for g in range(12) for k in range(8)]
    df = spark.createDataFrame(rows, "g long, level string, y double")
    found = []
    for gone in "ca":
        terms = [x for x in "abc" if x != gone]
        t = i.fixed_effects(df.select("g", "y", *i.deviation_columns("level", list("abc"), gone)), "g", "y", terms)
        found.append(i.with_omitted(t, terms, gone).set_index("variable").loc[list("abc")][["coef", "se", "p"]].to_numpy())
    assert abs(found[0] - found[1]).max() < 1e-9 and abs(found[0][:, 0].sum()) < 1e-9


def test_climatology_counts_the_whole_past(spark):
    from statloom.operators import windows as w

    rows = [(k % 2, k, None if k % 11 == 0 else float(k * 7919 % 101), float(k * 104729 % 97)) for k in range(700)]
    df = spark.createDataFrame(rows, "who long, ts long, value double, line double")
    got = {r["ts"]: r["share_over"] for r in w.climatology(df, ["who"], "value", "line", ["ts"], block=16).collect()}
    for who, k, _, line in rows:
        past = [v for g, j, v, _ in rows if g == who and j < k and v is not None]
        assert abs(got[k] - (sum(v > line for v in past) / len(past) if past else 0.5)) < 1e-12
