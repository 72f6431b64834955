"""Queries of the fitted models (M rows of the inventory); fits have no SQL twin."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..operators import copula as cop
from ..operators import distributions as dist
from ..operators import models as m
from ..operators import projection as pro
from ..operators import windows as w
from ..session import staged
from ..sources.roles import DUEL_HISTORY_SQL, EVENT_HISTORY_SQL, duel_history, event_history
from .base import Query, rounded

E, D = EVENT_HISTORY_SQL, DUEL_HISTORY_SQL
FEATURES = ["form", "recent", "home_n", "rest"]


def frame(s, d):
    """M24: events with lagged features only."""
    # what needs the same order as the first step of the weighted means comes before it, and shares its sort
    h = event_history(s, d).withColumn("recent", w.lagged_mean("exposure", "subject", 5)).withColumn("rest", w.days_since_previous("subject").cast("double"))
    h = w.lagged_ewm(h, "subject", ["exposure"], 10, suffix="_form").withColumnRenamed("exposure_form", "form")
    return h.withColumn("home_n", (F.col("value") > 50).cast("double")).withColumn("y", (F.col("exposure") / 10).cast("int").cast("double")).withColumn("minutes", F.greatest(F.col("value"), F.lit(1.0)))


def m24(s, d):
    return rounded(frame(s, d).select("event_id", "form", "recent", F.col("rest").cast("long").alias("rest"), F.col("home_n").cast("long").alias("home_n"), "y"))


def _split(s, d):
    f = staged(frame(s, d), "frame")  # fits and predictions read it several times
    return f.where("season < 2"), f.where("season = 2")


def m6(s, d):
    f = frame(s, d).where("form IS NOT NULL").withColumn("mean", F.greatest(F.col("form") / 10, F.lit(0.05)))
    alpha = m.dispersion(f, "y", "mean")
    return rounded(s.createDataFrame([(alpha,)], "alpha double"))


def m9(s, d):
    train, test = _split(s, d)
    model = m.poisson_rate(train, "y", FEATURES, "minutes")
    return m.predict_rate(model, test, "minutes").select("event_id", "y", "expected")


#: Settings of the boosted models of these queries: few and strong trees, as the tables are small.
_SMALL = {"rounds": 20, "rate": 0.2, "patience": 3}
LEVELS = [0.05, 0.25, 0.5, 0.75, 0.95]


def m10(s, d):
    """Boosted Poisson: the last training season decides how many trees stay."""
    train, test = _split(s, d)
    model = m.boosted_rate(train, "y", FEATURES, "minutes", valid=F.col("season") == 1, **_SMALL)
    return m.predict_boosted(model, test, "minutes").select("event_id", "y", "expected", F.lit(model.rounds).alias("rounds"), F.lit(float(min(model.deviance))).alias("valid_deviance"))


def _quantiles(s, d):
    train, test = _split(s, d)
    model = m.boosted_quantiles(train, "exposure", FEATURES, LEVELS, valid=F.col("season") == 1, **_SMALL)
    return test.withColumn("q", model.column())


def m11(s, d):
    """Boosted quantiles of the count, and the chance of going over the expected line that follows from them."""
    t = _quantiles(s, d)
    pmf = dist.pmf_of_quantiles(F.col("q"), LEVELS, 120)
    over, _, _ = dist.over_under_push(F.col("pmf"), F.floor(F.element_at("q", 3)) + 0.5)
    return t.withColumn("pmf", pmf).select("event_id", F.col("exposure").alias("y"), *[F.element_at("q", k + 1).alias(f"q{int(100 * x)}") for k, x in enumerate(LEVELS)], over.alias("over"))


def m12(s, d):
    train, test = _split(s, d)
    model = m.boosted_rate(train, "value", ["form", "recent", "rest"], valid=F.col("season") == 1, **_SMALL)
    return m.predict_boosted(model, test).select("event_id", F.col("value").alias("actual"), "expected")


def m14(s, d):
    h = event_history(s, d).withColumn("pred", w.lagged_mean("value", "subject", 20)).withColumn("spread", F.lit(30.0)).where("pred IS NOT NULL").withColumn("bucket", F.floor(F.col("pred") / 20))
    return rounded(m.conformal_scales(h, "bucket", "pred", "value", "spread"))


def _probabilities(s, d):
    h = frame(s, d).where("form IS NOT NULL")
    return h.withColumn("p", F.least(F.greatest(F.col("form") / 100, F.lit(0.02)), F.lit(0.98))).withColumn("outcome", (F.col("exposure") >= 50).cast("double"))


def m17(s, d):
    p = _probabilities(s, d)
    kind, scores = m.choose_calibrator(p, "p", "outcome", "subject")
    return s.createDataFrame([(k, float(v), k == kind) for k, v in scores.items()], "kind string, brier double, chosen boolean")


def m17_isotonic(s, d):
    p = _probabilities(s, d)
    out = m.fit_isotonic(p.where("season < 2"), "p", "outcome")(p.where("season = 2"))
    return a.calibration_bins(out, "calibrated", "outcome")


def m18(s, d):
    """Normal scores of counts under their own predicted distributions, and how they go with the value's."""
    mean = F.greatest(F.col("form") / 10, F.lit(0.05))
    h = frame(s, d).where("form IS NOT NULL").withColumn("c", dist.count_cdf(mean, F.lit(0.2), F.col("y")))
    h = h.withColumn("at", F.col("c.at")).withColumn("below", F.col("c.below"))
    return m.shrunk_correlation(m.pit_scores(h, "below", "at", ["event_id"]), "subject", "z", "value")


def m18_corr(s, d):
    return rounded(m.shrunk_correlation(event_history(s, d), "subject", "value", "exposure"))


def _counts(s, d):
    """Events with three counts, their expectations given form, and five exposure nodes around the form."""
    h = frame(s, d).where("form IS NOT NULL").withColumn("y2", F.floor(F.col("value") / 20).cast("double")).withColumn("y3", F.floor((F.col("value") + F.col("exposure")) / 40).cast("double"))
    rate = lambda c: F.greatest(F.coalesce(c, F.lit(1.0)), F.lit(0.05))
    return h.withColumn("m1", rate(F.col("form") / 10)).withColumn("m2", rate(w.lagged_mean("y2", "subject", 10))).withColumn("m3", rate(w.lagged_mean("y3", "subject", 10)))


def _scores(h):
    """Normal scores z1, z2, z3 of the three counts under their own expected distributions."""
    for i, (y, key) in enumerate((("y", 11), ("y2", 12), ("y3", 13)), 1):
        mean = F.col(f"m{i}")
        h = h.withColumn("c", dist.count_cdf(mean, F.lit(0.2), F.col(y)))
        h = m.pit_scores(h.withColumn("at", F.col("c.at")).withColumn("below", F.col("c.below")), "below", "at", ["event_id"], seed=key).withColumnRenamed("z", f"z{i}").drop("c", "at", "below")
    return staged(h.select("subject", "z1", "z2", "z3"), "scores")


def m18_matrix(s, d):
    """Shrunk correlation matrices of three columns, a row a subject and pair."""
    h = event_history(s, d).withColumn("both", F.col("value") + F.col("exposure"))
    r = cop.correlations(h, "subject", ["value", "exposure", "both"])
    return rounded(r.select("subject", "n", F.posexplode("rho").alias("cell", "rho")))


def m19(s, d):
    """Chances of three events together: two counts over their lines, and the sum of all three over its own."""
    h = _counts(s, d)
    rho = cop.correlations(_scores(h.where("season < 2")), "subject", ["z1", "z2", "z3"])
    t = h.where("season = 2").join(rho.select("subject", "rho"), "subject")
    share = (0.6, 0.8, 1.0, 1.2, 1.4)
    t = t.withColumn("weights", F.array(*[F.lit(x) for x in (0.1, 0.2, 0.4, 0.2, 0.1)])).withColumn("means", F.array(*[F.col(f"m{i}") * x for x in share for i in (1, 2, 3)])).withColumn("alphas", F.array(F.lit(0.1), F.lit(0.1), F.lit(0.05)))
    t = t.withColumn("line1", F.floor("m1") + 0.5).withColumn("line2", F.floor("m2") + 0.5).withColumn("line3", F.floor(F.col("m1") + F.col("m2") + F.col("m3")) + 0.5)
    asked = [cop.Condition((0,), "line1"), cop.Condition((1,), "line2"), cop.Condition((0, 1, 2), "line3")]
    t = t.select("event_id", "line1", "line2", "line3", "weights", "means", "alphas", "rho")
    return cop.joint_probability(t, "weights", "means", "alphas", "rho", asked).select("event_id", "line1", "line2", "line3", F.round("joint", 6).alias("joint"))


#: Quantiles of a bucket's residuals: that many equally likely exposures.
NODES = [(k + 0.5) / 25 for k in range(25)]
#: Nodes of the query that has a SQL twin.
FEW_NODES = [0.1, 0.3, 0.5, 0.7, 0.9]


def _with_nodes(h, past, levels, exact=False):
    """h with exposures: the last twenty rows' mean plus the residuals of rows of like means."""
    bucket = F.least(F.floor(F.col("pred") / 10), F.lit(9)).cast("int")
    table = pro.residual_table(past.where("pred IS NOT NULL").withColumn("bucket", bucket).withColumn("resid", F.col("value") - F.col("pred")), "bucket", "resid", levels, exact=exact)
    h = h.withColumn("bucket", bucket).join(F.broadcast(table.select("bucket", "q")), "bucket")  # ten rows at most
    return h.withColumn("exposures", pro.exposure_nodes(F.col("pred"), F.col("q"), 1.0))


def m20(s, d):
    """Projections of the last season: fitted rate in both scenarios where the side isn't known, 25 exposures, fitted dispersion."""
    h = frame(s, d).withColumn("pred", w.lagged_mean("value", "subject", 20)).withColumn("pred_sd", F.stddev_samp("value").over(w.series("subject").rowsBetween(-20, -1))).withColumn("games", w.prior_count("subject"))
    train = h.where("season < 2")
    model = m.poisson_rate(train, "y", FEATURES, "minutes")
    alpha = F.lit(m.dispersion(m.predict_rate(model, train.where("form IS NOT NULL"), "minutes"), "y", "expected"))
    future = _with_nodes(h.where("season = 2"), train, NODES)
    side = F.when(F.col("level") != "view", F.col("home"))  # not announced for these
    nodes = pro.scenario_nodes(side, m.rate_column(model, {"home_n": F.lit(1.0)}), m.rate_column(model, {"home_n": F.lit(0.0)}), F.col("exposures"))
    out = pro.project(future.withColumn("nodes", nodes), "nodes", alpha)
    low, high = pro.mean_interval(F.col("mean"), alpha, F.col("games"), F.col("pred"), F.col("pred_sd"))
    return out.select("event_id", "y", side.isNull().alias("both_sides"), "mean", "median", "lo", "hi", "over", "under", "push", low.alias("mean_low"), high.alias("mean_high"))


def m20_mixture(s, d):
    """The mixture alone, for given rates: a twentieth of form, a tenth more at home."""
    h = frame(s, d).withColumn("pred", w.lagged_mean("value", "subject", 20))
    future = _with_nodes(h.where("season = 2 AND form IS NOT NULL AND pred IS NOT NULL"), h.where("season < 2"), FEW_NODES, exact=True)
    rate = F.col("form") / 500
    side = F.when(F.col("level") != "view", F.col("home"))
    out = pro.project(future.withColumn("nodes", pro.scenario_nodes(side, rate * 1.1, rate * 0.9, F.col("exposures"))), "nodes", F.lit(0.25))
    return rounded(out.select("event_id", "mean", F.col("median").cast("long").alias("median"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "over", "under"), 5)


def m21_model(s, d):
    """Shares of projection - neutral of the fitted model: form, rest, exposure, and the side, whose neutral state is both halves."""
    h = frame(s, d)
    train, test = h.where("season < 2"), h.where("season = 2")
    model = m.poisson_rate(train, "y", FEATURES, "minutes")
    mean = train.agg(*[F.avg(c).alias(c) for c in ("form", "recent", "minutes")]).first()
    groups = {"form": {"form": F.lit(mean["form"]), "recent": F.lit(mean["recent"])}, "rest": {"rest": F.lit(1.0)}, "exposure": {"minutes": F.lit(mean["minutes"])}}
    expected = lambda own: m.rate_column(model, own) * own.get("minutes", F.col("minutes"))
    out = pro.contributions(test, groups, expected, {"side": "home_n"})
    return out.select("event_id", "projection", "neutral", "phi_form", "phi_rest", "phi_exposure", "phi_side")


def m21(s, d):
    h = event_history(s, d)
    base = h.agg(F.avg("value").alias("v0"), F.avg("exposure").alias("e0"))
    h = h.crossJoin(F.broadcast(base))
    groups = ["size", "time", "home"]

    def value(on: frozenset):
        v = F.col("value") if "size" in on else F.col("v0")
        e = F.col("exposure") if "time" in on else F.col("e0")
        k = F.when(F.col("home"), 1.2).otherwise(0.8) if "home" in on else F.lit(1.0)
        return v * e * k / 100

    sets = [frozenset(c) for k in range(4) for c in itertools.combinations(groups, k)]
    return rounded(m.shapley(h, groups, {x: value(x) for x in sets}).select("event_id", *[f"phi_{g}" for g in groups]), 5)


def _rated(s, d, *more):
    """Frames with the level's rating before the day, relative to all levels'; `more` columns than the models need.

    Fits and predictions read it often, so the frame is written once, and so are the ratings, a row a level and day.
    """
    f = staged(frame(s, d).select("event_id", "level", "d", "season", *FEATURES, "y", "minutes", *more), "frame")
    day = f.groupBy("level", "d").agg(F.avg("y").alias("y"), F.sum("y").alias("total"), F.count("y").alias("n")).withColumn("ts", F.col("d"))
    league = day.agg(F.try_divide(F.sum("total"), F.sum("n")).alias("league"))
    own = day.select("level", "d", w.lagged_mean("y", "level", 10, ["ts"]).alias("rating")).crossJoin(F.broadcast(league))
    own = staged(own.select("level", "d", (F.col("rating") / F.col("league")).alias("rating")), "ratings")
    return f.join(F.broadcast(own), ["level", "d"], "left").withColumn("short_form", F.col("form") / 10)


_BENCH = ("short_form", "rating", "home_n")
_CANDIDATES = {
    "benchmark": (lambda t: m.benchmark(t, "y", *_BENCH), lambda fitted, t: m.predict_benchmark(fitted, t, *_BENCH)),
    "glm": (lambda t: m.poisson_rate(t, "y", FEATURES, "minutes"), lambda fitted, t: m.predict_rate(fitted, t, "minutes")),
    "boosted": (lambda t: m.boosted_rate(t, "y", FEATURES, "minutes", valid=F.col("event_id") % 5 == 0, rounds=12, rate=0.3, patience=2), lambda fitted, t: m.predict_boosted(fitted, t, "minutes")),
}


def m15(s, d):
    f = w.own_dispersion(_rated(s, d, "subject", "ts"), "subject", "y", 0.3)
    fitted = m.benchmark(f.where("season < 2"), "y", *_BENCH)
    return m.predict_benchmark(fitted, f.where("season = 2"), *_BENCH).select("event_id", "y", "expected", "alpha")


def m16(s, d):
    f = _rated(s, d)
    best, errors, _ = m.choose_model(_CANDIDATES, f.where("season = 0"), f.where("season = 1"), "y")
    return s.createDataFrame([(k, e, k == best) for k, e in errors.items()], "candidate string, mae double, chosen boolean")


def m22(s, d):
    """Scores of every candidate and of the last rows' mean, fitted on earlier seasons; one read of the last season scores them all."""
    f = _rated(s, d)
    train, t = f.where("season < 2"), f.where("season = 2 AND form IS NOT NULL AND recent IS NOT NULL")
    for name, (fit, predict) in _CANDIDATES.items():
        t = predict(fit(train), t).withColumnRenamed("expected", name)
    t = t.withColumn("last_rows", F.col("recent") / 10).withColumn("hit", (F.col("y") > 0).cast("double"))
    models = [*_CANDIDATES, "last_rows"]
    for name in models:
        t = t.withColumn(f"p_{name}", 1 - F.exp(-F.greatest(F.col(name), F.lit(1e-6))))  # P(Y > 0) of a Poisson count
    scores = [F.struct(F.lit(name).alias("model"), *a.point_scores(name, "y"), *a.probability_scores(f"p_{name}", "hit"), F.count("*").alias("n")) for name in models]
    return t.groupBy("season").agg(F.array(*scores).alias("scores")).select("season", F.inline("scores"))


def m23(s, d):
    """What a group of features adds: errors of the model with and without it on the same rows."""
    train, test = _split(s, d)
    out = None
    for name, features in (("with", FEATURES), ("without", [c for c in FEATURES if c != "home_n"])):
        own = m.predict_rate(m.poisson_rate(train, "y", features, "minutes"), test, "minutes").agg(F.lit(name).alias("proxy"), *a.point_scores("expected", "y"), F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


def m8(s, d):
    q = event_history(s, d).groupBy("subject").agg(F.percentile("exposure", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    pmf = dist.pmf_of_quantiles(F.col("q"), [0.1, 0.5, 0.9], 60)
    return rounded(q.select("subject", F.posexplode(pmf).alias("k", "p")))


_EDGES = "CASE WHEN e >= x4 THEN 1.0 WHEN e >= x3 THEN 0.9 + 0.1 * (e - x3) / (x4 - x3) WHEN e >= x2 THEN 0.5 + 0.4 * (e - x2) / (x3 - x2) WHEN e >= x1 THEN 0.1 + 0.4 * (e - x1) / (x2 - x1) ELSE 0.1 * (e + 0.5) / (x1 + 0.5) END"


_PAIRS = ((1, 2), (1, 3), (2, 3))
_MIXTURE_SQL = f"""WITH a AS (SELECT *, count(exposure) OVER (PARTITION BY subject ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM {E}),
  f AS (SELECT *, sum(exposure * pow(2.0, i / 10.0)) OVER b / sum(pow(2.0, i / 10.0)) OVER b AS form, avg(value) OVER (PARTITION BY subject ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS pred FROM a
    WINDOW b AS (PARTITION BY subject ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  g AS (SELECT *, CAST(least(floor(pred / 10), 9) AS INTEGER) AS bucket FROM f WHERE pred IS NOT NULL), r AS (SELECT bucket, value - pred AS x FROM g WHERE season < 2),
  q AS (SELECT bucket, CASE WHEN count(*) >= 200 THEN quantile_cont(x, {FEW_NODES}) ELSE (SELECT quantile_cont(x, {FEW_NODES}) FROM r) END AS q FROM r GROUP BY 1),
  n AS (SELECT event_id, greatest(pred + unnest(q), 1.0) AS e, form / 500 AS rate, CASE WHEN level <> 'view' THEN home END AS side FROM g JOIN q USING (bucket) WHERE season = 2 AND form IS NOT NULL),
  m AS (SELECT event_id, 0.2 * CASE WHEN side IS NULL THEN 0.5 ELSE 1.0 END AS w, e * rate * h AS m FROM n CROSS JOIN (VALUES (1.1), (0.9)) v(h) WHERE side IS NULL OR side = (h > 1)),
  t AS (SELECT event_id, sum(w * m) AS mean, CAST(ceil(max(m) + 20 * sqrt(max(m) + 0.25 * max(m) * max(m)) + 20) AS BIGINT) AS top FROM m GROUP BY 1),
  p AS (SELECT event_id, mean, k, sum(w * exp(lgamma(k + 4) - lgamma(4) - lgamma(k + 1) - 4 * ln(1 + 0.25 * m) + k * (ln(0.25 * m) - ln(1 + 0.25 * m)))) AS p FROM m JOIN t USING (event_id) CROSS JOIN LATERAL (SELECT unnest(range(0, top + 1)) AS k) GROUP BY 1, 2, 3),
  c AS (SELECT *, sum(p) OVER (PARTITION BY event_id ORDER BY k) / sum(p) OVER (PARTITION BY event_id) AS c, p / sum(p) OVER (PARTITION BY event_id) AS o FROM p)
  SELECT event_id, round(any_value(mean), 5) AS mean, min(k) FILTER (c >= 0.5 - 1e-12) AS median, min(k) FILTER (c >= 0.05 - 1e-12) AS lo, min(k) FILTER (c >= 0.95 - 1e-12) AS hi,
   round(coalesce(sum(o) FILTER (k > floor(mean) + 0.5), 0), 5) AS over, round(coalesce(sum(o) FILTER (k < floor(mean) + 0.5), 0), 5) AS under FROM c GROUP BY 1"""



def _grid_sql(rounds: int = 3, points: int = 25, low: float = 1e-4, high: float = 4.0) -> str:
    """The likelihood on a grid of logarithms, then on a finer one between the best point's neighbours."""
    parts = [f"c AS MATERIALIZED (SELECT CAST(y AS DOUBLE) AS y, m, count(*) AS n FROM (SELECT exposure // 10 AS y, greatest(form / 10, 0.05) AS m FROM f WHERE form IS NOT NULL) GROUP BY 1, 2)", f"e0 AS (SELECT ln(CAST({low} AS DOUBLE)) AS lo, ln(CAST({high} AS DOUBLE)) AS hi)"]
    for r in range(rounds):
        parts += [
            f"g{r} AS (SELECT i, exp(lo + (hi - lo) * i / {points - 1}) AS a FROM e{r} CROSS JOIN range(0, {points}) t(i))",
            f"l{r} AS MATERIALIZED (SELECT i, a, sum(n * (y * ln(a) + lgamma(y + 1 / a) - lgamma(1 / a) + y * ln(m) - (y + 1 / a) * ln(1 + a * m))) AS l FROM g{r} CROSS JOIN c GROUP BY 1, 2)",
            f"b{r} AS (SELECT arg_max(i, l) AS i FROM l{r})",
            f"e{r + 1} AS (SELECT ln((SELECT a FROM l{r} WHERE i = greatest(b{r}.i - 1, 0))) AS lo, ln((SELECT a FROM l{r} WHERE i = least(b{r}.i + 1, {points - 1}))) AS hi FROM b{r})",
        ]
    frame = f"""a AS (SELECT *, count(exposure) OVER (PARTITION BY subject ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM {E}), f AS (SELECT exposure, sum(exposure * pow(2.0, i / 10.0)) OVER b / sum(pow(2.0, i / 10.0)) OVER b AS form FROM a
      WINDOW b AS (PARTITION BY subject ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
    return f"WITH {frame}, {', '.join(parts)} SELECT round(arg_max(a, l), 6) AS alpha FROM l{rounds - 1}"


QUERIES = [
    Query("m6_dispersion", m6, _grid_sql()),
    Query("m8_quantile_pmf", m8, f"""WITH q AS (SELECT subject, quantile_cont(exposure, 0.1) AS x1, quantile_cont(exposure, 0.5) AS x2, quantile_cont(exposure, 0.9) AS x3 FROM {E} GROUP BY 1),
      g AS (SELECT *, x3 + 2 * greatest(x3 - x2, 1) + 1 AS x4, CAST(unnest(range(0, 61)) AS INTEGER) AS k FROM q), h AS (SELECT *, k + 0.5 AS e FROM g),
      c AS (SELECT subject, k, {_EDGES} AS c FROM h), m AS (SELECT subject, k, greatest(0.0, c - coalesce(lag(c) OVER (PARTITION BY subject ORDER BY k), 0)) AS p FROM c)
      SELECT subject, k, round(p / sum(p) OVER (PARTITION BY subject), 6) AS p FROM m"""),
    Query("m15_benchmark", m15),
    Query("m16_chosen_model", m16),
    Query("m23_ablation", m23),
    Query("m9_poisson_glm", m9),
    Query("m10_boosted_rate", m10),
    Query("m11_boosted_quantile", m11),
    Query("m12_minutes_model", m12),
    Query("m14_conformal", m14, f"""WITH a AS (SELECT value, avg(value) OVER (PARTITION BY subject ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS pred FROM {E})
      SELECT CAST(floor(pred / 20) AS BIGINT) AS bucket, round(quantile_cont(abs(value - pred) / 30.0, 0.9), 6) AS scale, count(*) AS n FROM a WHERE pred IS NOT NULL GROUP BY 1"""),
    Query("m17_calibrators", m17),
    Query("m17_isotonic", m17_isotonic),
    Query("m18_normal_scores", m18),
    Query("m18_shrunk_correlation", m18_corr, f"""WITH l AS (SELECT corr(value, exposure) AS league FROM {E}), o AS (SELECT subject, count(*) AS n, corr(value, exposure) AS own FROM {E} GROUP BY 1)
      SELECT subject, n, round(own, 6) AS own, round(league, 6) AS league, round((n * coalesce(own, league) + 50 * league) / (n + 50), 6) AS rho FROM o CROSS JOIN l"""),
    Query("m19_joint_probability", m19),
    Query("m18_correlation_matrix", m18_matrix, f"""WITH b AS (SELECT subject, value AS x1, exposure AS x2, value + exposure AS x3 FROM {E} WHERE value IS NOT NULL AND exposure IS NOT NULL), o AS (SELECT subject, count(*) AS n, {", ".join(f"corr(x{i}, x{j}) AS r{i}{j}" for i, j in _PAIRS)} FROM b GROUP BY 1),
      l AS (SELECT {", ".join(f"corr(x{i}, x{j}) AS l{i}{j}" for i, j in _PAIRS)} FROM b), s AS (SELECT subject, n, {", ".join(f"(n * CASE WHEN isfinite(r{i}{j}) THEN r{i}{j} ELSE l{i}{j} END + 50 * l{i}{j}) / (n + 50) AS s{i}{j}" for i, j in _PAIRS)} FROM o CROSS JOIN l),
      c AS (SELECT subject, n, [1.0, s12, s13, s12, 1.0, s23, s13, s23, 1.0] AS a FROM s) SELECT subject, n, CAST(i AS INTEGER) AS cell, round(a[i + 1], 6) AS rho FROM c CROSS JOIN range(0, 9) t(i)"""),
    Query("m20_projection", m20),
    Query("m20_mixture", m20_mixture, _MIXTURE_SQL),
    Query("m21_projection_shares", m21_model),
    Query("m21_shapley", m21, f"""WITH b AS (SELECT avg(value) AS v0, avg(exposure) AS e0 FROM {E}), h AS (SELECT event_id, value AS v, exposure AS e, CASE WHEN home THEN 1.2 ELSE 0.8 END AS k, v0, e0 FROM {E} CROSS JOIN b)
      SELECT event_id, round(((v - v0) * e0 / 3 + (v - v0) * e / 6 + (v - v0) * e0 * k / 6 + (v - v0) * e * k / 3) / 100, 5) AS phi_size,
       round((v0 * (e - e0) / 3 + v * (e - e0) / 6 + v0 * (e - e0) * k / 6 + v * (e - e0) * k / 3) / 100, 5) AS phi_time,
       round((v0 * e0 / 3 + v * e0 / 6 + v0 * e / 6 + v * e / 3) * (k - 1) / 100, 5) AS phi_home FROM h"""),
    Query("m22_backtest", m22),
    Query("m24_model_frame", m24, f"""WITH a AS (SELECT *, count(exposure) OVER (PARTITION BY subject ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM {E})
      SELECT event_id, round(sum(exposure * pow(2.0, i / 10.0)) OVER b / sum(pow(2.0, i / 10.0)) OVER b, 6) AS form, round(avg(exposure) OVER (PARTITION BY subject ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS recent,
       d - lag(d) OVER (PARTITION BY subject ORDER BY ts, event_id) AS rest, CAST(value > 50 AS BIGINT) AS home_n, CAST(exposure // 10 AS DOUBLE) AS y FROM a
      WINDOW b AS (PARTITION BY subject ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
]
