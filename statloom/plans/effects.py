"""Queries of the effect variables (X2, I13 and I15 of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import effects as e
from ..operators import windows as w
from ..session import staged
from ..sources.roles import DUEL_HISTORY_SQL, table
from .base import Query, rounded

D = DUEL_HISTORY_SQL
STATS = ("value", "part", "rate")
#: Order of the rows of one nation's customers.
ORDER = ("ts", "event_id", "subject")


def _sides(s, d):
    """Suppliers' shares of orders as in `duel_history`: a supplier's lines of an order are added up by windows over one sort by order and
    supplier, which a join by order can use too, and not in a hash table of all sides."""
    side = Window.partitionBy("event_id").orderBy("subject")
    line = table(s, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("subject"), F.col("l_extendedprice").alias("value"), "l_discount", F.col("l_quantity").alias("exposure"))
    line = line.where("event_id IS NOT NULL").repartition("event_id").withColumn("part", F.col("value") * F.col("l_discount"))  # discounts shrink better than products
    sums = [F.sum(c).over(side.rangeBetween(Window.currentRow, Window.currentRow)).alias(c) for c in ("value", "part", "exposure")]
    line = line.select("event_id", "subject", *sums, F.row_number().over(side).alias("i"), F.lag("subject").over(side).alias("last"))
    return line.where((F.col("i") == 1) | ~F.col("last").eqNullSafe(F.col("subject"))).drop("i", "last")


def effect_rows(s, d):
    """Suppliers' orders with every column of the catalogue; the customer is the opponent, and a named one where its balance is positive.

    Rows lie by supplier at the end, in order of time.
    """
    nation = table(s, d, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("venue"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("opponent"), "c_acctbal", "c_mktsegment", "c_nationkey")
    size = c.groupBy("c_nationkey").agg((F.avg("c_acctbal") / 1000).alias("opponent_height"))
    own = table(s, d, "supplier").select(F.col("s_suppkey").alias("subject"), "s_nationkey")
    named = lambda x: F.when(F.col("c_acctbal") > 0, x)
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_custkey").alias("opponent")).join(c, "opponent")
    orders = orders.select("event_id", "ts", "c_nationkey", named(F.col("c_acctbal") / 1000).alias("defender_height"), named((F.col("opponent") % 97) / 10).alias("defender_weight"), named(F.col("c_mktsegment")).alias("defender_position"))
    h = _sides(s, d).join(orders, "event_id")
    h = h.select("*", w.lagged_mean("value", "c_nationkey", 10, ORDER).alias("opponent_rating"), w.lagged_mean("exposure", "c_nationkey", 10, ORDER).alias("opponent_pace")).withColumn("d", F.to_date("ts"))
    h = h.withColumn("rest", w.days_since_previous("subject")).join(own, "subject")  # the window first, as it sorts by more than the join
    home = F.col("event_id") % 2 == 0
    h = h.withColumn("place", F.when(home, F.col("s_nationkey")).otherwise(F.col("c_nationkey"))).join(F.broadcast(nation), "place").join(F.broadcast(size), "c_nationkey")  # a row a nation each
    rest = e.rest_columns(F.col("rest"))
    return h.select(
        "subject", "value", "part", F.try_divide("part", "value").alias("rate"), home.cast("double").alias("is_home"), *[x.alias(n) for n, x in rest.items()], F.date_format("d", "EEEE").alias("day_name"), F.date_format("d", "MM").alias("month"),
        (F.floor((F.dayofyear("d") - 1) / 7) + 1).cast("double").alias("week"), (F.month("d") == 12).cast("double").alias("is_playoff"), "defender_height", "defender_weight", "defender_position", "opponent_height",
        "opponent_rating", "opponent_pace", F.col("exposure").cast("double").alias("minutes"),
        (F.col("exposure") >= 30).cast("double").alias("is_starter"), (F.date_diff("d", F.lit("1960-01-01").cast("date")) / 365.25 - F.col("subject") % 15).alias("age"), "venue", (F.col("place") * 0.2).alias("altitude"), (F.col("venue") == "PERU").cast("double").alias("is_highest"),
    )


def x2(s, d):
    """The compiled design: rows, mean and mean square of every variable's every term over all rows."""
    h = staged(effect_rows(s, d), "effect-rows")  # for the levels, and for the terms
    terms = e.compile_terms(h, list(e.CATALOGUE.values()))
    cols = [(t.of.name, name, c) for t in terms.values() for name, c in zip(t.names, t.columns(), strict=True)]
    row = h.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.avg(c * c).alias("square")).alias(f"c{i}") for i, (_, _, c) in enumerate(cols)])
    each = F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(t).alias("term"), F.col(f"c{i}.n").alias("n"), F.col(f"c{i}.mean").alias("mean"), F.col(f"c{i}.square").alias("square")) for i, (v, t, _) in enumerate(cols)])
    return rounded(row.select(F.inline(each)), 5)


def i15(s, d):
    """All variables of the catalogue on three statistics."""
    return s.createDataFrame(e.effects(effect_rows(s, d), "subject", STATS), e.SCHEMA)


def i15_plain(s, d):
    """A slope without controls for each numeric variable and statistic."""
    numeric = [v for v in e.CATALOGUE.values() if v.kind != "categorical"]
    t = s.createDataFrame(e.effects(effect_rows(s, d), "subject", STATS, numeric, controls=()), e.SCHEMA)
    return rounded(t.select("variable", "stat", "n", "groups", F.round("mean", 3).alias("mean"), F.round("r2", 6).alias("r2"), *[F.round(F.col(c) / F.greatest(F.abs("coef"), F.lit(1e-9)), 5).alias(c) for c in ("se",)], F.format_string("%.5e", "coef").alias("coef")), 6)


_ROWS = f"""(WITH c AS (SELECT c_custkey AS opponent, c_acctbal, c_mktsegment, c_nationkey FROM customer), z AS (SELECT c_nationkey, avg(c_acctbal) / 1000 AS opponent_height FROM c GROUP BY 1),
 h AS (SELECT h.*, part / nullif(value, 0) AS rate, c_acctbal, c_mktsegment, c_nationkey, opponent_height, h.event_id % 2 = 0 AS home, CASE WHEN h.event_id % 2 = 0 THEN s_nationkey ELSE c_nationkey END AS place,
  h.d - lag(h.d) OVER (PARTITION BY h.subject ORDER BY h.ts, h.event_id) AS rest, avg(value) OVER k AS opponent_rating, avg(exposure) OVER k AS opponent_pace
  FROM {D} h JOIN c USING (opponent) JOIN supplier ON s_suppkey = h.subject JOIN z USING (c_nationkey) WINDOW k AS (PARTITION BY c_nationkey ORDER BY h.ts, h.event_id, h.subject ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
 SELECT subject, value, part, rate, CAST(home AS DOUBLE) AS is_home, CAST(rest <= 1 AS DOUBLE) AS is_back_to_back, CAST(CASE WHEN rest IS NOT NULL THEN least(rest, 3) END AS DOUBLE) AS rest_days, CASE WHEN rest >= 3 THEN '3+' ELSE CAST(rest AS VARCHAR) END AS rest_bucket,
  dayname(d) AS day_name, strftime(d, '%m') AS month, CAST((dayofyear(d) - 1) // 7 + 1 AS DOUBLE) AS week, CAST(month(d) = 12 AS DOUBLE) AS is_playoff, CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000 END AS defender_height,
  CASE WHEN c_acctbal > 0 THEN opponent % 97 / 10.0 END AS defender_weight, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS defender_position, opponent_rating, opponent_pace, CAST(exposure AS DOUBLE) AS minutes, CAST(exposure >= 30 AS DOUBLE) AS is_starter,
  (d - DATE '1960-01-01') / 365.25 - subject % 15 AS age, n_name AS venue, place * 0.2 AS altitude, CAST(n_name = 'PERU' AS DOUBLE) AS is_highest FROM h JOIN nation ON n_nationkey = place)"""


def _design_sql() -> str:
    out = []
    for v in e.CATALOGUE.values():
        if v.kind != "categorical":
            out.append(f"SELECT '{v.name}' AS variable, '{v.name}' AS term, count({v.column}) AS n, round(avg({v.column}), 5) AS mean, round(avg({v.column} * {v.column}), 5) AS square FROM r")
            continue
        omitted = f"(SELECT max({v.column}) FROM r)" if v.coding == "sum" else f"(SELECT {v.column} FROM r WHERE {v.column} IS NOT NULL GROUP BY 1 ORDER BY {v.column} = '{v.reference}' DESC, count(*) DESC, 1 LIMIT 1)"
        rest = f"CASE WHEN {v.column} = o THEN {-1.0 if v.coding == 'sum' else 0.0} WHEN {v.column} IS NOT NULL THEN 0.0 END"
        code = f"CASE WHEN {v.column} = x THEN 1.0 ELSE {rest} END"
        out.append(f"SELECT '{v.name}', '{v.name}=' || x, count({code}), round(avg({code}), 5), round(avg({code} * {code}), 5) FROM r CROSS JOIN (SELECT DISTINCT {v.column} AS x FROM r WHERE {v.column} IS NOT NULL) CROSS JOIN (SELECT {omitted} AS o) WHERE x <> o GROUP BY x")
    return f"WITH r AS MATERIALIZED (SELECT * FROM {_ROWS}) " + " UNION ALL ".join(out)


def _slopes_sql() -> str:
    numeric = [v for v in e.CATALOGUE.values() if v.kind != "categorical"]
    long = " UNION ALL ".join(f"SELECT '{v.name}' AS variable, '{y}' AS stat, subject, {v.column} AS x, {y} AS y FROM r WHERE {v.column} IS NOT NULL AND {y} IS NOT NULL" for v in numeric for y in STATS)
    return f"""WITH r AS MATERIALIZED (SELECT * FROM {_ROWS}), l AS ({long}), g AS (SELECT *, x - avg(x) OVER p AS xw, y - avg(y) OVER p AS yw, count(*) OVER p AS k FROM l WINDOW p AS (PARTITION BY variable, stat, subject)),
      b AS (SELECT variable, stat, sum(xw * yw) / sum(xw * xw) AS coef, sum(xw * xw) AS xx, sum(yw * yw) AS yy, count(*) AS n, count(DISTINCT subject) AS groups, avg(y) AS mean FROM g WHERE k > 1 GROUP BY 1, 2),
      s AS (SELECT variable, stat, sum(s * s) AS meat FROM (SELECT g.variable, g.stat, subject, sum(xw * (yw - coef * xw)) AS s FROM g JOIN b USING (variable, stat) WHERE k > 1 GROUP BY 1, 2, 3) GROUP BY 1, 2)
      SELECT variable, stat, n, groups, round(mean, 3) AS mean, round(coef * coef * xx / yy, 6) AS r2, round(sqrt(groups / (groups - 1.0) * meat) / xx / greatest(abs(coef), 1e-9), 5) AS se, printf('%.5e', coef) AS coef FROM b JOIN s USING (variable, stat) WHERE xx > 1e-12 * n"""


QUERIES = [
    Query("x2_variable_design", x2, _design_sql()),
    Query("i15_slopes", i15_plain, _slopes_sql()),
    Query("i15_catalogue_effects", i15),
]
