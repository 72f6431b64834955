"""Star-schema tables in the roles that the operators work on.

A history has a row an event of a subject: subject, event_id, ts, d (date), season,
level (the opponent or condition), value, exposure, home.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events: a season is ten days, exposure is the property k."""
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"), "event_id", ts.alias("ts"), F.to_date("ts").alias("d"), F.floor((F.dayofmonth("ts") - 1) / 10).cast("int").alias("season"), F.col("event_type").alias("level"), "value", k.alias("exposure"), (k >= 50).alias("home")
    )


EVENT_HISTORY_SQL = """(SELECT user_id AS subject, event_id, ts, CAST(ts AS DATE) AS d, CAST(floor((day(ts) - 1) / 10) AS INTEGER) AS season,
 event_type AS level, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS exposure, CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 AS home FROM events)"""


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders: a season is a year."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.to_date("o_orderdate").alias("d"), F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("level"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("position"))


ORDER_HISTORY_SQL = """(SELECT o_custkey AS subject, o_orderkey AS event_id, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INTEGER) AS season,
 o_orderpriority AS level, o_totalprice AS value, o_orderstatus AS position FROM orders)"""


def duel_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' shares of orders, a row an order and supplier: lines are added up, as line numbers repeat.

    The join comes first, so that lines are dealt by order once: adding them up by order and supplier needs no other shuffle.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "l_suppkey", "o_orderdate", "o_custkey").agg(
        F.sum("l_quantity").alias("exposure"), F.sum("l_extendedprice").alias("value"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("part"), F.max("l_returnflag").alias("position")
    )
    return lines.select(
        F.col("l_suppkey").alias("subject"), F.col("l_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.to_date("o_orderdate").alias("d"), F.year("o_orderdate").alias("season"), F.col("o_custkey").alias("opponent"), "exposure", "value", "part", "position"
    )


DUEL_HISTORY_SQL = """(SELECT l_suppkey AS subject, l_orderkey AS event_id, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INTEGER) AS season, o_custkey AS opponent,
 sum(l_quantity) AS exposure, sum(l_extendedprice) AS value, sum(l_extendedprice * l_discount) AS part, max(l_returnflag) AS position
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, l_orderkey, o_orderdate, o_custkey)"""
