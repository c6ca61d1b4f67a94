"""The driver's tables in the roles that operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.columns import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str):
    return (micros(c) / 1e6).cast("double")


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock levels: owner, ware, t (s), ord, level, raw."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("ware"), seconds("ts").alias("t"), F.col("event_id").alias("ord"), F.col("value").alias("level"), F.col("props").alias("raw"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: buyer, seller, ware, amount, total, price, t (s), day."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return l.join(o.select("o_orderkey", "o_custkey"), l["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("buyer"), F.col("l_suppkey").alias("seller"), F.col("l_partkey").alias("ware"), F.col("l_quantity").alias("amount"), F.col("l_extendedprice").alias("total"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), seconds("l_shipdate").alias("t"), F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open offers: place (supplier's nation), owner, ware, side, price, amount, flag."""
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return l.join(s.select("s_suppkey", "s_nationkey"), l["l_suppkey"] == s["s_suppkey"]).select(
        F.col("s_nationkey").alias("place"), F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("ware"), F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("amount"), F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"),
    )


STOCK_SQL = "stock AS (SELECT user_id AS owner, event_type AS ware, epoch_us(ts) / 1e6 AS t, event_id AS ord, value AS level, props AS raw FROM events)"
TRADES_SQL = "trades AS (SELECT o_custkey AS buyer, l_suppkey AS seller, l_partkey AS ware, l_quantity AS amount, l_extendedprice AS total, l_extendedprice / l_quantity AS price, epoch_us(l_shipdate) / 1e6 AS t, l_shipdate::DATE AS day, l_orderkey AS orderkey, l_linenumber AS line, l_returnflag AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
OFFERS_SQL = "offers AS (SELECT s_nationkey AS place, l_suppkey AS owner, l_partkey AS ware, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_extendedprice AS price, l_quantity AS amount, l_returnflag AS flag, l_orderkey AS orderkey, l_linenumber AS line FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"
