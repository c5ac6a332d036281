"""The driver's tables as ticks, quotes, panels, intervals and probabilities, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import micros


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, ts, at (microseconds), seq, user_id, price, price_c (cents), vol, dollar_c; price and vol above zero."""
    x = read(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", micros(F.col("ts")).alias("at"), F.col("event_id").alias("seq"), "user_id", F.col("value").alias("price"), F.round(F.col("value") * 100).cast("long").alias("price_c"), F.get_json_object("props", "$.k").cast("long").alias("vol"))
    return x.filter("price_c > 0 and vol > 0").withColumn("dollar_c", F.col("price_c") * F.col("vol"))


TICKS = """ticks AS (SELECT event_type AS series_id, ts, epoch_us(ts) AS at, event_id AS seq, user_id, value AS price, CAST(round(value*100) AS BIGINT) AS price_c,
  CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS vol, CAST(round(value*100) AS BIGINT)*CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS dollar_c
  FROM events WHERE round(value*100)>0 AND CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT)>0)"""


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many ticks at one time: series_id, ts, price, vol, dollar and a unique order."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("vol"), F.col("l_extendedprice").alias("dollar"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


LINE_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "dollar"]
LINES = """ticks_li AS (SELECT l_returnflag AS series_id, l_shipdate AS ts, l_extendedprice/l_quantity AS price, l_quantity AS vol, l_extendedprice AS dollar, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic book over line_ticks: the columns of an order-book event."""
    x = line_ticks(spark, sf_dir)
    action = F.element_at(F.array(*[F.lit(a) for a in "ACMRT"]), (F.col("l_orderkey") % 5 + 1).cast("int"))
    side = F.when(F.col("series_id") == "A", "A").when(F.col("series_id") == "N", "B").otherwise("N")
    return x.withColumns({
        "ts_recv": F.col("ts").cast("timestamp"), "ts_event": F.col("ts").cast("timestamp"), "action": action, "side": side, "size": F.col("vol").cast("long"), "flags": (F.col("l_orderkey") % 16).cast("int"), "sequence": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "symbol": F.col("series_id"),
        "bid_px_00": F.col("price") - 0.25 * (1 + F.col("l_partkey") % 3), "ask_px_00": F.col("price") + 0.25 * (1 + F.col("l_suppkey") % 3), "bid_sz_00": F.col("vol").cast("long"), "ask_sz_00": 1 + F.col("l_partkey") % 50, "bid_ct_00": (1 + F.col("l_linenumber")).cast("long"), "ask_ct_00": 1 + F.col("l_suppkey") % 5,
    })


QUOTES = LINES + """, quotes AS (SELECT *, CASE l_orderkey%5 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'M' WHEN 3 THEN 'R' ELSE 'T' END AS action, CASE series_id WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'N' END AS side,
  CAST(vol AS BIGINT) AS size, CAST(l_orderkey%16 AS INTEGER) AS flags, l_orderkey*10+l_linenumber AS sequence, series_id AS symbol, price-0.25*(1+l_partkey%3) AS bid_px, price+0.25*(1+l_suppkey%3) AS ask_px,
  CAST(vol AS BIGINT) AS bid_sz, 1+l_partkey%50 AS ask_sz, CAST(1+l_linenumber AS BIGINT) AS bid_ct, 1+l_suppkey%5 AS ask_ct FROM ticks_li)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, week, price): mean order prices by priority and week, in whole cents."""
    x = read(spark, sf_dir, "orders")
    cents = F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count("*")) / 100
    return x.groupBy(F.col("o_orderpriority").alias("asset"), F.date_trunc("week", "o_orderdate").cast("date").alias("week")).agg(cents.alias("price"))


PANEL = """panel AS (SELECT o_orderpriority AS asset, CAST(date_trunc('week',o_orderdate) AS DATE) AS week, round(CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/count(*))/100 AS price FROM orders GROUP BY 1,2)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with an end: t0 = at, t1 = at + (1 + seq % 24) hours, p and label of a bet."""
    x = ticks(spark, sf_dir)
    return x.withColumns({"t0": F.col("at"), "t1": F.col("at") + (1 + F.col("seq") % 24) * 3_600_000_000, "p": 0.5 + (F.col("vol") + 0.5) / 200, "label": F.col("vol") % 2, "w": 1 + F.col("user_id") % 3})


INTERVALS = TICKS + """, iv AS (SELECT *, at AS t0, at+(1+seq%24)*3600000000 AS t1, 0.5::DOUBLE+(vol+0.5::DOUBLE)/200 AS p, vol%2 AS label, 1+user_id%3 AS w FROM ticks)"""
