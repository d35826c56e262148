"""Canonical frames from the driver's tables, each with the same frame in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(name: str):
    return F.unix_micros(F.col(name).cast("timestamp")) / 1e6


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as an exchange sends them: decimal text, maker flag, milliseconds."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    return e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("T"),
        F.format_string("%.1f", 100 + F.col("event_id") % 50 / 10.0).alias("p"), F.get_json_object("props", "$.k").alias("q"), (~F.col("event_type").isin("purchase", "signup")).alias("m"),
    )


RAW_TRADES_SQL = """
raw_trades AS (SELECT 'S' || CAST(user_id % 4 AS VARCHAR) AS symbol, event_id AS seq, epoch_us(ts) // 1000 AS T, printf('%.1f', 100 + (event_id % 50) / 10.0) AS p,
  json_extract_string(props, '$.k') AS q, event_type NOT IN ('purchase', 'signup') AS m FROM events WHERE event_type <> 'error')"""


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best bid and ask of each view and click."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    bid = 100 + F.floor(F.col("value") / 20) * 0.5
    return e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"), F.col("event_id").alias("seq"), _seconds("ts").alias("ts"),
        bid.alias("bid"), (F.col("value") * 2).alias("bid_qty"), (bid + 0.5).alias("ask"), (F.col("value") + F.col("event_id") % 7).alias("ask_qty"),
    )


BOOK_SQL = """
book AS (SELECT 'S' || CAST(user_id % 4 AS VARCHAR) AS symbol, event_id AS seq, epoch_us(ts) / 1e6 AS ts, 100 + floor(value / 20) * 0.5 AS bid, value * 2 AS bid_qty,
  100 + floor(value / 20) * 0.5 + 0.5 AS ask, value + event_id % 7 AS ask_qty FROM events WHERE event_type IN ('view', 'click'))"""


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles of each symbol."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    hour = F.floor(_seconds("ts") / 3600).cast("bigint") * 3600
    return e.groupBy(F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"), hour.alias("open_time")).agg(F.sum("value").alias("quote_volume"), F.count(F.lit(1)).alias("trade_count")).select(
        "symbol", "open_time", (F.col("open_time") + 3600).alias("close_time"), "quote_volume", "trade_count", F.lit(True).alias("is_closed"))


CANDLES_SQL = """
candles AS (SELECT 'S' || CAST(user_id % 4 AS VARCHAR) AS symbol, CAST(floor(epoch_us(ts) / 3600e6) AS BIGINT) * 3600 AS open_time, sum(value) AS quote_volume, count(*) AS trade_count
  FROM events WHERE event_type <> 'error' GROUP BY 1, 2)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order book updates (symbol, seq, side, price, qty): orders by customer group."""
    o = table(spark, sf_dir, "orders")
    side = F.when(F.col("o_orderstatus") == "F", "bid").otherwise("ask")
    step = F.floor(F.col("o_totalprice") / 50000)
    price = F.when(F.col("o_orderstatus") == "F", 100 - step * 0.05).otherwise(100.05 + step * 0.05)
    qty = F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.floor(F.col("o_totalprice") / 1000))
    return o.select(F.concat(F.lit("B"), (F.col("o_custkey") % 5).cast("string")).alias("symbol"), F.col("o_orderkey").alias("seq"), side.alias("side"), F.round(price, 2).alias("price"), qty.cast("double").alias("qty"))


LEVELS_SQL = """
levels AS (SELECT 'B' || CAST(o_custkey % 5 AS VARCHAR) AS symbol, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'bid' ELSE 'ask' END AS side,
  round(CASE WHEN o_orderstatus = 'F' THEN 100 - floor(o_totalprice / 50000) * 0.05 ELSE 100.05 + floor(o_totalprice / 50000) * 0.05 END, 2) AS price,
  CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE floor(o_totalprice / 1000) END AS qty FROM orders)"""


def level_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``levels`` with a time: a minute for each order key; symbols are called as those of trades."""
    return levels(spark, sf_dir).withColumns({"symbol": F.regexp_replace("symbol", "^B", "S"), "ts": 1_704_067_200.0 + F.col("seq") * 60.0})


LEVEL_UPDATES_SQL = f"""{LEVELS_SQL},
updates AS (SELECT replace(symbol, 'B', 'S') AS symbol, seq, side, price, qty, 1704067200.0 + seq * 60.0 AS ts FROM levels)"""


def grid(frame: DataFrame, step: int) -> DataFrame:
    """(symbol, t): whole multiples of ``step`` seconds that each symbol's rows span, the end included.

    One row for each symbol and step; nothing is collected.
    """
    spans = frame.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    at = lambda x: (F.ceil(F.col(x) / step) * step).cast("bigint")
    return spans.select("symbol", F.explode(F.sequence(at("lo"), at("hi"), F.lit(step).cast("bigint"))).alias("t"))
