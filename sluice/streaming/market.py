"""Streaming twins of the market queries, and sinks that may be repeated."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def flow_stream(trades: DataFrame, window: int, slide: int, late: str = "1 hour") -> DataFrame:
    """Sums and balance of sliding windows over a trade stream (time column ``time``), with a watermark."""
    out = trades.withWatermark("time", late).groupBy("symbol", F.window("time", f"{window} seconds", f"{slide} seconds")).agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum("quote_qty").alias("total_quote"), F.sum(F.when(F.col("side") == "BUY", F.col("quote_qty")).otherwise(0.0)).alias("buy_quote"))
    sell = F.col("total_quote") - F.col("buy_quote")
    high = F.greatest(F.col("buy_quote"), sell)
    return out.select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "trade_count", "total_quote", "buy_quote", F.when(high > 0, F.least(F.col("buy_quote"), sell) / F.when(high > 0, high)).otherwise(0.0).alias("balance"))


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """Rows with a watermark on ``ts`` (seconds), from which idle states expire."""
    return rows.withColumn("_time", F.timestamp_seconds("ts")).withWatermark("_time", late)


def _keep_until(state, newest: float, idle_ms: int) -> None:
    state.setTimeoutTimestamp(max(int(newest * 1000), state.getCurrentWatermarkMs()) + idle_ms)


def refills_stream(book: DataFrame, limit: float, late: str = "1 hour", idle: str = "1 hour") -> DataFrame:
    """Refill hits of a best bid and ask stream: the last update of each symbol is the state, dropped once the watermark is ``idle`` past it."""
    columns, idle_ms = ["bid", "bid_qty", "ask", "ask_qty"], _milliseconds(idle)

    def hits(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        before = rows[columns].shift()
        if state.exists:
            before.iloc[0] = state.get
        n = sum((((rows[p] - before[p]).abs() <= 1e-12) & ((rows[q] - before[q]) * rows[p] >= limit)).astype(int) for p, q in (("bid", "bid_qty"), ("ask", "ask_qty")))
        state.update(tuple(float(x) for x in rows[columns].iloc[-1]))
        _keep_until(state, float(rows["ts"].max()), idle_ms)
        yield pd.DataFrame({"symbol": key[0], "seq": rows["seq"].to_numpy(), "refills": n.to_numpy()})

    return _timed(book, late).groupBy("symbol").applyInPandasWithState(hits, "symbol string, seq long, refills int", "bid double, bid_qty double, ask double, ask_qty double", "append", GroupStateTimeout.EventTimeTimeout)


def _milliseconds(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def trades_with_book(trades: DataFrame, book: DataFrame, late: str = "1 hour", idle: str = "1 hour") -> DataFrame:
    """Each trade of a stream with the mid price of the last book update before it, by time and then sequence.

    Both streams become one of tagged rows, with the last mid of each symbol as the state, so no
    state grows with time; a symbol that is idle is dropped. Rows of one batch are put in order;
    a trade that comes in an earlier batch than the update before it does not wait for it.
    """
    tagged = trades.select("symbol", "ts", "seq", "price", F.lit(None).cast("double").alias("mid")).unionByName(book.select("symbol", "ts", "seq", F.lit(None).cast("double").alias("price"), ((F.col("bid") + F.col("ask")) / 2).alias("mid")))
    idle_ms = _milliseconds(idle)

    def join(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "seq", "price"], kind="stable")  # of one instant and sequence the trade comes first
        last = rows["mid"].ffill()
        if state.exists:
            last = last.fillna(state.get[0])
        if last.notna().any():
            state.update((float(last.dropna().iloc[-1]),))
            _keep_until(state, float(rows["ts"].max()), idle_ms)
        own = rows["price"].notna()
        yield pd.DataFrame({"symbol": key[0], "seq": rows["seq"][own].to_numpy(), "price": rows["price"][own].to_numpy(), "mid": last[own].to_numpy()})

    return _timed(tagged, late).groupBy("symbol").applyInPandasWithState(join, "symbol string, seq long, price double, mid double", "mid double", "append", GroupStateTimeout.EventTimeTimeout)


def flow_streams(trades: DataFrame, windows: tuple[int, ...], slide: int, late: str = "1 hour") -> list[DataFrame]:
    """``flow_stream`` for several window lengths, each a query of its own on the same source, with its length as ``w``."""
    return [flow_stream(trades, w, slide, late).withColumn("w", F.lit(w)) for w in windows]


def routed(messages: DataFrame, suffix: str, schema: str) -> DataFrame:
    """The payloads of one sub-stream of a multiplexed stream (stream STRING, data STRING)."""
    return messages.where(F.col("stream").endswith(suffix)).select(F.regexp_extract("stream", "^([^@]+)", 1).alias("symbol"), F.from_json("data", schema).alias("d")).select("symbol", "d.*")


def write_once(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that overwrites the folder of its batch: a repeated batch leaves the same rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_snapshots(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest row of each key, as a table of its own for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def levels_stream(updates: DataFrame) -> DataFrame:
    """The order book as it stands (update or complete mode): the last quantity of each price of each side.

    The aggregation's state is the book; a snapshot is a batch of updates with a lower sequence.
    """
    return updates.groupBy("symbol", "side", "price").agg(F.max_by("qty", "seq").alias("qty"), F.max("seq").alias("seq"))


def baseline_stream(candles: DataFrame, rows: int) -> DataFrame:
    """The last ``rows`` closed candles' volumes of each symbol, kept as a sorted array (complete mode)."""
    kept = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("open_time", "quote_volume", "trade_count")))), 1, rows)
    return candles.where("is_closed").groupBy("symbol").agg(kept.alias("candles"))
