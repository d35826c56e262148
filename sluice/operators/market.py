"""Flow metrics of rolling windows, their states, judgements and overviews.

Windows end at the instants of an evaluation grid and look back ``w`` seconds, both ends
included. Sums, extremes and counts of values are merged from panes in two levels (``panes``);
only medians deal each row to the grid instants whose windows hold it. A null symbol is a symbol.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MarketSettings, Thresholds
from ..functions.numeric import INF, bucket_step, bucket_text, bucketed, clamp, ratio, window_text
from ..sources.shared import checkpointed
from .panes import window_parts, with_panes
from .places import joined_narrow

KEY = ["symbol", "w", "t"]
#: Sequence numbers and seconds of a stretch of a symbol's history, the unit of work of walks along it.
SEQ_STRETCH, TIME_STRETCH = 1 << 20, 86_400
#: Rows up to which short stretches of a history are taken as one.
STRETCH_ROWS = 20_000
PRIORITY = {"high": 4, "watch": 3, "active": 2, "low": 1, "warming": 0}


def trades(raw: DataFrame) -> DataFrame:
    """Typed trades from raw ones: notional, taker side from the maker flag, the size's own text."""
    price, qty = F.col("p").cast("double"), F.col("q").cast("double")
    return raw.select("symbol", "seq", (F.col("T") / 1000).alias("ts"), F.when(F.col("m"), "SELL").otherwise("BUY").alias("side"), price.alias("price"), qty.alias("qty"), F.col("q").alias("qty_text"), (price * qty).alias("quote_qty"))


def dealt(rows: DataFrame, windows: tuple[int, ...], step: int) -> DataFrame:
    """Each row once for every window length ``w`` and grid instant ``t`` with t - w <= ts <= t."""
    lengths = rows.withColumn("w", F.explode(F.array(*[F.lit(w) for w in windows])))
    first, last = F.ceil(F.col("ts") / step) * step, F.floor((F.col("ts") + F.col("w")) / step) * step
    lengths = lengths.where(first <= last)  # a window shorter than the step may hold no instant
    return lengths.withColumn("t", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint"))))


def _met(rows: DataFrame, ends: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Rows with what their stretch or window carries; null keys meet null keys, so a null symbol or order loses no row."""
    ends = ends.select(*[F.col(c).alias(f"_{c}_") for c in by], *[c for c in ends.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    return rows.join(ends, on, how).drop(*[f"_{c}_" for c in by])


def previous(rows: DataFrame, by: list[str], part: Column, order: str, columns: list[str]) -> DataFrame:
    """Add ``_prev``, a struct of ``columns`` of the row before each row in (by, order), null for the first.

    ``part`` cuts a history into stretches that follow ``order``; each is a group of its own and the
    last row of a stretch is carried to the next, so no task holds a whole history.
    """
    value = F.struct(*columns)
    dealt_rows = rows.withColumn("_part", part)
    ends = dealt_rows.groupBy(*by, "_part").agg(F.max_by(value, F.col(order)).alias("_end"))
    before = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*by).orderBy("_part")))
    inside = F.lag(value).over(Window.partitionBy(*by, "_part").orderBy(order))
    return _met(dealt_rows, before, [*by, "_part"]).withColumn("_prev", F.coalesce(inside, "_end")).drop("_part", "_end")


def carried(rows: DataFrame, by: list[str], part: Column, order: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the last value that is not null at or before each row in (by, order); stretches as in ``previous``."""
    everything = (Window.unboundedPreceding, Window.currentRow)
    dealt_rows = rows.withColumn("_part", part)
    ends = dealt_rows.groupBy(*by, "_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    before = ends.withColumn("_end", F.last("_end", True).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.last(value, True).over(Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(*everything))
    return _met(dealt_rows, before, [*by, "_part"]).withColumn(name, F.coalesce(inside, "_end")).drop("_part", "_end")


def stretch(column: str, size: int) -> Column:
    return F.floor(F.col(column) / size)


def baseline(candles: DataFrame, rows: int) -> DataFrame:
    """Median and mean volume, median count and number of the last closed candles of each symbol."""
    latest = Window.partitionBy("symbol").orderBy(F.desc("open_time"))
    kept = candles.where("is_closed").withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= rows)
    return kept.groupBy("symbol").agg(F.median("quote_volume").alias("median_volume"), F.avg("quote_volume").alias("mean_volume"), F.median("trade_count").alias("median_trades"), F.count(F.lit(1)).alias("samples"))


_FLOW = {"count": F.sum, "total": F.sum, "buy": F.sum, "turns": F.sum, "gaps": F.sum, "squares": F.sum, "first": F.min, "last": F.max}


def flow(trades: DataFrame, windows: tuple[int, ...], step: int) -> DataFrame:
    """Counts, sums, balance, switches, gaps and prices of each window, merged from panes.

    Each trade meets the one before it in its symbol's history (by seq) once; a window leaves out
    what its own first trade has to do with the one before. So trades arrive in order of ts;
    should one be late, it counts in the pane of its ts, and its switch and gap there too.
    """
    rows = previous(trades.select("symbol", "seq", "ts", "side", "price", "quote_qty"), ["symbol"], stretch("seq", SEQ_STRETCH), "seq", ["side", "ts"])
    turn, gap = F.coalesce((F.col("side") != F.col("_prev.side")).cast("int"), F.lit(0)), F.coalesce(F.col("ts") - F.col("_prev.ts"), F.lit(0.0))
    rows = with_panes(rows.withColumns({"_turn": turn, "_gap": gap}), windows, step)
    panes = rows.groupBy("symbol", "pane", "edge").agg(
        F.count(F.lit(1)).alias("count"), F.sum("quote_qty").alias("total"), F.sum(F.when(F.col("side") == "BUY", F.col("quote_qty")).otherwise(0.0)).alias("buy"), F.sum("_turn").alias("turns"),
        F.sum("_gap").alias("gaps"), F.sum(F.col("_gap") * F.col("_gap")).alias("squares"), F.min(F.struct("seq", "price", "_turn", "_gap")).alias("first"), F.max(F.struct("seq", "price")).alias("last"),
    )
    merge = [f(name).alias(name) for name, f in _FLOW.items()]
    out = window_parts(panes, ["symbol"], merge, windows, step).groupBy(*KEY).agg(*merge)
    between = F.greatest(F.col("count") - 1, F.lit(1))
    mean = (F.col("gaps") - F.col("first._gap")) / between
    spread = (F.col("squares") - F.col("first._gap") * F.col("first._gap")) / between - mean * mean
    out = out.withColumns({"_mean": mean, "_sd": F.sqrt(F.greatest(spread, F.lit(0.0)))}).select(
        *KEY, F.col("count").alias("trade_count"), F.col("total").alias("total_quote"), F.col("buy").alias("buy_quote"), (F.col("turns") - F.col("first._turn")).alias("switches"), "_mean", "_sd",
        F.col("first.price").alias("first_price"), F.col("last.price").alias("last_price"),
    )
    sell = F.col("total_quote") - F.col("buy_quote")
    high = F.greatest(F.col("buy_quote"), F.col("sell_quote"))
    out = out.withColumn("sell_quote", sell).withColumn("balance", F.when(high > 0, F.least("buy_quote", "sell_quote") / F.when(high > 0, high)).otherwise(0.0))
    out = out.withColumn("switch_rate", F.col("switches") / F.greatest(F.col("trade_count") - 1, F.lit(1)))
    cv = F.when((F.col("trade_count") >= 6) & (F.col("_mean") > 0), F.col("_sd") / F.when(F.col("_mean") > 0, F.col("_mean"))).otherwise(1.0)
    return out.withColumn("interval_cv", cv).drop("_mean", "_sd")


def _value_counts(rows: DataFrame, by: list[str], windows: tuple[int, ...], step: int) -> DataFrame:
    """How often each value of ``by`` occurs in each window, and its first seq, from counts of panes; ``rows`` has panes."""
    panes = rows.groupBy(*by, "pane", "edge").agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first"))
    return window_parts(panes, by, [F.sum("_n").alias("_n"), F.min("_first").alias("_first")], windows, step)


def concentration(counted: DataFrame, value: str, name: str) -> DataFrame:
    """The share of the most frequent value and of the five most frequent, and that value; ties to the first seen.

    ``counted``: the windows' KEY, value, and parts of its count ``_n`` and first seq ``_first``.
    """
    counted = counted.groupBy(*KEY, value).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    place = Window.partitionBy(*KEY).orderBy(F.desc("_n"), "_first")
    ranked = counted.withColumn("_all", F.sum("_n").over(Window.partitionBy(*KEY))).withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= 5)
    return ranked.groupBy(*KEY).agg(
        F.max_by(value, -F.col("_place")).alias(f"top_{name}"), (F.max("_n") / F.max("_all")).alias(f"top_{name}_rate"), (F.sum("_n") / F.max("_all")).alias(f"top5_{name}_rate"))


def concentrations(trades: DataFrame, windows: tuple[int, ...], step: int) -> DataFrame:
    """Repeats of exact size texts and of notional buckets, whose width follows the window's mean.

    A symbol's windows have few widths, so a trade is counted in its bucket of each of these, and a
    window reads the counts of its own width.
    """
    rows = with_panes(trades.select("symbol", "seq", "ts", "qty_text", "quote_qty"), windows, step)
    sizes = concentration(_value_counts(rows, ["symbol", "qty_text"], windows, step), "qty_text", "size")
    sums = rows.groupBy("symbol", "pane", "edge").agg(F.sum("quote_qty").alias("total"), F.count("quote_qty").alias("count"))
    merge = [F.sum(c).alias(c) for c in ("total", "count")]
    means = window_parts(sums, ["symbol"], merge, windows, step).groupBy(*KEY).agg(*merge)
    steps = checkpointed(means.select(*KEY, bucket_step(F.col("total") / F.col("count")).alias("_step")))
    widths = checkpointed(steps.select("symbol", "_step").distinct())
    valued = joined_narrow(rows.drop("qty_text"), widths, ["symbol"])
    valued = valued.withColumn("notional_text", bucket_text(bucketed(F.col("quote_qty"), F.col("_step")), F.col("_step")))
    counted = _value_counts(valued, ["symbol", "_step", "notional_text"], windows, step)
    own = joined_narrow(counted, steps.withColumn("_own", F.lit(True)), [*KEY, "_step"]).drop("_own")
    notionals = concentration(own, "notional_text", "notional")
    met = [sizes[c].eqNullSafe(notionals[c]) for c in KEY]
    return sizes.join(notionals, met[0] & met[1] & met[2], "left").drop(*[notionals[c] for c in KEY])


def book_flags(book: DataFrame, refill_quote: float) -> DataFrame:
    """Book updates with ``refills``: sides whose price stays while their notional grows by the limit or more."""
    rows = previous(book, ["symbol"], stretch("seq", SEQ_STRETCH), "seq", ["bid", "bid_qty", "ask", "ask_qty"])
    last = lambda c: F.col("_prev")[c]
    grown = lambda p, q: F.coalesce(((F.abs(F.col(p) - last(p)) <= 1e-12) & ((F.col(q) - last(q)) * F.col(p) >= refill_quote)).cast("int"), F.lit(0))
    return rows.withColumn("refills", grown("bid", "bid_qty") + grown("ask", "ask_qty")).drop("_prev")


def book_samples(book: DataFrame) -> DataFrame:
    """Mid, thinner side and spread of each book update, as samples."""
    mid = (F.col("bid") + F.col("ask")) / 2
    return book.select("symbol", "seq", "ts", mid.alias("mid"), F.least(F.col("bid") * F.col("bid_qty"), F.col("ask") * F.col("ask_qty")).alias("depth"), ((F.col("ask") - F.col("bid")) / mid).alias("slippage"))


def book_windows(flagged: DataFrame, windows: tuple[int, ...], step: int) -> DataFrame:
    """Rates of book updates and refills, median depth and slippage, first and last mid of each window."""
    rows = dealt(flagged.join(book_samples(flagged).drop("ts"), ["symbol", "seq"]), windows, step)
    return rows.groupBy(*KEY).agg(
        (F.count(F.lit(1)) / F.max("w")).alias("churn_per_second"), (F.sum("refills") * 60.0 / F.max("w")).alias("refill_per_minute"), F.median("depth").alias("twap_depth"), F.median("slippage").alias("twap_slippage"),
        F.min_by("mid", "seq").alias("first_mid"), F.max_by("mid", "seq").alias("last_mid"), F.count(F.lit(1)).alias("mids"))


def latest(samples: DataFrame, instants: DataFrame, step: int) -> DataFrame:
    """The last sample at or before each instant (as-of join): (symbol, t, depth, slippage, mid).

    Samples are first reduced to one for each grid step; those and the instants make one line
    for each symbol, along which the last sample is carried, so one from before the first
    instant counts too.
    """
    cell = (F.ceil(F.col("ts") / step) * step).cast("bigint")
    last = samples.groupBy("symbol", cell.alias("t")).agg(F.max_by(F.struct("depth", "slippage", "mid"), F.struct("ts", "seq")).alias("_s"))
    both = last.withColumn("_wanted", F.lit(False)).unionByName(instants.select("symbol", "t", F.lit(True).alias("_wanted")), True)
    line = both.groupBy("symbol", "t").agg(F.max("_s").alias("_s"), F.bool_or("_wanted").alias("_wanted"))
    out = carried(line, ["symbol"], stretch("t", max(TIME_STRETCH, 1024 * step)), "t", "_s", "_last")
    return out.where("_wanted").select("symbol", "t", "_last.depth", "_last.slippage", "_last.mid")


def window_metrics(trades: DataFrame, book: DataFrame, candles: DataFrame, grid: DataFrame, step: int, settings: MarketSettings, updates: DataFrame | None = None) -> DataFrame:
    """All metrics, score and state of every symbol, window length and instant of the grid.

    With ``updates`` of the whole book (as for ``book_versions``) depth and slippage are the book's own: at
    each instant, and as medians over samples; without, those of the best prices stand in.
    """
    lengths = grid.withColumn("w", F.explode(F.array(*[F.lit(w) for w in settings.windows])))
    flagged = book_flags(book, settings.refill_quote)
    out = lengths
    for part in (flow(trades, settings.windows, step), concentrations(trades, settings.windows, step), book_windows(flagged, settings.windows, step)):
        out = _met(out, part, KEY, "left")
    out = _met(out, latest(book_samples(book), grid, step), ["symbol", "t"], "left")
    if updates is not None:
        worse = F.greatest(F.coalesce("slippage_buy", F.lit(0.0)), F.coalesce("slippage_sell", F.lit(0.0)))
        now = book_insight(books_at(book_versions(updates), grid, max(3600, step)), settings.depth_band, settings.sweep_quote).select("symbol", F.col("t").cast("bigint").alias("t"), F.col("depth_min").alias("depth"), worse.alias("slippage"))
        sampled_windows = insight_windows(insight_samples(updates, settings), settings.windows, step).drop("depth_samples")
        out = _met(out.drop("depth", "slippage", "twap_depth", "twap_slippage"), sampled_windows, KEY, "left")
        out = _met(out, now, ["symbol", "t"], "left")
    base = baseline(candles, settings.baseline_rows)
    began = trades.groupBy("symbol").agg(F.min("ts").alias("_began"))
    out = _met(_met(out, base, ["symbol"], "left"), began, ["symbol"], "left")
    zero = {c: 0 for c in ("trade_count", "switches", "mids")} | {c: 0.0 for c in ("total_quote", "buy_quote", "sell_quote", "balance", "switch_rate", "churn_per_second", "refill_per_minute", "twap_depth", "twap_slippage", "top_size_rate", "top5_size_rate", "top_notional_rate", "top5_notional_rate", "depth", "slippage")}
    out = out.fillna(zero | {"interval_cv": 1.0, "top_size": "-", "top_notional": "-"})
    scale = F.col("w") / settings.baseline_seconds
    by_mids, by_trades = F.col("mids") >= 2, F.col("trade_count") >= 2
    start = F.when(by_mids, F.col("first_mid")).when(by_trades, F.col("first_price")).otherwise(F.coalesce("mid", F.lit(0.0)))
    end = F.when(by_mids, F.col("last_mid")).when(by_trades, F.col("last_price")).otherwise(F.coalesce("mid", F.lit(0.0)))
    out = out.withColumns({
        "volume_ratio": ratio(F.col("total_quote"), F.coalesce(F.col("median_volume") * scale, F.lit(0.0)), INF),
        "trade_ratio": ratio(F.col("trade_count"), F.coalesce(F.col("median_trades") * scale, F.lit(0.0)), INF),
        "price_return": F.when(start > 0, F.abs((end - start) / F.when(start > 0, start))).otherwise(0.0),
        "vol_to_depth": ratio(F.col("total_quote"), F.col("depth"), 0.0),
        "vol_to_twap_depth": ratio(F.col("total_quote"), F.col("twap_depth"), 0.0),
        "warmup": clamp((F.col("t") - F.col("_began")) / F.col("w"), 0, 1),
    })
    return with_state(out, settings.thresholds).drop("first_mid", "last_mid", "first_price", "last_price", "mid", "mids", "_began", "mean_volume", "samples")


def score(limits: Thresholds) -> Column:
    """0 to 100: a weighted sum of ten clamped components, gated by volume and trades.

    Fixed values: the weights, and where each component is full.
    """
    part = lambda x, full: clamp(F.col(x) / full, 0, 1)
    volume, count = part("volume_ratio", limits.suspicious_volume), part("trade_ratio", limits.suspicious_trades)
    impact = clamp(limits.largest_return / F.greatest(F.col("price_return"), F.lit(limits.largest_return)), 0, 1)
    depth = F.greatest(part("vol_to_depth", 4.0), part("vol_to_twap_depth", 4.0), part("slippage", 0.0030), part("twap_slippage", 0.0030))
    repeats = lambda name: clamp(F.greatest(F.col(f"top_{name}_rate") / 0.20, F.col(f"top5_{name}_rate") / 0.55), 0, 1)
    weighted = (
        0.22 * volume + 0.15 * count + 0.17 * part("balance", limits.suspicious_balance) + 0.12 * part("switch_rate", limits.suspicious_switches) + 0.10 * impact + 0.10 * depth
        + 0.05 * part("refill_per_minute", 3.0) + 0.05 * repeats("size") + 0.02 * repeats("notional") + 0.02 * clamp((0.85 - F.col("interval_cv")) / 0.85, 0, 1)
    )
    return weighted * clamp((volume + count) / 2, 0, 1) * 100


def with_state(metrics: DataFrame, limits: Thresholds) -> DataFrame:
    """Add ``score`` and ``state``; a window that is not yet full is warming up."""

    def reaches(kind: str) -> Column:
        return (F.col("volume_ratio") >= getattr(limits, f"{kind}_volume")) & (F.col("trade_ratio") >= getattr(limits, f"{kind}_trades")) & (F.col("balance") >= getattr(limits, f"{kind}_balance")) & (F.col("switch_rate") >= getattr(limits, f"{kind}_switches"))

    state = F.when(F.col("warmup") < 1, "WARMING_UP").when(reaches("suspicious") & (F.col("price_return") <= limits.largest_return), "SUSPECTED_WASH_LIKE").when(reaches("active"), "TWO_SIDED_ACTIVE").otherwise("NORMAL")
    return metrics.withColumn("score", score(limits)).withColumn("state", state)


def judged(metrics: DataFrame, limits: Thresholds) -> DataFrame:
    """Add status and score of three axes, the number of positive axes and the verdict ``level``."""
    part = lambda x, full: clamp(F.col(x) / full, 0, 1)
    c, warming = F.col, F.col("state") == "WARMING_UP"
    both = (c("volume_ratio") >= limits.active_volume) & (c("trade_ratio") >= limits.active_trades) & (c("balance") >= limits.active_balance)
    switching = c("switch_rate") >= limits.active_switches
    statuses = {
        "two_sided": (both, (c("volume_ratio") >= 0.75 * limits.active_volume) & (c("balance") >= 0.55)),
        "price_stuck": (both & (c("price_return") <= limits.largest_return), c("price_return") <= 1.8 * limits.largest_return),
        "mechanical": (switching & (c("interval_cv") <= 0.95) & ((c("top_notional_rate") >= 0.20) | (c("top_size_rate") >= 0.20)), switching & ((c("interval_cv") <= 1.10) | (c("top_notional_rate") >= 0.12))),
    }
    scores = {
        "two_sided": 0.4 * part("volume_ratio", limits.suspicious_volume) + 0.3 * part("trade_ratio", limits.suspicious_trades) + 0.3 * part("balance", limits.suspicious_balance),
        "price_stuck": clamp(0.7 * (1 - part("price_return", limits.largest_return)) + 0.3 * (1 - part("twap_slippage", 0.0030)), 0, 1),
        "mechanical": clamp(0.35 * part("switch_rate", limits.suspicious_switches) + 0.30 * clamp((1 - c("interval_cv")) / 0.85, 0, 1) + 0.20 * part("top_notional_rate", 0.20) + 0.15 * part("top_size_rate", 0.20), 0, 1),
    }
    out = metrics.withColumns({k: F.when(warming, "warming").when(yes, "positive").when(near, "neutral").otherwise("negative") for k, (yes, near) in statuses.items()})
    out = out.withColumns({f"{k}_score": F.when(warming, 0.0).otherwise(v) for k, v in scores.items()})
    count = lambda status: sum(((c(k) == status).cast("int") for k in statuses), F.lit(0))
    out = out.withColumns({"positive_axes": count("positive"), "neutral_axes": count("neutral")})
    p, n = c("positive_axes"), c("neutral_axes")
    return out.withColumn("level", F.when(warming, "warming").when(p == 3, "high").when(p >= 2, "watch").when((p == 1) | (n >= 2), "active").otherwise("low")).withColumn("window_label", window_text(c("w")))


def priority(level: str = "level") -> Column:
    """4 for the strongest level down to 0."""
    out = F.lit(0)
    for name, rank in PRIORITY.items():
        out = F.when(F.col(level) == name, rank).otherwise(out)
    return out


def strongest_windows(judged: DataFrame) -> DataFrame:
    """For each symbol and instant the strongest window: highest level, then score, then the shorter one."""
    order = F.struct(priority().alias("p"), "score", (-F.col("w")).alias("w"))
    return judged.groupBy("symbol", "t").agg(F.max_by(F.struct("level", "window_label", "score"), order).alias("_s"), F.bool_or(F.col("level") == "warming").alias("any_warming")).select("symbol", "t", "_s.level", "_s.window_label", "_s.score", "any_warming")


def overview(symbols: DataFrame, strongest: DataFrame) -> DataFrame:
    """One row for each instant: the strongest symbol (level, then window label as text, then order of symbols)."""
    joined = symbols.join(strongest, "symbol", "left").where(F.col("t").isNotNull())
    order = F.struct(priority().alias("p"), F.coalesce("window_label", F.lit("")).alias("l"), (-F.col("position")).alias("o"))
    return joined.groupBy("t").agg(F.max_by(F.struct("symbol", "level", "window_label"), order).alias("_s"), F.count(F.lit(1)).alias("ready")).select("t", F.col("_s.symbol").alias("strongest_symbol"), "_s.level", F.col("_s.window_label").alias("strongest_window"), "ready")


def streaks(states: DataFrame) -> DataFrame:
    """Add ``streak_seconds``: how long a tracked state has held over the grid, 0 where it starts and for others."""
    by = ["symbol", "w"]
    rows = previous(states, by, stretch("t", 64 * TIME_STRETCH), "t", ["state"])
    start = F.when(F.col("_prev").isNull() | (F.col("_prev.state") != F.col("state")), F.col("t"))
    out = carried(rows.withColumn("_start", start), by, stretch("t", 64 * TIME_STRETCH), "t", "_start", "_since")
    tracked = F.col("state").isin("TWO_SIDED_ACTIVE", "SUSPECTED_WASH_LIKE")
    return out.withColumn("streak_seconds", F.when(tracked, F.col("t") - F.col("_since")).otherwise(0)).drop("_prev", "_start", "_since")


def _jumps(ts: np.ndarray, spacing: float) -> np.ndarray:
    """For each row of a stretch in order the first row that lies ``spacing`` or more after it, or the number of rows."""
    times, first, own = np.unique(ts, return_index=True, return_inverse=True)
    to = np.searchsorted(times, times + spacing)  # rounding of the sum may be one time off, either way
    low = np.maximum(to - 1, 0)
    to = np.where((to > 0) & (times[low] - times >= spacing), low, to)
    at = np.minimum(to, len(times) - 1)
    to = np.where((to < len(times)) & (times[at] - times < spacing), to + 1, to)
    return np.append(first, len(ts))[to][own]


def sampled(rows: DataFrame, spacing: float = 1.0, part: int = 3600) -> DataFrame:
    """Greedy samples: a row stays if it lies ``spacing`` or more after the last row that stayed; the first stays.

    Order is by ts, then seq. Which rows of a stretch stay depends only on where the samples
    enter it. So each stretch of ``part`` seconds first tells, for every row at which they may enter,
    where they leave; a walk over stretches, not rows, fixes the entries; then every stretch
    marks its own rows. ``part`` is at least ``spacing``. Where rows are sparse a stretch is as many
    times longer as leaves it at most STRETCH_ROWS rows: each costs a task a frame of its own.
    """
    columns, size, rows = rows.columns, max(part, int(np.ceil(spacing))), checkpointed(rows)
    most = rows.groupBy("symbol", stretch("ts", size).alias("_part")).count().agg(F.max("count")).head()[0] or 1
    size *= max(1, STRETCH_ROWS // most)
    dealt_rows = rows.withColumn("_part", stretch("ts", size))

    def leave(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ts = frame.sort_values(["ts", "seq"])["ts"].to_numpy()
        jump = _jumps(ts, spacing)
        last = np.where(jump < len(ts), jump, np.arange(len(ts)))
        while (last[last] != last).any():  # doubles the number of jumps each time
            last = last[last]
        surely = np.flatnonzero(ts - key[1] * size >= spacing + 1e-6)  # whoever left before the stretch may enter here at the latest
        doors = int(surely[0]) + 1 if len(surely) else len(ts)
        return pd.DataFrame({"symbol": [key[0]], "_part": [key[1]], "doors": [ts[:doors].tolist()], "exits": [ts[last[:doors]].tolist()]})

    def enter(frame: pd.DataFrame) -> pd.DataFrame:
        kept, entered = -np.inf, []
        for doors, exits in frame.sort_values("_part")[["doors", "exits"]].itertuples(index=False):
            entered.append(kept)
            fits = np.flatnonzero(np.asarray(doors) - kept >= spacing)
            kept = exits[fits[0]] if len(fits) else kept
        return pd.DataFrame({"symbol": frame["symbol"], "_part": frame["_part"].sort_values().to_numpy(), "before": entered})

    def mark(key: tuple, frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "seq"])
        if frame.empty:
            return frame[columns]
        ts = frame["ts"].to_numpy()
        fits = np.flatnonzero(ts - entry["before"].iloc[0] >= spacing)
        jump, places = _jumps(ts, spacing), []
        at = fits[0] if len(fits) else len(ts)
        while at < len(ts):
            places.append(at)
            at = jump[at]
        return frame.iloc[places][columns]

    by = dealt_rows.groupBy("symbol", "_part")
    doors = dealt_rows.select("symbol", "_part", "ts", "seq").groupBy("symbol", "_part").applyInPandas(leave, "symbol string, _part long, doors array<double>, exits array<double>")
    entries = doors.groupBy("symbol").applyInPandas(enter, "symbol string, _part long, before double")
    return by.cogroup(entries.groupBy("symbol", "_part")).applyInPandas(mark, rows.schema)


# --- order book ---


def book_state(updates: DataFrame) -> DataFrame:
    """Levels after all updates: the last quantity of each price; quantity 0 removes it."""
    last = updates.groupBy("symbol", "side", "price").agg(F.max_by("qty", "seq").alias("qty"))
    return last.where(F.col("qty") != 0)


def sequence_flags(diffs: DataFrame) -> DataFrame:
    """Mark depth diffs: ``stale`` (ends at or before the last applied id) and ``gap`` (starts beyond it)."""
    rows = diffs.withColumn("_part", stretch("seq", SEQ_STRETCH))
    ends = rows.groupBy("symbol", "_part").agg(F.max("final_id").alias("_end"))
    earlier = (Window.unboundedPreceding, -1)
    before = ends.withColumn("_end", F.max("_end").over(Window.partitionBy("symbol").orderBy("_part").rowsBetween(*earlier)))
    inside = F.max("final_id").over(Window.partitionBy("symbol", "_part").orderBy("seq").rowsBetween(*earlier))
    rows = _met(rows, before, ["symbol", "_part"]).withColumn("_last", F.greatest(inside, "_end"))
    flags = {"stale": F.coalesce(F.col("final_id") <= F.col("_last"), F.lit(False)), "gap": F.coalesce(F.col("first_id") > F.col("_last") + 1, F.lit(False))}
    return rows.withColumns(flags).drop("_part", "_end", "_last")


def book_depth(levels: DataFrame, band: float) -> DataFrame:
    """Best prices, mid, notional within the band about the mid on each side, and the smaller of both."""
    best = levels.groupBy("symbol").agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("best_bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("best_ask"))
    best = best.where("best_bid IS NOT NULL AND best_ask IS NOT NULL").withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)
    inside = ((F.col("side") == "bid") & (F.col("price") >= F.col("mid") * (1 - band))) | ((F.col("side") == "ask") & (F.col("price") <= F.col("mid") * (1 + band)))
    side = lambda s: (inside & (F.col("side") == s))
    rows = levels.join(best, "symbol")
    value = F.col("price") * F.col("qty")
    out = rows.groupBy("symbol", "best_bid", "best_ask", "mid").agg(*[f for s in ("bid", "ask") for f in (F.sum(F.when(side(s), value).otherwise(0.0)).alias(f"{s}_depth"), F.count(F.when(side(s), 1)).alias(f"{s}_levels"))])
    return out.withColumn("depth_min", F.least("bid_depth", "ask_depth"))


def sweep_slippage(levels: DataFrame, target: float) -> DataFrame:
    """Slippage, against the best price of the side, of taking ``target`` quote from each side of the book; null if the side is too thin."""
    best = levels.groupBy("symbol").agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("_b"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("_a"))
    from_best = Window.partitionBy("symbol", "side").orderBy(F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price"))).rowsBetween(Window.unboundedPreceding, -1)
    rows = levels.withColumn("_quote", F.col("price") * F.col("qty")).withColumn("_before", F.coalesce(F.sum("_quote").over(from_best), F.lit(0.0)))
    rows = rows.withColumn("_take", F.least(F.col("_quote"), F.greatest(F.lit(target) - F.col("_before"), F.lit(0.0))))
    swept = rows.groupBy("symbol", "side").agg(F.sum("_take").alias("_q"), F.sum(F.col("_take") / F.col("price")).alias("_base")).join(best, "symbol")
    mean = F.col("_q") / F.when(F.col("_base") > 0, F.col("_base"))
    slip = F.when(F.col("side") == "ask", mean / F.col("_a") - 1).otherwise(1 - mean / F.col("_b"))
    return swept.select("symbol", "side", F.when(F.col("_q") >= target - 1e-9, F.greatest(slip, F.lit(0.0))).alias("slippage"))


def book_versions(updates: DataFrame) -> DataFrame:
    """Price levels with the time that each held (symbol, side, price, qty, since, until), from updates (symbol, seq, ts, side, price, qty).

    A level holds from its update to the next one of its price (by seq), the last one for ever
    (``until`` is infinite); quantity 0 is no level. Updates arrive in order of ts.
    """
    by = ["symbol", "side", "price"]
    rows = previous(updates.select(*by, "seq", "ts", "qty"), by, stretch("seq", SEQ_STRETCH), "seq", ["ts", "qty"])
    closed = rows.where(F.col("_prev").isNotNull()).select(*by, F.col("_prev.qty").alias("qty"), F.col("_prev.ts").alias("since"), F.col("ts").alias("until"))
    last = updates.groupBy(*by).agg(F.max_by(F.struct("qty", "ts"), "seq").alias("_l")).select(*by, "_l.qty", F.col("_l.ts").alias("since"), F.lit(INF).alias("until"))
    return closed.union(last).where("qty <> 0 AND since < until")


def books_at(versions: DataFrame, instants: DataFrame, bin_seconds: int = 3600) -> DataFrame:
    """The levels (symbol, t, side, price, qty) of the whole book at each instant (symbol, t), all updates up to t applied.

    An as-of join of intervals: versions and instants meet by bins of time, of which a version
    covers those up to its symbol's last instant, then by their ends. Bins as long as instants lie
    apart keep a version from being dealt to bins without one.
    """
    asked = instants.select("symbol", F.col("t").cast("double").alias("t")).withColumn("_bin", F.floor(F.col("t") / bin_seconds))
    spans = checkpointed(asked.groupBy("symbol").agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi")))
    first, last = F.greatest(F.floor(F.col("since") / bin_seconds), F.col("_lo")), F.least(F.floor(F.least(F.col("until"), F.lit(1e15)) / bin_seconds), F.col("_hi"))
    dealt_versions = joined_narrow(versions, spans, ["symbol"]).where(first <= last).withColumn("_bin", F.explode(F.sequence(first, last))).drop("_lo", "_hi")
    met = _met(dealt_versions, asked, ["symbol", "_bin"]).where("since <= t AND t < until")
    return met.select("symbol", "t", "side", "price", "qty")


def book_insight(levels: DataFrame, band: float, target: float) -> DataFrame:
    """Of each two-sided book (symbol, t): best prices, notional within the band on each side, levels, and what a sweep of ``target`` slips.

    ``levels`` as from ``books_at``. A buy slips from the best ask, a sale from the best bid; null if
    the side is too thin. A book is one group: it is as large as the market keeps it.
    """
    book, value = Window.partitionBy("symbol", "t"), F.col("price") * F.col("qty")
    bid = F.col("side") == "bid"
    rows = levels.withColumns({"_bid": F.max(F.when(bid, F.col("price"))).over(book), "_ask": F.min(F.when(~bid, F.col("price"))).over(book)}).where("_bid > 0 AND _ask > 0")
    mid = (F.col("_bid") + F.col("_ask")) / 2
    near = F.when(bid, F.col("price") >= mid * (1 - band)).otherwise(F.col("price") <= mid * (1 + band))
    ahead = F.coalesce(F.sum(value).over(Window.partitionBy("symbol", "t", "side").orderBy(F.when(bid, -F.col("price")).otherwise(F.col("price"))).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumns({"_near": F.when(near, value).otherwise(0.0), "_take": F.least(value, F.greatest(F.lit(target) - ahead, F.lit(0.0)))})
    of = lambda side, x: F.sum(F.when(side, x).otherwise(0.0))
    out = rows.groupBy("symbol", "t").agg(
        F.max("_bid").alias("best_bid"), F.max("_ask").alias("best_ask"), of(bid, F.col("_near")).alias("bid_depth"), of(~bid, F.col("_near")).alias("ask_depth"), F.count_if(bid).alias("bid_levels"), F.count_if(~bid).alias("ask_levels"),
        of(bid, F.col("_take")).alias("_sold"), of(bid, F.col("_take") / F.col("price")).alias("_sold_base"), of(~bid, F.col("_take")).alias("_spent"), of(~bid, F.col("_take") / F.col("price")).alias("_bought"),
    )
    full = lambda quote, slip: F.when(F.col(quote) >= target - 1e-9, F.greatest(slip, F.lit(0.0)))
    out = out.withColumns({
        "depth_min": F.least("bid_depth", "ask_depth"), "slippage_buy": full("_spent", F.col("_spent") / F.col("_bought") / F.col("best_ask") - 1), "slippage_sell": full("_sold", 1 - F.col("_sold") / F.col("_sold_base") / F.col("best_bid")),
    })
    return out.drop("_sold", "_sold_base", "_spent", "_bought")


def insight_samples(updates: DataFrame, settings: MarketSettings, spacing: float = 1.0) -> DataFrame:
    """(symbol, seq, ts, depth, slippage): the whole book's depth and worse slippage at greedy samples of its updates.

    Samples lie ``spacing`` seconds or more apart; a one-sided book gives none.
    """
    taken = checkpointed(sampled(updates.groupBy("symbol", "ts").agg(F.max("seq").alias("seq")), spacing))
    found = book_insight(books_at(book_versions(updates), taken.select("symbol", F.col("ts").alias("t")), max(3600, int(spacing))), settings.depth_band, settings.sweep_quote)
    worse = F.greatest(F.coalesce("slippage_buy", F.lit(0.0)), F.coalesce("slippage_sell", F.lit(0.0)))
    return _met(taken, found.select("symbol", F.col("t").alias("ts"), F.col("depth_min").alias("depth"), worse.alias("slippage")), ["symbol", "ts"])


def insight_windows(samples: DataFrame, windows: tuple[int, ...], step: int) -> DataFrame:
    """Median depth and slippage of the samples of each window, and their number."""
    rows = dealt(samples.select("symbol", "ts", "depth", "slippage"), windows, step)
    return rows.groupBy(*KEY).agg(F.median("depth").alias("twap_depth"), F.median("slippage").alias("twap_slippage"), F.count(F.lit(1)).alias("depth_samples"))
