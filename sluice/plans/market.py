"""Market queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MarketSettings
from ..functions import numeric as N
from ..operators import market as M
from ..operators import report as R
from ..sources import frames as S
from ..sources.shared import checkpointed

#: The tables hold an event every few minutes, so windows are one and two days, on daily instants.
STEP = 86_400
SETTINGS = MarketSettings(windows=(86_400, 172_800), baseline_rows=120, baseline_seconds=3_600.0, refill_quote=2_000.0, sweep_quote=100_000.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trades(S.raw_trades(spark, sf_dir))


def market_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trades(spark, sf_dir))


def market_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.flow(trades(spark, sf_dir), SETTINGS.windows, STEP))


def market_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.concentrations(trades(spark, sf_dir), SETTINGS.windows, STEP))


def market_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.baseline(S.candles(spark, sf_dir), SETTINGS.baseline_rows))


def book_refills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.book_flags(S.book(spark, sf_dir), SETTINGS.refill_quote).select("symbol", "seq", "refills"))


def book_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.book_windows(M.book_flags(S.book(spark, sf_dir), SETTINGS.refill_quote), SETTINGS.windows, STEP))


def book_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = M.book_samples(S.book(spark, sf_dir))
    return rounded(M.latest(samples, S.grid(trades(spark, sf_dir), STEP), STEP))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return M.window_metrics(t, S.book(spark, sf_dir), S.candles(spark, sf_dir), S.grid(t, STEP), STEP, SETTINGS)


def market_window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics(spark, sf_dir))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.judged(metrics(spark, sf_dir), SETTINGS.thresholds)


_JUDGED = ["symbol", "t", "w", "window_label", "state", "score", "two_sided", "price_stuck", "mechanical", "two_sided_score", "price_stuck_score", "mechanical_score", "positive_axes", "neutral_axes", "level"]


def market_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(judged(spark, sf_dir).select(_JUDGED))


def market_strongest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.strongest_windows(judged(spark, sf_dir)))


def market_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = spark.createDataFrame([(i, f"S{i}") for i in range(5)], "position int, symbol string")  # S4 has no data
    return M.overview(symbols, M.strongest_windows(judged(spark, sf_dir)))


def market_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.streaks(metrics(spark, sf_dir).select("symbol", "w", "t", "state"))


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Judged windows with streaks, in numbers of six decimals, and the strongest of each instant; both read one checkpoint."""
    rows = checkpointed(M.judged(M.streaks(checkpointed(metrics(spark, sf_dir))), SETTINGS.thresholds))
    return rounded(rows), M.strongest_windows(rows)


def market_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = R.projected(_read(spark, sf_dir)[0])
    return shown.select("symbol", "t", "w", "window_label", *[c for c in shown.columns if c.endswith("_text")])


def market_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report(*_read(spark, sf_dir))


def market_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.sampled(M.book_samples(S.book(spark, sf_dir)), 600.0))


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.book_state(S.levels(spark, sf_dir)))


def book_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.book_depth(M.book_state(S.levels(spark, sf_dir)), SETTINGS.depth_band))


def book_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.sweep_slippage(M.book_state(S.levels(spark, sf_dir)), SETTINGS.sweep_quote))


#: Seconds between instants at which whole books are looked at, and between samples of them.
BOOK_STEP, BOOK_SPACING = 86_400, 21_600.0


def book_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and slippage of the whole book at the end of each day of its updates."""
    updates = S.level_updates(spark, sf_dir)
    return rounded(M.book_insight(M.books_at(M.book_versions(updates), S.grid(updates, BOOK_STEP), BOOK_STEP), SETTINGS.depth_band, SETTINGS.sweep_quote))


def book_insight_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians over windows of samples of the whole book (greedy, so without SQL)."""
    samples = M.insight_samples(S.level_updates(spark, sf_dir), SETTINGS, BOOK_SPACING)
    return rounded(M.insight_windows(samples, SETTINGS.windows, STEP))


def depth_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth diffs made from line items: ids overlap, repeat and jump."""
    line = S.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("n"))
    diffs = line.select(F.concat(F.lit("B"), (F.col("l_orderkey") % 7).cast("string")).alias("symbol"), F.col("l_orderkey").alias("seq"), (F.col("l_orderkey") - F.col("n") % 3).alias("first_id"), (F.col("l_orderkey") + F.col("n") % 11).alias("final_id"))
    return M.sequence_flags(diffs)


def market_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    x, s = F.col("o_totalprice"), F.col("o_orderkey")
    return o.select(
        "o_orderkey", N.short_settled(x).alias("short"), N.ratio_text(N.settled(x / 1000)).alias("ratio"), N.hundredths_text(N.settled(x / 1e6 * 100)).alias("percent"), N.duration_text(s).alias("duration"), N.window_text(s * 60).alias("label"),
        F.round(N.nice_step(x), 6).alias("nice"), F.round(N.bucket_step(x / 1e4), 6).alias("step"), F.round(N.bucketed(x, F.lit(500.0)), 6).alias("bucket"), F.round(N.clamp(x, 100, 200000), 6).alias("clamped"),
    )


_TRADES = f"""{S.RAW_TRADES_SQL},
trades AS (SELECT symbol, seq, T / 1000 AS ts, CASE WHEN m THEN 'SELL' ELSE 'BUY' END AS side, CAST(p AS DOUBLE) AS price, CAST(q AS DOUBLE) AS qty, q AS qty_text, CAST(p AS DOUBLE) * CAST(q AS DOUBLE) AS quote_qty FROM raw_trades),
grid AS (SELECT symbol, unnest(range(CAST(ceil(min(ts) / {STEP}) * {STEP} AS BIGINT), CAST(ceil(max(ts) / {STEP}) * {STEP} AS BIGINT) + 1, {STEP})) AS t FROM trades GROUP BY symbol),
lens AS (SELECT unnest([{", ".join(map(str, SETTINGS.windows))}]) AS w),
tw AS (SELECT symbol, w, t0.t, seq, ts, side, price, qty_text, quote_qty FROM trades JOIN lens ON true JOIN (SELECT unnest(range({{lo}}, {{hi}}, {STEP})) AS t) t0 ON ts >= t0.t - w AND ts <= t0.t)"""
# every multiple of the step that may hold an event of the tables (the year 2024 and some)
_TRADES = _TRADES.replace("{lo}", str(19_700 * STEP)).replace("{hi}", str(20_200 * STEP))
_BUCKET = "CASE WHEN m <= 0 THEN 1.0 ELSE greatest(CASE WHEN m >= 50 THEN 1.0 WHEN m >= 5 THEN 0.1 ELSE 0.01 END, {nice}) END"


def _nice(x: str) -> str:
    p = f"pow(10.0, floor(log10({x})))"
    return f"({p} * CASE WHEN {x} / {p} < 1.5 THEN 1.0 WHEN {x} / {p} < 3.5 THEN 2.0 WHEN {x} / {p} < 7.5 THEN 5.0 ELSE 10.0 END)"


_FLOW = """
fl AS (SELECT *, CAST(side <> lag(side) OVER k AS INT) AS sw, ts - lag(ts) OVER k AS gap FROM tw WINDOW k AS (PARTITION BY symbol, w, t ORDER BY seq)),
fa AS (SELECT symbol, w, t, count(*) AS trade_count, sum(quote_qty) AS total_quote, sum(CASE WHEN side = 'BUY' THEN quote_qty ELSE 0.0 END) AS buy_quote, CAST(coalesce(sum(sw), 0) AS BIGINT) AS switches,
  avg(gap) AS mean, stddev_pop(gap) AS sd, min_by(price, seq) AS first_price, max_by(price, seq) AS last_price FROM fl GROUP BY ALL),
flow AS (SELECT symbol, w, t, trade_count, total_quote, buy_quote, switches, first_price, last_price, total_quote - buy_quote AS sell_quote,
  CASE WHEN greatest(buy_quote, total_quote - buy_quote) > 0 THEN least(buy_quote, total_quote - buy_quote) / greatest(buy_quote, total_quote - buy_quote) ELSE 0.0 END AS balance,
  switches / greatest(trade_count - 1, 1) AS switch_rate, CASE WHEN trade_count >= 6 AND mean > 0 THEN sd / mean ELSE 1.0 END AS interval_cv FROM fa)"""


def _top(column: str, name: str) -> str:
    return f"""
{name}_c AS (SELECT symbol, w, t, {column} AS v, count(*) AS n, min(seq) AS f FROM nb GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY symbol, w, t) AS a, row_number() OVER (PARTITION BY symbol, w, t ORDER BY n DESC, f) AS place FROM {name}_c),
{name}_t AS (SELECT symbol, w, t, max(CASE WHEN place = 1 THEN v END) AS top_{name}, max(n) / max(a) AS top_{name}_rate, sum(n) / max(a) AS top5_{name}_rate FROM {name}_r WHERE place <= 5 GROUP BY ALL)"""


_CONC = f"""
ms AS (SELECT *, avg(quote_qty) OVER (PARTITION BY symbol, w, t) AS m FROM tw),
st AS (SELECT *, {_BUCKET.format(nice=_nice("(m * 0.02)"))} AS step FROM ms),
nb AS (SELECT *, CASE WHEN step >= 1 THEN printf('%.0f', round_even(quote_qty / step, 0) * step) WHEN step >= 0.1 THEN printf('%.1f', round_even(quote_qty / step, 0) * step) ELSE printf('%.2f', round_even(quote_qty / step, 0) * step) END AS notional_text FROM st),{_top("qty_text", "size")},{_top("notional_text", "notional")},
conc AS (SELECT * FROM size_t JOIN notional_t USING (symbol, w, t))"""
_BASE = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS rn FROM candles),
base AS (SELECT symbol, median(quote_volume) AS median_volume, avg(quote_volume) AS mean_volume, median(trade_count) AS median_trades, count(*) AS samples FROM ranked WHERE rn <= {SETTINGS.baseline_rows} GROUP BY symbol)"""
_BOOKF = f"""
flags AS (SELECT *, CAST(coalesce(CAST(abs(bid - lag(bid) OVER k) <= 1e-12 AND (bid_qty - lag(bid_qty) OVER k) * bid >= {SETTINGS.refill_quote} AS INT), 0) + coalesce(CAST(abs(ask - lag(ask) OVER k) <= 1e-12 AND (ask_qty - lag(ask_qty) OVER k) * ask >= {SETTINGS.refill_quote} AS INT), 0) AS INT) AS refills,
  (bid + ask) / 2 AS mid, least(bid * bid_qty, ask * ask_qty) AS depth, (ask - bid) / ((bid + ask) / 2) AS slippage FROM book WINDOW k AS (PARTITION BY symbol ORDER BY seq)),
bw AS (SELECT symbol, w, t0.t, flags.* EXCLUDE (symbol) FROM flags JOIN (SELECT unnest([{", ".join(map(str, SETTINGS.windows))}]) AS w) l ON true JOIN (SELECT unnest(range({19_700 * STEP}, {20_200 * STEP}, {STEP})) AS t) t0 ON ts >= t0.t - w AND ts <= t0.t),
bookw AS (SELECT symbol, w, t, count(*) / w AS churn_per_second, sum(refills) * 60.0 / w AS refill_per_minute, median(depth) AS twap_depth, median(slippage) AS twap_slippage, min_by(mid, seq) AS first_mid, max_by(mid, seq) AS last_mid, count(*) AS mids FROM bw GROUP BY symbol, w, t)"""
_ASOF = """
asof_b AS (SELECT g.symbol, g.t, f.depth, f.slippage, f.mid FROM grid g ASOF LEFT JOIN flags f ON g.symbol = f.symbol AND f.ts <= g.t)"""
_L = SETTINGS.thresholds


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


_V, _C = _clamp(f"volume_ratio / {_L.suspicious_volume}"), _clamp(f"trade_ratio / {_L.suspicious_trades}")
_REACH = "volume_ratio >= {v} AND trade_ratio >= {c} AND balance >= {b} AND switch_rate >= {s}"
_METRICS = f"""WITH {_TRADES},{_FLOW},{_CONC},{S.BOOK_SQL},{_BOOKF},{S.CANDLES_SQL},{_BASE},{_ASOF},
began AS (SELECT symbol, min(ts) AS b FROM trades GROUP BY symbol),
j AS (SELECT g.symbol, g.t, lens.w, coalesce(trade_count, 0) AS trade_count, coalesce(total_quote, 0.0) AS total_quote, coalesce(buy_quote, 0.0) AS buy_quote, coalesce(switches, 0) AS switches, coalesce(sell_quote, 0.0) AS sell_quote,
  coalesce(balance, 0.0) AS balance, coalesce(switch_rate, 0.0) AS switch_rate, coalesce(interval_cv, 1.0) AS interval_cv, coalesce(top_size, '-') AS top_size, coalesce(top_size_rate, 0.0) AS top_size_rate, coalesce(top5_size_rate, 0.0) AS top5_size_rate,
  coalesce(top_notional, '-') AS top_notional, coalesce(top_notional_rate, 0.0) AS top_notional_rate, coalesce(top5_notional_rate, 0.0) AS top5_notional_rate, coalesce(churn_per_second, 0.0) AS churn_per_second, coalesce(refill_per_minute, 0.0) AS refill_per_minute,
  coalesce(twap_depth, 0.0) AS twap_depth, coalesce(twap_slippage, 0.0) AS twap_slippage, coalesce(depth, 0.0) AS depth, coalesce(slippage, 0.0) AS slippage, median_volume, median_trades, first_mid, last_mid, coalesce(mids, 0) AS mids, first_price, last_price, mid, b
  FROM grid g JOIN lens ON true LEFT JOIN flow USING (symbol, w, t) LEFT JOIN conc USING (symbol, w, t) LEFT JOIN bookw USING (symbol, w, t) LEFT JOIN asof_b USING (symbol, t) LEFT JOIN base USING (symbol) LEFT JOIN began USING (symbol)),
p AS (SELECT *, CASE WHEN mids >= 2 THEN first_mid WHEN trade_count >= 2 THEN first_price ELSE coalesce(mid, 0.0) END AS p0, CASE WHEN mids >= 2 THEN last_mid WHEN trade_count >= 2 THEN last_price ELSE coalesce(mid, 0.0) END AS p1,
  coalesce(median_volume * (w / {SETTINGS.baseline_seconds}), 0.0) AS bv, coalesce(median_trades * (w / {SETTINGS.baseline_seconds}), 0.0) AS bt FROM j),
r AS (SELECT *, CASE WHEN bv > 0 THEN total_quote / bv ELSE CAST('inf' AS DOUBLE) END AS volume_ratio, CASE WHEN bt > 0 THEN trade_count / bt ELSE CAST('inf' AS DOUBLE) END AS trade_ratio, CASE WHEN p0 > 0 THEN abs((p1 - p0) / p0) ELSE 0.0 END AS price_return,
  CASE WHEN depth > 0 THEN total_quote / depth ELSE 0.0 END AS vol_to_depth, CASE WHEN twap_depth > 0 THEN total_quote / twap_depth ELSE 0.0 END AS vol_to_twap_depth, {_clamp("(t - b) / w")} AS warmup FROM p),
metrics AS (SELECT symbol, t, w, trade_count, total_quote, buy_quote, switches, sell_quote, balance, switch_rate, interval_cv, top_size, top_size_rate, top5_size_rate, top_notional, top_notional_rate, top5_notional_rate, churn_per_second, refill_per_minute, twap_depth, twap_slippage, depth, slippage, median_volume, median_trades, volume_ratio, trade_ratio, price_return, vol_to_depth, vol_to_twap_depth, warmup,
  (0.22 * {_V} + 0.15 * {_C} + 0.17 * {_clamp(f"balance / {_L.suspicious_balance}")} + 0.12 * {_clamp(f"switch_rate / {_L.suspicious_switches}")} + 0.10 * {_clamp(f"{_L.largest_return} / greatest(price_return, {_L.largest_return})")}
   + 0.10 * greatest({_clamp("vol_to_depth / 4.0")}, {_clamp("vol_to_twap_depth / 4.0")}, {_clamp("slippage / 0.0030")}, {_clamp("twap_slippage / 0.0030")}) + 0.05 * {_clamp("refill_per_minute / 3.0")} + 0.05 * {_clamp("greatest(top_size_rate / 0.20, top5_size_rate / 0.55)")}
   + 0.02 * {_clamp("greatest(top_notional_rate / 0.20, top5_notional_rate / 0.55)")} + 0.02 * {_clamp("(0.85 - interval_cv) / 0.85")}) * {_clamp(f"({_V} + {_C}) / 2")} * 100 AS score,
  CASE WHEN warmup < 1 THEN 'WARMING_UP' WHEN {_REACH.format(v=_L.suspicious_volume, c=_L.suspicious_trades, b=_L.suspicious_balance, s=_L.suspicious_switches)} AND price_return <= {_L.largest_return} THEN 'SUSPECTED_WASH_LIKE'
  WHEN {_REACH.format(v=_L.active_volume, c=_L.active_trades, b=_L.active_balance, s=_L.active_switches)} THEN 'TWO_SIDED_ACTIVE' ELSE 'NORMAL' END AS state FROM r)"""
_BOTH = f"volume_ratio >= {_L.active_volume} AND trade_ratio >= {_L.active_trades} AND balance >= {_L.active_balance}"
_SW = f"switch_rate >= {_L.active_switches}"
_LABEL = "CASE WHEN w % 3600 = 0 THEN CAST(w // 3600 AS VARCHAR) || 'h' WHEN w % 60 = 0 THEN CAST(w // 60 AS VARCHAR) || 'm' ELSE CAST(w AS VARCHAR) || 's' END"
_JUDGE = f"""{_METRICS},
ax AS (SELECT *, {_LABEL} AS window_label, CASE WHEN state = 'WARMING_UP' THEN 'warming' WHEN {_BOTH} THEN 'positive' WHEN volume_ratio >= {0.75 * _L.active_volume} AND balance >= 0.55 THEN 'neutral' ELSE 'negative' END AS two_sided,
  CASE WHEN state = 'WARMING_UP' THEN 'warming' WHEN {_BOTH} AND price_return <= {_L.largest_return} THEN 'positive' WHEN price_return <= {1.8 * _L.largest_return} THEN 'neutral' ELSE 'negative' END AS price_stuck,
  CASE WHEN state = 'WARMING_UP' THEN 'warming' WHEN {_SW} AND interval_cv <= 0.95 AND (top_notional_rate >= 0.20 OR top_size_rate >= 0.20) THEN 'positive' WHEN {_SW} AND (interval_cv <= 1.10 OR top_notional_rate >= 0.12) THEN 'neutral' ELSE 'negative' END AS mechanical,
  CASE WHEN state = 'WARMING_UP' THEN 0.0 ELSE 0.4 * {_V} + 0.3 * {_C} + 0.3 * {_clamp(f"balance / {_L.suspicious_balance}")} END AS two_sided_score,
  CASE WHEN state = 'WARMING_UP' THEN 0.0 ELSE {_clamp(f"0.7 * (1 - {_clamp(f'price_return / {_L.largest_return}')}) + 0.3 * (1 - {_clamp('twap_slippage / 0.0030')})")} END AS price_stuck_score,
  CASE WHEN state = 'WARMING_UP' THEN 0.0 ELSE {_clamp(f"0.35 * {_clamp(f'switch_rate / {_L.suspicious_switches}')} + 0.30 * {_clamp('(1 - interval_cv) / 0.85')} + 0.20 * {_clamp('top_notional_rate / 0.20')} + 0.15 * {_clamp('top_size_rate / 0.20')}")} END AS mechanical_score FROM metrics),
ac AS (SELECT *, CAST(two_sided = 'positive' AS INT) + CAST(price_stuck = 'positive' AS INT) + CAST(mechanical = 'positive' AS INT) AS positive_axes, CAST(two_sided = 'neutral' AS INT) + CAST(price_stuck = 'neutral' AS INT) + CAST(mechanical = 'neutral' AS INT) AS neutral_axes FROM ax),
judged AS (SELECT *, CASE WHEN state = 'WARMING_UP' THEN 'warming' WHEN positive_axes = 3 THEN 'high' WHEN positive_axes >= 2 THEN 'watch' WHEN positive_axes = 1 OR neutral_axes >= 2 THEN 'active' ELSE 'low' END AS level FROM ac),
pr AS (SELECT *, CASE level WHEN 'high' THEN 4 WHEN 'watch' THEN 3 WHEN 'active' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS pri FROM judged),
sw AS (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY pri DESC, score DESC, w) AS rn, bool_or(level = 'warming') OVER (PARTITION BY symbol, t) AS any_warming FROM pr),
strongest AS (SELECT symbol, t, level, window_label, score, any_warming, pri FROM sw WHERE rn = 1)"""
_LEVELS = f"""WITH {S.LEVELS_SQL},
bs AS (SELECT symbol, side, price, max_by(qty, seq) AS qty FROM levels GROUP BY ALL HAVING max_by(qty, seq) <> 0),
best AS (SELECT symbol, max(CASE WHEN side = 'bid' THEN price END) AS best_bid, min(CASE WHEN side = 'ask' THEN price END) AS best_ask FROM bs GROUP BY symbol),
bm AS (SELECT *, (best_bid + best_ask) / 2 AS mid FROM best WHERE best_bid IS NOT NULL AND best_ask IS NOT NULL)"""


def rounded_sql(body: str, doubles: str, rest: str, source: str) -> str:
    return f"{body} SELECT {rest}, " + ", ".join(f"round({c}, 6) AS {c}" for c in doubles.split()) + f" FROM {source}"


_METRIC_DOUBLES = "total_quote buy_quote sell_quote balance switch_rate interval_cv top_size_rate top5_size_rate top_notional_rate top5_notional_rate churn_per_second refill_per_minute twap_depth twap_slippage depth slippage median_volume median_trades volume_ratio trade_ratio price_return vol_to_depth vol_to_twap_depth warmup score"

def _two(x: str, places: int = 2) -> str:
    """The shortest decimal text of a double, rounded half up, as Spark's format_string does."""
    return f"printf('%.{places}f', CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {places}) AS DOUBLE))"


def _short(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'n/a' WHEN {x} >= 1e9 THEN {_two(f'{x} / 1e9')} || 'B' WHEN {x} >= 1e6 THEN {_two(f'{x} / 1e6')} || 'M' WHEN {x} >= 1e3 THEN {_two(f'{x} / 1e3')} || 'K' ELSE {_two(x)} END"


def _times(x: str) -> str:
    return f"CASE WHEN isinf({x}) THEN 'inf' ELSE {_two(f'CASE WHEN isinf({x}) THEN 0 ELSE {x} END')} || 'x' END"


_TEXTS = {c: _short(c) for c in "total_quote buy_quote sell_quote twap_depth depth median_volume".split()} | {c: _times(c) for c in "volume_ratio trade_ratio vol_to_depth vol_to_twap_depth".split()} | {c: _two(f"{c} * 100") + " || '%'" for c in "price_return slippage twap_slippage top_size_rate top5_size_rate top_notional_rate top5_notional_rate".split()}
_TEXTS |= {"interval_cv": _two("interval_cv"), "streak_seconds": "CASE WHEN streak_seconds >= 3600 THEN printf('%dh%02dm%02ds', streak_seconds // 3600, streak_seconds % 3600 // 60, streak_seconds % 60) WHEN streak_seconds >= 60 THEN printf('%dm%02ds', streak_seconds // 60, streak_seconds % 60) ELSE printf('%ds', streak_seconds) END"}
_SHOWN = f"""{_JUDGE},
k0 AS (SELECT *, lag(state) OVER (PARTITION BY symbol, w ORDER BY t) AS ps FROM judged), k1 AS (SELECT *, max(CASE WHEN ps IS NULL OR ps <> state THEN t END) OVER (PARTITION BY symbol, w ORDER BY t) AS since FROM k0),
k2 AS (SELECT * REPLACE ({", ".join(f"round({c}, 6) AS {c}" for c in _METRIC_DOUBLES.split())}), CAST(CASE WHEN state IN ('TWO_SIDED_ACTIVE', 'SUSPECTED_WASH_LIKE') THEN t - since ELSE 0 END AS BIGINT) AS streak_seconds FROM k1),
shown AS (SELECT *, {", ".join(f"{x} AS {c}_text" for c, x in _TEXTS.items())} FROM k2),
body AS (SELECT *, lpad(window_label, 4, ' ') || ' state=' || state || ' score=' || {_two("score", 1)} || ' streak=' || streak_seconds_text || ' verdict=' || level || chr(10)
  || '    quote=' || total_quote_text || ' (' || volume_ratio_text || '), buy=' || buy_quote_text || ', sell=' || sell_quote_text || ', balance=' || {_two("balance")} || chr(10)
  || '    trades=' || trade_count || ' (' || trade_ratio_text || '), switch_rate=' || {_two("switch_rate")} || ', move=' || price_return_text || ', book_churn=' || {_two("churn_per_second")} || '/s, refill=' || {_two("refill_per_minute")} || '/min' || chr(10)
  || '    vol/depth=' || vol_to_depth_text || ', size_top1=' || top_size_rate_text || ' (' || top_size || '), size_top5=' || top5_size_rate_text || chr(10)
  || '    vol/tw_depth=' || vol_to_twap_depth_text || ', tw_slip=' || twap_slippage_text || ', gap_cv=' || interval_cv_text || ', notional_top1=' || top_notional_rate_text || ' (' || top_notional || ')' || chr(10)
  || '    two_sided=' || two_sided || ' | price_stuck=' || price_stuck || ' | mechanical=' || mechanical AS body FROM shown)"""


QUERIES = {f.__name__: f for f in (market_trades, market_flow, market_concentration, market_baseline, book_refills, book_windows, book_asof, market_window_metrics, market_judgement, market_strongest_window, market_overview, market_streaks, market_projections, market_report, market_samples, book_levels, book_depth, book_slippage, book_history, book_insight_windows, depth_sequence, market_format)}

ORACLES = {
    "market_projections": f"{_SHOWN} SELECT symbol, t, w, window_label, {', '.join(c + '_text' for c in _TEXTS)} FROM shown",
    "market_report": f"""{_SHOWN} SELECT b.symbol, b.t, 'symbol=' || b.symbol || ' overall=' || any_value(s.level) || ' (' || any_value(s.window_label) || ')' || chr(10) || CASE WHEN min(median_trades) IS NULL THEN 'baseline_1m=warming_up' ELSE 'baseline_1m=median_quote=' || min(median_volume_text) || ', median_trades=' || {_two("min(median_trades)", 0)} END || chr(10) || string_agg(body, chr(10) ORDER BY b.w) AS report
  FROM body b JOIN strongest s ON s.symbol = b.symbol AND s.t = b.t GROUP BY b.symbol, b.t""",
    "market_trades": rounded_sql(f"WITH {_TRADES}", "ts price qty quote_qty", "symbol, seq, side, qty_text", "trades"),
    "market_flow": rounded_sql(f"WITH {_TRADES},{_FLOW}", "total_quote buy_quote sell_quote balance switch_rate interval_cv first_price last_price", "symbol, w, t, trade_count, switches", "flow"),
    "market_concentration": rounded_sql(f"WITH {_TRADES},{_CONC}", "top_size_rate top5_size_rate top_notional_rate top5_notional_rate", "symbol, w, t, top_size, top_notional", "conc"),
    "market_baseline": rounded_sql(f"WITH {S.CANDLES_SQL},{_BASE}", "median_volume mean_volume median_trades", "symbol, samples", "base"),
    "book_refills": f"WITH {S.BOOK_SQL},{_BOOKF} SELECT symbol, seq, refills FROM flags",
    "book_windows": rounded_sql(f"WITH {S.BOOK_SQL},{_BOOKF}", "churn_per_second refill_per_minute twap_depth twap_slippage first_mid last_mid", "symbol, w, t, mids", "bookw"),
    "book_asof": rounded_sql(f"WITH {_TRADES},{S.BOOK_SQL},{_BOOKF},{_ASOF}", "depth slippage mid", "symbol, t", "asof_b"),
    "market_window_metrics": rounded_sql(_METRICS, _METRIC_DOUBLES, "symbol, t, w, trade_count, switches, top_size, top_notional, state", "metrics"),
    "market_judgement": rounded_sql(_JUDGE, "score two_sided_score price_stuck_score mechanical_score", "symbol, t, w, window_label, state, two_sided, price_stuck, mechanical, positive_axes, neutral_axes, level", "judged"),
    "market_strongest_window": rounded_sql(_JUDGE, "score", "symbol, t, level, window_label, any_warming", "strongest"),
    "market_overview": f"{_JUDGE}, o AS (SELECT t, symbol AS strongest_symbol, level, window_label AS strongest_window, row_number() OVER (PARTITION BY t ORDER BY pri DESC, window_label DESC, symbol) AS rn, count(*) OVER (PARTITION BY t) AS ready FROM strongest) SELECT t, strongest_symbol, level, strongest_window, ready FROM o WHERE rn = 1",
    "market_streaks": f"""{_METRICS}, ch AS (SELECT symbol, w, t, state, CAST(coalesce(state <> lag(state) OVER (PARTITION BY symbol, w ORDER BY t), true) AS INT) AS c FROM metrics), isl AS (SELECT *, sum(c) OVER (PARTITION BY symbol, w ORDER BY t) AS i FROM ch)
  SELECT symbol, w, t, state, CASE WHEN state IN ('TWO_SIDED_ACTIVE', 'SUSPECTED_WASH_LIKE') THEN t - min(t) OVER (PARTITION BY symbol, w, i) ELSE 0 END AS streak_seconds FROM isl""",
    "book_levels": f"{_LEVELS} SELECT symbol, side, round(price, 6) AS price, round(qty, 6) AS qty FROM bs",
    "book_depth": f"""{_LEVELS}, d AS (SELECT symbol, best_bid, best_ask, mid, sum(CASE WHEN side = 'bid' AND price >= mid * (1 - {SETTINGS.depth_band}) THEN price * qty ELSE 0.0 END) AS bid_depth, count(CASE WHEN side = 'bid' AND price >= mid * (1 - {SETTINGS.depth_band}) THEN 1 END) AS bid_levels,
  sum(CASE WHEN side = 'ask' AND price <= mid * (1 + {SETTINGS.depth_band}) THEN price * qty ELSE 0.0 END) AS ask_depth, count(CASE WHEN side = 'ask' AND price <= mid * (1 + {SETTINGS.depth_band}) THEN 1 END) AS ask_levels FROM bs JOIN bm USING (symbol) GROUP BY ALL)
  SELECT symbol, round(best_bid, 6) AS best_bid, round(best_ask, 6) AS best_ask, round(mid, 6) AS mid, round(bid_depth, 6) AS bid_depth, bid_levels, round(ask_depth, 6) AS ask_depth, ask_levels, round(least(bid_depth, ask_depth), 6) AS depth_min FROM d""",
    "book_slippage": f"""{_LEVELS}, c AS (SELECT *, price * qty AS q, coalesce(sum(price * qty) OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS bf FROM bs),
  tk AS (SELECT *, least(q, greatest({SETTINGS.sweep_quote} - bf, 0.0)) AS take FROM c), s AS (SELECT symbol, side, sum(take) AS q, sum(take / price) AS b FROM tk GROUP BY ALL)
  SELECT symbol, side, round(CASE WHEN q >= {SETTINGS.sweep_quote} - 1e-9 THEN greatest(CASE WHEN side = 'ask' THEN q / b / best_ask - 1 ELSE 1 - q / b / best_bid END, 0.0) END, 6) AS slippage FROM s JOIN bm USING (symbol)""",
    "book_history": f"""WITH {S.LEVEL_UPDATES_SQL}, gr AS (SELECT symbol, unnest(range(CAST(ceil(min(ts) / {BOOK_STEP}) * {BOOK_STEP} AS BIGINT), CAST(ceil(max(ts) / {BOOK_STEP}) * {BOOK_STEP} AS BIGINT) + 1, {BOOK_STEP})) AS t FROM updates GROUP BY symbol),
  v AS (SELECT u.symbol, t, side, price, max_by(qty, seq) AS qty FROM updates u JOIN gr ON gr.symbol = u.symbol AND u.ts <= gr.t GROUP BY ALL HAVING max_by(qty, seq) <> 0),
  b AS (SELECT *, max(CASE WHEN side = 'bid' THEN price END) OVER (PARTITION BY symbol, t) AS bb, min(CASE WHEN side = 'ask' THEN price END) OVER (PARTITION BY symbol, t) AS ba,
    coalesce(sum(price * qty) OVER (PARTITION BY symbol, t, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS ahead FROM v),
  k AS (SELECT *, least(price * qty, greatest({SETTINGS.sweep_quote} - ahead, 0.0)) AS take, CASE WHEN side = 'bid' AND price >= (bb + ba) / 2 * (1 - {SETTINGS.depth_band}) OR side = 'ask' AND price <= (bb + ba) / 2 * (1 + {SETTINGS.depth_band}) THEN price * qty ELSE 0.0 END AS near FROM b WHERE bb > 0 AND ba > 0),
  s AS (SELECT symbol, CAST(t AS DOUBLE) AS t, max(bb) AS best_bid, max(ba) AS best_ask, sum(near) FILTER (side = 'bid') AS bid_depth, sum(near) FILTER (side = 'ask') AS ask_depth, count(*) FILTER (side = 'bid') AS bid_levels, count(*) FILTER (side = 'ask') AS ask_levels,
    sum(take) FILTER (side = 'bid') AS sold, sum(take / price) FILTER (side = 'bid') AS sold_base, sum(take) FILTER (side = 'ask') AS spent, sum(take / price) FILTER (side = 'ask') AS bought FROM k GROUP BY ALL)
  SELECT symbol, round(t, 6) AS t, round(best_bid, 6) AS best_bid, round(best_ask, 6) AS best_ask, round(bid_depth, 6) AS bid_depth, round(ask_depth, 6) AS ask_depth, bid_levels, ask_levels, round(least(bid_depth, ask_depth), 6) AS depth_min,
    round(CASE WHEN spent >= {SETTINGS.sweep_quote} - 1e-9 THEN greatest(spent / bought / best_ask - 1, 0.0) END, 6) AS slippage_buy, round(CASE WHEN sold >= {SETTINGS.sweep_quote} - 1e-9 THEN greatest(1 - sold / sold_base / best_bid, 0.0) END, 6) AS slippage_sell FROM s""",
    "depth_sequence": """WITH l AS (SELECT l_orderkey, sum(l_linenumber) AS n FROM lineitem GROUP BY 1), d AS (SELECT 'B' || CAST(l_orderkey % 7 AS VARCHAR) AS symbol, l_orderkey AS seq, CAST(l_orderkey - n % 3 AS BIGINT) AS first_id, CAST(l_orderkey + n % 11 AS BIGINT) AS final_id FROM l),
  x AS (SELECT *, max(final_id) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la FROM d) SELECT symbol, seq, first_id, final_id, coalesce(final_id <= la, false) AS stale, coalesce(first_id > la + 1, false) AS gap FROM x""",
    "market_format": f"""SELECT o_orderkey, CASE WHEN o_totalprice >= 1e9 THEN printf('%.2fB', CAST(round(CAST(o_totalprice / 1e9 AS DECIMAL(38, 10)), 2) AS DOUBLE)) WHEN o_totalprice >= 1e6 THEN printf('%.2fM', CAST(round(CAST(o_totalprice / 1e6 AS DECIMAL(38, 10)), 2) AS DOUBLE)) WHEN o_totalprice >= 1e3 THEN printf('%.2fK', CAST(round(CAST(o_totalprice / 1e3 AS DECIMAL(38, 10)), 2) AS DOUBLE)) ELSE printf('%.2f', o_totalprice) END AS short,
  printf('%.2fx', CAST(round(CAST(o_totalprice / 1000 AS DECIMAL(38, 10)), 2) AS DOUBLE)) AS ratio, printf('%.2f%%', CAST(round(CAST(o_totalprice / 1e6 * 100 AS DECIMAL(38, 10)), 2) AS DOUBLE)) AS percent, CASE WHEN o_orderkey >= 3600 THEN printf('%dh%02dm%02ds', o_orderkey // 3600, o_orderkey % 3600 // 60, o_orderkey % 60) WHEN o_orderkey >= 60 THEN printf('%dm%02ds', o_orderkey // 60, o_orderkey % 60) ELSE printf('%ds', o_orderkey) END AS duration,
  CASE WHEN o_orderkey * 60 % 3600 = 0 THEN CAST(o_orderkey * 60 // 3600 AS VARCHAR) || 'h' ELSE CAST(o_orderkey AS VARCHAR) || 'm' END AS label, round({_nice("o_totalprice")}, 6) AS nice,
  round({_BUCKET.format(nice=_nice("(m * 0.02)"))}, 6) AS step, round(round_even(o_totalprice / 500.0, 0) * 500.0, 6) AS bucket, round(greatest(100.0, least(200000.0, o_totalprice)), 6) AS clamped FROM (SELECT *, o_totalprice / 1e4 AS m FROM orders)""",
}
