"""Metrics as text: what a table or a console shows of each window, and the report of an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N

#: How each metric is written: the text columns by the form they take.
FORMS = {
    N.short_number: ("total_quote", "buy_quote", "sell_quote", "twap_depth", "depth", "median_volume"),
    N.ratio_text: ("volume_ratio", "trade_ratio", "vol_to_depth", "vol_to_twap_depth"),
    N.percent_text: ("price_return", "slippage", "twap_slippage", "top_size_rate", "top5_size_rate", "top_notional_rate", "top5_notional_rate"),
    N.duration_text: ("streak_seconds",),
}
AXES = ("two_sided", "price_stuck", "mechanical")


def projected(metrics: DataFrame) -> DataFrame:
    """Add ``<metric>_text`` for every metric that the rows have, and ``window_label``; a null is n/a."""
    texts = {f"{c}_text": F.when(F.col(c).isNull(), "n/a").otherwise(form(F.col(c))) for form, columns in FORMS.items() for c in columns if c in metrics.columns}
    scalar = F.when(F.col("interval_cv") == N.INF, "inf").otherwise(F.format_string("%.2f", "interval_cv"))
    return metrics.withColumns(texts | {"interval_cv_text": scalar, "window_label": N.window_text(F.col("w"))})


def window_lines(judged: DataFrame) -> DataFrame:
    """Add ``body``: the six lines of a window in the report."""
    c, two = F.col, lambda name: F.format_string("%.2f", name)
    part = lambda label, value: F.concat(F.lit(f"{label}="), value)
    line = lambda *parts: F.concat_ws(", ", *parts)
    both = lambda a, b: F.concat(c(a), F.lit(" ("), c(b), F.lit(")"))
    head = F.concat_ws(" ", F.lpad("window_label", 4, " "), part("state", c("state")), part("score", F.format_string("%.1f", "score")), part("streak", c("streak_seconds_text")), part("verdict", c("level")))
    axes = F.concat_ws(" | ", *[part(a, c(a)) for a in AXES])
    lines: list[Column] = [
        line(part("quote", both("total_quote_text", "volume_ratio_text")), part("buy", c("buy_quote_text")), part("sell", c("sell_quote_text")), part("balance", two("balance"))),
        line(part("trades", F.concat(c("trade_count").cast("string"), F.lit(" ("), c("trade_ratio_text"), F.lit(")"))), part("switch_rate", two("switch_rate")), part("move", c("price_return_text")), part("book_churn", F.concat(two("churn_per_second"), F.lit("/s"))), part("refill", F.concat(two("refill_per_minute"), F.lit("/min")))),
        line(part("vol/depth", c("vol_to_depth_text")), part("size_top1", both("top_size_rate_text", "top_size")), part("size_top5", c("top5_size_rate_text"))),
        line(part("vol/tw_depth", c("vol_to_twap_depth_text")), part("tw_slip", c("twap_slippage_text")), part("gap_cv", c("interval_cv_text")), part("notional_top1", both("top_notional_rate_text", "top_notional"))),
        axes,
    ]
    return projected(judged).withColumn("body", F.array_join(F.array(head, *[F.concat(F.lit("    "), x) for x in lines]), "\n"))


def report(judged: DataFrame, strongest: DataFrame) -> DataFrame:
    """(symbol, t, report): a heading with the strongest window, the baseline, and all windows from the shortest on.

    ``judged`` has ``streak_seconds``; ``strongest`` is that of ``strongest_windows``. An instant of a symbol has as many windows as there are lengths.
    """
    blocks = window_lines(judged).groupBy("symbol", "t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "body"))), lambda x: x["body"]), "\n").alias("_windows"), F.min("median_volume_text").alias("_volume"), F.min("median_trades").alias("_trades"))
    base = F.when(F.col("_trades").isNull(), "baseline_1m=warming_up").otherwise(F.concat(F.lit("baseline_1m=median_quote="), "_volume", F.lit(", median_trades="), F.format_string("%.0f", "_trades")))
    head = F.concat(F.lit("symbol="), F.coalesce("symbol", F.lit("-")), F.lit(" overall="), "level", F.lit(" ("), "window_label", F.lit(")"))
    return blocks.join(strongest.select(F.col("symbol").alias("_s"), F.col("t").alias("_t"), "level", "window_label"), F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("t") == F.col("_t"))).select("symbol", "t", F.concat_ws("\n", head, base, "_windows").alias("report"))
