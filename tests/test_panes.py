"""Windows from panes against all rows of each window, and rows with null keys."""

import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.functions.numeric import bucket_step, bucket_text, bucketed
from sluice.operators import market as M
from sluice.operators import panes

TRADE = "symbol string, seq long, ts double, side string, price double, quote_qty double, qty_text string"


def some_trades(seed, n, span):
    rng = random.Random(seed)
    at = sorted(rng.choice([float(rng.randrange(span)), rng.random() * span]) for _ in range(n))
    return [(rng.choice(["a", "a", "a", "b", None]), i, t, rng.choice(["BUY", "SELL"]), 100.0 + rng.randrange(9), float(rng.choice([5, 20, 21, 80, 300])), rng.choice(["1", "2", "7.5", None])) for i, t in enumerate(at)]


def windows_of(rows, windows, step):
    held = defaultdict(list)
    last = max(r[2] for r in rows)
    for w in windows:
        for t in range(0, int(last) + w + 2 * step, step):
            for r in rows:
                if t - w <= r[2] <= t:
                    held[r[0], w, t].append(r)
    return held


@pytest.mark.parametrize(("windows", "step", "span"), [((7, 20), 1, 60), ((6, 60, 25), 4, 150), ((3,), 10, 100), ((300, 900), 60, 2000)])
def test_flow(spark, windows, step, span):
    rows = some_trades(step, 150, span)
    got = {(r.symbol, r.w, r.t): r for r in M.flow(spark.createDataFrame(rows, TRADE), windows, step).collect()}
    want = windows_of(rows, windows, step)
    assert got.keys() == want.keys()
    for key, own in want.items():
        r, gaps = got[key], [b[2] - a[2] for a, b in zip(own, own[1:], strict=False)]
        turns = sum(a[3] != b[3] for a, b in zip(own, own[1:], strict=False))
        cv = statistics.pstdev(gaps) / statistics.mean(gaps) if len(own) >= 6 and statistics.mean(gaps) > 0 else 1.0
        assert (r.trade_count, r.switches, r.first_price, r.last_price) == (len(own), turns, own[0][4], own[-1][4])
        assert [r.total_quote, r.buy_quote, r.interval_cv] == pytest.approx([sum(x[5] for x in own), sum(x[5] for x in own if x[3] == "BUY"), cv])


def test_concentrations(spark):
    rows, windows, step = some_trades(9, 120, 90), (10, 40), 3
    frame = spark.createDataFrame([(x,) for x in (5.0, 20.0, 21.0, 80.0, 300.0)], "q double")
    got = {(r.symbol, r.w, r.t): r for r in M.concentrations(spark.createDataFrame(rows, TRADE), windows, step).collect()}
    want = windows_of(rows, windows, step)
    assert got.keys() == want.keys()
    means = sorted({sum(x[5] for x in own) / len(own) for own in want.values()})
    text = {(r.m, r.q): r.t for r in frame.crossJoin(spark.createDataFrame([(m,) for m in means], "m double")).select("m", "q", bucket_text(bucketed(F.col("q"), bucket_step(F.col("m"))), bucket_step(F.col("m"))).alias("t")).collect()}
    for key, own in want.items():
        mean = sum(x[5] for x in own) / len(own)
        for name, values in (("size", [x[6] for x in own]), ("notional", [text[mean, x[5]] for x in own])):
            counts = Counter(values)  # in order of first occurrence, which settles ties
            top = [n for _, n in counts.most_common(5)]
            assert got[key][f"top_{name}"] == counts.most_common(1)[0][0]
            assert got[key][f"top_{name}_rate"] == pytest.approx(top[0] / len(own)) and got[key][f"top5_{name}_rate"] == pytest.approx(sum(top) / len(own))


def test_a_window_needs_few_panes(spark):
    """A second's steps over ten minutes: no trade is copied, and of panes and blocks far fewer than 600 make a window."""
    rows = spark.range(5000).select(F.lit("a").alias("symbol"), (F.col("id") / 2).alias("ts"), F.lit(1).alias("n"))
    state = panes.with_panes(rows, (600,), 1).groupBy("symbol", "pane", "edge").agg(F.sum("n").alias("n"))
    parts = panes.window_parts(state, ["symbol"], [F.sum("n").alias("n")], (600,), 1)
    held = parts.where("t BETWEEN 700 AND 2000").groupBy("t").agg(F.count("*").alias("parts"), F.sum("n").alias("n")).agg(F.max("parts"), F.min("n"), F.max("n")).head()
    assert held[0] < 130 and (held[1], held[2]) == (1201, 1201)


def test_null_keys_lose_no_rows(spark):
    book = spark.createDataFrame([("a", 1, 1.0, 10.0, 5.0, 11.0, 5.0), (None, 2, 2.0, 10.0, 5.0, 11.0, 5.0), (None, 3, 3.0, 10.0, 9000.0, 11.0, 5.0), ("a", None, 4.0, 10.0, 5.0, 11.0, 5.0)], "symbol string, seq long, ts double, bid double, bid_qty double, ask double, ask_qty double")
    assert sorted((r.ts, r.refills) for r in M.book_flags(book, 2000.0).collect()) == [(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 0)]
    diffs = spark.createDataFrame([(None, 1, 1, 5), (None, 2, 4, 5), ("a", None, 1, 2)], "symbol string, seq long, first_id long, final_id long")
    assert sorted((r.first_id, r.stale, r.gap) for r in M.sequence_flags(diffs).collect()) == [(1, False, False), (1, False, False), (4, True, False)]
    samples = spark.createDataFrame([(None, 1, 5.0, 1.0, 2.0, 3.0), ("a", 2, 7.0, 4.0, 5.0, 6.0)], "symbol string, seq long, ts double, depth double, slippage double, mid double")
    instants = spark.createDataFrame([(None, 10), ("a", 10), ("a", 0)], "symbol string, t long")
    assert {(r.symbol, r.t): r.mid for r in M.latest(samples, instants, 10).collect()} == {(None, 10): 3.0, ("a", 10): 6.0, ("a", 0): None}
