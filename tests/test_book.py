"""The whole book at instants, and windows over its samples, against a book that is kept update by update."""

import random
import statistics

import pytest

from sluice.config import MarketSettings
from sluice.operators import market as M
from sluice.plans import market as P
from sluice.sources import frames

BAND, TARGET = 0.01, 3000.0
SCHEMA = "symbol string, seq long, ts double, side string, price double, qty double"


def some_updates(seed, n=400):
    rng, ts, rows = random.Random(seed), 0.0, []
    for i in range(n):
        ts += rng.choice([0.0, 0.25, 0.5, 3.0])
        side, off = rng.choice(["bid", "ask"]), rng.randrange(12) * 0.25
        rows.append((rng.choice(["a", "b", None]), i, ts, side, 100 - off if side == "bid" else 100.25 + off, rng.choice([0.0, 0.0, 3.0, 7.0, 20.0])))
    return rows


def insight(bids, asks):
    """Best prices, depth in the band and slippage of books that map prices to quantities."""
    if not bids or not asks:
        return None
    best_bid, best_ask = max(bids), min(asks)
    mid = (best_bid + best_ask) / 2

    def swept(levels):
        left, base = TARGET, 0.0
        for price, qty in levels:
            take = min(left, price * qty)
            base, left = base + take / price, left - take
        return TARGET / base if left <= 1e-9 else None

    buy, sale = swept(sorted(asks.items())), swept(sorted(bids.items(), reverse=True))
    depth = [sum(p * q for p, q in bids.items() if p >= mid * (1 - BAND)), sum(p * q for p, q in asks.items() if p <= mid * (1 + BAND))]
    return best_bid, best_ask, *depth, len(bids), len(asks), max(0.0, buy / best_ask - 1) if buy else None, max(0.0, 1 - sale / best_bid) if sale else None


def kept(rows, instants):
    """The insight at each (symbol, t), updates up to t applied one by one."""
    out = {}
    for symbol, t in instants:
        books = {"bid": {}, "ask": {}}
        for s, _, ts, side, price, qty in rows:
            if s == symbol and ts <= t:
                books[side].pop(price, None)
                if qty:
                    books[side][price] = qty
        if (found := insight(books["bid"], books["ask"])) is not None:
            out[symbol, t] = found
    return out


@pytest.mark.parametrize("bin_seconds", [7, 3600])
def test_books_at_instants(spark, bin_seconds):
    rows = some_updates(1)
    instants = [(s, float(t)) for s in ("a", "b", None, "c") for t in range(-5, 500, 13)]
    versions = M.book_versions(spark.createDataFrame(rows, SCHEMA))
    levels = M.books_at(versions, spark.createDataFrame(instants, "symbol string, t double"), bin_seconds)
    got = {(r.symbol, r.t): tuple(r)[2:] for r in M.book_insight(levels, BAND, TARGET).select("symbol", "t", "best_bid", "best_ask", "bid_depth", "ask_depth", "bid_levels", "ask_levels", "slippage_buy", "slippage_sell").collect()}
    want = kept(rows, instants)
    assert got.keys() == want.keys() and any(x[-1] is None for x in want.values()) and any(x[-1] for x in want.values())
    for key, values in want.items():
        assert got[key] == pytest.approx(values)


def test_samples_of_the_book(spark):
    rows, settings = some_updates(2), MarketSettings(depth_band=BAND, sweep_quote=TARGET)
    updates = spark.createDataFrame(rows, SCHEMA)
    taken = []
    for symbol in ("a", "b", None):
        last = None
        for ts in sorted({r[2] for r in rows if r[0] == symbol}):
            if last is None or ts - last >= 2.0:
                taken.append((symbol, ts))
                last = ts
    want = {k: (min(v[2], v[3]), max(v[6] or 0.0, v[7] or 0.0)) for k, v in kept(rows, taken).items()}
    samples = M.insight_samples(updates, settings, 2.0)
    got = {(r.symbol, r.ts): (r.depth, r.slippage) for r in samples.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    for r in M.insight_windows(samples, (30, 90), 30).collect():
        own = [v for (s, ts), v in want.items() if s == r.symbol and r.t - r.w <= ts <= r.t]
        assert (r.twap_depth, r.twap_slippage, r.depth_samples) == (pytest.approx(statistics.median(x[0] for x in own)), pytest.approx(statistics.median(x[1] for x in own)), len(own))


def test_window_metrics_on_the_whole_book(spark, sf_dir):
    """Depth and slippage come from the book: of the instant, and as medians of samples."""
    trades, updates = P.trades(spark, sf_dir), frames.level_updates(spark, sf_dir)
    grid = frames.grid(trades, P.STEP)
    out = M.window_metrics(trades, frames.book(spark, sf_dir), frames.candles(spark, sf_dir), grid, P.STEP, P.SETTINGS, updates)
    plain = P.metrics(spark, sf_dir)
    assert sorted(out.columns) == sorted(plain.columns) and out.count() == plain.count()
    now = {(r.symbol, int(r.t)): r for r in M.book_insight(M.books_at(M.book_versions(updates), grid), P.SETTINGS.depth_band, P.SETTINGS.sweep_quote).collect()}
    rows = out.collect()
    assert now and all(r.depth == pytest.approx(now[r.symbol, r.t].depth_min if (r.symbol, r.t) in now else 0.0) for r in rows)
    assert any(r.twap_depth > 0 for r in rows) and all(r.vol_to_depth == pytest.approx(r.total_quote / r.depth if r.depth > 0 else 0.0) for r in rows)


def test_sparse_samples_take_few_stretches_and_bins(spark, monkeypatch):
    """Sparse rows are not dealt to a stretch for each sample, nor levels to bins without one; the samples stay the greedy ones."""
    sizes, bins, stretch, books_at = [], [], M.stretch, M.books_at
    monkeypatch.setattr(M, "stretch", lambda column, size: sizes.append((column, size)) or stretch(column, size))
    monkeypatch.setattr(M, "books_at", lambda versions, instants, bin_seconds=3600: bins.append(bin_seconds) or books_at(versions, instants, bin_seconds))
    rng = random.Random(3)
    rows = [("ab"[i % 2], i, i * 1500.0 + rng.choice([0, 40, 900]), "bid" if i % 3 else "ask", 100.0 + (i % 3 == 0) * (1 + i % 4) - i % 5 * 0.25 * (i % 3 > 0), 5.0) for i in range(400)]
    updates, settings = spark.createDataFrame(rows, SCHEMA), MarketSettings(depth_band=BAND, sweep_quote=TARGET)
    got = {(r.symbol, r.ts) for r in M.insight_samples(updates, settings, 21_600.0).collect()}
    assert bins == [21_600]
    assert max(size for column, size in sizes if column == "ts") >= 400 * 1500
    for rows_in_one in (1, 30, 20_000):
        monkeypatch.setattr(M, "STRETCH_ROWS", rows_in_one)
        want, last = set(), {}
        for s, _, ts, *_ in rows:
            if s not in last or ts - last[s] >= 21_600.0:
                want.add((s, ts))
                last[s] = ts
        assert {(r.symbol, r.ts) for r in M.sampled(updates.select("symbol", "ts", "seq"), 21_600.0).collect()} == want
    assert got == {x for x in want if x in kept(rows, want)}
