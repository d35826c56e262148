"""One state machine for each symbol over all its market events: trades, best prices, depth diffs, snapshots.

Events wait in state until the watermark has passed them and are then taken in order of time
and sequence, in whichever batches they came. Best prices give the mid that later trades are
joined with, and refills; diffs keep the book's levels, are stale or leave a gap, and after a gap
the book is empty until the next snapshot. A diff without ids is stale. The state of a symbol is its book, its last best
prices and what waits, and goes when the watermark has left its last event behind by ``idle``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "symbol string, ts double, seq long, kind string, price double, bid double, bid_qty double, ask double, ask_qty double, first_id long, final_id long, sides array<string>, prices array<double>, qtys array<double>"
OUTPUT = "symbol string, ts double, seq long, kind string, price double, mid double, refills int, stale boolean, gap boolean, ready boolean, best_bid double, best_ask double"
#: Of one instant and sequence, which kind comes first.
ORDER = {"snapshot": 0, "diff": 1, "trade": 2, "book": 3}


class InOrder(StatefulProcessor):
    """Events (with ``ts`` in seconds and ``seq``) wait until the watermark has passed them and are taken in order of (ts, seq, kind).

    A subclass names its states (``states``) and says what it makes of an event (``taken``, None for
    nothing). All state goes when the watermark is ``idle_ms`` past the key's last event.
    """

    key_names: tuple[str, ...] = ("symbol",)
    whole: tuple[str, ...] = ("seq",)  # pandas makes nullable longs doubles

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def states(self, handle: StatefulProcessorHandle) -> list:
        return []

    def taken(self, e: dict) -> dict | None:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "events string")
        self.until = handle.getValueState("until", "ms long")
        self.own = self.states(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict[int, list[dict]] = {}
        for frame in rows:
            for event in json.loads(frame.drop(columns=[*self.key_names, "_time"], errors="ignore").to_json(orient="records", double_precision=15)):
                event |= {c: None if event[c] is None else int(event[c]) for c in self.whole}
                new.setdefault(int(event["ts"] * 1000) + 1, []).append(event)
        for ms, events in new.items():
            if self.waiting.containsKey((ms,)):
                events = json.loads(self.waiting.getValue((ms,))[0]) + events
            else:
                self.handle.registerTimer(ms)
            self.waiting.updateValue((ms,), (json.dumps(events),))
        if new:
            self._stays(max(new))
        yield pd.DataFrame()

    def _stays(self, ms: int) -> None:
        self.until.update((max(ms, self.until.get()[0] if self.until.exists() else 0),))
        self.handle.registerTimer(ms + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        if self.waiting.containsKey((ms,)):
            events = json.loads(self.waiting.getValue((ms,))[0])
            self.waiting.removeKey((ms,))
            events.sort(key=lambda e: (e["ts"], e["seq"] if e["seq"] is not None else -1, ORDER.get(e.get("kind"), 9)))
            out = [x for x in map(self.taken, events) if x is not None]
        if self.until.exists() and ms >= self.until.get()[0] + self.idle_ms:
            for state in (self.waiting, self.until, *self.own):
                state.clear()
        frame = pd.DataFrame(out)
        if out:
            for k, name in enumerate(self.key_names):
                frame.insert(k, name, key[k])
        yield frame

    def close(self) -> None:
        pass


class SampleProcessor(InOrder):
    """Greedy samples: an event stays if it lies ``spacing`` or more after the last one that stayed."""

    def __init__(self, spacing: float, idle_ms: int) -> None:
        super().__init__(idle_ms)
        self.spacing = spacing

    def states(self, handle: StatefulProcessorHandle) -> list:
        self.last = handle.getValueState("last", "ts double")
        return [self.last]

    def taken(self, e: dict) -> dict | None:
        if self.last.exists() and e["ts"] - self.last.get()[0] < self.spacing:
            return None
        self.last.update((float(e["ts"]),))
        return e


class StreakProcessor(InOrder):
    """How long a tracked state has held: 0 where it starts and for others."""

    key_names = ("symbol", "w")
    tracked = ("TWO_SIDED_ACTIVE", "SUSPECTED_WASH_LIKE")

    def states(self, handle: StatefulProcessorHandle) -> list:
        self.now = handle.getValueState("now", "state string, since long")
        return [self.now]

    def taken(self, e: dict) -> dict | None:
        state, since = self.now.get() if self.now.exists() else (None, e["seq"])
        if state is None or state != e["state"]:
            since = e["seq"]
        self.now.update((e["state"], since))
        return {"t": e["seq"], "state": e["state"], "streak_seconds": e["seq"] - since if e["state"] in self.tracked else 0}


class MarketProcessor(InOrder):
    """See the module. Rows of EVENT in, one row of OUTPUT for each event."""

    whole = ("seq", "first_id", "final_id")

    def __init__(self, refill_quote: float, idle_ms: int) -> None:
        super().__init__(idle_ms)
        self.refill_quote = refill_quote

    def states(self, handle: StatefulProcessorHandle) -> list:
        self.levels = handle.getMapState("levels", "side string, price double", "qty double")
        self.best = handle.getValueState("best", "bid double, bid_qty double, ask double, ask_qty double")
        self.applied = handle.getValueState("applied", "final_id long, ready boolean")
        return [self.levels, self.best, self.applied]

    def taken(self, e: dict) -> dict:
        out = {"ts": e["ts"], "seq": e["seq"], "kind": e["kind"], "price": e["price"], "mid": None, "refills": None, "stale": None, "gap": None, "ready": None, "best_bid": None, "best_ask": None}
        kind = e["kind"]
        if kind == "book":
            now = tuple(e[c] for c in ("bid", "bid_qty", "ask", "ask_qty"))
            before = self.best.get() if self.best.exists() else None
            grown = lambda p, q: before is not None and abs(now[p] - before[p]) <= 1e-12 and (now[q] - before[q]) * now[p] >= self.refill_quote
            out["refills"] = int(grown(0, 1)) + int(grown(2, 3))
            self.best.update(now)
        if kind in ("book", "trade") and self.best.exists():
            bid, _, ask, _ = self.best.get()
            out["mid"] = (bid + ask) / 2
        if kind in ("diff", "snapshot"):
            self._depth(e, out)
        return out

    def _depth(self, e: dict, out: dict) -> None:
        final, ready = self.applied.get() if self.applied.exists() else (0, False)
        if e["kind"] == "snapshot":
            self.levels.clear()
            final, ready, apply = e["final_id"] or 0, True, True
        elif e["first_id"] is None or e["final_id"] is None:
            apply, out["stale"], out["gap"] = False, True, False
        else:
            out["stale"] = bool(ready and e["final_id"] <= final)
            out["gap"] = bool(ready and not out["stale"] and e["first_id"] > final + 1)
            apply = ready and not out["stale"] and not out["gap"]
            if out["gap"]:
                self.levels.clear()
                ready = False
            final = e["final_id"] if apply else final
        if apply:
            for side, price, qty in zip(e["sides"] or [], e["prices"] or [], e["qtys"] or [], strict=True):
                if qty:
                    self.levels.updateValue((side, price), (qty,))
                elif self.levels.containsKey((side, price)):
                    self.levels.removeKey((side, price))
        self.applied.update((final, ready))
        held = list(self.levels.keys()) if ready else []
        out["ready"] = ready
        out["best_bid"] = max((p for s, p in held if s == "bid"), default=None)
        out["best_ask"] = min((p for s, p in held if s == "ask"), default=None)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        """A row of the start (symbol, ts, final_id, sides, prices, qtys): the book as a snapshot left it."""
        for row in initialState.itertuples():
            for side, price, qty in zip(row.sides, row.prices, row.qtys, strict=True):
                if qty:
                    self.levels.updateValue((side, float(price)), (float(qty),))
            self.applied.update((int(row.final_id), True))
            self._stays(int(row.ts * 1000) + 1)


def market_events(trades: DataFrame | None = None, book: DataFrame | None = None, depth: DataFrame | None = None) -> DataFrame:
    """Rows of EVENT from trades (price), best prices (bid, bid_qty, ask, ask_qty) and depth (kind diff or snapshot, ids, levels)."""
    names = [c.split()[0] for c in EVENT.split(", ")]
    kinds = {c.split()[0]: c.split()[1] for c in EVENT.split(", ")}
    parts = [df if kind is None else df.withColumn("kind", F.lit(kind)) for df, kind in ((trades, "trade"), (book, "book"), (depth, None)) if df is not None]
    full = [df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names]) for df in parts]
    out = full[0]
    for df in full[1:]:
        out = out.unionByName(df)
    return out


def _in_order(events: DataFrame, keys: tuple[str, ...], processor: InOrder, output: str, late: str, start: DataFrame | None = None) -> DataFrame:
    timed = events.withColumn("_time", F.timestamp_millis((F.col("ts") * 1000).cast("bigint"))).withWatermark("_time", late)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, output, "Append", "EventTime", start.groupBy(*keys) if start is not None else None)


def _milliseconds(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def processed(events: DataFrame, refill_quote: float, late: str = "10 seconds", idle: str = "1 hour", start: DataFrame | None = None) -> DataFrame:
    """A stream of EVENT rows through the processor; ``start`` holds books to begin with (symbol, ts, final_id, sides, prices, qtys).

    Events later than ``late`` behind the newest are dropped. It needs the RocksDB state store.
    """
    return _in_order(events, ("symbol",), MarketProcessor(refill_quote, _milliseconds(idle)), OUTPUT, late, start)


def sampled_stream(rows: DataFrame, spacing: float = 1.0, late: str = "10 seconds", idle: str = "1 hour") -> DataFrame:
    """The streaming twin of ``operators.market.sampled``, for rows (symbol, seq, ts, ...) of numbers and texts, across batches of any order."""
    schema = ", ".join(f"`{n}` {k}" for n, k in (("symbol", dict(rows.dtypes)["symbol"]), *[x for x in rows.dtypes if x[0] != "symbol"]))
    return _in_order(rows, ("symbol",), SampleProcessor(spacing, _milliseconds(idle)), schema, late)


def streaks_stream(states: DataFrame, late: str = "10 seconds", idle: str = "1 day") -> DataFrame:
    """The streaming twin of ``operators.market.streaks``, for (symbol, w, t, state)."""
    rows = states.select("symbol", "w", F.col("t").cast("double").alias("ts"), F.col("t").cast("bigint").alias("seq"), "state")
    return _in_order(rows, ("symbol", "w"), StreakProcessor(_milliseconds(idle)), "symbol string, w int, t long, state string, streak_seconds long", late)
