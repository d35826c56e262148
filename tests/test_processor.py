"""The market processor over batches that mix up the order of events, against a loop over events in order."""

import random

import pytest
from sluice.operators import market as M
from sluice.streaming import processor as S

NAMES = [c.split()[0] for c in S.EVENT.split(", ")]


def event(symbol, ts, seq, kind, **values):
    return tuple({"symbol": symbol, "ts": ts, "seq": seq, "kind": kind, **values}.get(n) for n in NAMES)


def some_events(seed, n=160):
    rng, rows, last = random.Random(seed), [], {"a": 0, "b": 0}
    for i in range(n):
        s, ts = rng.choice("ab"), 1000.0 + i * 0.5
        kind = rng.choice(["trade", "trade", "book", "book", "diff", "diff", "snapshot" if i % 3 == 0 else "diff"])
        if kind == "trade":
            rows.append(event(s, ts, i, kind, price=100.0 + rng.randrange(5)))
        elif kind == "book":
            rows.append(event(s, ts, i, kind, bid=100.0 + rng.randrange(2), bid_qty=rng.choice([1.0, 50.0]), ask=102.0, ask_qty=rng.choice([1.0, 60.0])))
        else:
            jump = rng.choice([1, 1, 1, 1, 0, 4])
            first = last[s] + jump
            final = first + rng.randrange(3) - (jump == 0)
            last[s] = max(last[s], final)
            levels = [(rng.choice(["bid", "ask"]), rng.randrange(4), rng.choice([0.0, 2.0])) for _ in range(3)]
            rows.append(event(s, ts, i, kind, first_id=first, final_id=final, sides=[x[0] for x in levels], prices=[99.0 - p if side == "bid" else 101.0 + p for side, p, _ in levels], qtys=[x[2] for x in levels]))
    return rows


def looped(rows, limit, start=()):
    """Events in order, one by one."""
    best, books, out = {}, {s: (final, True, dict(levels)) for s, final, levels in start}, {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        e = dict(zip(NAMES, row, strict=True))
        s, mid, refills, stale, gap, ready, bid, ask = e["symbol"], None, None, None, None, None, None, None
        if e["kind"] == "book":
            old = best.get(s)
            refills = sum(old is not None and old[p] == e[p] and (e[q] - old[q]) * e[p] >= limit for p, q in (("bid", "bid_qty"), ("ask", "ask_qty")))
            best[s] = e
        if e["kind"] in ("book", "trade") and s in best:
            mid = (best[s]["bid"] + best[s]["ask"]) / 2
        if e["kind"] in ("diff", "snapshot"):
            final, ready, levels = books.get(s, (0, False, {}))
            if e["kind"] == "snapshot":
                final, ready, levels, use = e["final_id"], True, {}, True
            else:
                stale = ready and e["final_id"] <= final
                gap = ready and not stale and e["first_id"] > final + 1
                use = ready and not stale and not gap
                ready, final = ready and not gap, e["final_id"] if use else final
            if use:
                for side, price, qty in zip(e["sides"], e["prices"], e["qtys"], strict=True):
                    levels[side, price] = qty
                levels = {k: q for k, q in levels.items() if q}
            books[s] = final, ready, levels
            bid = max((p for x, p in levels if x == "bid"), default=None) if ready else None
            ask = min((p for x, p in levels if x == "ask"), default=None) if ready else None
        out[s, e["seq"]] = (mid, refills, stale, gap, ready, bid, ask)
    return out


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def run(spark, path, batches, **options):
    """The processor's rows over batches of events, one file each, in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, S.EVENT).coalesce(1).write.parquet(f"{path}/in/{k:02d}")
    stream = spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").option("recursiveFileLookup", "true").parquet(f"{path}/in")
    out = S.processed(S.market_events(depth=stream), 1000.0, **options)
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination(150)
    return {(r.symbol, r.seq): tuple(r)[5:] for r in spark.read.schema(S.OUTPUT).parquet(f"{path}/out").collect()}


def test_events_of_mixed_batches_are_taken_in_order(spark, tmp_path, rocks):
    rows = some_events(1)
    rng = random.Random(2)
    parts = [rows[:60], rows[60:120], rows[120:]]
    for k in range(2):  # some of each batch come with the next one, within the allowed lateness
        late = rng.sample(parts[k][30:], 12)
        parts[k] = [r for r in parts[k] if r not in late]
        parts[k + 1] = late + parts[k + 1]
    for p in parts:
        rng.shuffle(p)
    end = [event(s, 5000.0, 999, "trade", price=1.0) for s in "ab"]
    start = spark.createDataFrame([("a", 999.0, 0, ["bid", "ask"], [90.0, 110.0], [5.0, 5.0])], "symbol string, ts double, final_id long, sides array<string>, prices array<double>, qtys array<double>")
    got = run(spark, tmp_path, [*parts, end], late="40 seconds", start=start)
    want = looped(rows, 1000.0, [("a", 0, {("bid", 90.0): 5.0, ("ask", 110.0): 5.0})])
    assert got == want
    assert any(w[3] for w in want.values()) and any(w[2] for w in want.values()) and any(w[1] for w in want.values())


def test_idle_state_goes(spark, tmp_path, rocks):
    """After an hour without events the last best prices are forgotten."""
    first = [event("a", 1000.0, 1, "book", bid=1.0, bid_qty=1.0, ask=3.0, ask_qty=1.0), event("a", 1001.0, 2, "trade", price=2.0)]
    tick = [event("b", 8000.0, 3, "trade", price=2.0)]
    again = [event("a", 8001.0, 4, "trade", price=2.0)]
    got = run(spark, tmp_path, [first, tick, tick, again, [event("b", 9000.0, 5, "trade", price=1.0)]], late="1 second")
    assert got["a", 2][0] == 2.0 and got["a", 4][0] is None


def streamed(spark, path, rows, schema, build, seed):
    """Rows in batches by time, shuffled, some of each a batch late; then one far row to close."""
    rng, n = random.Random(seed), len(rows) // 3
    parts = [list(rows[:n]), list(rows[n : 2 * n]), list(rows[2 * n :])]
    for k in range(2):
        late = rng.sample(parts[k][n // 2 :], n // 5)
        parts[k] = [r for r in parts[k] if r not in late]
        parts[k + 1] = late + parts[k + 1]
    parts.append([tuple(1e6 if type(x) is float else 10**6 if c == "t" else x for x, c in zip(rows[0], schema.replace(",", "").split()[::2], strict=True))])
    for k, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/in/{k}")
    out = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in"))
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination(150)
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def test_samples_as_batch(spark, tmp_path, rocks):
    rng, schema = random.Random(7), "symbol string, seq long, ts double, mid double"
    rows = [(rng.choice("ab"), i, 100 + i * 0.3, 1.0 + i) for i in range(240)]
    got = streamed(spark, tmp_path, rows, schema, lambda s: S.sampled_stream(s, 2.0, "60 seconds"), 8)
    want = M.sampled(spark.createDataFrame(rows, schema), 2.0)
    assert sorted(map(tuple, got.where("ts < 1000").collect())) == sorted(map(tuple, want.collect()))


def test_streaks_as_batch(spark, tmp_path, rocks):
    rng, schema, state = random.Random(9), "symbol string, w int, t long, state string", "NORMAL"
    rows = []
    for i in range(90):
        state = rng.choice([state, state, "NORMAL", "TWO_SIDED_ACTIVE", "SUSPECTED_WASH_LIKE"])
        rows.append(("a", rng.choice([300, 600]), 1000 + 10 * i, state))
    got = streamed(spark, tmp_path, rows, schema, lambda s: S.streaks_stream(s, "2000 seconds"), 10)
    columns = ["symbol", "w", "t", "state", "streak_seconds"]
    want = M.streaks(spark.createDataFrame(rows, schema)).select(columns)
    assert sorted(map(tuple, got.where("t < 100000").select(columns).collect())) == sorted(map(tuple, want.collect()))
