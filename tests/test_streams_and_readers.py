"""Readers of landed files, streams against their batch twins, and order-dependent operators against plain loops."""

import json
import random

from pyspark.sql import functions as F

from sluice.operators import clusters
from sluice.operators import intel as I
from sluice.operators import market as M
from sluice.operators import ops as O
from sluice.functions import text as T
from sluice.plans import market as P
from sluice.sources import frames, readers
from sluice.streaming import market as S


def write(tmp_path, name, *rows):
    p = tmp_path / name
    p.write_text("\n".join(json.dumps(r) for r in rows))
    return str(p)


def test_readers(spark, tmp_path):
    k = [[i * 60000, "1", "1", "1", "1", "1", (i + 1) * 60000 - 1, str(10 + i), 5 + i] for i in range(5)]
    got = readers.candles_json(spark, write(tmp_path, "k.json", {"symbol": "A", "rows": k}), 4 * 60000, 2).orderBy("open_time").collect()
    assert [(r.open_time, r.quote_volume, r.trade_count) for r in got] == [(120000, 12.0, 7), (180000, 13.0, 8)]
    book = readers.depth_snapshot_json(spark, write(tmp_path, "d.json", {"symbol": "A", "lastUpdateId": 7, "bids": [["1.5", "2"]], "asks": [["1.6", "0"]]}))
    assert sorted((r.side, r.price, r.qty, r.seq) for r in book.collect()) == [("ask", 1.6, 0.0, 7), ("bid", 1.5, 2.0, 7)]
    info = readers.symbol_info_json(spark, write(tmp_path, "s.json", {"symbol": "A", "status": "TRADING", "filters": [{"filterType": "PRICE_FILTER", "tickSize": "0.01"}, {"filterType": "LOT_SIZE", "stepSize": "0.1"}]}, {"symbol": "B", "status": "BREAK", "filters": []}))
    assert [tuple(r) for r in info.collect()] == [("A", 0.01, 0.1)]
    post = {"id": "1", "title": "T &amp; x", "selftext": "<p>body</p>", "author": "a", "subreddit": "s", "permalink": "/r/s/1", "url": "https://www.News.org/x", "score": 3, "created_utc": 5.0}
    item = readers.forum_json(spark, write(tmp_path, "f.json", {"data": {"children": [{"data": post}]}})).head()
    assert (item.text, item.url, item.external_domain, item.created_ts) == ("T & x body", "https://www.reddit.com/r/s/1", "news.org", 5)
    feed = tmp_path / "feed.xml"
    feed.write_text("<rss><channel><item><title>Hello</title><description>b</description><link>https://a.org/1</link><guid>g1</guid><pubDate>x</pubDate></item></channel></rss>")
    entry = readers.feed_xml(spark, str(feed)).head()
    assert (entry.id, entry.text, entry.source_domain) == ("g1", "Hello b", "a.org")
    raw = spark.createDataFrame([('noise {"a": [{"id": "1", "text": "x", "in": {"id": "2", "full_text": "y"}}, {"id": "1", "text": "x"}]}',)], "j string")
    assert sorted((r.id, r.text) for r in readers.nested_posts(raw, "j").collect()) == [("1", "x"), ("2", "y")]


def run(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.sql(f"SELECT * FROM {name}")


def test_flow_stream_as_batch(spark, sf_dir, tmp_path):
    t = P.trades(spark, sf_dir).withColumn("time", F.timestamp_seconds("ts"))
    t.repartitionByRange(4, "time").write.parquet(str(tmp_path / "t"))
    got = {(r.symbol, r.end.timestamp()): (r.trade_count, round(r.total_quote, 6), round(r.balance, 9)) for r in run(S.flow_stream(spark.readStream.schema(t.schema).parquet(str(tmp_path / "t")), 172800, 86400), "flow_out", "complete").collect()}
    batch = t.groupBy("symbol", F.window("time", "172800 seconds", "86400 seconds")).agg(F.count(F.lit(1)).alias("n"), F.sum("quote_qty").alias("q")).collect()
    assert {k: v[:2] for k, v in got.items()} == {(r.symbol, r.window.end.timestamp()): (r.n, round(r.q, 6)) for r in batch}


def test_refills_stream_as_batch(spark, sf_dir, tmp_path):
    b = frames.book(spark, sf_dir)
    b.coalesce(1).write.parquet(str(tmp_path / "b"))
    got = run(S.refills_stream(spark.readStream.schema(b.schema).parquet(str(tmp_path / "b")), 2000.0), "refill_out").collect()
    want = M.book_flags(b, 2000.0).select("symbol", "seq", "refills").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_repeated_batches_and_routing(spark, tmp_path):
    sink, rows = S.write_once(str(tmp_path / "o")), spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    sink(rows, 0), sink(rows, 0), sink(rows, 1)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4
    S.latest_snapshots(str(tmp_path / "l"), "s", "id")(rows.union(rows.withColumn("id", F.lit(9))), 0)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "l")).select("id", "s").collect())) == [(9, "a"), (9, "b")]
    messages = spark.createDataFrame([("btc@aggTrade", '{"p":"1.5"}'), ("btc@depth", "{}")], "stream string, data string")
    assert [tuple(r) for r in S.routed(messages, "@aggTrade", "p string").collect()] == [("btc", "1.5")]


def test_greedy_sampler(spark):
    rng = random.Random(3)
    rows, ts = [], 0.0
    for i in range(300):
        ts += rng.random() * 2
        rows.append(("A", i, ts))
    kept, last = [], None
    for _, i, t in rows:
        if last is None or t - last >= 1.0 or int(t // 3600) != int(last // 3600):
            kept.append(i)
            last = t
    got = M.sampled(spark.createDataFrame(rows, "symbol string, seq long, ts double")).collect()
    assert sorted(r.seq for r in got) == kept


def test_clusters_and_merges(spark):
    rows = [("t", 1, 9.0, ["a", "b", "c"], ["x"], "k1", ""), ("t", 2, 8.0, ["a", "b", "d"], [], "", ""), ("t", 3, 7.0, ["q", "r"], ["e1", "e2"], "", "launch"), ("t", 4, 6.0, ["z"], ["e1", "e2", "e3"], "", "launch"), ("t", 5, 5.0, ["m"], [], "k1", ""), ("t", 6, 4.0, ["n"], [], "", "")]
    frame = spark.createDataFrame(rows, "topic string, pos long, seed double, tokens array<string>, terms array<string>, key string, kind string")
    got = {r.pos: r.cluster for r in clusters.greedy_clusters(frame, ["topic"]).collect()}
    assert got[1] == got[2] == got[5] and got[3] == got[4] and len({got[1], got[3], got[6]}) == 3
    e = spark.createDataFrame([("t", "k1", 1, ["a", "b", "c", "d", "e"]), ("t", "k2", 2, ["a", "b", "c", "d", "e", "f"]), ("t", "k3", 3, ["a", "b", "c", "d", "z"]), ("t", "k1", 4, ["a", "q"])], "topic string, event_key string, pos long, signature array<string>")
    merged = {r.pos: r.merged_key for r in clusters.fuzzy_merge(e).collect()}
    assert merged == {1: "k1", 2: "k1", 3: "k3", 4: "k1"}
    pair = spark.createDataFrame([(["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "z"], False), (["a", "b", "c"], ["a", "b", "c", "d"], True), (["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"], True), (["b", "a"], ["a", "b"], False)], "a array<string>, b array<string>, w boolean")
    assert all(r.g == r.w for r in pair.select("w", clusters.mergeable(F.col("a"), F.col("b")).alias("g")).collect())


def test_text(spark):
    frame = spark.createDataFrame([("x" * 30 + "\n" + "y" * 30 + "\n" + "z" * 75,)], "t string")
    assert frame.select(T.chunked(F.col("t"), 40).alias("c")).head().c == ["x" * 30, "y" * 30, "z" * 40, "z" * 35]
    probe = spark.createDataFrame([("Crowds and flight  plan, 突发 news",)], "t string")
    hits = probe.select(T.keyword_hits(F.lower("t"), ["crowd", "flight plan", "突发", "new", "plane"]).alias("h")).head().h
    assert sorted(hits) == sorted(["crowd", "flight plan", "突发", "new"])
    words = spark.createDataFrame([("这是新闻",), ("plain English",), ("日本のニュース",), ("https://a.b/c",), ("@a #b",)], "t string")
    assert [r[0] for r in words.select(T.needs_translation(F.col("t"))).collect()] == [False, True, True, False, False]


def test_trend_and_tasks(spark):
    history = spark.createDataFrame([(i, 1000 + i, ["a", "A", "b"] if i < 2 else ["a"]) for i in range(3)] + [(9, 1, ["old"])], "run long, captured_at long, alert_codes array<string>")
    repeats = O.trend(history, 1003, 100)
    assert {r.code: r.runs for r in repeats.collect()} == {"a": 3, "b": 2}
    alert = O.trend_alert(repeats, F.lit(3), F.lit(3), ["a"]).head()
    assert (alert.severity, alert.runs) == ("critical", 3) and O.trend_alert(repeats, F.lit(2), F.lit(2), ["a"]).count() == 0
    tasks = spark.createDataFrame([("1", "running"), ("2", "succeeded")], "id string, status string")
    assert {r.id: r.status for r in O.restarted(tasks).collect()} == {"1": "failed", "2": "succeeded"}


def test_book_and_baseline_streams_as_batch(spark, sf_dir, tmp_path):
    levels, candles = frames.levels(spark, sf_dir), frames.candles(spark, sf_dir)
    levels.repartition(3).write.parquet(str(tmp_path / "l"))
    candles.repartition(3).write.parquet(str(tmp_path / "c"))
    book = run(S.levels_stream(spark.readStream.schema(levels.schema).parquet(str(tmp_path / "l"))), "levels_out", "complete").where("qty <> 0").select("symbol", "side", "price", "qty")
    assert sorted(map(tuple, book.collect())) == sorted(map(tuple, M.book_state(levels).select("symbol", "side", "price", "qty").collect()))
    base = run(S.baseline_stream(spark.readStream.schema(candles.schema).parquet(str(tmp_path / "c")), 5), "base_out", "complete")
    got = {r.symbol: sorted(c.quote_volume for c in r.candles)[2] for r in base.collect()}
    assert got == {r.symbol: r.median_volume for r in M.baseline(candles, 5).collect()}


def test_submission_gate(spark):
    tasks = spark.createDataFrame([("1", "failed"), ("2", "queued")], "id string, status string")
    assert not O.may_submit(tasks).head().may_submit and O.may_submit(tasks.where("id = '1'")).head().may_submit


def test_trades_with_book_as_batch(spark, sf_dir, tmp_path):
    """Every trade of a stream gets the mid of the last update before it, as an as-of join gives it."""
    b, t = frames.book(spark, sf_dir), M.trades(frames.raw_trades(spark, sf_dir)).select("symbol", "ts", "seq", "price")
    b.coalesce(1).write.parquet(str(tmp_path / "b"))
    t.coalesce(1).write.parquet(str(tmp_path / "t"))
    read = lambda name, like: spark.readStream.schema(like.schema).parquet(str(tmp_path / name))
    got = run(S.trades_with_book(read("t", t), read("b", b)), "with_book").collect()
    lines = [(r.symbol, r.ts, r.seq, 1, (r.bid + r.ask) / 2) for r in b.collect()] + [(r.symbol, r.ts, r.seq, 0, r.price) for r in t.collect()]
    last, want = {}, {}
    for symbol, _, seq, update, value in sorted(lines):  # at one instant and sequence the trade comes first
        if update:
            last[symbol] = value
        else:
            want[symbol, seq] = (value, last.get(symbol))
    assert {(r.symbol, r.seq): (r.price, r.mid) for r in got} == want and len(got) == len(want)
