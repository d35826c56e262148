import os
import random

from pyspark.sql import functions as F

from sluice.operators import intel as I
from sluice.sources.keyed import KeyedTable

ROW = "k string, at long, v string, over boolean"


def held(table):
    return {r.k: (r["at"], r.v) for r in table.current().collect()}


def test_batches_compactions_and_repeats(spark, tmp_path):
    rng, table, want = random.Random(5), KeyedTable(spark, str(tmp_path / "t"), ("k",), "at", "over"), {}
    assert table.current() is None
    for batch in range(6):
        rows = [(rng.choice(["a", "b", "c", "d", None]), rng.randrange(20), f"v{batch}-{i}", rng.random() < 0.2) for i in range(6)]
        rows = list({(k, at): (k, at, v, over) for k, at, v, over in rows}.values())  # of one batch and time one row for each key
        frame = spark.createDataFrame(rows, ROW)
        table.upsert(frame, batch)
        if batch % 2:
            table.upsert(frame, batch)  # repeated
        for k, at, v, over in sorted(rows, key=lambda r: r[1]):
            if k not in want or at >= want[k][0]:
                want[k] = (at, v, over)
        assert held(table) == {k: x[:2] for k, x in want.items() if not x[2]}
        if batch in (1, 4):
            table.compact()
            want = {k: x for k, x in want.items() if not x[2]}
            assert held(table) == {k: x[:2] for k, x in want.items()}
    assert sorted(os.listdir(tmp_path / "t/base")) == ["upto=1", "upto=4"] and sorted(os.listdir(tmp_path / "t/deltas")) == [f"batch={b}" for b in range(2, 6)]


def test_a_broken_compaction_is_not_read(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("k",), "at")
    table.sink()(spark.createDataFrame([("a", 1, "x", False)], ROW), 0)
    os.makedirs(tmp_path / "t/base/upto=0")
    assert held(table) == {"a": (1, "x")}
    table.compact(), table.compact()
    assert held(table) == {"a": (1, "x")} and os.path.exists(tmp_path / "t/base/upto=0/_SUCCESS")


def test_as_the_sink_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("a", k, f"v{k}", False), (f"k{k}", 5, "y", False)], ROW).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    table = KeyedTable(spark, str(tmp_path / "t"), ("k",), "at")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(table.sink()).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination(100)
    assert held(table) == {"a": (2, "v2"), "k0": (5, "y"), "k1": (5, "y"), "k2": (5, "y")}


def test_united_entries(spark):
    """Tokens in order of their first place; the better representative, of equal ones the later."""
    rep = "struct<pos: long, selection_score: double, topic_quality_score: double, signal_hot: double, captured_at: long, source_confirmed: boolean, source_authority_key: string, source_authority_score: double>"
    row = f"pos long, topic string, event_key string, signature array<string>, snapshot_hits int, evidence_count long, first_seen_at long, last_seen_at long, confirmation_count long, authority_score double, authority_keys array<string>, source_counts map<string,long>, representatives map<string,{rep}>"
    one = lambda p, s, q=1.0, sure=False, key="", score=0.5: (p, s, q, 1.0, 5, sure, key, score)
    entries = [
        (0, "t", "k", ["b", " A "], 1, 2, 7200, 9000, 0, 0.5, ["z"], {"x": 1}, {"x": one(1, 2.0)}),
        (1, "t", "k", ["a", "c", ""], 1, 3, 3600, 8000, 1, 1.5, [], {"x": 2, "rss": 1}, {"x": one(2, 2.0), "rss": one(3, 1.0, 1.0, True, "Site.org", 2.5)}),
        (2, "t", "k", ["d", "b"], 1, 1, 5000, 8500, 0, 1.0, ["z", "y"], {"rss": 4}, {"rss": one(4, 1.0, 0.5, True, "other.org")}),
        (3, "t", "u", [], 1, 1, 10, 10, 0, 0.0, [], {}, {}),
    ]
    united = I.united_entries(spark.createDataFrame(entries, row))
    got = {r.event_key: r for r in united.collect()}
    assert got["k"].signature == ["b", "a", "c", "d"] and got["u"].signature == [] and got["k"].snapshot_hits == 3 and got["k"].source_counts == {"x": 3, "rss": 5}
    assert got["k"].representatives["x"].pos == 2 and got["k"].representatives["rss"].pos == 3
    items = {r.source: r for r in I.expanded_entries(united).collect()}
    assert items.keys() == {"x", "rss"}
    r = items["rss"]
    assert (r.window_hits, r.event_evidence_count, r.event_source_count, r.event_has_x, r.event_confirmation_count, r.event_authority_score, r.event_authority_count, r.window_span_hours, r.representative.pos) == (3, 6, 2, True, 3, 2.5, 3, 1.5, 3)
