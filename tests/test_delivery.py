import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import delivery as D
from sluice.sources.outbox import Outbox

LOG = "channel string, seq long, day string, kind string, due boolean"


def machine(rows):
    """The rule, one row after the other."""
    state, out = {}, {}
    for channel, seq, day, kind, due in sorted(rows, key=lambda r: r[1]):
        s = state.setdefault(channel, {"day": None, "pending": None, "sent": None})
        if kind in ("sending", "sent_not_committed", "committed", "failed"):
            if day != s["day"]:
                s["pending"] = None
            s["day"] = day
            if s["sent"] == day:
                got = "already_sent"
            elif s["pending"]:
                got = "held"
            elif not due:
                got = "waiting"
            else:
                got = kind
                if kind == "committed":
                    s["sent"] = day
                elif kind != "failed":
                    s["pending"] = kind
        elif kind in ("confirm", "clear"):
            got = "nothing"
            if s["pending"]:
                got = kind.rstrip("r") + ("ed" if kind == "confirm" else "red")
                if kind == "confirm":
                    s["sent"] = s["day"]
                s["pending"] = None
        else:
            got = "ignored"
        out[channel, seq] = got
    return out, state


@pytest.mark.parametrize("size", [3, 1 << 20])
def test_outcomes_as_the_machine(spark, monkeypatch, size):
    monkeypatch.setattr(D, "SEQ_STRETCH", size)
    rng, rows, seq = random.Random(3), [], 0
    for day in range(12):
        for _ in range(14):
            seq += 1
            kind = rng.choice(["sending", "sent_not_committed", "committed", "failed", "failed", "confirm", "clear", "clear", "note", None])
            rows.append((rng.choice(["a", "a", "b", None]), seq, f"2024-01-{day + 1:02d}", kind, rng.choice([True, True, True, False, None])))
    settled = D.outcomes(spark.createDataFrame(rows, LOG).withColumn("extra", F.lit(1))).cache()
    want, state = machine(rows)
    assert {(r.channel, r.seq): r.outcome for r in settled.collect()} == want
    stands = {r.channel: (r.last_sent_day, r.pending) for r in D.standing(settled).collect()}
    assert stands == {c: (s["sent"], s["pending"]) for c, s in state.items()}
    assert D.outcomes(spark.createDataFrame([], LOG)).count() == 0


def client(wire, failing=(), silent=()):
    """A client whose wire is a folder: what is written there is out."""

    def send(rows):
        rows.where(~F.col("key").isin("", *failing, *silent)).write.mode("append").parquet(wire)
        error = F.when(F.col("key").isin("", *failing), "refused")
        return rows.where(~F.col("key").isin("", *silent)).select("key", F.when(error.isNull(), F.col("fingerprint")).alias("message_id"), error.alias("error"))

    return send


def test_outbox(spark, tmp_path):
    box, wire = Outbox(spark, str(tmp_path / "log")), str(tmp_path / "wire")
    rows = lambda *keys: spark.createDataFrame([(k, f"text {k}") for k in keys] + [(None, "x"), ("blank", " ")], "key string, body string")
    out = lambda: sorted(r.key for r in spark.read.parquet(wire).collect())
    state = lambda: {r.key: r.state for r in box.states().collect()}
    assert box.pending().count() == 0 and box.registry().count() == 0

    box.deliver(rows("a", "b", "b"), 0, 100, client(wire, failing=["b"]))
    assert out() == ["a"] and state() == {"a": "committed", "b": "failed"}
    box.deliver(rows("a", "b"), 0, 110, client(wire))  # the batch again: only what failed goes out
    assert out() == ["a", "b"] and [tuple(r) for r in box.registry().orderBy("key").collect()] == [("a", 100), ("b", 110)]

    box.deliver(rows("c", "d"), 1, 200, client(wire, silent=["d"]))  # nobody knows about d
    assert out() == ["a", "b", "c"] and state()["d"] == "sending"
    box.deliver(rows("c", "d"), 1, 210, client(wire))
    box.deliver(rows("d"), 2, 220, client(wire))
    assert out() == ["a", "b", "c"]  # held, in its own batch and in later ones
    box.resolve("clear", spark.createDataFrame([("d",)], "key string"))
    box.deliver(rows("d"), 3, 230, client(wire))
    assert out() == ["a", "b", "c", "d"] and state()["d"] == "committed"
    with pytest.raises(ValueError):
        box.resolve("drop")


def test_outbox_survives_breaks(spark, tmp_path, monkeypatch):
    box, wire = Outbox(spark, str(tmp_path / "log")), str(tmp_path / "wire")
    one = spark.createDataFrame([("k", "text")], "key string, body string")
    out = lambda: spark.read.parquet(wire).count()

    def broken(rows):
        client(wire)(rows)
        raise OSError("gone")

    with pytest.raises(OSError):
        box.deliver(one, 0, 1, broken)
    box.deliver(one, 0, 2, client(wire))
    assert out() == 1 and box.pending().head().state == "sending"
    box.resolve("confirm")
    assert box.registry().head().sent_at == 1

    two = spark.createDataFrame([("m", "text")], "key string, body string")
    with monkeypatch.context() as m:
        m.setattr(Outbox, "commit", lambda self, batch: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            box.deliver(two, 1, 3, client(wire))
    assert box.pending().head().state == "sent_not_committed"
    box.deliver(two, 1, 4, client(wire))  # the batch again commits and does not send
    assert out() == 2 and box.pending().count() == 0
    box.table.compact()
    box.deliver(two, 2, 5, client(wire))
    assert out() == 2 and box.registry().count() == 2


def test_outbox_as_a_sink(spark, tmp_path):
    source, wire = str(tmp_path / "in"), str(tmp_path / "wire")
    spark.createDataFrame([(f"k{i % 5}", f"t{i % 5}") for i in range(20)], "key string, body string").repartition(3).write.parquet(source)
    box = Outbox(spark, str(tmp_path / "log"))
    stream = spark.readStream.schema("key string, body string").option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(box.sink(client(wire), lambda: 7)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(wire).collect()) == [f"k{i}" for i in range(5)]
    assert box.registry().count() == 5
