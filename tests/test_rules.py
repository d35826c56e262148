"""Rules that depend on order or on rare input, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.functions import text as T
from sluice.functions import values as V
from sluice.operators import clusters
from sluice.operators import digest as D
from sluice.operators import market as M
from sluice.sources import readers


def test_latest_carries_samples_from_before_the_first_instant(spark):
    samples = spark.createDataFrame([("a", 1, 3.0, 7.0, 0.1, 5.0), ("a", 2, 200_000.0, 8.0, 0.2, 6.0), ("b", 1, 500.0, 1.0, 0.3, 2.0)], "symbol string, seq long, ts double, depth double, slippage double, mid double")
    instants = spark.createDataFrame([("a", 60), ("a", 120), ("a", 199_980), ("a", 200_040), ("b", 60), ("c", 60)], "symbol string, t long")
    got = {(r.symbol, r.t): r.mid for r in M.latest(samples, instants, 60).collect()}
    assert got == {("a", 60): 5.0, ("a", 120): 5.0, ("a", 199_980): 5.0, ("a", 200_040): 6.0, ("b", 60): None, ("c", 60): None}


def test_windows_shorter_than_the_step(spark):
    rows = spark.createDataFrame([(100.0,), (550.0,), (600.0,)], "ts double")
    assert sorted((r.ts, r.w, r.t) for r in M.dealt(rows, (300, 900), 600).collect()) == [(100.0, 900, 600), (550.0, 300, 600), (550.0, 900, 600), (550.0, 900, 1200), (600.0, 300, 600), (600.0, 900, 600), (600.0, 900, 1200)]


@pytest.mark.parametrize("spacing", [1.0, 0.3, 7.5])
def test_samples_by_the_true_rule(spark, spacing):
    """The choice goes on over hours; spans without rows lie between."""
    rng, rows, seq = random.Random(3), [], 0
    for symbol in "ab":
        at = 0.0
        for _ in range(1500):
            at += rng.choice([0.0, 0.1, 0.25, 0.5, 1.0, 3.0, 9.0, 400.0 if rng.random() < 0.02 else 0.7])
            rows.append((symbol, seq, round(at, 3)))
            seq += 1
    want = set()
    for symbol in "ab":
        last = None
        for _, seq, ts in sorted((r for r in rows if r[0] == symbol), key=lambda r: (r[2], r[1])):
            if last is None or ts - last >= spacing:
                want.add((symbol, seq))
                last = ts
    got = M.sampled(spark.createDataFrame(rows, "symbol string, seq long, ts double"), spacing, 60)
    assert {(r.symbol, r.seq) for r in got.collect()} == want


def test_walks_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(M, "SEQ_STRETCH", 10)
    rng = random.Random(5)
    rows = [("a", i, 100 + rng.randint(0, 1), float(rng.randint(1, 50)), 101.0, float(rng.randint(1, 50))) for i in range(0, 200, 3)]
    got = {r.seq: r.refills for r in M.book_flags(spark.createDataFrame([(s, i, float(b), c, d, e) for s, i, b, c, d, e in rows], "symbol string, seq long, bid double, bid_qty double, ask double, ask_qty double"), 1000.0).collect()}
    for before, now in zip(rows, rows[1:], strict=False):
        assert got[now[1]] == sum(p == p0 and (q - q0) * p >= 1000 for p0, q0, p, q in ((*before[2:4], *now[2:4]), (*before[4:6], *now[4:6])))
    diffs = [("a", i, i - rng.randint(0, 2), i + rng.randint(0, 6)) for i in range(0, 100, 4)]
    flags = {r.seq: (r.stale, r.gap) for r in M.sequence_flags(spark.createDataFrame(diffs, "symbol string, seq long, first_id long, final_id long")).collect()}
    top = None
    for _, seq, first, final in diffs:
        assert flags[seq] == ((False, False) if top is None else (final <= top, first > top + 1))
        top = final if top is None else max(top, final)


def test_keyword_rules(spark):
    terms = ["c++", "(x", "", " Bank ", "x", "rate cut", "e-mail", "a_b", "税", "cats", "cat"]
    texts = ["we use c++ here", "f(x) is", "banks and bankers", "two  rate\tcuts", "rate  cut now", "send e-mails", "an e-mail", "a_b", "降税了", "cats", "cat", "nothing"]
    want = [["c++"], ["(x", "x"], ["bank"], [], ["rate cut"], [], ["e-mail"], ["a_b"], ["税"], ["cat", "cats"], ["cat"], []]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.keyword_hits(F.col("t"), terms).alias("h")).collect()
    assert [sorted(r.h) for r in sorted(got)] == want


def test_posts_at_any_depth(spark):
    text = '{"id": "1", "text": "top", "a": ' + '{"b": [' * 9 + '{"id": "2", "text": "deep"}' + "]}" * 9 + "}"
    raw = spark.createDataFrame([(text,), ("no json",), (None,)], "j string")
    assert sorted((r.id, r.text) for r in readers.nested_posts(raw, "j").collect()) == [("1", "top"), ("2", "deep")]


def items_for_clusters(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    return [(i, "g", float(rng.randint(0, 9)), rng.sample(words, rng.randint(0, 7)), rng.sample(words[:8], rng.randint(0, 4)), rng.choice(["", "k1", "k2", "k3", f"u{i}"]), rng.choice(["", "p", "q"])) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "task_rows"), [(0, 120, 1000), (1, 120, 1000), (2, 45, 0), (3, 60, 0)])
def test_greedy_clusters_by_the_rule(spark, seed, n, task_rows):
    """In one task and, for groups above ``task_rows``, in rounds."""
    rows = items_for_clusters(n, seed)
    known, want = [], {}
    for pos, _, _, tokens, terms, key, kind in sorted(rows, key=lambda r: (-r[2], r[0])):
        scored = []  # (place, likeness, kindred), all clusters compared
        home = next((i for i, c in enumerate(known) if key and key in c["keys"]), None)
        if home is None:
            best, top = None, 0.0
            for i, c in enumerate(known):
                union = set(tokens) | c["tokens"]
                like = len(set(tokens) & c["tokens"]) / len(union) if union and tokens and c["tokens"] else 0.0
                if kind and kind in c["kinds"] and len(set(terms) & c["terms"]) >= 2:
                    best, top = i, max(top, 0.72)
                if like > top:
                    best, top = i, like
                scored.append(like)
            if best is not None and (top >= 0.32 or len(set(tokens) & known[best]["tokens"]) >= 3 or len(set(terms) & known[best]["terms"]) >= 2):
                home = best
        if home is None:
            home = len(known)
            known.append({"tokens": set(), "terms": set(), "keys": set(), "kinds": set()})
        for name, values in (("tokens", tokens), ("terms", terms), ("keys", [key] if key else []), ("kinds", [kind] if kind else [])):
            known[home][name] |= set(values)
        want[pos] = home + 1
    frame = spark.createDataFrame(rows, "pos long, g string, seed double, tokens array<string>, terms array<string>, key string, kind string")
    assert {r.pos: r.cluster for r in clusters.greedy_clusters(frame, ["g"], task_rows=task_rows).collect()} == want


@pytest.mark.parametrize(("seed", "task_rows"), [(0, 1000), (1, 1000), (2, 5)])
def test_fuzzy_merge_by_the_rule(spark, seed, task_rows):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.choice([f"e{i // 2}", f"e{rng.randint(0, 30)}"]), i, [rng.choice(["h1", "h2"]), *rng.sample([f"t{j}" for j in range(9)], rng.randint(0, 5))][: rng.randint(0, 9)]) for i in range(80)]
    kept, want = [], {}
    for topic, key, pos, signature in rows:
        for other in kept:
            a, b = set(signature), set(other["tokens"])
            shared = len(a & b)
            near = bool(a and b) and signature[0] == other["tokens"][0] and ((shared >= 3 and shared == min(len(a), len(b))) or (shared >= 4 and shared / len(a | b) >= 0.8))
            if other["topic"] == topic and (other["key"] == key or near):
                other["tokens"] += [t for t in signature if t not in other["tokens"]]
                want[pos] = other["key"]
                break
        else:
            kept.append({"topic": topic, "key": key, "tokens": list(signature)})
            want[pos] = key
    got = clusters.fuzzy_merge(spark.createDataFrame(rows, "topic string, event_key string, pos long, signature array<string>"), task_rows)
    assert {r.pos: r.merged_key for r in got.collect()} == want


def test_a_chain_of_entries_is_one_group(spark):
    """Each entry shares one token with the next, in an order of its own."""
    n = 500
    at = [(i * 373 + 11) % n for i in range(n)]
    rows = [("t", f"e{i}", at[i], ["h", f"s{i}", f"s{i + 1}"]) for i in range(n)]
    got = clusters.kindred(spark.createDataFrame(rows, "topic string, event_key string, pos long, signature array<string>")).collect()
    assert len(got) == n and {r._group for r in got} == {0}


def test_chunks_by_the_rule(spark, sf_dir):
    """Cuts at the last line end past the middle, or at the limit; line ends at the cut go."""
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()} | {-1: "", -2: "x" * 2500, -3: ("y" * 700 + "\n") * 5, -4: "a\n\n\n" + "b" * 999 + "\n\n" + "c" * 1200}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.c for r in frame.select("doc_id", T.chunked(F.col("text"), 1000).alias("c")).collect()}
    for d, text in rows.items():
        want, rest = [], text.strip()
        while rest:
            cut = len(rest) if len(rest) <= 1000 else rest[:1000].rfind("\n")
            cut = cut if len(rest) <= 1000 or cut > 500 else 1000
            want.append(rest[:cut])
            rest = rest[cut:].lstrip("\n")
        assert got[d] == want, d


def test_values(spark):
    row = spark.range(1).select(
        V.whole(F.lit("12"), 5).alias("a"), V.whole(F.lit("x"), 5).alias("b"), V.whole(F.lit("-7"), 5).alias("c"), V.whole(F.lit("99"), 5, 1, 20).alias("d"), V.whole(F.lit("3.9"), 5).alias("e"),
        V.iso_utc(F.lit(1_700_000_000)).alias("f"), V.iso_utc(F.lit(0)).alias("g"), V.clock(F.lit(1_700_000_000), "Asia/Tokyo").alias("h"), V.strict_time(F.lit("2023-11-14T22:13:20+00:00")).alias("i"), V.strict_time(F.lit("2023-11-14T22:13:20")).alias("j"),
        V.daily_minute(F.lit("07:05")).alias("k"), V.daily_minute(F.lit("25:00")).alias("l"), V.safe_zone(F.lit("Europe/Paris")).alias("m"), V.safe_zone(F.lit("Moon/Base")).alias("n"), V.day_of(F.lit("digest-2024-02-03.json"), F.lit("2023-01-01")).alias("o"),
        V.window_start(F.lit(None).cast("long"), F.lit(100_000)).alias("p"), V.filled(F.lit(" "), F.lit(None).cast("string"), F.lit(" z ")).alias("q"), V.json_object(F.lit('```json\n{"a": 1}\n```')).cast("string").alias("r"), V.json_object(F.lit('Sure: {"b": 2} ok')).cast("string").alias("s"),
        V.map_total(F.create_map(F.lit("x"), F.lit(3), F.lit("y"), F.lit(-2))).alias("t"),
    ).head()
    assert tuple(row) == (12, 5, 0, 20, 3, "2023-11-14T22:13:20Z", "", "07:13:20", 1_700_000_000, None, 425, 510, "Europe/Paris", "Asia/Shanghai", "2024-02-03", 13_600, "z", '{"a":1}', '{"b":2}', 3)
    docs = spark.createDataFrame([(((1, "a"), 5), ((None, "b"), None)), (((1, "a"), 5), None)], "base struct<x: struct<n: int, s: string>, y: int>, patch struct<x: struct<n: int, s: string>, y: int>")
    kind = docs.schema["base"].dataType
    assert [(r.m.x.n, r.m.x.s, r.m.y) for r in docs.select(V.merged(F.col("base"), F.col("patch"), kind).alias("m")).collect()] == [(1, "b", 5), (1, "a", 5)]


def test_choices_of_stored_and_live_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "topic string, at long, v string")
    stored, live = make([("crypto", 1, "s")]), make([("crypto", 2, "l"), ("world", 2, "l")])
    assert {(r.topic, r.v) for r in D.with_bootstrap(stored, live, ["topic"]).collect()} == {("crypto", "s"), ("world", "l")}
    assert {(r.topic, r.v) for r in D.first_available([stored, live], ["topic"], "at").collect()} == {("crypto", "s"), ("world", "l")}
    assert {(r.topic, r.v) for r in D.newer(stored, live, ["topic"], "at").collect()} == {("crypto", "l"), ("world", "l")}
    config = spark.createDataFrame([({"crypto": ["btc", ""], "world": [" "], "hot": []}, ["someone"])], "queries map<string,array<string>>, watched array<string>")
    assert {r.topic for r in D.configured_topics(config).collect()} == {"crypto", "custom"}
