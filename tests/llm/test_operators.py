"""Every operator against brute force or an exact round trip, on odd rows and on small tables."""

import base64
import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from helpers import prose
from pyspark.sql import functions as F

from sluice.llm import bpe, fingerprint, langid, mixing, neardup, quality, repeats, stages, topk, toxicity
from sluice.llm.common import in_fold

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text, k):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, shingles(t, k))
    reach = {d: {d} for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                joined = reach[a] | reach[b]
                for x in joined:
                    reach[x] = joined
    return {d: (len(sets[d]), min(reach[d])) for d in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_on_odd_rows(odd, odd_rows, nothing, k):
    want = components([(r[0], r[1]) for r in odd_rows], k)
    got = neardup.near_duplicates(odd, words=k).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert neardup.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies that differ in many places: some link only through others, none may be lost."""
    import random

    base = prose(9, 150).split()
    rows = []
    for i in range(400):
        rng, words = random.Random(i), list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    want = components(rows, 4)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_one_of_each_keeps_one_row_of_each_group(odd, odd_rows):
    kept = neardup.one_of_each(odd, words=5).collect()
    want = components([(r[0], r[1]) for r in odd_rows], 5)
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(ids) == sorted(d for d, (_, c) in want.items() if d == c)
    assert sum(r.doc_id is None for r in kept) == sum(r[0] is None for r in odd_rows)
    assert all(r["score"] == "t" for r in kept)


def cut_brute(rows):
    raw = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in raw:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], float("inf")))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), kept))
    return out


def test_repeats_on_odd_rows(odd, odd_rows, nothing, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 5_000)
    want = Counter((r[0], *x) for r, x in zip(odd_rows, cut_brute([(r[0], r[1]) for r in odd_rows]), strict=True))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(odd).collect())
    assert got == want
    assert repeats.without_repeats(nothing).count() == 0


def test_repeats_on_a_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {d: (n, g, s, hashlib.sha256(k).hexdigest()) for (d, _), (n, g, s, k) in zip(rows, cut_brute(rows), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op6_repeats(spark, sf_dir).collect()}
    assert got == want


def test_repeats_far_into_a_long_text(spark):
    """A passage beyond byte 2**24 of a text is found in later texts, and removed there if it stands earlier."""
    noise = np.random.default_rng(3).integers(97, 123, (1 << 24) + 4000).astype(np.uint8).tobytes().decode()
    late, early = prose(71, 40), prose(72, 40)
    rows = [(1, early), (2, noise + "#|" + late + "|" + early + "|"), (3, prose(73, 60) + "%|" + late + "|")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()}
    assert got == {1: (0, 0), 2: (len(early), 1), 3: (len(late) + 2, 1)}


def test_bpe_as_tiktoken(spark, odd, odd_rows, nothing):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.decode(bpe.encode(odd, path, P.PATTERN), path).collect()
    assert len(coded) == len(odd_rows)
    for r in coded:
        ids = np.frombuffer(bytes(r.token_ids), "<u4").tolist()
        assert ids == own.encode_ordinary(r.text or "") and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(nothing, path, P.PATTERN).count() == 0
    encoder = bpe.Encoder(bpe.serialise_model(bpe.read_ranks(path)), P.PATTERN)
    every = [t.decode() for t in ranks if t.isascii()]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(every)] == [own.encode_ordinary(t) for t in every]


def test_fingerprints(spark, odd, odd_rows, nothing):
    docs = odd.select("doc_id", "text")
    walked = fingerprint.with_next(docs, 6).collect()
    assert len(walked) == len(odd_rows)
    order = sorted(((r[0] is None, -(r[0] or 0), r[1] or "") for r in odd_rows))
    want = Counter((None if n else -d, t, order[(i + 1) % len(order)][2]) for i, (n, d, t) in enumerate(order))
    assert Counter((r.doc_id, r.text, r.next_text) for r in walked) == want
    assert Counter((r.doc_id, r.text, r.next_text) for r in fingerprint.with_next(docs, 6, most=2).collect()) == want
    assert fingerprint.with_next(nothing.select("doc_id", "text"), 6, most=2).count() == 0
    assert fingerprint.with_next(nothing.select("doc_id", "text"), 6).count() == 0
    one = spark.createDataFrame([(1, prose(4, 900)), (2, prose(4, 900)), (3, prose(4, 450) + " " + prose(5, 450)), (4, "a b"), (5, "")], "doc_id long, text string")
    s = {r.doc_id: r.f for r in fingerprint.fingerprints(one, name="f").select("doc_id", "f").collect()}
    assert s[1] == s[2] and len(s[4]) == 1 and s[5] == []
    a, b = F.col("a"), F.col("b")
    pair = spark.createDataFrame([(s[1], s[3]), (s[1], s[2]), (s[5], s[5]), (s[4], s[1])], "a array<long>, b array<long>")
    got = pair.select(fingerprint.resemblance(a, b).alias("r"), fingerprint.containment(a, b).alias("c"), fingerprint.distinct_shingles(a).alias("n")).collect()
    t1, t3 = shingles(prose(4, 900), 5), shingles(prose(4, 450) + " " + prose(5, 450), 5)
    assert abs(got[0].r - len(t1 & t3) / len(t1 | t3)) < 0.15 and abs(got[0].c - len(t1 & t3) / len(t1)) < 0.2 and abs(got[0].n / len(t1) - 1) < 0.25
    assert got[1].r == 1.0 and got[2].r == 1.0 and got[3].r <= 1 / 128 * 2
    halves = spark.createDataFrame([(s[1], s[3])], "a array<long>, b array<long>").select(fingerprint.merge(a, b).alias("m")).head().m
    assert halves == sorted(set(s[1]) | set(s[3]))[:128]


def test_mixing(odd, odd_rows, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows) and mixing.mix(nothing).count() == 0
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += len((r[1] or "").split())
    names = sorted((x for x in sizes if x is not None), key=lambda x: [ord(c) for c in x]) + ([None] if None in sizes else [])
    total, weight, target, open_ = sum(sizes.values()), {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(names)
    while open_:  # raise the level until every source is full or none is over its cap
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        open_ -= full
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"] and (r.slot is None) == (r.taken == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(20, 0.01 * target[s]) for s in names)
    assert Counter(tuple(r) for r in mixing.mix(odd).collect()) == Counter(map(tuple, rows))
    copies = Counter((r.doc_id, r.text, r.source, r.n_chars, r["size"]) for r in mixing.mixed(odd).collect())
    want = Counter()
    for r in rows:
        want[r.doc_id, r.text, r.source, r.n_chars, "s"] += 1 if r["size"] == 0 else (2 * r.taken + r["size"]) // (2 * r["size"])
    assert copies == +want and all(r[c] == "x" for r in mixing.mixed(odd.withColumns({c: F.lit("x") for c in ("taken", "slot", "row", "range", "hash", "n")})).collect() for c in ("taken", "slot", "row", "range", "hash", "n"))


def corput(plan, points):
    """The schedule by brute force: for each source (in order) the slots of its points, as exact fractions."""
    total, lo, out = sum(plan.values()), 0, {}
    point = [Fraction(int(f"{i:062b}"[::-1], 2), 2**62) for i in range(points)]
    for s, k in plan.items():
        hits = [i for i in range(points) if Fraction(lo, total) <= point[i] < Fraction(lo + k, total)]
        out[s], lo = hits[:k], lo + k
    return out


def test_schedule_against_brute_force(spark):
    plan = {"a": 700, "b": 1, "c": 250, "d": 3, "e": 46}
    frame = spark.createDataFrame([*plan.items(), ("f", 0)], "source string, blocks long")
    got = defaultdict(dict)
    for r in mixing.schedule(spark, frame, chunk=64).collect():
        got[r.source][r.block] = r.slot
    want = corput(plan, 2000)
    assert {s: [got[s][i] for i in range(len(x))] for s, x in want.items()} == want and all(len(want[s]) == k for s, k in plan.items())
    first = sorted((slot, s) for s, x in want.items() for slot in x)[:500]  # every stretch is near the shares
    assert abs(sum(s == "a" for _, s in first) - 350) <= 5 and abs(sum(s == "c" for _, s in first) - 125) <= 5


def test_points_of_far_slots_are_exact(spark):
    """Beyond 2 ** 33 slots too, points are all different and no interval of one block in 2 ** 27 goes without one."""
    far = [2**33 + 5, 2**40 - 1, 2**61 + 12345, 0, 1]
    got = spark.createDataFrame([(i,) for i in far], "i long").select(mixing.point(F.col("i")).alias("p")).collect()
    assert [r.p for r in got] == [int(f"{i:062b}"[::-1], 2) for i in far]
    n = 2**27  # blocks; of points, those in a few intervals of one block each
    lo = [k * 6_700_417 % n * 2**62 // n for k in range(20)]
    slots = [int(f"{-(-x // 2**34):028b}"[::-1], 2) for x in lo]  # of the first point of 2 * n in each interval
    assert all(s < 2 * n and x <= int(f"{s:062b}"[::-1], 2) < x + 2**62 // n for s, x in zip(slots, lo, strict=True))


def test_mixing_joins_blocks_to_slots(spark, sf_dir):
    """Pieces of every block add up to its words and share the slot of the brute-force schedule."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    laid = mixing.laid_out(docs, F.struct("doc_id"), block=256, range_rows=30, chunk=64)
    takes = {r.source: r["take"] for r in laid.rows.select("source", "take").distinct().collect()}
    plan = {s: -(-takes[s] // 256) for s in sorted(takes)}
    want, sums, slots = corput(plan, 2 * sum(plan.values())), defaultdict(int), {}
    for r in laid.pieces.collect():
        sums[r.source, r.block] += r.words
        assert slots.setdefault((r.source, r.block), r["slot"]) == r["slot"]
    assert dict(sums) == {(s, k): min(256, takes[s] - 256 * k) for s, n in plan.items() for k in range(n)}
    assert slots == {(s, k): slot for s, x in want.items() for k, slot in enumerate(x)}


def test_mixing_gives_every_source_its_rounded_target(spark):
    """Sources of a few words beside large ones: none may round away to nothing."""
    rows = [(i, prose(i, 3000), f"big{i % 3}", None) for i in range(400)] + [(1000 + i, prose(i, 1 + i % 5), f"rare{i:02d}", None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    taken, target = defaultdict(int), {}
    for r in mixing.mix(docs, block=512).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {s: taken[s] for s in target} == {s: int(t + 0.5) for s, t in target.items()}
    assert {r.source for r in mixing.mixed(docs).collect()} == set(target)
    sizes = spark.createDataFrame([("a", 10**9), ("b", 200)], "source string, source_size long")
    plan = {r.source: r for r in mixing.planned(sizes).collect()}
    assert plan["b"]["take"] == 600 and plan["b"].blocks == 1 and plan["a"]["take"] == 10**9 - 400
    assert mixing.schedule(spark, mixing.planned(sizes)).where("source = 'b'").count() == 1


def test_top_k(spark, nothing):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(50, rows[50][1]), (50, rows[7][1]), (1000, rows[3][1]), (1050, None), (1100, [1.0, float("nan")] + [0.0] * 6), (1150, [float("inf")] * 8), (None, rows[1][1]), (1200, [1.0, 2.0]), (1250, [3.0, 4.0]), (1300, []), (1350, [None] * 8)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for n, (i, v) in enumerate(good):
        if i % 50 == 0:
            others = sorted((-int(v @ x), j) for m, (j, x) in enumerate(good) if m != n and len(x) == len(v))[:5]
            want.update((i, r, j, -s) for r, (s, j) in enumerate(others, 1))
    got = topk.top_k(topk.whole_numbers(frame), F.col("vec_id") % 50 == 0)
    assert Counter(map(tuple, got.collect())) == want
    assert topk.top_k(topk.whole_numbers(frame.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_huge_numbers_and_repeated_rows(spark):
    """Products beyond 2**53 are exact, beyond a long they saturate; a row that is repeated often ranks as often."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-(2**20), 2**20, 6)]) for i in range(120)] + [(200, [1e300] * 6), (250, [2.0**20 - 1] * 6), (300, [3.0] * 6)]
    rows += [(7, rows[7][1])] * 40 + [(50, rows[50][1])] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, [int(c * 256) if abs(c) < 1e200 else int(256 * 1e300) for c in v]) for i, v in rows]
    want = Counter()
    for n, (i, v) in enumerate(good):
        if i % 50 == 0:
            others = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), j) for m, (j, x) in enumerate(good) if m != n)[:5]
            want.update((i, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(others, 1))
    got = topk.top_k(topk.whole_numbers(frame), F.col("vec_id") % 50 == 0)
    assert Counter(map(tuple, got.where("query_id <> 200").collect())) == Counter({k: n for k, n in want.items() if k[0] != 200})
    assert got.where("query_id = 200 AND score IN (9223372036854775807, -9223372036854775808)").count() == 5


def test_pivots_remove_candidates(spark):
    """Clustered vectors: most are never evaluated."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16) * 0.1 + 4 * np.eye(16)[i % 16]]) for i in range(6000)]
    work = topk.top_k(topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), F.col("vec_id") % 50 == 0, work=True)
    r = work.agg(F.sum("evaluated").alias("e"), F.sum("candidates").alias("c")).head()
    assert r.c == 120 * 6000 and r.e < 0.2 * r.c


def accuracy(rows, label, predicted):
    return sum(r[label] == r[predicted] for r in rows) / len(rows)


def test_quality_learns(spark, odd, nothing):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op1_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert accuracy(rows, "quality", "predicted") >= 0.93
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), labels, F.lit(True))
    out = quality.score(odd, model, name="p").collect()
    assert all(0 <= r.p <= 1 and r["score"] == "t" for r in out) and len(out) == odd.count()
    assert quality.score(nothing, model).count() == 0
    empty = quality.train(nothing, labels, F.lit(True))
    assert {r.p for r in quality.score(odd, empty, name="p").collect()} == {0.5}


def test_toxicity_learns(spark, odd, nothing):
    texts = [(i, prose(i, 60) + (" 1d10t " + prose(900 + i, 2) if i % 4 == 0 else ""), 1 if i % 4 == 0 else 0) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels, F.lit(True))
    probe = spark.createDataFrame([(1, "such an IDIOT here"), (2, "such an іdіot here"), (3, "id​iot!"), (4, prose(7, 50)), (5, None), (6, "")], "doc_id long, text string")
    p = {r.doc_id: r.p for r in toxicity.score(probe, lexicon, name="p").collect()}
    assert min(p[1], p[2], p[3]) >= 0.5 > max(p[4], p[5], p[6])
    assert toxicity.score(odd, lexicon).count() == odd.count() and toxicity.score(nothing, toxicity.train(nothing, labels, F.lit(True))).count() == 0


def test_toxicity_exceptions(spark):
    texts = [(i, prose(i, 40) + " scumbag", 1) for i in range(60)] + [(100 + i, prose(100 + i, 40) + " scumble paint", 0) for i in range(3)] + [(200 + i, prose(200 + i, 40), 0) for i in range(200)]
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels, F.lit(True))
    probe = spark.createDataFrame([(1, "a scumble paint"), (2, "a scumbag")], "doc_id long, text string")
    p = {r.doc_id: r.p for r in toxicity.score(probe, lexicon, name="p").collect()}
    assert p[1] < 0.5 <= p[2]


def test_language(spark, odd, nothing):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.op10_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert accuracy(rows, "lang", "lang_pred") >= 0.95
    model = langid.train(docs, F.lit(True))
    out = {r.doc_id: r for r in langid.identify(odd.drop("score"), model).collect()}
    assert out[4].lang_pred == out[5].lang_pred == out[6].lang_pred == "und" and out[4].score == 0
    assert all(r.lang_pred in {"en", "fr", "de", "es", "und"} and 0 <= r.score <= 1 for r in out.values())
    assert langid.identify(nothing, langid.train(nothing, F.lit(True))).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.train(nothing, F.lit(True))).collect()} == {"und"}


def test_folds(spark):
    import zlib

    frame = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = {r.doc_id: r.f for r in frame.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)} | {None: False}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert k + 1 == len(corpus_pipeline.STAGES) or docs.columns == columns
    assert docs.where("NOT round_trip").count() == 0 and docs.count() > 50
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_fingerprint_query_by_brute_force(spark, sf_dir):
    """Edited texts, sketches and likenesses of every document, from plain Python."""
    import re

    import xxhash

    def sketch(text):
        words, out = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w], set()
        for shingle in [words[i : i + 5] for i in range(len(words) - 4)] or [words] * bool(words):
            h = 42
            for w in shingle:
                h = xxhash.xxh64_intdigest(w.encode(), seed=h)
            out.add(h >> 4)
        return sorted(out)[:128]

    def near(a, b):
        union = sorted({*a, *b})[:128]
        return sum(h in set(a) and h in set(b) for h in union) / len(union) if union else 1.0

    texts = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    want = {}
    for i, (d, t) in enumerate(texts):
        other, half = texts[(i + 1) % len(texts)][1], len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        own, cut = sketch(t), sketch(edited)
        shown = lambda s: "".join(f"{h:015x}" for h in s)
        want[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(cut), near(own, cut), near(own, sketch(other)))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprint.op3_fingerprint(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:4] == w[:4] and abs(got[d][4] - w[4]) < 1e-12 and abs(got[d][5] - w[5]) < 1e-12


def plain_features(text):
    """The features of the quality model, without arrays."""
    import math

    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality.FEATURES)
    n, count, words = len(raw), Counter(raw), raw.split()
    punctuation = {c for c in range(33, 127) if not chr(c).isalnum()}
    lines = [x for x in raw.split(b"\n") if x]
    times = Counter(words)
    share = lambda cs: sum(count[c] for c in cs) / n
    out = [math.log1p(n), share(range(65, 91)), share(range(48, 58)), share(punctuation), sum(a == b and a in punctuation for a, b in zip(raw, raw[1:], strict=False)) / n, share(range(128, 256)), share([32, *range(9, 14)]), share([124]), share([33])]
    if not words:
        return out + [0.0] * 9 + [-sum(c / n * math.log2(c / n) for c in count.values()), 0.0]
    pairs = list(zip(words, words[1:], strict=False))
    out += [sum(map(len, words)) / len(words), min(max(map(len, words)), 1000), len(times) / len(words), max(times.values()) / len(words), sum(a == b for a, b in pairs) / len(words), len(set(pairs)) / len(pairs) if pairs else 0.0]
    out += [len(lines) / len(words), 1 - len(set(lines)) / max(len(lines), 1), count[46] / len(words)]
    return out + [-sum(c / n * math.log2(c / n) for c in count.values()), math.log1p(len(words))]


def test_quality_scores_by_brute_force(spark, sf_dir):
    """Features and the sum of table entries of every document, from plain Python, give the query's scores."""
    import math
    from bisect import bisect_right

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, ~in_fold(F.col("doc_id"), 4, 2))
    got = {r.doc_id: r for r in quality.op1_quality(spark, sf_dir).collect()}
    for d, text in [(r.doc_id, r.text) for r in docs.collect()]:
        x = [float(np.float32(v)) for v in plain_features(text)]
        assert np.allclose(x, quality.features(text), rtol=1e-5, atol=1e-6)
        x = [float(v) for v in quality.features(text)]
        bins = [bisect_right(list(e), v) for e, v in zip(model.edges, x, strict=True)]
        total = model.prior + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[bins[i] * model.coarse // (len(model.edges[i]) + 1) * model.coarse + bins[j] * model.coarse // (len(model.edges[j]) + 1)]
        assert abs(got[d].score - 1 / (1 + math.exp(-total))) < 1e-9 and got[d].predicted == int(got[d].score >= 0.7)


def test_toxicity_scores_by_brute_force(spark):
    """Matches found by searching every entry, on the real labels, give the query's scores; held-out accuracy."""
    import math

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.train(docs, labels, ~in_fold(F.col("doc_id"), 5, 0))
    scored = toxicity.op7_toxicity(spark, sf).join(docs.select("doc_id", "text"), "doc_id").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in scored if r.held_out]
    assert accuracy(held, "toxic", "predicted") >= 0.95 and lexicon.weights

    def places(text, term):
        at = text.find(term)
        while at >= 0:
            yield at, at + len(term)
            at = text.find(term, at + 1)

    for r in scored[:600]:
        text = toxicity.folded(r.text)
        spared = [p for e in lexicon.exceptions for p in places(text, e)]
        total = sum(w for t, w in lexicon.weights.items() for a, b in places(text, t) if not any(x <= a and b <= y for x, y in spared))
        a, b, c = lexicon.logistic
        p = 1 / (1 + math.exp(-max(-30, min(30, a + b * math.log1p(total) + c * 100 * total / (100 + text.count(" "))))))
        assert abs(r.score - p) < 1e-9


def test_language_scores_by_brute_force(spark, sf_dir):
    """n-grams counted one by one and cosines to every centroid give the query's predictions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs, ~in_fold(F.col("doc_id"), 4, 2))

    def vector(text):
        b, x = [32, *text.lower().encode(), 32], np.zeros(langid.DIMENSIONS)
        at = 0
        for n, size in enumerate(langid.BUCKETS, 1):
            for i in range(len(b) - n + 1):
                code = b[i]
                for c in b[i + 1 : i + n]:
                    code = code * 0x01000193 % 2**32 ^ c
                x[at + (code if n == 1 else code * 2654435761 % 2**32 // (2**32 // size))] += 1
            at += size
        x = np.log1p(x) * model.idf
        return x / np.linalg.norm(x)

    got = {r.doc_id: r for r in langid.op10_language(spark, sf_dir).collect()}
    for d, text in [(r.doc_id, r.text) for r in docs.collect()][:120]:
        if not any(c.isalpha() for c in text or ""):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        cosine = model.centroids @ vector(text)
        best = {name: max(c for c, o in zip(cosine, model.owner, strict=True) if o == i) for i, name in enumerate(model.languages)}
        top = max(best.values())
        score = 1 / sum(np.exp(20 * (v - top)) for v in best.values()) * (0.5 if top < model.nearest else 1.0)
        assert best[got[d].lang_pred] >= top - 1e-5 and (abs(got[d].score - score) < 1e-3 or abs(top - model.nearest) < 1e-5)


def test_stages_on_odd_rows(spark, odd, odd_rows, nothing, sf_dir):
    """Every stage keeps the caller's columns, whatever their names, and takes nulls, repeats and empty tables."""
    clashing = ("base", "spans", "taken", "slot", "size", "_score", "_guess", "_both", "more", "row", "k1", "copies", "label", "set", "target")
    wide = odd.drop("size").withColumns({c: F.lit(c) for c in clashing})
    labels = [(r[0], i % 2, 0) for i, r in enumerate(odd_rows) if r[0] is not None]
    import tempfile

    folder = tempfile.mkdtemp()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for stage in (stages.keep_good, stages.keep_one_of_each, stages.redact_personal_data, stages.mix_sources):
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns and stage(spark, nothing, folder).count() == 0
        rows = out.collect()
        assert all(r[c] == c for r in rows for c in clashing) and (len(rows) == len(odd_rows) or stage is not stages.redact_personal_data)
    coded = stages.encode(spark, wide, folder).collect()
    assert len(coded) == len(odd_rows) and all(r.round_trip for r in coded) and stages.encode(spark, nothing, folder).count() == 0
    redacted = {r.doc_id: r for r in stages.redact_personal_data(spark, wide, folder).collect()}
    assert "<email> or" not in redacted[4].asDict().values() and "<email>" in redacted[12].text and "<ip>" in redacted[12].text and redacted[12].n_chars == len(redacted[12].text)
