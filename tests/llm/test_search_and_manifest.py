"""Ranked search and the manifest against plain Python, on odd rows and on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import prose
from pyspark.sql import functions as F

from sluice.llm import lexical, merkle

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def searched(docs, items, top):
    """Every document against every item, straight from the formula."""
    of = lambda t: TERM.findall((t or "").translate(UPPER))
    counts = [(d, Counter(of(t))) for d, t in docs]
    n_docs, words = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // max(words, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in of(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if x[1] else x[2], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return out


def test_search_on_odd_rows(spark, odd, odd_rows, nothing, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 3)  # several blocks
    monkeypatch.setattr(lexical, "CELLS", 200)  # several slices of a batch
    base = prose(1, 40)
    items = [(1, base), (2, base + " " + base), (3, None), (4, ""), (5, "ERIN thon thon"), (6, prose(2, 300)), (7, "日本語 naïve 10"), (8, base + " erin"), (None, "thon")]
    asked = spark.createDataFrame([(*x, "a", "b") for x in items], "item_id long, text string, doc_id string, score string")
    for top in (2, 50):
        got = [tuple(r) for r in lexical.search(odd, asked, top).select("item_id", "rank", "doc_id", "score").collect()]
        assert Counter(got) == Counter(searched([(r[0], r[1]) for r in odd_rows], items, top))
    assert lexical.search(nothing, asked).count() == 0
    assert lexical.search(odd, asked.where("item_id > 100")).count() == 0
    twice = lexical.search(odd, asked.where("item_id = 5").union(asked.where("item_id = 5")), 3).collect()
    assert [r["rank"] for r in sorted(twice, key=lambda r: r["rank"])] == list(range(1, len(twice) + 1))


def test_sharing_adds_up_and_shares():
    """The nodes of every item stand for exactly its terms with repeats, and pairs that recur are nodes once."""
    rng = random.Random(5)
    items = [[f"t{rng.randrange(12)}".encode() for _ in range(rng.randrange(0, 14))] for _ in range(40)]
    plan = lexical.sharing(items)
    held = [Counter() for _ in range(plan.sets)]
    for term, k in plan.numbers.items():
        for node, times in zip(plan.nodes[plan.starts[k] : plan.starts[k + 1]], plan.times[plan.starts[k] : plan.starts[k + 1]], strict=True):
            held[node][term] += int(times)
    for a, b in plan.sums:
        held.append(held[a] + held[b])
    assert [sum((held[e] for e in ends), Counter()) for ends in plan.ends] == [Counter(i) for i in items]
    assert len(set(plan.sums)) == len(plan.sums) > 0
    assert all(n < 2 for n in Counter(p for e in plan.ends for p in zip(e, e[1:], strict=False)).values())


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(r, n_chars):
    fields = [r["doc_id"], r["source"], r["lang"], n_chars, r["text"]]
    return digest(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def proven(nodes):
    """The root over nodes, and of each node the (before, after) on its way."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            pair = nodes[place - place % 2 :][:2]
            ways[k].append(("".join(pair[: place % 2]), "".join(pair[place % 2 + 1 :])))
            at[k] = place // 2
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], ways


def manifest_of(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, row_digest(r, r["n_chars"]), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: proven([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])]) for lang in langs}
    root, above = proven([built[lang][0] for lang in langs])
    out = []
    for lang, way in zip(langs, above, strict=True):
        for (*_, leaf, r), own in zip(sorted(trees[lang], key=lambda x: x[:3]), built[lang][1], strict=True):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = row_digest(r, r["n_chars"] + 1 if bad and r["n_chars"] is not None else r["n_chars"])
            for before, after in own + way:
                node = digest(before, node, after)
            out.append((r["doc_id"], leaf, built[lang][0], root, digest(*(a + b for a, b in own + way)), node, node == root))
    return out


@pytest.mark.parametrize("every", [1, 2, 6])
def test_manifest(spark, tmp_path, odd, odd_rows, monkeypatch, every):
    monkeypatch.setattr(merkle, "EVERY", every)
    many = spark.range(150).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("xx").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    largest = spark.createDataFrame([(2**63 - 1 - k, "t", "zz", None, 2**63 - 1) for k in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = odd.unionByName(many, True).unionByName(largest, True)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in merkle.op13_manifest(spark, str(tmp_path)).collect())
    assert got == Counter(manifest_of(rows.collect()))
    assert 0 < sum(not r[-1] for r in got.elements()) < 100


def test_manifest_of_nothing_and_of_one(spark, odd, nothing):
    empty = merkle.manifest(nothing)
    assert empty.root is None and merkle.proofs(empty).count() == 0
    one = merkle.manifest(odd.where("doc_id = 8"))
    (row,) = merkle.proofs(one).collect()
    assert row.node == row.subroot == one.root and row.proof == []
