"""The Jaccard join against all pairs in plain Python."""

import random

import numpy as np
import pytest
from helpers import prose

from sluice.llm import jaccard


def sets_of(rows, k):
    words = {d: (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split() for d, t in rows if d is not None}
    return {d: frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []) for d, w in words.items()}


def joined(rows, k, percent=80):
    sets = sets_of(rows, k)
    root = {d: d for d in sets}

    def of(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and sets[b] and percent * max(len(sets[a]), len(sets[b])) <= 100 * min(len(sets[a]), len(sets[b])):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = of(a), of(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), of(d)) for d in sets}


def got(rows, k=5, percent=80):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(rows, k, percent).collect()}


def test_odd_rows(odd, odd_rows, nothing):
    found = jaccard.jaccard_join(odd).collect()
    want = joined([(r[0], r[1]) for r in odd_rows], 5)
    assert len(found) == len(odd_rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] if r.doc_id is not None else r.component_id is None for r in found)
    assert jaccard.jaccard_join(nothing).count() == 0


def edited(base, rng, most):
    words = list(base)
    for _ in range(rng.randint(0, most)):
        words[rng.randrange(len(words))] = f"w{rng.randint(0, 10**6)}"
    return words


@pytest.mark.parametrize("percent", [80, 60])
def test_large_forests(spark, monkeypatch, percent):
    """Chains, copies far from one another, shared passages and odd sizes, over many leaves and levels."""
    monkeypatch.setattr(jaccard, "LEAF", 8)
    monkeypatch.setattr(jaccard, "FAN", 2)
    rows, passage = [], prose(50, 90).split()
    bases = [prose(s, n).split() for s, n in ((1, 150), (2, 60), (3, 400))]
    for i in range(330):
        rng = random.Random(i)
        words = edited(bases[i % 3], rng, 1 + len(bases[i % 3]) // 25)
        if i % 5 == 0:
            words = edited(passage, rng, 2) + prose(1000 + i, rng.randint(5, 60)).split()
        if i % 7 == 0:
            words = words[: rng.randint(4, len(words))]
        rows.append((i, " ".join(words)))
    drift = prose(7, 120).split()
    for i in range(60):  # each near the one before, far from the first
        for _ in range(2):
            drift[(i * 37 + 11 * _) % 120] = f"d{i}_{_}"
        rows.append((500 - i, " ".join(drift)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(table, 5, percent) == joined(rows, 5, percent)


def test_rows_that_repeat_an_id_are_one_document(spark):
    a, b, c = (prose(s, 40) for s in (1, 2, 3))
    rows = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a + " x"), (4, c)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_join(rows).collect()} == {(5, 3), (3, 3), (9, 3), (4, 4)}


def test_heads_hold_what_is_promised():
    """Of any two sets that link, the heads have ``in_common`` shingles in common."""
    rng = np.random.default_rng(1)
    for _ in range(3000):
        percent = int(rng.choice([50, 70, 80, 95]))
        n = int(rng.integers(1, 120))
        x = rng.choice(10**6, n, replace=False)
        gone, new = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 4 + 1))
        y = np.concatenate((rng.permutation(x)[gone:], rng.choice(10**6, new, replace=False) + 10**6 * int(rng.integers(0, 2))))
        x, y = np.unique(x), np.unique(y)
        shared = len(np.intersect1d(x, y))
        if len(y) and 100 * shared >= percent * (len(x) + len(y) - shared):
            heads = [s[: int(jaccard.head(len(s), percent))] for s in (x, y)]
            least = min((100 - percent) * -(-percent * len(s) // 100) // 200 + 1 for s in (x, y))
            assert len(np.intersect1d(*heads)) >= max((100 - percent) * -(-percent * len(s) // 100) // 200 + 1 for s in (x, y)) >= least


def test_a_passage_of_many_texts_makes_no_large_forest(spark, monkeypatch):
    """Texts that share a passage and do not link are not met pair by pair, leaf by leaf."""
    monkeypatch.setattr(jaccard, "LEAF", 8)
    dealt, join = [], jaccard._joined

    def counted(documents, cells, *rest):
        dealt.append(cells.count())
        return join(documents, cells, *rest)

    monkeypatch.setattr(jaccard, "_joined", counted)
    passage = prose(50, 60)
    rows = [(i, f"{passage} {prose(1000 + i // 3, 40)}{' x' * (i % 3)}") for i in range(300)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == joined(rows, 5)
    assert sum(dealt) <= 2 * len(rows)


def test_forests_of_one_leaf_are_parted_too(spark):
    """What is read for the parting follows the sets in forests, not which forests outgrow a leaf."""
    passage = prose(50, 60)
    rows = [(i, f"{passage} {prose(1000 + i // 2 if i < 4 else 2000 + i, 40)}{' x' * (i % 2)}") for i in range(40)] + [(i, f"{prose(60, 50)} {prose(3000 + i, 40)}") for i in (90, 91)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    with jaccard.Scratch(spark) as scratch:
        members = spark.createDataFrame([(d, n, min(d, 90), min(d, 90) // 90) for d, (n, _) in joined(rows, 5).items()], "id long, n long, near long, forest long")
        left = jaccard.parted(documents, scratch.table(members), 5, 80, scratch).collect()
    assert {(r.id, r.near) for r in left} == {(0, 0), (1, 0), (2, 2), (3, 2), (90, 90), (91, 90)}
    assert len({r.forest for r in left}) == 3
