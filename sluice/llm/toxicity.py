"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton after folding.

Folding lower-cases, maps look-alike letters of other scripts and digit substitutions to
Latin letters, drops invisible characters and turns punctuation into spaces. Lexicon
entries are whole words or word beginnings, learned from labelled documents: those that
cover toxic documents and hardly any clean one. Exception phrases (longer words or word
pairs around an entry that only clean documents hold) cancel the matches inside them.
The sum of matched weights, alone and divided by length, gives the score.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold, labelled_sample, lean_batches, table

# Letters that look like Latin ones, and digits that stand for letters.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһԛԝвнкмтαοενκρτυιβη", "aeopcyxijsdhqwbhkmtaoevkptuibn", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i", "|": " "}


@cache
def folding() -> dict[int, str | None]:
    fold: dict[int, str | None] = {c: " " for c in range(128) if not chr(c).isalnum()}
    fold |= {c: " " for c in [*range(0xA0, 0xC0), *range(0x2000, 0x2070), *range(0x3000, 0x3004)]}
    fold |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    fold |= {ord(a): b for a, b in [*LOOK_ALIKES.items(), *DIGITS.items()]}
    for c in range(0xFF01, 0xFF5F):  # full-width forms
        plain = chr(c - 0xFEE0).lower()
        fold[c] = fold.get(ord(plain), plain)
    return fold


def folded(text: str | None) -> str:
    """The folded words of a text, a space before, between and after them."""
    return f" {' '.join((text or '').lower().translate(folding()).split())} "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    logistic: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight, term))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None, phrase))
        if len(found):
            found.make_automaton()
        return found

    @staticmethod
    def matches(automaton, text: str) -> list[tuple[int, int, float, str]]:
        """Start, end, weight and entry of the matches in a folded text that no exception covers."""
        if not len(automaton):
            return []
        hits = [(end + 1 - size, end + 1, weight, term) for end, (size, weight, term) in automaton.iter(text)]
        excepted = sorted((a, b) for a, b, weight, _ in hits if weight is None)
        starts, reach = [a for a, _ in excepted], [0, *accumulate((b for _, b in excepted), max)]
        return [h for h in hits if h[2] is not None and reach[bisect_right(starts, h[0])] < h[1]]

    def inputs(self, automaton, text: str | None) -> tuple[float, float]:
        fold = folded(text)
        total = sum(h[2] for h in self.matches(automaton, fold))
        return float(np.log1p(total)), 100 * total / (100 + fold.count(" "))

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b, c = self.logistic
        return 1 / (1 + np.exp(-np.clip(a + x @ np.array([b, c]), -30, 30)))


def word_terms(text: str | None, least: int = 4, most: int = 8) -> set[str]:
    """The whole words and the word beginnings of a text, folded."""
    words = set(folded(text).split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(least, min(most, len(w) - 1) + 1)}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
            seen[y].update(word_terms(text))
        terms = list(seen[1])  # entries come from toxic documents
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])
        rest = list(seen[0].keys() - seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([seen[0][t] for t in rest], pa.int64())], ["term", "toxic", "clean"])


def choose(covers: list[tuple[int, set[int]]], terms: list[str], least: int) -> list[str]:
    """Greedy cover: the term that adds most toxic documents, less five for each clean one, until none adds ``least``."""
    toxic = {i for i, (y, _) in enumerate(covers) if y}
    by_term: dict[int, set[int]] = {}
    for i, (_, own) in enumerate(covers):
        for t in own:
            by_term.setdefault(t, set()).add(i)
    left, chosen = set(toxic), []
    while by_term:
        gain, _, best = max((len(d & left) - 5 * len(d - toxic), -len(terms[t]), t) for t, d in by_term.items())
        if gain < least:
            break
        chosen.append(terms[best])
        left -= by_term.pop(best)
    return chosen


def train(documents: DataFrame, labels: DataFrame, usable, per_class: int = 4000, candidates: int = 4000) -> Lexicon:
    """Learn entries, exceptions and weights from at most ``per_class`` documents of each label.

    The term counts are summed in Spark; the driver gets at most ``candidates`` terms and,
    for each sampled document, which of them it holds.
    """
    spark = documents.sparkSession
    lean_batches(spark)
    sample = labelled_sample(documents, labels, "toxic", per_class, usable)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1):
        return Lexicon(logistic=(-30.0 if sizes else 0.0, 0.0, 0.0))
    if not sizes.get(0):
        return Lexicon(logistic=(30.0, 0.0, 0.0))
    least = max(2, round(0.002 * sizes[1]))
    counted = sample.select("text", "y").mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    pure = counted.where((F.col("toxic") >= least) & (F.col("toxic") / sizes[1] > 25 * F.col("clean") / sizes[0]))
    terms = [r["term"] for r in pure.orderBy(F.desc(F.col("toxic") - 5 * F.col("clean")), "term").limit(candidates).collect()]
    shared = spark.sparkContext.broadcast(Lexicon(dict.fromkeys(terms, 1.0)))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, index = shared.value.automaton(), {t: i for i, t in enumerate(shared.value.weights)}
        for batch in batches:
            own = [sorted({index[h[3]] for h in Lexicon.matches(automaton, folded(t))}) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array(own, pa.list_(pa.int32()))], ["doc_id", "y", "own"])

    covers = [(r["y"], set(r["own"])) for r in sample.mapInArrow(cover, "doc_id long, y int, own array<int>").orderBy("doc_id").collect()]
    chosen = choose(covers, terms, least)
    index = {t: i for i, t in enumerate(terms)}
    toxic, clean = (sum(y == v for y, _ in covers) for v in (1, 0))
    counts = {t: [sum(y == v and index[t] in own for y, own in covers) for v in (0, 1)] for t in chosen}
    lexicon = Lexicon({t: float(np.log((n[1] + 0.5) / (toxic + 1)) - np.log((n[0] + 0.5) / (clean + 1))) for t, n in counts.items()})
    shared_lexicon = spark.sparkContext.broadcast(lexicon)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The longer word and the word pairs about each match."""
        automaton = shared_lexicon.value.automaton()
        for batch in batches:
            phrases, labelled = [], []
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
                fold, own = folded(text), set()
                for start, end, _, _ in Lexicon.matches(automaton, fold):
                    stop = fold.find(" ", end - 1)
                    before, after = fold.rfind(" ", 0, start), fold.find(" ", stop + 1)
                    own |= {fold[start : stop + 1], *([fold[before : stop + 1]] if before >= 0 else []), *([fold[start : after + 1]] if after >= 0 else [])}
                phrases += own
                labelled += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(labelled, pa.int32())], ["phrase", "y"])

    about = sample.select("text", "y").mapInArrow(around, "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    spared = about.where((F.col("clean") >= 3) & (F.col("toxic") == 0)).orderBy(F.desc("clean"), "phrase").limit(candidates).collect()
    lexicon.exceptions = [r["phrase"] for r in spared if r["phrase"] not in lexicon.weights]
    shares = {r["y"]: r["n"] for r in labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & usable).groupBy(F.col("toxic").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    fitted = sample.select("doc_id", "y", _inputs_of(spark, lexicon)(F.col("text")).alias("x")).orderBy("doc_id").collect()
    x, y = np.array([r["x"] for r in fitted]), np.array([r["y"] for r in fitted], float)
    lexicon.logistic = _logistic(x, y, np.where(y == 1, shares[1] / sizes[1], shares[0] / sizes[0]))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    weight = weight / weight.mean()
    z, b = np.c_[np.ones(len(x)), x], np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        slope, curve = z.T @ (weight * (y - p)) - ridge * b, (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(3)
        b = b + np.linalg.solve(curve, slope)
    return float(b[0]), float(max(b[1], 0)), float(max(b[2], 0))


def _inputs_of(spark: SparkSession, lexicon: Lexicon):
    shared = spark.sparkContext.broadcast(lexicon)

    @F.arrow_udf("array<double>")
    def inputs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = shared.value.automaton()
        for batch in batches:
            yield pa.array([shared.value.inputs(automaton, t) for t in batch.to_pylist()], pa.list_(pa.float64()))

    return inputs


def score(documents: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "score") -> DataFrame:
    """Add ``name``, the probability that a text is toxic, for every row, from its whole text.

    Null and empty texts match nothing and get the score of a text without matches; equal
    texts get equal scores, other columns pass through, an empty table gives an empty one.
    """
    lean_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = shared.value
        automaton = lexicon.automaton()
        for batch in batches:
            x = np.array([lexicon.inputs(automaton, t) for t in batch.to_pylist()], float).reshape(-1, 2)
            yield pa.array(lexicon.probability(x), pa.float64())

    return documents.withColumn(name, probability(F.col(text)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the cases are those of ``train`` and ``score``, ties at 0.5 count as toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    scored = score(docs.select("doc_id", "text"), train(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
