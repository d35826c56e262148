"""Quality classifier: a generalised additive model with pairwise interactions.

Twenty features of the whole text are put into bins. Boosting goes round the features:
each step fits a shallow tree to the gradient over one feature's bins and adds it to that
feature's table; then the pairs that explain most of the rest get tables of their own in
the same way. A score is the sum of one table entry for each feature and pair, so a batch
of rows is scored by a few vectorised lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold, labelled_sample, lean_batches, release_memory, table

FEATURES = (
    "log_bytes", "upper", "digit", "punctuation", "symbol_run", "non_ascii", "space", "pipe", "exclamation", "mean_word",
    "long_word", "distinct_words", "top_word", "word_repeats", "bigram_distinct", "lines_per_word", "line_repeats", "stop_ends", "byte_entropy", "log_words",
)

_BYTE = np.arange(256)
_KIND = np.zeros((256, 6), bool)
_KIND[:, 0] = (_BYTE >= 65) & (_BYTE <= 90)
_KIND[:, 1] = (_BYTE >= 48) & (_BYTE <= 57)
_KIND[:, 2] = (_BYTE > 32) & (_BYTE < 127) & ~_KIND[:, 0] & ~_KIND[:, 1] & ~((_BYTE >= 97) & (_BYTE <= 122))
_KIND[:, 3] = _BYTE >= 128
_KIND[:, 4] = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_MIX = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _runs(b: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and hashes of the runs of bytes between edges."""
    inside = np.concatenate(([False], ~edge, [False]))
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turn[::2], turn[1::2]
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_MIX[b] * _power(len(b)), dtype=np.uint64)))
    return start, end - start, (sums[end] - sums[start]) * _inverse(len(b))[start]


_POWERS: dict[str, np.ndarray] = {}


def _power(n: int) -> np.ndarray:
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        for name, base in (("up", int(_ODD)), ("down", pow(int(_ODD), -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n]


def _inverse(n: int) -> np.ndarray:
    _power(n)
    return _POWERS["down"]


def features(text: str | None) -> np.ndarray:
    """The features of one whole text; null and empty texts have zeros."""
    out = np.zeros(len(FEATURES), np.float32)
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    histogram = np.bincount(b, minlength=256)
    share = histogram[histogram > 0] / n
    punctuation = _KIND[b, 2]
    out[0] = np.log1p(n)
    out[1:4] = histogram @ _KIND[:, :3] / n
    out[4] = np.count_nonzero(punctuation[1:] & (b[1:] == b[:-1])) / n
    out[5], out[6] = histogram[128:].sum() / n, histogram @ _KIND[:, 4] / n
    out[7], out[8] = histogram[124] / n, histogram[33] / n
    out[18] = -(share * np.log2(share)).sum()
    _, length, word = _runs(b, _KIND[b, 4])
    words = len(word)
    if words:
        _, times = np.unique(word, return_counts=True)
        out[9], out[10] = length.mean(), min(length.max(), 1000)
        out[11], out[12] = len(times) / words, times.max() / words
        out[13] = np.count_nonzero(word[1:] == word[:-1]) / words
        if words > 1:
            out[14] = len(np.unique(word[1:] * _ODD ^ word[:-1])) / (words - 1)
        _, _, line = _runs(b, b == 10)
        out[15], out[16] = len(line) / words, 1 - len(np.unique(line)) / max(len(line), 1)
        out[17] = histogram[46] / words
        out[19] = np.log1p(words)
    return out


def _tree(gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float) -> np.ndarray:
    """The step for each bin of a tree of this depth over ordered bins."""
    step = np.zeros(len(gradient))

    def grow(lo: int, hi: int, left: int) -> None:
        g, h = np.cumsum(gradient[lo:hi]), np.cumsum(hessian[lo:hi])
        if left and hi - lo > 1:
            ok = (h[:-1] >= least) & (h[-1] - h[:-1] >= least)
            gain = np.where(ok, g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1), -1)
            if (at := int(gain.argmax())) >= 0 and gain[at] > 1e-6:
                grow(lo, lo + at + 1, left - 1)
                grow(lo + at + 1, hi, left - 1)
                return
        step[lo:hi] = g[-1] / (h[-1] + 1)

    grow(0, len(gradient), depth)
    return step


@dataclass
class AdditiveModel:
    prior: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: int = 8

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def cells(self, bins: np.ndarray, pair: tuple[int, int]) -> np.ndarray:
        i, j = (bins[:, k] * self.coarse // (len(self.edges[k]) + 1) for k in pair)
        return i * self.coarse + j

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        bins, total = self.bins(x), np.full(len(x), self.prior)
        for j, values in enumerate(self.tables):
            total += values[bins[:, j]]
        for pair, values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[self.cells(bins, pair)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, n_bins: int = 48, rounds: int = 150, pairs: int = 6, pair_rounds: int = 60, rate: float = 0.15) -> AdditiveModel:
    """Fit the tables. Without rows, or with one label only, the score is a constant."""
    model = AdditiveModel()
    if not len(y):
        return model
    w = np.ones(len(y)) if weight is None else weight
    mean = float(np.clip((w * y).sum() / w.sum(), 0.01, 0.99))
    model.prior = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    bins, total = model.bins(x), np.full(len(y), model.prior)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    least = 1e-3 * w.sum() * mean * (1 - mean)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return w * (y - p), w * p * (1 - p)

    for _ in range(rounds):
        for j, values in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(bins[:, j], g, len(values)), np.bincount(bins[:, j], h, len(values)), 2, least)
            values += step
            total += step[bins[:, j]]
    g, h = slopes()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i):
            cell = model.cells(bins, (i, j))
            gains.append((float((np.bincount(cell, g) ** 2 / (np.bincount(cell, h) + least)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros(model.coarse**2) for _ in model.pairs]
    cells = [model.cells(bins, pair) for pair in model.pairs]
    for _ in range(pair_rounds):
        for cell, values in zip(cells, model.pair_tables, strict=True):
            g, h = slopes()
            grid_g, grid_h = (np.bincount(cell, v, len(values)).reshape(model.coarse, -1) for v in (g, h))
            cut = _tree(grid_g.sum(1), grid_h.sum(1), 1, least)  # first along one feature, then each side along the other
            step = np.zeros_like(grid_g)
            for side in np.unique(cut):
                own = cut == side
                step[own] = _tree(grid_g[own].sum(0), grid_h[own].sum(0), 1, least)
            step = rate * step.ravel()
            values += step
            total += step[cell]
    return model


def with_features(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_features`` (array of float) computed from the whole text."""

    lean_batches(documents.sparkSession)

    @F.arrow_udf("array<float>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = [features(t) for t in batch.to_pylist()]
            flat = np.concatenate(x) if x else np.zeros(0, np.float32)
            yield pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32), pa.array(flat))

    return documents.withColumn("_features", compute(F.col(text)))


def train(documents: DataFrame, labels: DataFrame, usable, per_class: int = 5000) -> AdditiveModel:
    """Fit on at most ``per_class`` labelled documents of each class, weighted back to their shares.

    Only their features come to the driver: 20 numbers for each of at most 2 * per_class rows.
    """
    shares = {r["y"]: r["n"] for r in labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & usable).groupBy(F.col("quality").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sorted((r["doc_id"], r["y"], r["_features"]) for r in with_features(labelled_sample(documents, labels, "quality", per_class, usable)).select("doc_id", "y", "_features").collect())
    x, y = np.array([r[2] for r in rows], np.float32).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float)
    weight = np.array([shares[int(v)] / max((y == v).sum(), 1) for v in y])
    return fit(x, y, weight / weight.mean() if len(weight) else weight)


def score(documents: DataFrame, model: AdditiveModel, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability ``name`` of label 1 for every row, from its whole text.

    Null and empty texts are scored as texts whose features are 0. Equal texts get equal
    scores, other columns pass through, and an empty table gives an empty one.
    """
    lean_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array([features(t) for t in batch.to_pylist()], np.float32).reshape(-1, len(FEATURES))
            yield pa.array(shared.value.score(x), pa.float64())
        release_memory()

    return documents.withColumn(name, probability(F.col(text)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; the cases are those of ``train`` and ``score``, ties at 0.7 count as good."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    scored = score(docs.select("doc_id", "text"), train(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
