"""Language identification by nearest clustered centroids.

A text becomes a vector of hashed byte n-grams (1 to 3 bytes of the lower-cased text),
weighted by TF-IDF and scaled to length 1. Each language has several centroids, from
spherical k-means over a bounded sample of its documents; the prediction is the language
of the centroid of the highest cosine. Texts far from every centroid are marked as
rejected and score low.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, in_fold, joined_small, lean_batches, table

#: Hash buckets of the n-grams of 1, 2 and 3 bytes, one after another.
BUCKETS = (256, 2048, 4096)
DIMENSIONS = sum(BUCKETS)


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts of each text, a row of DIMENSIONS for each."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts, strict=True):
        b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        if not len(b):
            continue
        b = np.concatenate(([np.uint32(32)], b, [np.uint32(32)]))
        at = 0
        for n, size in enumerate(BUCKETS, 1):
            code = b[: len(b) - n + 1].copy()
            for i in range(1, n):
                code *= np.uint32(0x01000193)
                code ^= b[i : len(b) - n + 1 + i]
            if n > 1:
                code *= np.uint32(2654435761)
                code >>= np.uint32(32 - size.bit_length() + 1)
            row[at : at + size] = np.bincount(code, minlength=size)
            at += size
    return out


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    nearest: float

    def vectors(self, texts: list[str]) -> np.ndarray:
        x = counts(texts)
        np.log1p(x, out=x)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return x

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score from 0 to 1, and whether the text is too far from all."""
        cosine = self.vectors(texts) @ self.centroids.T
        by_language = np.full((len(texts), len(self.languages)), -1.0, np.float32)
        for k, language in enumerate(self.owner):
            by_language[:, language] = np.maximum(by_language[:, language], cosine[:, k])
        best = by_language.argmax(1)
        top = by_language[np.arange(len(texts)), best]
        shares = np.exp(20 * (by_language - top[:, None])).sum(1)
        far = top < self.nearest
        return best, np.clip(1 / shares * np.where(far, 0.5, 1.0), 0, 1), far


def fit(texts: list[str], languages: list[str], clusters: int = 4, rounds: int = 8, reject: float = 0.001) -> Centroids:
    """Centroids of a sample. ``reject``: share of the sample that the distance limit puts aside."""
    names = sorted(set(languages))
    model = Centroids(names, np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), -1.0)
    if not names:
        return model
    seen = np.zeros(DIMENSIONS)
    for i in range(0, len(texts), 512):
        seen += (counts(texts[i : i + 512]) > 0).sum(0)
    model.idf = (np.log((1 + len(texts)) / (1 + seen)) + 1).astype(np.float32)
    owner, all_centroids, near = [], [], []
    for k, name in enumerate(names):
        x = model.vectors([t for t, own in zip(texts, languages, strict=True) if own == name])
        picked = [0]
        while len(picked) < min(clusters, len(x)):  # the farthest from those picked so far
            picked.append(int((x @ x[picked].T).max(1).argmin()))
        centre = x[picked]
        for _ in range(rounds):
            member = (x @ centre.T).argmax(1)
            centre = np.stack([x[member == c].sum(0) if (member == c).any() else centre[c] for c in range(len(centre))])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        near.append((x @ centre.T).max(1))
        all_centroids.append(centre)
        owner += [k] * len(centre)
    model.centroids, model.owner = np.concatenate(all_centroids).astype(np.float32), np.array(owner)
    model.nearest = float(np.quantile(np.concatenate(near), reject))
    return model


def train(documents: DataFrame, usable: Column, per_language: int = 250, clusters: int = 4) -> Centroids:
    """Fit on at most ``per_language`` documents of each language (lowest hashes of doc_id).

    Rows with a null text, language or id, texts without a letter, and rows outside
    ``usable`` are not learned from.
    """
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & usable)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language).select("doc_id", "lang").distinct()
    sample = documents.select("doc_id", "lang", "text").where(F.col("text").rlike(r"\p{L}"))
    # of rows that repeat an id one counts, so they do not pass the bound either
    sample = joined_small(sample, chosen, ["doc_id", "lang"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    kept: dict[str, list[str]] = {}
    for lang, _, text in sorted((r["lang"], r["doc_id"], r["text"]) for r in sample.collect()):
        kept.setdefault(lang, []).append(text)
    return fit([t for x in kept.values() for t in x], [lang for lang, x in kept.items() for _ in x], clusters)


def identify(documents: DataFrame, model: Centroids, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "lang_far")) -> DataFrame:
    """Add the language, a score from 0 to 1 and whether the text is far from all, called by ``names``, to every row, from its whole text.

    A null text, a text without a letter (so the empty one) and any text under a model
    that learned no language give ``und``, score 0 and far. Equal texts get equal results.
    Other columns pass through; columns that bear ``names`` are replaced, so choose others to
    keep them. An empty table gives an empty one.
    """
    lean_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,far:boolean>")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        names = np.array(model.languages, object)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            lang, score, far = [], [], []
            for i in range(0, len(texts), 256):
                best, s, f = model.predict(texts[i : i + 256])
                lang += names[best].tolist()
                score.append(s)
                far.append(f)
            parts = [pa.array(lang, pa.string()), pa.array(np.concatenate(score or [[]]).astype(float), pa.float64()), pa.array(np.concatenate(far or [[]]).astype(bool), pa.bool_())]
            yield pa.StructArray.from_arrays(parts, ["lang", "score", "far"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    guess = F.when(lettered, nearest(F.col(text))) if model.languages else F.lit(None).cast("struct<lang:string,score:double,far:boolean>")
    (own,) = fresh(documents, "guess")
    found = (F.coalesce(F.col(own)["lang"], F.lit("und")), F.coalesce(F.col(own)["score"], F.lit(0.0)), F.coalesce(F.col(own)["far"], F.lit(True)))
    return documents.withColumn(own, guess).withColumns(dict(zip(names, found, strict=True))).drop(own)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; the cases are those of ``train`` and ``identify``."""
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    found = identify(docs.select("doc_id", "text"), train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "lang_far")
