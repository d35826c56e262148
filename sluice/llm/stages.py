"""The stages of the corpus pipeline: quality, near duplicates, personal data, source mix, byte-level BPE.

Each takes (spark, docs, sf_dir), works on all rows at hand and returns the columns of ``docs``
(the last one its own). Callers' columns of any name come back unchanged. An empty table gives
an empty one; what null, empty and very long texts, ties and repeated rows give is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, mixing, neardup, pii, quality
from .common import fresh, in_fold, table

#: A document stays if its quality score is at least this.
GOOD = 0.7


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches GOOD; learned as in op1_quality, from the rows at hand.

    Null and empty texts are scored like any text without words; equal texts share a score, so
    repeated rows stay or go together; without labelled rows every score is 0.5 and all go.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~in_fold(F.col("doc_id"), 4, 2))
    (score,) = fresh(docs, "score")
    return quality.score(docs, model, name=score).where(F.col(score) >= GOOD).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The smallest doc_id of a group stays, one row of it if it is repeated; texts without words
    and rows without doc_id stay.
    """
    return neardup.one_of_each(docs, words=5, percent=80).select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind in angle brackets, n_chars (where there is one) of the new text.

    Rows without spans, null and empty texts among them, stay as they are.
    """
    names = tuple(fresh(docs, "base", "spans"))
    found = pii.redact(pii.find(docs, names=names), spans=names[1])
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(names[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the shares of the target weights, see ``mixing.mixed``."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids of every row; ``round_trip`` tells that they decode to the text's bytes.

    A null or empty text has no tokens.
    """
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return both.select("doc_id", "lang", "source", "n_tokens", "token_ids", same.alias("round_trip"))
