"""Bottom-k fingerprints of documents, from DataFrame functions alone.

A fingerprint keeps the k smallest hashes of a text's distinct word shingles, as fixed
width hexadecimal words in ascending order. The bottom k of two fingerprints' union is the
fingerprint of the united texts, so parts merge; the share of that union found in both
estimates resemblance, and the k-th hash estimates the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Words of a shingle, hashes of a fingerprint.
WORDS, K = 5, 128
#: Documents of a range that is walked as one group, at most about; the ranges' first ids come to the driver.
RANGE_ROWS = 50_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the word shingles in order, as longs of 60 bits; a shorter text has one of all its words."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return let(split, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(
        F.size(w) < words, F.array(F.shiftrightunsigned(F.xxhash64(w), 4))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j) for j in range(words)]), 4))))


def sketch(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return sketch(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets: 1 for two empty ones."""
    both = let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))
    return both.cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(2**60)) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds: 1 for an empty a."""
    r = resemblance(a, b, k)
    shared = r / (1 + r) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def encoded(a: Column) -> Column:
    """A sketch as text: 15 hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 15, "0")), ""))


def _cuts(ids: DataFrame, ranges: int, by: list[str]) -> DataFrame:
    """Approximate quantiles of doc_id, distinct and ascending, for each group of ``by``."""
    found = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges) if ranges > 1 else F.array().cast("array<bigint>")
    return ids.groupBy(*by).agg(F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<bigint>")).cast("array<bigint>"))).alias("_cuts"))


def in_ranges(docs: DataFrame, blocks: int, most: int = 1024) -> DataFrame:
    """Add ``_block``: ranges of descending doc_id, about ``blocks`` of them, null ids in a last one.

    Beyond ``most`` ranges each of these is cut again, into at most ``most``, so neither the
    cuts that a row meets nor the table of cuts (``most`` arrays, broadcast) grow with the data.
    """
    above = lambda cuts: F.size(F.filter(cuts, lambda c: c > F.col("doc_id")))
    coarse = F.array(*[F.lit(c).cast("bigint") for c in _cuts(docs.select("doc_id"), min(blocks, most), []).head()["_cuts"]])
    dealt = docs.withColumn("_block", F.when(F.col("doc_id").isNull(), F.size(coarse) + 1).otherwise(above(coarse)))
    if blocks <= most:
        return dealt
    fine = _cuts(dealt.select("doc_id", "_block"), min(most, -(-blocks // most)), ["_block"])
    both = dealt.join(F.broadcast(fine), "_block")
    return both.withColumn("_block", F.col("_block") * (most + 1) + F.when(F.col("doc_id").isNull(), 0).otherwise(above(F.col("_cuts")))).drop("_cuts")


def with_next(docs: DataFrame, blocks: int, most: int = 1024) -> DataFrame:
    """Rows of (doc_id, text) with ``next_text``: the text after them by descending doc_id, cyclically.

    Ranges of doc_id come from approximate quantiles; a window walks each range. The head of
    each range is also dealt, as one extra row, to the end of the range before it, so no row
    needs a window over the whole table. Null ids come last, ties go by text (so rows that
    repeat an id and text follow one another), a null text counts as empty, a long one is whole,
    an empty table gives an empty one, other columns are not read. The driver sees at most
    ``blocks`` ids.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = in_ranges(docs, blocks, most)
    ids = dealt.groupBy("_block").agg(F.max("doc_id").alias("_id"))
    heads = dealt.join(F.broadcast(ids), (dealt["_block"] == ids["_block"]) & dealt["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    heads = heads.groupBy("_block", "doc_id").agg(F.min("text").alias("text"))
    in_turn = Window.orderBy("_block")  # over one row for each of the bounded number of ranges
    before = F.coalesce(F.lag("_block").over(in_turn), F.max("_block").over(in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    extra = heads.select("doc_id", "text", before.alias("_block"), F.lit(True).alias("_extra"))
    walk = Window.partitionBy("_block").orderBy("_extra", F.col("doc_id").desc_nulls_last(), "text")
    walked = dealt.withColumn("_extra", F.lit(False)).unionByName(extra).withColumn("next_text", F.lead("text").over(walk))
    return walked.where(~F.col("_extra")).select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", words: int = WORDS, k: int = K) -> DataFrame:
    """Add the sketch of each whole text as array ``name``; null and empty texts have an empty one.

    Equal texts have equal sketches, a text of fewer words than a shingle has one hash; an empty
    table gives an empty one; a column called ``name`` is replaced, others pass through.
    """
    return docs.withColumn(name, sketch(shingle_hashes(F.col(text), words), k))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its half-edited text and its neighbour; see the module's functions for the cases."""
    rows = table(spark, sf_dir, "documents")
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    docs = with_next(rows, blocks)
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("CAST(n_chars DIV 2 AS INT)")
    docs = docs.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)))
    for text, name in (("text", "_own"), ("edited", "_edited"), ("next_text", "_next")):
        docs = fingerprints(docs, text, name)
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), encoded(F.col("_own")).alias("fingerprint"), encoded(F.col("_edited")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_edited")).alias("near_edited"), resemblance(F.col("_own"), F.col("_next")).alias("near_next"),
    )
