"""Mixing sources to target weights by a low-discrepancy schedule, from DataFrame functions alone.

Each source's documents are shuffled by hash, laid end to end as words, round after round up
to the source's rounded target, and this line is cut into blocks of equal words. The slots of
the mix are van der Corput points, mapped to sources through the cumulative numbers of blocks.
Slots are ranked within their source and the r-th slot is joined to the source's r-th block,
so the mix has an order in which every stretch holds the sources near their shares. A document
is taken for those of its words that lie in joined blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, fresh, table

#: Most times that a word is taken, words of a block, rows of a hash range of documents, slots of a chunk.
MOST, BLOCK, RANGE_ROWS, CHUNK = 3, 4096, 5_000, 1 << 16
#: Binary digits of a point; points and the ends of intervals are whole numbers of 2 ** -POINT_BITS.
POINT_BITS = 62


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ...; targets share the sum of
    all sizes by weight, but none is above MOST times its source's size: the excess goes to
    the others by weight. With sources by rising cap per weight, the capped ones are a
    prefix, so running sums find them. One task sorts one row for each source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("w", ((place - 1) % 3 + 1).cast("double")).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = weighed.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    first = F.max(F.when(F.col("open"), F.col("level"))).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("first", first).select("source", "source_size", F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("first") * F.col("w"))).alias("target"))


def planned(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``targets`` with ``take``, the target to the word, and ``blocks``, how many blocks hold it."""
    take = F.least(F.round("target").cast("long"), MOST * F.col("source_size"))
    return targets(sizes).withColumn("take", take).withColumn("blocks", F.ceil(F.col("take") / block).cast("long"))


def ranked(rows: DataFrame, order: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Add ``name``, the rank from 0 of each row within its source by ``order`` (whole numbers from 0, distinct in a source).

    Ranks go by chunks of ``order`` and running counts over chunks, so no task sorts a whole source.
    """
    dealt = rows.withColumn("_c", F.floor(F.col(order) / chunk))
    counts = dealt.groupBy("source", "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("_s"), F.col("_c").alias("_d"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("source", "_c").orderBy(order)) - 1
    out = dealt.withColumn("_i", inside).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_c") == F.col("_d")))
    return out.withColumn(name, F.col("_start") + F.col("_i")).drop("_c", "_d", "_s", "_i", "_start")


def point(slot: Column) -> Column:
    """The van der Corput point of a slot: its binary digits in reverse, exact for all slots below 2 ** POINT_BITS."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), POINT_BITS, "0")), 2, 10).cast("bigint")


def schedule(spark: SparkSession, plan: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(source, block, slot): the slot of every block of a plan (source, blocks), blocks from 0.

    A source owns an interval of the points as long as its share of all blocks; points and
    intervals meet in equal bins by an equi-join. There are twice as many points as blocks, n:
    the first 2 ** m of them, more than n, lie at equal distances below 1 / n, so an interval of
    k blocks holds k points or more, at any size. Each source uses its first ones.
    """
    plan = plan.where(F.col("blocks") > 0).select("source", "blocks")
    totals = plan.agg(F.sum("blocks").alias("n"), F.count(F.lit(1)).alias("sources")).head()
    n, bits = totals["n"] or 0, max(12, (4 * totals["sources"]).bit_length())
    order = Window.orderBy(F.col("source").asc_nulls_last())  # over one row for each source
    end = lambda blocks: F.expr(f"CAST(CAST({blocks} AS DECIMAL(18, 0)) * CAST({1 << POINT_BITS} AS DECIMAL(19, 0)) AS DECIMAL(38, 0)) DIV {max(n, 1)}")
    spans = plan.withColumn("upto", F.sum("blocks").over(order)).select("source", "blocks", end("upto - blocks").alias("lo"), end("upto").alias("hi"))
    at = lambda c: F.shiftright(c, POINT_BITS - bits)
    spans = spans.withColumn("bin", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi") - 1))))
    points = spark.range(2 * n).select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).withColumn("bin", at(F.col("u")))
    met = points.join(spans, "bin").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return ranked(met.select("source", "blocks", "slot"), "slot", "block", chunk).where(F.col("block") < F.col("blocks")).select("source", "block", "slot")


@dataclass(frozen=True)
class Laid:
    """``rows``: row (a struct), source, size, range, n (its place in the range), start (its first word in the source's line) and
    the plan of its source; ``pieces``: range, n, source, pass, block, slot, words of each stretch that is taken."""

    rows: DataFrame
    pieces: DataFrame


def laid_out(documents: DataFrame, keep: Column, narrow: bool = False, block: int = BLOCK, range_rows: int = RANGE_ROWS, chunk: int = CHUNK) -> Laid:
    """Lay the documents of each source out as a line of words and join its blocks to the slots of the schedule.

    ``keep`` is a struct of what ``row`` shall hold; where it is ``narrow`` (holds no text) the texts
    are read once. A source that holds most rows is spread over
    hash ranges of about ``range_rows`` rows, whose number grows with the table.
    """
    spark = documents.sparkSession
    docs = documents.select(keep.alias("row"), F.col("source"), F.col("doc_id").alias("id"), words().alias("size"), F.xxhash64(F.lit("mix"), "doc_id", "text").alias("hash"))
    small = checkpointed(docs if narrow else docs.drop("row"))
    at = F.pmod(F.shiftrightunsigned("hash", 16), F.lit(1 + small.count() // range_rows))
    docs, small = (small if narrow else docs).withColumn("range", at), small.withColumn("range", at)
    ranges = checkpointed(small.groupBy("source", "range").agg(F.sum("size").alias("words")))
    goals = checkpointed(planned(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), block))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(F.col("source").alias("_s"), "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("_start"))
    plan = starts.join(goals, F.col("_s").eqNullSafe(F.col("source"))).select("_s", F.col("range").alias("_r"), "_start", "source_size", "target", "take")
    inside = Window.partitionBy("source", "range").orderBy("hash", "id", "size")

    def placed(table: DataFrame) -> DataFrame:
        before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = table.withColumns({"n": F.row_number().over(inside), "_before": before})
        met = found.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r"))).withColumn("start", F.col("_start") + F.col("_before"))
        return met.drop("_s", "_r", "_start", "_before", "hash", "id")

    line = checkpointed(placed(small))
    c = F.col
    rounds = line.where("size > 0").select("source", "range", "n", "size", "start", "source_size", "take", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("pass"))
    taken = rounds.withColumn("lo", c("start") + c("pass") * c("source_size")).withColumn("hi", F.least(c("lo") + c("size"), c("take"))).where("hi > lo")
    cut = taken.withColumn("block", F.explode(F.sequence(F.floor(c("lo") / block), F.floor((c("hi") - 1) / block))))
    cut = cut.withColumn("words", F.least(c("hi"), (c("block") + 1) * block) - F.greatest(c("lo"), c("block") * block))
    slots = schedule(spark, goals, chunk).select(c("source").alias("_s"), c("block").alias("_b"), "slot")
    joined = cut.join(slots, c("source").eqNullSafe(c("_s")) & (c("block") == c("_b")), "left")
    end = 2 * F.lit(1 << 60)  # after all slots
    return Laid(line if narrow else placed(docs), joined.select("source", "range", "n", "pass", "block", F.coalesce("slot", end).alias("slot"), "words"))


def taken(laid: Laid) -> DataFrame:
    """``rows`` with ``taken``, the words of its joined pieces, and ``slot``, the first of their slots (null if nothing is taken)."""
    sums = laid.pieces.groupBy("source", "range", "n").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"))
    sums = sums.select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.col("n").alias("_n"), "taken", "slot")
    met = F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")) & (F.col("n") == F.col("_n"))
    return laid.rows.join(sums, met, "left").select("row", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot")


_NAMES = ("size", "source_size", "target", "taken", "slot")


def mix(documents: DataFrame, names: tuple[str, ...] = _NAMES, block: int = BLOCK, range_rows: int = RANGE_ROWS, chunk: int = CHUNK) -> DataFrame:
    """Every row of ``documents`` (doc_id, source, text) with its size, source_size, target, taken and slot, called by ``names``.

    ``taken`` sums to the rounded target in each source. Null and empty texts have size 0 and are
    never taken; a very long text is a run of blocks; repeated rows are separate documents; a
    null source is a source of its own; an empty table gives an empty one. The order of words
    depends on doc_id, source and text only, so reruns agree, ties among equal rows aside.
    Other columns pass through; columns that bear ``names`` are replaced, so choose others to keep them.
    """
    out = taken(laid_out(documents, F.struct(*documents.columns), False, block, range_rows, chunk))
    kept = [F.col("row")[c].alias(c) for c in documents.columns if c not in names]
    return out.select(*kept, *[F.col(c).alias(n) for c, n in zip(_NAMES, names, strict=True)])


def mixed(documents: DataFrame) -> DataFrame:
    """The mix of whole documents: each row as often as ``mix`` takes it, half or more of its words counting as one time.

    Columns are those of ``documents``, unchanged. Of each source one document at most, where its
    last round stops, is rounded. Rows without words cost nothing and stay once.
    """
    taken_name, size_name, slot_name, a, b = fresh(documents, "taken", "size", "slot", "ss", "tt")
    planned = mix(documents, (size_name, a, b, taken_name, slot_name))
    size, n = F.col(size_name), F.col(taken_name)
    times = F.when(size == 0, F.lit(1)).otherwise(F.floor((2 * n + size) / (2 * F.greatest(size, F.lit(1)))))
    many = F.array_repeat(F.lit(0), times.cast("int"))
    (copy,) = fresh(planned, "copy")
    return planned.withColumn(copy, F.explode(many)).select(documents.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the slot of its first one; the cases are those of ``mix``."""
    out = taken(laid_out(table(spark, sf_dir, "documents"), F.struct("doc_id"), narrow=True))
    return out.select("row.doc_id", "size", "source_size", "target", "taken", "slot")
