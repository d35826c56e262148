"""Places of rows in one order over a whole table or within groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Rows up to which a side of a join may be broadcast; they are counted before.
BROADCAST_ROWS = 2_000_000


def joined_narrow(rows: DataFrame, small: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join by null-safe equality; ``small`` (a narrow checkpoint) is broadcast only if it is of at most BROADCAST_ROWS rows."""
    other = small.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in small.columns if c not in by])
    met = F.lit(True)
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(F.broadcast(other) if small.count() <= BROADCAST_ROWS else other, met, how).drop(*[f"_{c}" for c in by])


def with_places(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """Add ``name``, each row's place from 0 within its group of ``by`` in ``order``; equal rows follow one another in any order.

    The table is cut into ranges of (by, order): each range is put in order by itself, and what
    the ranges before hold of a group is added to the places inside. So neither a group that
    holds most rows nor one key that most rows share is a single task's. Null groups are groups.
    Keep the rows narrow: they are checkpointed twice.
    """
    tied = checkpointed(rows.withColumn("_tie", F.monotonically_increasing_id()))
    keys = [*by, *order, "_tie"]
    laid = checkpointed(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)).drop("_tie"))
    held = laid.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over one row for each range
    starts = checkpointed(held.select(*by, "_range", (F.col("_first") - before).alias("_shift")))
    return joined_narrow(laid, starts, [*by, "_range"]).withColumn(name, F.col("_at") - F.col("_shift")).drop("_at", "_range", "_shift")
