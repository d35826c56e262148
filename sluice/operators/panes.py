"""Sliding windows from panes in two levels: no row is copied for the windows that hold it.

Windows end at multiples of ``step`` and look back ``w``, both ends included. Rows are first merged
into panes, as wide as the greatest common measure of step and windows, then panes into blocks of
about the square root of half a window's panes. A window is merged from the blocks that lie
inside it and the panes at its ends, so of w / pane states it needs about the square root.
"""

from __future__ import annotations

from math import gcd, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pane_width(windows: tuple[int, ...], step: int) -> int:
    return gcd(step, *windows)


def with_panes(rows: DataFrame, windows: tuple[int, ...], step: int) -> DataFrame:
    """Add ``pane``, which ends at a multiple of the pane width at or after ts, and ``edge``: whether ts is that end.

    Edges are panes of their own, for a window holds the edge that it starts at. A null ts has no pane and goes.
    """
    width = pane_width(windows, step)
    rows = rows.where(F.col("ts").isNotNull()).withColumn("pane", F.ceil(F.col("ts") / width).cast("bigint"))
    return rows.withColumn("edge", F.col("ts") == F.col("pane") * width)


def window_parts(panes: DataFrame, by: list[str], merge: list[Column], windows: tuple[int, ...], step: int) -> DataFrame:
    """States (by, w, t, ...) of panes and blocks, which ``merge`` over (by, w, t) makes into windows.

    ``panes``: by, pane, edge and the state's columns, one row for each; ``merge`` merges states, each
    column under its own name.
    """
    width = pane_width(windows, step)
    stride, size = step // width, max(1, isqrt(max(windows) // width // 2))
    c = F.col
    panes = panes.withColumn("block", F.floor((c("pane") - 1) / size))
    blocks = panes.groupBy(*by, "block").agg(*merge)

    def instants(lo: Column, hi: Column) -> Column:
        first, last = F.ceil(lo / stride).cast("bigint"), F.floor(hi / stride).cast("bigint")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    lengths = F.explode(F.array(*[F.lit(w // width).cast("bigint") for w in windows]))
    inside, until = (c("block") + 1) * size, c("block") * size + c("m")  # windows that end between these hold the whole block
    fine = panes.withColumn("m", lengths).withColumn("past", c("pane") - 1 + c("m"))
    ends = F.concat(instants(c("pane"), F.least(inside - 1, c("past"))), instants(F.greatest(until + 1, inside), c("past") + c("edge").cast("int")))
    ragged = fine.withColumn("t", F.explode(ends)).drop("pane", "edge", "block", "past")
    whole = blocks.withColumn("m", lengths).withColumn("t", F.explode(instants(inside, until))).drop("block")
    return whole.unionByName(ragged).withColumns({"w": (c("m") * width).cast("int"), "t": c("t") * step}).drop("m")
