"""Connected components by contraction: hook, jump to the roots, keep the edges between roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch, checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of an edge (a, b) of any ordered type: ``label`` is the smallest id that it reaches.

    A contraction hooks each end to its smallest neighbour, if that is smaller, and follows the
    hooks by pointer jumps, so a chain costs as many jumps as its length has binary digits. The edges
    between different roots go on; at most half of the ends do, so contractions are as few, and
    the tables shrink at that rate. No label walks along a path edge by edge. Null ends take no
    part; loops and repeated edges do no harm. Only whether something is left comes to the driver.
    """
    with Scratch(edges.sparkSession) as scratch:
        ends = scratch.table(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        left, hooked = ends.where("a <> b"), []
        while rows := left.count():
            hooked.append((_roots(left, rows, scratch), rows))
            x, y = (hooked[-1][0].select(F.col("id").alias(c), F.col("up").alias(to)) for c, to in (("a", "x"), ("b", "y")))
            moved = left.join(x, "a").join(y, "b").where("x <> y")
            left = scratch.table(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), rows)
        found = None
        for roots, rows in reversed(hooked):  # those of the last contraction are final
            if found is None:
                found = roots.withColumnRenamed("up", "label")
                continue
            final = found.select(F.col("id").alias("up"), "label")
            found = scratch.table(roots.join(final, "up", "left").select("id", F.coalesce("label", "up").alias("label")), rows)
        alone = ends.where("a = b").select(F.col("a").alias("id")).distinct()
        if found is not None:
            alone = alone.join(found.select("id"), "id", "left_anti")
        alone = alone.select("id", F.col("id").alias("label"))
        return checkpointed(alone if found is None else found.union(scratch.table(alone)))


def _roots(edges: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """(id, up): the root that each end of edges (a > b) comes to by way of smallest neighbours."""
    own = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("up")), F.struct(F.col("b").alias("id"), F.col("b").alias("up")))).alias("e")).select("e.*")
    hooks = scratch.table(own.groupBy("id").agg(F.min("up").alias("up")), rows)  # an end with no smaller neighbour has itself
    while True:
        over = hooks.where("id <> up").select(F.col("id").alias("up"), F.col("up").alias("over"))  # a root need not be looked up
        jumped = scratch.table(hooks.join(over, "up", "left").select("id", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")), rows)
        hooks = jumped.select("id", "up")
        if jumped.where("moved").isEmpty():
            return hooks
