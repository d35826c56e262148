"""Tables of the newest row for each key, kept across batches: deltas are merged when read and compacted now and then.

A batch writes its own delta folder and nothing else, so a batch that is repeated leaves the same
table. Compaction writes a base of all batches up to one, and readers take the last base that is
complete and only the deltas after it; what it stands for goes with the next compaction, so
a reader that has begun can end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path`` (of the shared store) by ``key``; of two rows of a key the one with the greater ``order`` is newer, of equal ones that of the later batch.

    Rows where the column ``gone`` (if one is named) is true end their key. Null keys are keys;
    a null order is before all others.
    """

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    order: str
    gone: str | None = None

    def _children(self, folder: str, name: str, complete: bool) -> list[int]:
        """The numbers of the folders name=number that hold a finished write."""
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        top = jvm.Path(f"{self.path}/{folder}")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName().startswith(f"{name}=")]
        return sorted(int(p.getName().split("=")[1]) for p in found if not complete or fs.exists(jvm.Path(p, "_SUCCESS")))

    def _remove(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row for each key; a partial aggregation, so a key with many rows is no single task's."""
        columns = [c for c in rows.columns if c != "batch"]
        best = rows.groupBy(*self.key).agg(F.max_by(F.struct(*columns, "batch"), F.struct(self.order, "batch")).alias("_r"))
        return best.select("_r.*")

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Write the newest row of each key of a batch; writing a batch again replaces it."""
        newest = self._newest(rows.withColumn("batch", F.lit(batch).cast("bigint"))).drop("batch")
        newest.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")

    def next_batch(self) -> int:
        """A number after all batches that were begun, broken ones too, for a writer that numbers its own."""
        return max([-1, *self._children("deltas", "batch", False), *self._children("base", "upto", False)]) + 1

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return self.upsert

    def _merged(self) -> tuple[DataFrame | None, int]:
        bases, deltas = self._children("base", "upto", True), self._children("deltas", "batch", True)
        upto, parts = (bases[-1] if bases else -1), []
        if bases:
            parts.append(self.spark.read.parquet(f"{self.path}/base/upto={upto}"))
        later = [b for b in deltas if b > upto]
        if later:
            read = self.spark.read.option("basePath", f"{self.path}/deltas").parquet(*[f"{self.path}/deltas/batch={b}" for b in later])
            parts.append(read.withColumn("batch", F.col("batch").cast("bigint")))
        if not parts:
            return None, upto
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], True)
        return self._newest(rows), max([upto, *later])

    def current(self) -> DataFrame | None:
        """The newest row of each key that has not ended; None before the first batch."""
        rows, _ = self._merged()
        if rows is None:
            return None
        return (rows.where(~F.coalesce(F.col(self.gone), F.lit(False))) if self.gone else rows).drop("batch")

    def compact(self) -> None:
        """Make a base of all batches so far; ended keys go. Bases and deltas that the base before stood for are removed.

        A compaction that is broken off leaves a folder that no reader takes, and can be called again.
        """
        rows, upto = self._merged()
        before = self._children("base", "upto", True)
        if rows is None or (before and before[-1] == upto):
            return
        if self.gone:
            rows = rows.where(~F.coalesce(F.col(self.gone), F.lit(False)))
        rows.write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")
        for old in before[:-1]:
            self._remove(f"{self.path}/base/upto={old}")
        for batch in self._children("deltas", "batch", False):
            if before and batch <= before[-1]:
                self._remove(f"{self.path}/deltas/batch={batch}")
