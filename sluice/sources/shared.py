"""Lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local master, whose driver is its one executor, may do without the setting.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sluice-checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir``."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def lean_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let Arrow batches hold at most ``rows`` rows from now on in this session (Spark's default is 10,000).

    Texts may be long, and a Python worker holds a batch in several forms at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(rows, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))


def kept(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition over costly columns, each of which is computed once.

    A plain filter moves below the columns that it reads, where they are computed for it a second
    time, and what these read a third. A filter that also reads a row's number stays where it is.
    """
    return rows.withColumn("_row", F.monotonically_increasing_id()).where(condition & (F.col("_row") >= 0)).drop("_row")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by a key: a file of few row groups is read by as few tasks, too few for work on texts."""
    return rows.repartition(key)


#: Rows that a file of a table of known size holds at least, and the files that any such table may have.
FILE_ROWS, FILES = 20_000, 8


class Scratch:
    """Tables in a folder of the shared store, deleted at the end of a ``with`` block.

    Unlike a checkpoint, a table is computed once, and plans that read it know its size but nothing
    of how it came about, so rounds of a loop stay alike. What the block returns has to be
    checkpointed in it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def table(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``rows``: about how many it will be. A shuffle may have hundreds of partitions; with few rows, each would be a file of hardly any."""
        path, self.count = f"{self.folder}/{self.count}", self.count + 1
        (df if rows is None else df.coalesce(max(FILES, -(-rows // FILE_ROWS)))).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
