"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import lean_batches  # noqa: F401

#: Bytes that separate words, as a Java regular expression class.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local master, whose driver is its one executor, may do without the setting and gets
    a folder of its own; on a cluster that would lose data, so it is an error there.
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


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that nothing reads any more."""
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder of ``shared_folder``."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, usable: Column) -> DataFrame:
    """Text and label (``text``, ``y``) of at most ``per_class`` documents of each class.

    The sample is a bounded, documented parameter of a fit: the lowest hashes of
    doc_id win, so that reruns agree. Null ids, null labels and rows outside
    ``usable`` (a condition on doc_id) are not learned from; a document that is
    labelled twice counts with its smallest label, and of rows that repeat an id the
    smallest text counts, so repeated rows do not pass the bound either.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable).groupBy("doc_id").agg(F.min(label).alias("y"))
    lowest = [known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(label), F.col("doc_id")), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = lowest[0].union(lowest[1])
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", F.col("y").cast("int").alias("y")).agg(F.min("text").alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def joined_small(df: DataFrame, keys: DataFrame, on, how: str = "inner", limit: int = 2_000_000) -> DataFrame:
    """Join with a side that is broadcast only if it has at most ``limit`` rows, else shuffled.

    ``keys`` should be narrow and cheap to count (a checkpoint).
    """
    return df.join(F.broadcast(keys) if keys.count() <= limit else keys.hint("merge"), on, how)


def release_memory() -> None:
    """Give a Python worker's freed memory back to the system; idle workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
