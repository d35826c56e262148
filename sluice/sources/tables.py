"""Tables of pools, histories and registries: partitioned by day, appended or replaced by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _with_day(rows: DataFrame, time: str) -> DataFrame:
    return rows.withColumn("day", F.date_format(F.timestamp_seconds(time), "yyyy-MM-dd"))


def append_pool(rows: DataFrame, path: str, time: str = "captured_at") -> None:
    """Append rows with a positive time to the day partitions they belong to."""
    _with_day(rows.where(F.col(time) > 0), time).write.mode("append").partitionBy("day").parquet(path)


def pool_since(spark: SparkSession, path: str, since: int, time: str = "captured_at") -> DataFrame:
    """Rows from ``since`` on; earlier days are pruned by partition, so retention needs no rewrite."""
    first_day = F.date_format(F.timestamp_seconds(F.lit(since)), "yyyy-MM-dd")
    return spark.read.parquet(path).where((F.col("day").cast("string") >= first_day) & (F.col(time) >= since)).drop("day")


def upsert_days(rows: DataFrame, path: str, time: str = "captured_at") -> None:
    """Replace the partitions of the days that ``rows`` hold, and no others; a repeated call changes nothing."""
    _with_day(rows, time).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
