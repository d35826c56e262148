from pyspark.sql import functions as F

from sluice.sources import tables

DAY = 86_400


def test_pool(spark, tmp_path):
    path = str(tmp_path / "pool")
    rows = spark.createDataFrame([(i, i * DAY // 2) for i in range(8)], "id long, captured_at long")
    tables.append_pool(rows, path)
    tables.append_pool(rows.where("id = 7"), path)
    got = tables.pool_since(spark, path, 2 * DAY)
    assert sorted(r.id for r in got.collect()) == [4, 5, 6, 7, 7]
    assert "PartitionFilters: [isnotnull(" in got._jdf.queryExecution().executedPlan().toString()
    tables.upsert_days(rows.where("id IN (6, 7)").withColumn("id", F.col("id") + 100), path)
    tables.upsert_days(rows.where("id IN (6, 7)").withColumn("id", F.col("id") + 100), path)
    assert sorted(r.id for r in tables.pool_since(spark, path, 0).collect()) == [1, 2, 3, 4, 5, 106, 107]
