"""Numbers as text where a quotient stands next to a tie."""

import duckdb

from sluice.plans import market


def test_ties_with_binary_noise_are_written_as_the_sql_does(spark, tmp_path):
    """65450.0 / 1e6 * 100 is just below 6.545 and 1.005e9 / 1e9 just below 1.005."""
    prices = [x + c for c in (0.0, 50.0) for x in [65_450.0, 300_650.0, 1_005_000.0, 1_005_000_000.0, 2_675.0, 999.995, 1_115.0, *[5_000.0 + 1_000 * n for n in range(300)]]]
    spark.createDataFrame([(n, p) for n, p in enumerate(prices, 1)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: (r.short, r.ratio, r.percent) for r in market.market_format(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = {k: v for k, *v in con.sql(f"SELECT o_orderkey, short, ratio, percent FROM ({market.ORACLES['market_format']})").fetchall()}
    assert got == {k: tuple(v) for k, v in want.items()}
