import random

from pyspark.sql import functions as F

from sluice.operators.components import components
from sluice.operators.places import with_places
from sluice.sources.shared import FILES, Scratch


def test_a_long_chain_settles(spark):
    """100,000 links in an order that has nothing to do with the ends' names."""
    n = 100_000
    mixed = lambda c: (F.col(c) * 7919 + 13) % (n + 1)  # noqa: E731  a permutation
    edges = spark.range(n).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j")).select(mixed("i").alias("a"), mixed("j").alias("b"))
    got = components(edges).agg(F.count("*"), F.countDistinct("id"), F.min("label"), F.max("label")).head()
    assert tuple(got) == (n + 1, n + 1, 0, 0)


def test_components_of_random_edges(spark):
    rng = random.Random(3)
    for n, m in ((60, 40), (60, 90), (5, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(7, 7), (None, 1), (2, None)] * (m > 0)
        reach = {x: {x} for e in edges for x in e if None not in e}
        for a, b in edges:
            if a is not None and b is not None:
                both = reach[a] | reach[b]
                for x in both:
                    reach[x] = both
        names = spark.createDataFrame([(str(a) if a is not None else None, str(b) if b is not None else None) for a, b in edges], "a string, b string")
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.id: r.label for r in got} == {x: min(v) for x, v in reach.items()} and len(got) == len(reach)
        assert {r.id: r.label for r in components(names).collect()} == {str(x): min(map(str, v)) for x, v in reach.items()}


def test_few_edges_are_few_files(spark, monkeypatch):
    """The rounds of few edges do not write and read a file for each partition of a shuffle."""
    files, table = [], Scratch.table

    def counted(self, *args):
        out = table(self, *args)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    wide = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wide}
    for k, v in wide.items():
        spark.conf.set(k, v)
    try:
        got = components(spark.range(0, 400, 1, 3).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.id: r.label for r in got} == {i: i % 7 for i in range(400)}
    assert len(files) > 3 and max(files) <= FILES


def test_places(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3]), rng.randrange(5)) for _ in range(500)] + [("a", 2, 1)] * 300
    table = spark.createDataFrame(rows, "g string, x int, y int").repartition(5)
    got = with_places(table, ["g"], [F.desc_nulls_last("x"), "y"]).collect()
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2])
    for g in ("a", "b", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and [key(r) for r in own] == sorted(key(r) for r in rows if r[0] == g)
    assert with_places(table.where("y > 9"), [], ["x"]).count() == 0
    assert sorted(r.place for r in with_places(table.select("y"), [], ["y"]).collect()) == list(range(len(rows)))
