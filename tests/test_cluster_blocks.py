"""Greedy clusters of groups that one task may not settle."""

from sluice.operators import clusters


def test_a_chain_of_choices_takes_as_many_steps_as_blocks(spark, monkeypatch):
    """Each item shares three tokens with the one before it alone; rounds would be as many as the items."""
    rows = [(i, "g", float(-i), [f"t{i + k}" for k in range(4)], [], "", "") for i in range(40)]
    frame = spark.createDataFrame(rows, "pos long, g string, seed double, tokens array<string>, terms array<string>, key string, kind string")
    written, table = [], clusters.Scratch.table
    monkeypatch.setattr(clusters.Scratch, "table", lambda self, df: written.append(1) or table(self, df))
    assert {r.cluster for r in clusters.greedy_clusters(frame, ["g"], task_rows=20).collect()} == {1}
    assert len(written) <= 8


def test_groups_of_unlike_lengths(spark):
    """A group whose last block is done has clusters but no rows in the blocks of a longer one; rows of a known key bring tokens that later ones meet."""
    rows = [(100 * g + i, f"g{g}", float(-i), [f"t{g}_{i + k}" for k in range(4)], [], f"k{i // 2}", "") for g, n in enumerate((20, 75)) for i in range(n)]
    frame = spark.createDataFrame(rows, "pos long, g string, seed double, tokens array<string>, terms array<string>, key string, kind string")
    got = {r.pos: r.cluster for r in clusters.greedy_clusters(frame, ["g"], task_rows=16).collect()}
    assert got == {r[0]: 1 for r in rows} == {r.pos: r.cluster for r in clusters.greedy_clusters(frame, ["g"]).collect()}
