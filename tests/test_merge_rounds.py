"""Fuzzy merge of groups that one task may not settle."""

from sluice.operators import clusters


def test_common_tokens_do_not_pair_all_rows_with_all_homes(spark, monkeypatch):
    """Entries that share a first token and two more, each with a word of its own: no home fits, none is to be met."""
    n, pairs, table = 300, [], clusters.Scratch.table
    rows = [("t", f"e{i}", i, ["h", "a", "b", f"w{i}"]) for i in range(n)] + [("t", "k", n + i, ["h", "a", "b"]) for i in range(3)]

    def counted(self, df, *more):
        out = table(self, df, *more)
        if {"sid", "home"} <= set(out.columns):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(clusters.Scratch, "table", counted)
    frame = spark.createDataFrame(rows, "topic string, event_key string, pos long, signature array<string>")
    want = {r.pos: r.merged_key for r in clusters.fuzzy_merge(frame).collect()}
    assert not pairs
    assert {r.pos: r.merged_key for r in clusters.fuzzy_merge(frame, 5).collect()} == want and set(want) == set(range(n + 3))
    assert pairs and max(pairs) <= 10 * n
