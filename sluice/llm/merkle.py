"""Merkle manifest of a table: checkpoint every few levels, recompute what lies between.

Rows are leaves. Those of each language form a tree in order of doc_id, the trees' roots
(subroots) one more tree, whose root stands for the table. Of the levels of a tree only every
``EVERY``-th is stored. A proof is read from the top down: for every stored level the nodes
of an aligned subtree (at most FAN ** EVERY of them) meet in one row, which computes the levels
that are missing between them, gives the siblings on each node's way up, and forgets them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.places import joined_narrow, with_places
from .common import checkpointed, table

#: Children of a node; levels from one stored level to the next.
FAN, EVERY = 2, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIBLINGS = "array<struct<before:string,after:string>>"


def leaf_digest(**changed: Column) -> Column:
    """H of a row's fields, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and the value."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def _up(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), ""), 256))


def subtree(nodes: Column, steps: Column) -> Column:
    """The nodes of one aligned subtree and of the ``steps`` levels above them, bottom first."""
    return F.aggregate(F.array_repeat(F.lit(0), steps), F.array(nodes), lambda levels, _: F.concat(levels, F.array(_up(F.element_at(levels, -1)))))


def siblings(levels: Column, at: Column, steps: Column) -> Column:
    """What stands before and after the node ``at`` in its run, and likewise for those above it, level by level."""

    def beside(nodes: Column, j: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(FAN), j)).cast("int")
        start = place - place % FAN
        return F.struct(F.array_join(F.slice(nodes, start + 1, place - start), "").alias("before"), F.array_join(F.slice(nodes, place + 2, start + FAN - place - 1), "").alias("after"))

    return F.transform(F.slice(levels, F.lit(1), steps), beside)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _steps() -> Column:
    """Levels from a stored level to the next, or to its tree's root: ``n`` nodes of the tree lie on the level."""
    below = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    return F.least(F.lit(EVERY), below).cast("int")


def _subtrees(nodes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(tree, n, above, rows, levels, steps): a row for each aligned subtree over a stored level."""
    grouped = nodes.withColumn("above", F.floor(F.col("place") / FAN**EVERY)).groupBy("tree", "n", "above").agg(F.array_sort(F.collect_list(F.struct("place", "node", *extra))).alias("rows"))
    return grouped.withColumn("steps", _steps()).withColumn("levels", subtree(F.transform("rows", lambda r: r["node"]), F.col("steps")))


@dataclass(frozen=True)
class Manifest:
    """``stored``: tree, n, place, node of each stored level, leaves first (these with the columns that
    came with them); the last has one node for each tree. ``trees``: tree, lang, subroot, proof (from the
    subroot to the root). ``root``: the table's, None for an empty table."""

    stored: list[DataFrame]
    trees: DataFrame
    root: str | None


def _stored(leaves: DataFrame) -> list[DataFrame]:
    """The leaves and every ``EVERY``-th level above them, up to one node for each tree; nodes of a tree are placed from 0."""
    sizes = checkpointed(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    levels, most = [checkpointed(joined_narrow(leaves, sizes, ["tree"]))], sizes.agg(F.max("n")).head()[0] or 0
    while most > 1:
        up = _subtrees(levels[-1].select("tree", "n", "place", "node"))
        levels.append(checkpointed(up.select("tree", F.ceil(F.col("n") / FAN**EVERY).alias("n"), F.col("above").alias("place"), F.element_at(F.element_at("levels", -1), 1).alias("node"))))
        most = -(-most // FAN**EVERY)
    return levels


def _with_proofs(stored: list[DataFrame], tops: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Tree, place, ``names`` and ``proof`` of each leaf; ``tops`` has tree, subroot and the proof of each tree's root."""
    above = tops.select("tree", F.lit(0).cast("long").alias("above"), "subroot", "proof")
    for k in range(len(stored) - 1, -1, -1):
        extra = names if k == 0 else ()
        met = _subtrees(stored[k], extra).join(above, ["tree", "above"])
        first = F.col("above") * FAN**EVERY
        row = F.explode(F.col("rows")).alias("r")
        rows = met.select("tree", "subroot", "levels", "steps", "proof", first.alias("first"), row)
        proof = F.concat(siblings(F.col("levels"), F.col("r.place") - F.col("first"), F.col("steps")), F.col("proof")).cast(_SIBLINGS)
        above = rows.select("tree", F.col("r.place").alias("above" if k else "place"), "subroot", proof.alias("proof"), *[F.col("r")[c].alias(c) for c in ("node", *extra) if k == 0])
    return above


def manifest(documents: DataFrame, **named: Column) -> Manifest:
    """Store the trees of ``documents`` (FIELDS); ``named`` columns are computed beside the leaves and stay with them.

    A tree's leaves ascend by doc_id, null ids first; rows that repeat an id go by their digest,
    and each is a leaf of its own. A null lang has a tree of its own, before all others. Null
    fields and empty texts have digests of their own kind, long texts count in whole; other columns
    are not read, and an empty table has no root.
    """
    rows = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf_digest().alias("node"), *[c.alias(n) for n, c in named.items()])
    rows = checkpointed(rows)
    trees = checkpointed(with_places(rows.select("lang").distinct(), [], [F.col("lang").asc_nulls_first()], "tree"))
    placed = with_places(joined_narrow(rows, trees, ["lang"]).drop("lang"), ["tree"], [F.col("doc_id").asc_nulls_first(), "node"])
    stored = _stored(placed)
    subroots = checkpointed(stored[-1].select("tree", "node"))
    over = _stored(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "node"))
    root = over[-1].head()
    tops = over[-1].select("tree", F.col("node").alias("subroot"), F.array().cast(_SIBLINGS).alias("proof"))
    proofs = _with_proofs(over, tops, ()).select(F.col("place").alias("tree"), F.col("node").alias("subroot"), "proof")
    return Manifest(stored, checkpointed(proofs.join(trees, "tree")), root["node"] if root else None)


def proofs(stored: Manifest, *names: str) -> DataFrame:
    """tree, place, node (the leaf), subroot, ``proof`` (siblings up to the root) and the columns ``names`` of every leaf."""
    return _with_proofs(stored.stored, stored.trees, ("doc_id", *names))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and the root that follows from a row that may be tampered; cases as in ``manifest``.

    A largest possible n_chars plus 1 counts on as a decimal number; a row without doc_id is not tampered.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    longer = F.when(tampered, (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")).otherwise(F.col("n_chars").cast("string"))
    found = manifest(table(spark, sf_dir, "documents"), claimed=leaf_digest(n_chars=longer))
    root = F.lit(found.root).cast("string")
    out = proofs(found, "claimed").withColumn("folded_root", folded(F.col("claimed"), F.col("proof")))
    return out.select("doc_id", F.col("node").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS i, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z, n_chars FROM documents),
c AS (SELECT *, coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(i, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda r, k: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 7 = 0, false) AS bad FROM d),
l AS (SELECT doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
    sha256(a || coalesce(strlen(CAST(n_chars + CAST(bad AS INT) AS VARCHAR)) || ':' || (n_chars + CAST(bad AS INT)), '-') || z) AS claimed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM c),
t AS (SELECT lang, 0 AS lvl, place, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM l
  UNION ALL SELECT lang, lvl + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY lang, lvl, place // 2),
s AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, lvl AS height FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, place, subroot AS node, count(*) OVER () AS n FROM s
  UNION ALL SELECT lvl + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), any_value((n + 1) // 2) FROM u WHERE n > 1 GROUP BY lvl, place // 2),
w AS (SELECT l.doc_id, t.lvl, l.place >> t.lvl AS spot, x.node FROM l JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.n > 1 AND t.place = l.place >> t.lvl
    LEFT JOIN t x ON x.lang IS NOT DISTINCT FROM l.lang AND x.lvl = t.lvl AND x.place = xor(l.place >> t.lvl, 1)
  UNION ALL SELECT l.doc_id, s.height + u.lvl, s.place >> u.lvl, x.node FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN u ON u.n > 1 AND u.place = s.place >> u.lvl
    LEFT JOIN u x ON x.lvl = u.lvl AND x.place = xor(s.place >> u.lvl, 1)),
p AS (SELECT doc_id, list(coalesce(node, '') ORDER BY lvl) AS nodes, list(spot % 2 ORDER BY lvl) AS sides FROM w GROUP BY doc_id),
f AS (SELECT l.doc_id, 1 AS k, claimed AS node FROM l
  UNION ALL SELECT f.doc_id, k + 1, sha256(CASE WHEN sides[k] = 1 THEN nodes[k] || node ELSE node || nodes[k] END) FROM f JOIN p ON p.doc_id = f.doc_id WHERE k <= len(nodes))
SELECT l.doc_id, leaf, subroot, (SELECT node FROM u WHERE n = 1) AS root, sha256(array_to_string(coalesce(nodes, []), '')) AS proof_sha256, f.node AS folded_root, f.node = (SELECT node FROM u WHERE n = 1) AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN p ON p.doc_id = l.doc_id JOIN f ON f.doc_id = l.doc_id AND f.k = coalesce(len(nodes), 0) + 1
"""
