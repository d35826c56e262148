"""Jaccard join of word-shingle sets by signature trees, exact but for collisions of 64-bit hashes.

1. Texts of equal sets form a class, which one row stands for. In the order of their hashes the
   first ``head`` shingles of two sets that link have more in common than ``in_common`` tells, so
   a set none of whose head is found elsewhere that often links with nothing. Of the rest's heads
   the rarest shingles, all but the last ``in_common - 1``, are keys: sets that link share one.
2. Sets joined by keys, directly or by way of others, are a forest of their own; nothing links
   across forests. Most forests are two or three sets. Others, which a passage that many texts
   hold would make grow with the table, are parted anew by keys of their whole sets. Most forests
   that are left are a few sets, which one leaf holds.
3. A larger forest is cut into leaves of bounded size, over which nodes with OR-combined bitmaps, size
   ranges and label ranges rise, FAN to one. First each leaf is joined by itself, then the
   least sets of each label, and what is still apart is put in order of labels and descended
   from the roots, both sides at once: a pair of nodes goes on only if its bitmaps and sizes
   allow an overlap that links, and its labels differ. Leaf pairs that are left meet in one
   task, where the same bound is taken over groups of sets, then over sets.
A link counts once both full sets are compared. Sets already joined are not compared again, so
a group of near copies never gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.places import with_places
from ..sources.shared import Scratch, checkpointed
from .common import joined_small, lean_batches, release_memory, table
from .neardup import _by_cell
from .wordhash import mix, shingles

#: Sets of a leaf, and shingles of all of them; children of a node; sets of a group inside a task; longs of a bitmap.
LEAF, LEAF_SHINGLES, FAN, GROUP, LONGS = 256, 1 << 19, 16, 16, 16
#: Sets of a forest that is not parted anew: few enough pairs to meet as they are.
FEW = 3
_BITS = [f"b{i}" for i in range(LONGS)]


def head(n, percent: int):
    """How many shingles of a set of n, the smallest hashes, are looked at."""
    return np.minimum(n, n - -(-percent * n // 100) + 1 + (100 - percent) * n // 200)


def in_common(n: Column, percent: int) -> Column:
    """What the heads of a set of n and of any set that it links with have in common at least."""
    return F.floor((100 - percent) * F.ceil(percent * n / 100) / 200) + 1


def summarised(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, k1, k2, head): set size, two hashes of the whole set and its smallest shingle hashes, for every row."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingles(batch["text"].to_pylist(), words)
            keys = [[int(mix(s ^ np.uint64(seed)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for seed in (0x51ED270B, 0x2545F491)]
            heads = [s[: int(head(len(s), percent))].view(np.int64) for s in sets]
            starts = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([*heads, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), *[pa.array(k, pa.int64()) for k in keys], listed], ["doc_id", "n", "k1", "k2", "head"])
        release_memory()

    return documents.select("doc_id", "text").mapInArrow(summarise, "doc_id long, n long, k1 long, k2 long, head array<long>")


def forests(base: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(id, n, near, forest) of the classes that may link: ``forest`` is the smallest row number that keys lead to, ``near`` the one that shares most keys.

    ``base`` has row numbers ``ref``, ``classes`` one for each class. A key that very many sets share is
    counted before it is joined, and its sets meet the one with the smallest number, not one another.
    """
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62  # smaller sets link with none but equal ones
    rows = joined_small(base.where(F.col("n") >= least).select("ref", "n", "head"), classes.select("ref"), "ref", "left_semi").select("ref", "n", F.explode("head").alias("key"))
    shared = scratch.table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    met = rows.join(shared.hint("merge"), "key").groupBy("ref", "n").agg(F.collect_list(F.struct("df", "key")).alias("shared"))
    keys = met.where(F.size("shared") >= in_common(F.col("n"), percent)).withColumn("kept", (F.size("shared") - in_common(F.col("n"), percent) + 1).cast("int"))
    keyed = scratch.table(keys.select("ref", "n", F.transform(F.slice(F.array_sort("shared"), F.lit(1), F.col("kept")), lambda x: x["key"]).alias("keys")))
    grown, rows = _grown(keyed, scratch)
    return scratch.table(grown.join(classes.select("ref", "id", "n"), "ref").select("id", "n", "near", "forest"), rows)


def _grown(keyed: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(ref, near, forest) of the rows (ref, keys) that share a key with another ref, and how many rows there are at most."""
    rows, flat = keyed.count(), keyed.select("ref", F.explode("keys").alias("key"))
    hubs = scratch.table(flat.groupBy("key").agg(F.min("ref").alias("hub"), F.max("ref").alias("_last")).where("hub < _last").select("key", "hub"), rows)
    stars = scratch.table(flat.join(hubs.hint("merge"), "key").where("ref > hub").groupBy("ref", "hub").agg(F.count(F.lit(1)).alias("keys")), rows)
    found = components(stars.select(F.col("ref").alias("a"), F.col("hub").alias("b")))
    nearest = stars.groupBy("ref").agg(F.max_by("hub", F.struct("keys", -F.col("hub"))).alias("near"))
    return found.select(F.col("id").alias("ref"), F.col("label").alias("forest")).join(nearest, "ref", "left").withColumn("near", F.coalesce("near", "ref")), rows


def parted(documents: DataFrame, members: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Members (id, n, near, forest) whose forests of more than FEW sets are parted anew; those that link with nothing are left out.

    Two sets that link have ``percent`` of each in common, so of any one order of all shingles the first
    ones of both, as many as are beyond that part and one more, share a shingle. Rarest first,
    these leave out what a passage brings that many texts hold, as long as it is not most of them.
    Each shingle of these sets is one row, at any size of their forests.
    """
    rows = members.count()
    large = scratch.table(members.groupBy("forest").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > FEW).select("forest"), rows)
    if large.isEmpty():
        return members
    ids = scratch.table(joined_small(members, large, "forest", "left_semi").select("id").distinct(), rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingles(batch["text"].to_pylist(), words)]
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch["id"], listed], ["id", "set"])
        release_memory()

    texts = joined_small(documents.select(F.col("doc_id").alias("id"), "text").where(F.length("text") > 0), ids, "id", "left_semi")
    sets = scratch.table(texts.select("id", "text").mapInArrow(whole, "id long, set array<long>").withColumn("row", F.monotonically_increasing_id()))
    each = sets.select("row", F.col("id").alias("ref"), F.size("set").alias("n"), F.explode("set").alias("key"))
    shared = scratch.table(each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    met = each.join(shared.hint("merge"), "key").groupBy("row", "ref", "n").agg(F.collect_list(F.struct("df", "key")).alias("shared"))
    kept = (F.size("shared") - F.ceil(percent * F.col("n") / 100) + 1).cast("int")  # the others of the first ones are in no other set
    keys = F.transform(F.slice(F.array_sort("shared"), F.lit(1), F.col("kept")), lambda x: x["key"]).alias("keys")
    grown = _grown(scratch.table(met.withColumn("kept", kept).where("kept > 0").select("ref", keys)), scratch)[0].withColumnRenamed("ref", "id")
    again = joined_small(members, large, "forest", "left_semi").select("id", "n").join(grown, "id").select("id", "n", "near", F.xxhash64(F.lit("part"), "forest").alias("forest"))
    return scratch.table(joined_small(members, large, "forest", "left_anti").unionByName(again), rows)


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap of LONGS longs for each set."""
    out = np.zeros((len(sets), LONGS * 64), bool)
    for i, s in enumerate(sets):
        out[i, s >> np.uint64(64 - (LONGS * 64 - 1).bit_length())] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def _may_link(a: tuple, b: tuple, percent: int) -> np.ndarray:
    """Whether sets of node a may link with sets of node b. A node: bitmap, least and greatest size, and the most shingles that a set of it has beyond its bits.

    Two sets have at most as many shingles in common as bits, and those that fell on bits of others.
    """
    overlap = np.bitwise_count(a[0] & b[0]).sum(-1, dtype=np.int64) + np.minimum(a[3], b[3])
    most = np.minimum(np.minimum(a[2], b[2]), overlap)
    return ((100 + percent) * most >= percent * (a[1] + b[1])) & (100 * a[2] >= percent * b[1]) & (100 * b[2] >= percent * a[1])


def _links(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Links (a, b) that join all sets that link, labels given; the bitmaps, and what each set has beyond its bits."""
    n, bits = np.array([len(s) for s in sets]), _bitmaps(sets)
    over, found = n - np.bitwise_count(bits).sum(1, dtype=np.int64), []
    root = {x: x for x in labels.tolist()}

    def of(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    starts = np.arange(0, len(n), GROUP)
    groups = [f.reduceat(x, starts) for f, x in ((np.bitwise_or, bits), (np.minimum, n), (np.maximum, n), (np.maximum, over))]
    for g, lo in enumerate(starts.tolist()):
        own = slice(lo, lo + GROUP)
        for h in np.flatnonzero(_may_link(tuple(x[g] for x in groups), tuple(x[g:] for x in groups), percent)) + g:
            other = slice(starts[h], starts[h] + GROUP)
            a, b = ((bits[s], n[s], n[s], over[s]) for s in (own, other))
            near = _may_link(tuple(x[:, None] for x in a), b, percent) & (labels[own, None] != labels[other]) & (ids[own, None] != ids[other])
            for p, q in np.argwhere(near):
                p, q = p + lo, q + starts[h]
                x, y = of(int(labels[p])), of(int(labels[q]))
                if p >= q or x == y:
                    continue
                s, t = sets[p], sets[q]
                shared = np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s)
                if 100 * shared >= percent * (len(s) + len(t) - shared):
                    root[max(x, y)] = min(x, y)
                    found.append((int(ids[p]), int(ids[q])))
    return found, bits, over


def _in_one_leaf() -> Column:
    """Whether a leaf holds a forest of _m sets with _t shingles."""
    return (F.col("_m") <= LEAF) & (F.col("_t") <= LEAF_SHINGLES)


def _in_leaves(members: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Members (id, n, forest, label), a table, with ``tree`` (0 where a leaf holds the forest, else by doubling sizes) and ``leaf``."""
    rows, held = members.count(), members.groupBy("forest").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_t"))
    dealt = members.join(scratch.table(held, rows).hint("merge"), "forest").withColumn("tree", F.when(_in_one_leaf(), 0).otherwise(F.length(F.bin("n")))).drop("_m", "_t")
    placed = with_places(scratch.table(dealt, rows), ["forest", "tree"], order, "leaf")
    room = F.greatest(F.lit(1), F.least(F.lit(LEAF), F.floor(F.lit(LEAF_SHINGLES) / F.pow(F.lit(2), F.col("tree")))))
    return scratch.table(placed.withColumn("leaf", F.when(F.col("tree") == 0, 0).otherwise(F.floor(F.col("leaf") / room)).cast("long")), rows)


def _joined(documents: DataFrame, cells: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) found in each cell, and rows with its bitmap and ``beyond`` its bits (a, b null); ``cells``: id, label, cell."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            sets = shingles(rows["text"].to_pylist(), words)
            full = np.array([len(s) > 0 for s in sets])
            found, bits, over = _links(rows["id"].to_numpy()[full], rows["label"].to_numpy()[full], [s for s in sets if len(s)], percent)
            united = np.bitwise_or.reduce(bits, 0).view(np.int64).tolist()
            columns = [[x[k] for x in found] + [None] for k in (0, 1)] + [[None] * len(found) + [x] for x in (int(over.max()), *united)]
            return pa.RecordBatch.from_arrays([pa.array([rows["cell"][0].as_py()] * (len(found) + 1), pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], ["cell", "a", "b", "beyond", *_BITS])

        return _by_cell(batches, block)

    ids = scratch.table(cells)
    texts = joined_small(documents.select(F.col("doc_id").alias("id"), "text").where(F.length("text") > 0), ids, "id").select("cell", "id", "label", "text")
    return scratch.table(texts.repartition("cell").sortWithinPartitions("cell").mapInArrow(join, ", ".join(f"{c} long" for c in ("cell", "a", "b", "beyond", *_BITS))))


def _cell() -> Column:
    return F.xxhash64("forest", "tree", "leaf")


def _overlapping(a: str, b: str, percent: int) -> Column:
    """``_may_link`` of two node rows, and whether their labels leave something to join."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    common = sum((F.bit_count(x(c).bitwiseAND(y(c))) for c in _BITS), F.lit(0)) + F.least(x("beyond"), y("beyond"))
    most = F.least(x("hi"), y("hi"), common)
    apart = (x("first") != x("last")) | (y("first") != y("last")) | (x("first") != y("first"))
    return ((100 + percent) * most >= percent * (x("lo") + y("lo"))) & (100 * x("hi") >= percent * y("lo")) & (100 * y("hi") >= percent * x("lo")) & apart


def descended(leaves: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (cell, other) of leaves, each with itself among them, that a descent from all pairs of roots of a forest leaves.

    ``leaves``: forest, tree, leaf, lo, hi (sizes), first, last (labels), beyond, bitmap. Nodes pass
    through one level at a time; only how many levels there are comes to the driver.
    """
    levels, most = [leaves.withColumn("node", F.col("leaf"))], leaves.agg(F.max("leaf")).head()[0] or 0
    while most > 0:
        up = levels[-1].withColumn("node", F.floor(F.col("node") / FAN)).groupBy("forest", "tree", "node")
        levels.append(scratch.table(up.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("beyond").alias("beyond"), *[F.bit_or(c).alias(c) for c in _BITS])))
        most //= FAN
    value = lambda side: F.struct("lo", "hi", "first", "last", "beyond", *_BITS).alias(side)
    side = lambda df, s, up: df.select("forest", F.col("tree").alias(f"t{s}"), F.col("node").alias(f"n{s}"), *([F.floor(F.col("node") / FAN).alias(f"u{s}")] if up else []), value(s))
    ordered = (F.col("tx") < F.col("ty")) | ((F.col("tx") == F.col("ty")) & (F.col("nx") <= F.col("ny")))
    near = F.abs(F.col("tx") - F.col("ty")) <= 1  # sizes that differ by more than double do not link: percent is 50 or more
    top = levels[-1]  # one node for each tree, and a forest has at most 64 of these
    pairs = side(top, "x", False).join(side(top, "y", False), "forest").where(ordered & near & _overlapping("x", "y", percent))
    for level in levels[-2::-1]:
        pairs = scratch.table(pairs.select("forest", "tx", F.col("nx").alias("ux"), "ty", F.col("ny").alias("uy")))
        x = pairs.join(side(level, "x", True), ["forest", "tx", "ux"])
        pairs = x.join(side(level, "y", True), ["forest", "ty", "uy"]).where(ordered & _overlapping("x", "y", percent))
    return pairs.select(*[F.xxhash64("forest", f"t{s}", f"n{s}").alias(c) for s, c in (("x", "cell"), ("y", "other"))])


def _labelled(members: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    found = components(links)
    return scratch.table(members.drop("label").join(found, "id", "left").withColumn("label", F.coalesce("label", "id")), members.count())


def _of_leaves(members: DataFrame) -> DataFrame:
    """Size and label range of each leaf."""
    return members.groupBy("forest", "tree", "leaf").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("first"), F.max("label").alias("last"))


def _unsettled(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (id, n, label, forest) of forests with several labels, of which some leaf pairs have not met."""
    rows = members.count()
    wide = scratch.table(members.groupBy("forest").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.max("tree").alias("_tree")).where("_lo <> _hi AND _tree > 0").select("forest"), rows)
    return scratch.table(joined_small(members.select("id", "n", "label", "forest"), wide, "forest", "left_semi"), rows)


def links(documents: DataFrame, base: DataFrame, classes: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between classes, enough to join all that link directly or by way of others."""
    edge = lambda df: df.where("a IS NOT NULL").select("a", "b")
    all_members = parted(documents, forests(base, classes, percent, scratch), words, percent, scratch).withColumn("label", F.col("id"))
    leaves = _in_leaves(all_members, ["near", "id"], scratch)
    found = edge(_joined(documents, leaves.select("id", "label", _cell().alias("cell")), words, percent, scratch))
    members = _unsettled(_labelled(leaves, found, scratch), scratch)
    if members.isEmpty():
        return found

    least = members.groupBy("forest", "label").agg(F.min_by(F.struct("id", "n"), "id").alias("_m")).select("_m.id", "_m.n", "label", "forest")
    heads = _in_leaves(scratch.table(least, members.count()), ["n", "id"], scratch)
    found = scratch.table(found.union(edge(_joined(documents, heads.select("id", "label", _cell().alias("cell")), words, percent, scratch))))
    members = _labelled(members, found, scratch)

    leaves = _in_leaves(members, ["label", "id"], scratch)
    seen = _joined(documents, leaves.select("id", "label", _cell().alias("cell")), words, percent, scratch)
    found = scratch.table(found.union(edge(seen)))
    leaves = _labelled(leaves, found, scratch)
    nodes = _of_leaves(leaves).withColumn("cell", _cell()).join(seen.where("a IS NULL").select("cell", "beyond", *_BITS), "cell").drop("cell")
    pairs = scratch.table(descended(scratch.table(nodes, leaves.count() // 8), percent, scratch).where("cell <> other"))
    both = leaves.withColumn("_leaf", _cell()).select("id", "label", "_leaf")
    met = pairs.withColumn("_leaf", F.explode(F.array("cell", "other"))).withColumn("cell", F.xxhash64("cell", "other")).select("cell", "_leaf")
    return found.union(edge(_joined(documents, both.join(met, "_leaf").select("id", "label", "cell"), words, percent, scratch)))


def jaccard_join(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``documents`` (doc_id, text); ``percent`` is from 50 to 99.

    Texts without words (null, empty, blank) have an empty set and link with nothing. Equal sets
    link, however many rows share one. Rows that repeat a doc_id are one document's and link.
    A row without doc_id takes no part and has a null component. Very long texts count in
    whole, other columns are not read, an empty table gives an empty one.
    """
    spark = documents.sparkSession
    lean_batches(spark)
    with Scratch(spark) as scratch:
        base = scratch.table(summarised(documents, words, percent).withColumn("ref", F.monotonically_increasing_id()))
        rows = base.count()
        known = base.where("n > 0 AND doc_id IS NOT NULL")
        classes = known.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "ref")).alias("m")).select("k1", "k2", "n", F.col("m.doc_id").alias("id"), "m.ref")
        classes = scratch.table(classes, rows)
        repeated = known.groupBy("doc_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("doc_id")
        same = joined_small(known.select("doc_id", "k1", "k2", "n"), scratch.table(repeated), "doc_id").join(classes, ["k1", "k2", "n"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
        labels = components(links(documents, base, classes, words, percent, scratch).union(same))
        named = scratch.table(classes.join(labels, "id", "left").select("k1", "k2", "n", F.coalesce("label", "id").alias("_component")), rows)
        out = base.select("doc_id", "n", "k1", "k2").join(named.hint("merge"), ["k1", "k2", "n"], "left")
        component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
        return checkpointed(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles at 80 %; the cases are those of ``jaccard_join``."""
    return jaccard_join(table(spark, sf_dir, "documents"), 5, 80)


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS sh FROM d, LATERAL unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
"""
