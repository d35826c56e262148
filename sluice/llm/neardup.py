"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Every text gives its set of word shingles, 256 minima of it, 32 band keys of four of
   the minima each, and a signature of the two low bits of each minimum, packed in longs.
   Documents with equal sets form one class, which its smallest doc_id stands for.
2. Classes that share a band key are candidates. In each bucket every class is held against
   one hub, the member that shares buckets most; each class keeps the hub of the highest
   estimate. The estimate counts equal bit pairs and corrects for chance collisions.
3. Links found so far join classes; only buckets whose members are not yet in one component
   are looked at again, in blocks of bounded size and in the first band that a pair shares.
   A first pass over signatures alone finds the members that come near one of another
   component. To these the sets are dealt, every such pair is held against its sets, and
   a block gives no more links than join its components, so no link is lost to a hub and
   no group gives all its pairs.
Links count only after 100 * intersection >= 80 * union on the full sets. A pair at 0.8
shares no band with probability (1 - 0.8^4)^32 = 5e-8; its estimate is MARGIN, or 4.5
standard errors, too low with probability 3e-6.
"""


from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import checkpointed, joined_small, lean_batches, release_memory, table
from .fingerprint import shingle_hashes
from .wordhash import mix, shingles

BANDS, ROWS, BITS, HASHES = 32, 4, 2, 256
#: Longs of a signature, and how far below the limit an estimate may lie.
LONGS, MARGIN = HASHES * BITS // 64, 0.134
SIGNATURE = [f"s{i}" for i in range(LONGS)]
#: Members of a block that are compared with one another at once.
BLOCK = 1024
_EVEN = 0x5555555555555555


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set keys (n, 2), band keys (n, BANDS) and signatures (n, LONGS) of non-empty sets."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)
    h = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    keys = np.stack([np.add.reduceat(mix(h ^ np.uint64(seed)), starts) for seed in (0x1234567, 0x89ABCDEF)], 1)
    minima = np.empty((len(sets), HASHES), np.uint64)
    for i in range(0, len(sets), 64):  # small enough to stay in the cache
        lo, hi = starts[i], starts[i + 64] if i + 64 < len(sets) else len(h)
        part, at = h[lo:hi], starts[i : i + 64] - lo
        for k in range(HASHES):
            minima[i : i + 64, k] = np.minimum.reduceat(part * a[k] + b[k], at)
    minima = mix(minima)
    bands = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(sets), 1), np.uint64)
    for r in range(ROWS):
        bands = mix(bands * np.uint64(0xD6E8FEB86659FD93) + minima[:, r : BANDS * ROWS : ROWS])
    low = (minima & np.uint64(2**BITS - 1)).reshape(len(sets), LONGS, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(BITS))
    return keys, bands, np.bitwise_or.reduce(low, 2)


def signed(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, k1, k2, bands, s0, s1, ...) of every row; the empty set has n = 0 and zeros."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = shingles(part["text"].to_pylist(), words)
                full = np.array([len(s) > 0 for s in sets])
                columns: list[np.ndarray] = [np.zeros(len(sets), np.int64) for _ in range(2 + LONGS)]
                bands = np.zeros((len(sets), BANDS), np.int64)
                if full.any():
                    keys, own, signature = _signatures([s for s in sets if len(s)])
                    bands[full] = own.view(np.int64)
                    for column, values in zip(columns, [*keys.T, *signature.T], strict=True):
                        column[full] = np.ascontiguousarray(values).view(np.int64)
                listed = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, columns[:2]), listed, *map(pa.array, columns[2:])], ["doc_id", "n", "k1", "k2", "bands", *SIGNATURE])
        release_memory()

    lean_batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, k1 long, k2 long, bands array<long>, " + ", ".join(f"{c} long" for c in SIGNATURE))


def estimate(a: str, b: str) -> Column:
    """Similarity from the signatures of two sides: equal bit pairs, less those by chance."""
    unequal = F.lit(0)
    for c in SIGNATURE:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_EVEN)))
    chance = 2.0**-BITS
    return ((1 - unequal / HASHES) - chance) / (1 - chance)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet 100 * intersection >= percent * union."""
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    y = x.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    sized = y.withColumn("i", F.size(F.array_intersect("x", "y"))).withColumn("u", F.size("x") + F.size("y") - F.col("i"))
    return sized.where(100 * F.col("i") >= percent * F.col("u")).select("a", "b")


def _by_cell(batches: Iterator[pa.RecordBatch], block: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply ``block`` to the rows of each cell; rows come sorted by cell, which may go on in the next batch."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        key = rows["cell"].to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[0]["cell"][0].as_py() != key[lo]:
                yield block(pa.concat_tables(held))
                held = []
            held.append(rows.slice(lo, hi - lo))
    if held:
        yield block(pa.concat_tables(held))
    release_memory()


_MEMBER = ["cell", "bucket", "part", "id", "label", "n", "bands", *SIGNATURE]


def _near(rows: pa.Table, least: float, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (p, q) of the pairs of a cell with different labels and near signatures, in this their first common bucket."""
    own = {k: rows[k].to_numpy() for k in ("bucket", "part", "id", "label", "n", *SIGNATURE)}
    bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    most = int((1 - (least * (1 - 2.0**-BITS) + 2.0**-BITS)) * HASHES)
    apart = own["part"].min() != own["part"].max()  # pairs of one part have a cell of their own
    for i in range(0, len(own["id"]) if own["label"].min() != own["label"].max() else 0, 128):
        left = {k: own[k][i : i + 128, None] for k in ("id", "label", "n", "part")}
        near = (left["id"] < own["id"]) & (left["label"] != own["label"]) & (100 * np.minimum(left["n"], own["n"]) >= percent * np.maximum(left["n"], own["n"]))
        if apart:
            near &= left["part"] != own["part"]
        p, q = np.nonzero(near)
        p += i
        unequal = np.zeros(len(p), np.int32)
        for k in SIGNATURE:
            x = (own[k][p] ^ own[k][q]).view(np.uint64)
            unequal += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(_EVEN))
        p, q = p[unequal <= most], q[unequal <= most]
        for k in range(0, len(p), 4096):
            a, b = p[k : k + 4096], q[k : k + 4096]
            first = bands[a, (bands[a] == bands[b]).argmax(1)] == own["bucket"][a]
            yield a[first], b[first]


def _rest(members: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket with different labels, enough to join all that are linked.

    ``members``: bucket, id, label, n, bands and the signature. A bucket of m members is cut
    into m / BLOCK parts by a hash, and each pair of parts is a cell of at most about 2 * BLOCK rows.
    """
    parts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    parts = parts.where(F.col("lo") != F.col("hi")).select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    cells = members.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.withColumn("cell", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))).select(_MEMBER)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            hit = np.zeros(rows.num_rows, bool)
            for p, q in _near(rows, least, percent):
                hit[p] = hit[q] = True
            return pa.RecordBatch.from_arrays([x.combine_chunks() for x in rows.filter(pa.array(hit)).columns], rows.schema.names)

        return _by_cell(batches, block)

    kinds = {"part": "int", "bands": "array<long>"}
    dealt = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(screen, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in _MEMBER))
    near = checkpointed(dealt)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            ids, labels, found = rows["id"].to_numpy(), rows["label"].to_numpy(), []
            own = [np.sort(x.values.to_numpy()) for x in rows["set"]]
            root = {x: x for x in labels.tolist()}

            def of(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for p, q in _near(rows, least, percent):
                for a, b in zip(p.tolist(), q.tolist(), strict=True):
                    x, y = of(labels[a].item()), of(labels[b].item())
                    if x == y:
                        continue
                    s, t = own[a], own[b]
                    shared = np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s)
                    if 100 * shared >= percent * (len(s) + len(t) - shared):
                        root[max(x, y)] = min(x, y)
                        found.append((ids[a], ids[b]))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        return _by_cell(batches, block)

    with_sets = near.join(sets, "id").select(*_MEMBER, "set").repartition("cell").sortWithinPartitions("cell")
    return with_sets.mapInArrow(link, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents`` (doc_id, text).

    Texts without words (null, empty, blank) have an empty set, link with nothing and are kept.
    Rows of equal sets share a component. A doc_id is taken to name one document: rows that
    repeat it are links of it. A row without doc_id takes no part: its component is null and
    it is kept. Very long texts count in whole; other columns are not read; an empty table
    gives an empty one.
    """
    base = checkpointed(signed(documents, words))
    classes = checkpointed(base.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id")))
    chosen = base.join(classes, ["k1", "k2", "n"]).where(F.col("doc_id") == F.col("id")).dropDuplicates(["id", "k1"])
    keyed = chosen.select("id", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = checkpointed(keyed.join(shared, "bucket"))
    met = checkpointed(buckets.groupBy("id").agg(F.sum("m").alias("popular")))
    members = checkpointed(joined_small(chosen.select("id", "n", "bands", *SIGNATURE), met, "id"))
    text = documents.select(F.col("doc_id").alias("id"), "text")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = checkpointed(joined_small(text, met.select("id"), "id", "left_semi").select("id", F.array_distinct(shingle_hashes(lower, words)).alias("set")))

    hubs = buckets.join(met, "id").groupBy("bucket").agg(F.max(F.struct("popular", -F.col("id"))).alias("h")).select("bucket", (-F.col("h.col2")).alias("hub"))
    stars = buckets.join(hubs, "bucket").where(F.col("id") != F.col("hub")).select("id", "hub").distinct()
    short, least = F.struct("n", *SIGNATURE), percent / 100 - MARGIN
    near = stars.join(members.select("id", short.alias("x")), "id").join(members.select(F.col("id").alias("hub"), short.alias("y")), "hub")
    near = near.withColumn("e", estimate("x", "y")).where((F.col("e") >= least) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")))
    best = near.groupBy("id").agg(F.max_by("hub", F.struct("e", "hub")).alias("hub"))
    links = checkpointed(confirmed(best.select(F.col("id").alias("a"), F.col("hub").alias("b")), sets, percent))
    labels = components(links)

    labelled = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    more = checkpointed(_rest(buckets.select("bucket", "id").join(labelled, "id"), sets, least, percent))
    labels = components(links.union(more))

    named = classes.join(labels, "id", "left").select("k1", "k2", "n", F.coalesce("label", "id").alias("_component"))
    out = base.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles at 80 %; the cases are those of ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each group of near duplicates, that of the smallest doc_id.

    All columns stay. Of rows that repeat a kept doc_id one stays; rows without doc_id stay.
    """
    found = checkpointed(near_duplicates(documents, words, percent))
    kept = found.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    twice = checkpointed(kept.where("rows > 1").select("doc_id"))
    gone = checkpointed(found.where(~F.col("kept")).select("doc_id").union(twice).distinct())
    once = joined_small(documents, gone, "doc_id", "left_anti")
    return once.unionByName(joined_small(documents, twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])) if twice.count() else once


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS sh
      FROM d, LATERAL unnest(range(1, greatest(len(w) - 2, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
"""
