"""Ranked lexical search for many items at once, with what items share computed once.

Terms that occur in the same items form one shared term set, a node of a sharing graph. Pairs
of nodes that several items hold become nodes of their own, level by level, so an item is a
sum of few nodes. Of a document each set's partial score is accumulated once, the graph adds
these up in its order, and each item reads its sum from the nodes that it ends in. The items are
the stated query set, met in blocks of bounded size; documents are never paired with one another.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, lean_batches, release_memory, table

#: Items and bytes of item texts of a block of the query set; cells of a document by node table in a task.
ITEMS, ITEM_BYTES, CELLS = 1024, 8 << 20, 1 << 21
#: Bytes to what separates terms (a space) or to their lower case; others stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class Sharing:
    """The sharing graph of a block of items. ``numbers``: of each term. Term k adds to the nodes
    ``nodes[starts[k] : starts[k + 1]]``, each as often as ``times`` says. Node ``sets + i`` is the
    sum of the two nodes ``sums[i]``; item i is the sum of the nodes ``ends[i]``."""

    numbers: dict[bytes, int]
    starts: np.ndarray
    nodes: np.ndarray
    times: np.ndarray
    sets: int
    sums: list[tuple[int, int]]
    ends: list[list[int]]


def sharing(items: list[list[bytes]]) -> Sharing:
    """The sharing graph of items, given as lists of terms; the k-th repeat of a term counts as a term of its own."""
    holders: dict[tuple[bytes, int], list[int]] = {}
    for i, own in enumerate(items):
        for term, n in sorted(Counter(own).items()):
            for k in range(n):
                holders.setdefault((term, k), []).append(i)
    sets: dict[tuple[int, ...], int] = {}
    of_term: dict[bytes, Counter] = {}
    for (term, _), held in holders.items():
        of_term.setdefault(term, Counter())[sets.setdefault(tuple(held), len(sets))] += 1
    ends: list[list[int]] = [[] for _ in items]
    for held, node in sorted(sets.items(), key=lambda x: (-len(x[0]), x[1])):
        for i in held:
            ends[i].append(node)
    sums: list[tuple[int, int]] = []
    while True:
        pairs = Counter(p for own in ends for p in zip(own, own[1:], strict=False))
        named = {p: len(sets) + len(sums) + i for i, (p, _) in enumerate(sorted((x for x in pairs.items() if x[1] > 1), key=lambda x: (-x[1], x[0])))}
        if not named:
            break
        used: dict[int, int] = {}
        found: list[tuple[int, int]] = []
        for i, own in enumerate(ends):
            out, at = [], 0
            while at < len(own):
                pair = tuple(own[at : at + 2])
                following = tuple(own[at + 1 : at + 3])
                if pair in named and named.get(following, math.inf) > named[pair]:  # the more frequent of two that overlap
                    if named[pair] not in used:
                        used[named[pair]] = len(sets) + len(sums) + len(found)
                        found.append(pair)
                    out.append(used[named[pair]])
                    at += 2
                else:
                    out.append(own[at])
                    at += 1
            ends[i] = out
        sums += found
    numbers = {t: k for k, t in enumerate(of_term)}
    rows = [x for t in of_term for x in of_term[t].items()]
    starts = np.cumsum([0, *(len(x) for x in of_term.values())])
    return Sharing(numbers, starts, np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], np.int64), len(sets), sums, ends)


def counted(documents: DataFrame, plan: Sharing) -> DataFrame:
    """(doc_id, n, term, tf): each document's number of terms, and the items' terms in it with their counts."""
    numbers = plan.numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, starts, which, often = [], [0], [], []
            for text in batch["text"]:
                own = terms(text.as_py())
                n.append(len(own))
                for t, k in Counter(own).items():
                    if t in numbers:
                        which.append(numbers[t])
                        often.append(k)
                starts.append(len(which))
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, kind)) for x, kind in ((which, pa.int32()), (often, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])
        release_memory()

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(count, "doc_id long, n long, term array<int>, tf array<long>")


def _scored(rows: DataFrame, plan: Sharing, weights: np.ndarray, documents: int, words: int, top: int) -> DataFrame:
    """(item, doc_id, score): the ``top`` best documents of each item in each task."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in plan.ends]
        width = plan.sets + len(plan.sums)
        for whole in batches:
            for lo in range(0, whole.num_rows, max(1, CELLS // max(width, 1))):
                batch = whole.slice(lo, max(1, CELLS // max(width, 1)))
                ids = batch["doc_id"]
                missing, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                m = np.array([75 + 25 * n * documents // words for n in batch["n"].to_pylist()], np.int64)
                lengths = batch["term"].value_lengths().to_numpy()
                row, term, tf = np.repeat(np.arange(len(doc)), lengths), batch["term"].flatten().to_numpy(), batch["tf"].flatten().to_numpy()
                part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
                wide = plan.starts[term + 1] - plan.starts[term]
                at = np.repeat(plan.starts[term] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
                nodes = np.zeros((width, len(doc)), np.int64)
                np.add.at(nodes, (plan.nodes[at], np.repeat(row, wide)), np.repeat(part, wide) * plan.times[at])
                for k, (a, b) in enumerate(plan.sums):
                    nodes[plan.sets + k] = nodes[a] + nodes[b]
                for i, ends in enumerate(plan.ends):
                    if not ends:
                        continue
                    s, none, d = best[i]
                    own = nodes[ends].sum(0)
                    hit = np.flatnonzero(own >= (s[-1] if len(s) == top else 1))
                    if len(hit):
                        s, none, d = np.concatenate((s, own[hit])), np.concatenate((none, missing[hit])), np.concatenate((d, doc[hit]))
                        order = np.lexsort((d, none, -s))[:top]
                        best[i] = s[order], none[order], d[order]
        found = [(i, *x) for i, (s, none, d) in enumerate(best) for x in zip(s.tolist(), none.tolist(), d.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([None if x[2] else x[3] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["item", "doc_id", "score"])
        release_memory()

    return rows.mapInArrow(score, "item int, doc_id long, score long")


def _best(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(documents: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0, ties by doc_id, null ids last.

    ``documents``: doc_id, text; ``items``: item_id, text. Null and empty texts have no term: such an
    item finds nothing, such a document is in no statistic and never found. Long texts count in
    whole, repeated rows of documents are separate documents. An item_id that is repeated counts
    once, with its smallest text; a null one is an item of its own. Other columns are not read;
    with no item or no document the result is empty. The items come to the driver a block at a
    time, where their sharing graph is made; all else stays on the executors, and what is sent
    to them is bounded by the block.
    """
    spark = documents.sparkSession
    lean_batches(spark)
    asked = items.groupBy("item_id").agg(F.min("text").alias("text")).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    in_turn = Window.orderBy(F.col("item_id").asc_nulls_first())  # over the stated items
    asked = asked.withColumn("block", F.greatest(F.floor(F.row_number().over(in_turn) / ITEMS), F.floor(F.sum("bytes").over(in_turn) / ITEM_BYTES)))
    asked = checkpointed(asked)
    found = None
    for (block,) in asked.select("block").distinct().orderBy("block").collect():
        block_items = asked.where(F.col("block") == block).select("item_id", F.col("text").cast("binary")).collect()
        plan = sharing([terms(r[1]) for r in block_items])
        rows = checkpointed(counted(documents, plan))
        total = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).head()
        weights = np.zeros(len(plan.numbers) + 1, np.int64)
        for term, df in rows.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # at most the block's terms
            weights[term] = math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df + 1)))
        best = _scored(rows.where(F.size("term") > 0), plan, weights, total[0], total[1] or 1, top)
        shares = best.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        best = _best(_best(shares, ["item", "share"], top).drop("rank"), ["item"], top)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(block_items)], f"item int, item_id {dict(items.dtypes)['item_id']}")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most ITEMS rows
        found = best if found is None else found.union(best)
    return found if found is not None else spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item; the cases are those of ``search``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
b AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
x AS (SELECT item_id, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score FROM b JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM k WHERE rank <= 20
"""
