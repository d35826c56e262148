"""Exact top-k inner products by pivot-table elimination.

Distances from every vector to many pivots are computed once and kept in a table beside it.
They bound the distance of a query and a candidate from below by the largest
|d(q, p) - d(x, p)|; with the norms that bounds their inner product from above. Candidates are
evaluated in the order of that bound, in growing batches, until the next bound cannot reach
the k-th best score. Queries and candidates meet in a grid of blocks; each cell gives its own
k + 1 best, and a rank over those is the answer.

Scores are exact: products of whole numbers go through doubles only where no sum can pass
2**53, and through Python's integers, without bounds, elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Rows of a candidate block and of a query block, pivots, vectors among which they are picked.
CANDIDATES, QUERIES, PIVOTS, PIVOT_SAMPLE = 8192, 2048, 48, 2000
_LONG = 2**63 - 1


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): vectors as floor(scale * x), whole numbers held exactly in doubles.

    Null ids and vectors, and vectors that hold null or non-finite components, take no part; an
    empty vector scores 0 with its like. A product scale * x that is no longer finite keeps the largest double.
    """
    x = F.col(embedding)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    top = F.lit(float(np.finfo(float).max))
    scaled = lambda c: F.greatest(-top, F.least(top, scale * c.cast("double")))
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  # larger doubles are whole
    return vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: whole(scaled(c))).alias("v"))


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors of the sample that lie far from one another."""
    picked = [int(np.square(sample - sample.mean(0)).sum(1).argmax())]
    far = np.square(sample - sample[picked[0]]).sum(1)
    while len(picked) < min(count, len(sample)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, np.square(sample - sample[picked[-1]]).sum(1))
    return sample[picked]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = np.square(x).sum(1)[:, None] + np.square(pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def safe_limit(dim: int) -> float:
    """Vectors whose components stay below this have inner products below 2**53 at every step."""
    return float(np.floor(np.sqrt(2.0**53 / max(dim, 1))))


def best_in_block(q: np.ndarray, table_q: np.ndarray, x: np.ndarray, table_x: np.ndarray, norms: np.ndarray, ids: np.ndarray, k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, evaluated): the k best rows of a block for one query, ties to smaller ids. All components are below ``safe_limit``."""
    low = np.zeros(len(x))
    for p in range(table_x.shape[1]):
        np.maximum(low, np.abs(table_x[:, p] - table_q[p]), out=low)
    own = float(q @ q)
    low = np.maximum(low * (1 - 1e-9) - 1e-3 - 1e-7 * np.sqrt(own + norms), 0)  # eased by more than its rounding
    bound = (own + norms - np.square(low)) / 2 + 1e-6 * (own + norms) + 1
    rows, scores, seen, size, left = np.zeros(0, np.int64), np.zeros(0), 0, step, np.arange(len(x))
    while len(left):
        if len(left) > size:
            part = np.argpartition(-bound[left], size - 1)
            now, left = left[part[:size]], left[part[size:]]
        else:
            now, left = left, left[:0]
        seen += len(now)
        rows, scores = np.concatenate((rows, now)), np.concatenate((scores, x[now] @ q))
        order = np.lexsort((ids[rows], -scores))[:k]
        rows, scores = rows[order], scores[order]
        if len(scores) == k and len(left):
            left = left[bound[left] >= scores[-1]]
        size *= 2
    return rows, scores, seen


def exact_scores(q: np.ndarray, x: np.ndarray) -> list[int]:
    own = [int(c) for c in q]
    return [sum(a * int(c) for a, c in zip(own, row, strict=True)) for row in x]


def best_of(queries: dict[str, np.ndarray], block: dict[str, np.ndarray], k: int) -> Iterator[tuple[int, list[tuple[int, int]], int]]:
    """For each query of a cell: (its place, its k best (row, score), how many rows were evaluated)."""
    x, ids = block["v"], block["vec_id"]
    limit = safe_limit(x.shape[1])
    small = np.flatnonzero(np.abs(x).max(1, initial=0) <= limit)
    large = np.setdiff1d(np.arange(len(x)), small)
    safe = {c: block[c][small] for c in ("v", "table", "norm", "vec_id")}
    for i, q in enumerate(queries["v"]):
        fits = np.abs(q).max(initial=0) <= limit
        found: list[tuple[int, int]] = []
        rest, seen = (large if fits else np.arange(len(x))), 0
        if fits and len(small):
            rows, scores, seen = best_in_block(q, queries["table"][i], safe["v"], safe["table"], safe["norm"], safe["vec_id"], k)
            found = [(int(small[r]), int(s)) for r, s in zip(rows, scores, strict=True)]
        found += zip(rest.tolist(), exact_scores(q, x[rest]), strict=True)
        yield i, sorted(found, key=lambda f: (-f[1], ids[f[0]]))[:k], seen + len(rest)


def with_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add ``norm`` (squared) and ``table``, the distances to the pivots of the vector's length (to the origin where there are none)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, tables = np.zeros(batch.num_rows), [[]] * batch.num_rows
            dims = batch["dim"].to_numpy()
            flat, ends = batch["v"].flatten().to_numpy(), np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = flat[(ends[own] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(own), 0))
                with np.errstate(all="ignore"):  # rows beyond the safe limit do not use their bounds
                    norm[own] = np.square(x).sum(1)
                    for i, row in zip(own.tolist(), distances(x, pivots.get(dim, np.zeros((1, dim)))), strict=True):
                        tables[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm), pa.array(tables, pa.list_(pa.float64()))], [*batch.schema.names, "norm", "table"])

    return vectors.mapInArrow(add, "vec_id long, v array<double>, copies long, dim int, row long, norm double, table array<double>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, work: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of every query row.

    ``vectors`` has vec_id and v (whole numbers; see ``whole_numbers``), ``is_query`` is a
    condition on vec_id. Vectors of different lengths are not compared; very long ones are
    whole rows. A query row leaves out itself alone: a row that repeats its id or vector is a
    candidate. Repeated rows are evaluated once and ranked as often as they occur, so no block
    grows with them. Ties go to the smaller vec_id; fewer than k candidates give fewer rows; an
    empty table gives none; other columns are not read. A score beyond a long is given as the
    nearest long. With ``work``: query_id, evaluated, candidates instead, how many rows were
    evaluated for each distinct query row out of how many.
    """
    spark = vectors.sparkSession
    one = vectors.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies")).withColumns({"dim": F.size("v"), "row": F.xxhash64("vec_id", "v")})
    one = checkpointed(one)
    n, n_queries = one.count(), one.where(is_query).count()
    blocks, supers = 1 + n // CANDIDATES, 1 + n_queries // QUERIES
    # at most PIVOT_SAMPLE vectors come to the driver; huge ones make no pivots
    sample = [r for r in one.orderBy("row", "vec_id").limit(PIVOT_SAMPLE).select("dim", "v").collect() if max(map(abs, r["v"]), default=0) <= safe_limit(r["dim"])]
    pivots = {dim: pick_pivots(np.array([r["v"] for r in sample if r["dim"] == dim], float), PIVOTS) for dim in {r["dim"] for r in sample} - {0}}
    rows = checkpointed(with_table(one, pivots))

    def cell(key: tuple[pa.Scalar, ...], q: pa.Table, x: pa.Table) -> pa.Table:
        dim, out = key[0].as_py(), []

        def arrays(t: pa.Table) -> dict[str, np.ndarray]:
            t = t.rename_columns([c.removeprefix("q_") for c in t.column_names])
            flat = lambda c: t[c].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) if t.num_rows and dim else np.zeros((t.num_rows, dim and 1))
            return {"v": flat("v"), "table": flat("table"), **{c: t[c].to_numpy() for c in ("norm", "vec_id", "row", "copies")}}

        if q.num_rows and x.num_rows:
            a, b = arrays(q), arrays(x)
            for i, found, seen in best_of(a, b, k + 1):
                head = (int(a["row"][i]), int(a["vec_id"][i]))
                for r, score in found:
                    same = bool(b["vec_id"][r] == a["vec_id"][i] and (b["v"][r] == a["v"][i]).all())
                    out.append((*head, int(b["vec_id"][r]), max(-_LONG - 1, min(_LONG, score)), same, int(b["copies"][r]), 0, 0))
                out.append((*head, None, None, False, 0, seen, x.num_rows))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        return pa.table([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=["query_row", "query_id", "vec_id", "score", "same", "copies", "evaluated", "candidates"])

    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    wanted = ("dim", "s", "b", "vec_id", "row", "copies", "v", "norm", "table")
    dealt_q = rows.where(is_query).withColumn("s", F.pmod("row", F.lit(supers))).withColumn("b", each(blocks)).select(*[F.col(c).alias(f"q_{c}") for c in wanted])  # names of its own: both sides are one table
    dealt_x = rows.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("s", each(supers)).select(*wanted)
    cells = dealt_q.groupBy("q_dim", "q_s", "q_b").cogroup(dealt_x.groupBy("dim", "s", "b")).applyInArrow(cell, "query_row long, query_id long, vec_id long, score long, same boolean, copies long, evaluated long, candidates long")
    if work:
        return cells.groupBy("query_id", "query_row").agg(F.sum("evaluated").alias("evaluated"), F.sum("candidates").alias("candidates")).drop("query_row")
    # of the rows that equal the query's own, that one itself is left out
    others = cells.where("vec_id IS NOT NULL").withColumn("times", F.least(F.col("copies") - F.col("same").cast("int"), F.lit(k))).where("times > 0")
    others = others.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    ranked = others.withColumn("rank", rank).where(F.col("rank") <= k)
    copies = rows.where(is_query & (F.col("copies") > 1)).select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("copies").alias("_n"))
    repeated = ranked.join(copies, ["query_id", "query_row"], "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1).cast("long")))))
    return repeated.select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vec_id divisible by 50; the cases are those of ``whole_numbers`` and ``top_k``."""
    return top_k(whole_numbers(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, row_number() OVER () AS rn FROM v),
s AS (SELECT q.vec_id AS query_id, q.rn AS qn, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM n q JOIN n c ON q.rn <> c.rn AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
