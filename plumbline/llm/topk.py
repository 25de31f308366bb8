"""Operator 8: exact top-k by integer inner product through distributed histogram selection.

Queries go in blocks of a fixed size (a bounded broadcast); for each block every task scores all its vectors. Round by
round a global histogram for each query, over the range that still holds its kth value, narrows that range until it is
one integer. A task sends counts only from its own kth value up: a bin below cannot hold the global kth one. In the end
scores at or above the kth value are kept, of ties at it the k smallest ids of each task, and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import drop, shared_dir, written

BINS = 1024
EXACT = float(1 << 53)
NONE = -(1 << 63)
MOST = (1 << 62) - 1


def integer_vectors(table: DataFrame, scale: float = 256.0, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, vec binary of little-endian 64-bit floats that hold integers): floor(scale * x).

    Rows with a null id, a null vector, or a null or non-finite component are left out; so are an empty vector and one
    with a component that is not finite any more when scaled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.array([np.nan if c is None else c for c in v.as_py()] if v.values.null_count else v.values.to_numpy(zero_copy_only=False), np.float64)
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x)
                if len(x) and np.isfinite(x).all():
                    ids.append(i), out.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vec"])

    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(run, "vec_id long, vec binary")


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, held within +-``MOST``; what floats can't hold exactly is taken as Python integers."""
    with np.errstate(over="ignore"):
        bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    if bound < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    as_int = lambda m: np.array([[int(c) for c in r] for r in m], object).reshape(m.shape)
    exact = as_int(queries) @ as_int(vectors).T
    return np.minimum(np.maximum(exact, -MOST), MOST).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the vectors of the queries' width; other widths have no inner product with them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            ids = batch.column(0).slice(at, rows).to_numpy()
            vecs = batch.column(1).slice(at, rows).to_pylist()
            fit = np.array([len(v) == 8 * dim for v in vecs], bool)
            if fit.any():
                yield ids[fit], np.frombuffer(b"".join(v for v in vecs if len(v) == 8 * dim), "<f8").reshape(-1, dim)


def _each(batches: Iterator[pa.RecordBatch], qids: np.ndarray, qvecs: np.ndarray, some: int = 512) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(queries, ids, scores) of all blocks of a task; NONE where the candidate is the query's own id."""
    for ids, vecs in _blocks(batches, qvecs.shape[1]):
        for at in range(0, len(qids), some):
            q = slice(at, at + some)
            scores = _scores(qvecs[q], vecs)
            scores[qids[q][:, None] == ids[None, :]] = NONE
            yield q, ids, scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """For each query (vec_id, vec) its k best other vectors: query_id, rank, vec_id, score; ties to the smaller vec_id.

    Both inputs come from :func:`integer_vectors`. Scores beyond 62 bits count as the largest or smallest one, +-``MOST``. A candidate with the query's own id is not its neighbour; a query
    without candidates gets no row. A repeated id is one candidate for each row, and each of its rows is a query of its own.
    Blocks have about ``block`` queries; a block's rows are written, and what was sent for it is dropped, before the next.
    """
    spark = vectors.sparkSession
    vectors, held = written(vectors, "topk-vectors")
    n_blocks = max(1, -(-queries.count() // block))
    dealt, asked = written(queries.withColumn("b", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks))), "topk-queries")
    folder, told = shared_dir(spark, "topk"), "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], told).write.parquet(folder)
    for b in range(n_blocks):
        rows = dealt.where(F.col("b") == b).select("vec_id", "vec").orderBy("vec_id", "vec").collect()
        for dim in sorted({len(r["vec"]) // 8 for r in rows}):
            own = [r for r in rows if len(r["vec"]) == 8 * dim]
            part, sent = _search_block(vectors, np.array([r["vec_id"] for r in own], np.int64), np.frombuffer(b"".join(bytes(r["vec"]) for r in own), "<f8").reshape(-1, dim), k)
            part.write.mode("append").parquet(folder)
            for x in sent:
                x.destroy()
    drop(spark, held, asked)
    return spark.read.schema(told).parquet(folder)


def _search_block(vectors: DataFrame, qids: np.ndarray, qvecs: np.ndarray, k: int) -> tuple[DataFrame, list]:
    """Histogram selection for one block of queries of one width: the result, and the broadcasts that it needs until it is written."""
    spark, n = vectors.sparkSession, len(qids)
    sent = spark.sparkContext.broadcast((qids, qvecs))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max((float(np.abs(v).max(initial=0)) for _, v in _blocks(batches, sent.value[1].shape[1])), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    most = vectors.mapInArrow(largest, "most double").agg(F.max("most").alias("m")).collect()[0]["m"] or 0.0
    bound = min(MOST, int(qvecs.shape[1]) * int(np.abs(qvecs).max(initial=0)) * int(most) + 1)
    lo, hi, want = [-bound] * n, [bound] * n, [k] * n
    while any(h > a for a, h in zip(lo, hi, strict=True)):
        step = [max(1, -(-(h - a + 1) // BINS)) for a, h in zip(lo, hi, strict=True)]
        ranges = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in (lo, hi, step)))

        def histogram(batches: Iterator[pa.RecordBatch], ranges=ranges) -> Iterator[pa.RecordBatch]:
            low, high, width = ranges.value
            counts = np.zeros((n, BINS), np.int64)
            for q, _, scores in _each(batches, *sent.value):
                r, c = np.nonzero((scores >= low[q, None]) & (scores <= high[q, None]) & (high > low)[q, None])
                bins = (scores[r, c] - low[q][r]) // width[q][r]
                m = len(low[q])
                counts[q] += np.bincount(r * BINS + bins, minlength=m * BINS).reshape(m, BINS)
            above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            q, b = np.nonzero((counts > 0) & (above < k))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[q, b])], ["q", "bin", "n"])

        counts = vectors.mapInArrow(histogram, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        goal = spark.createDataFrame(list(enumerate(want)), "q int, want long")  # a row for each query of the block
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy(F.col("bin").desc())))
        reached = F.col("upto") >= F.col("want")
        found = upto.join(F.broadcast(goal), "q").groupBy("q").agg(F.max(F.when(reached, F.col("bin"))).alias("bin"), F.max_by("n", F.when(reached, F.col("bin"))).alias("n"), F.max_by("upto", F.when(reached, F.col("bin"))).alias("upto"))
        seen = {r["q"]: r for r in found.collect()}
        ranges.destroy()
        for q in range(n):
            if hi[q] > lo[q]:
                if q not in seen or seen[q]["bin"] is None:  # fewer than k candidates: all are taken
                    lo[q] = hi[q] = NONE + 1
                else:
                    want[q] -= seen[q]["upto"] - seen[q]["n"]
                    lo[q] += seen[q]["bin"] * step[q]
                    hi[q] = min(hi[q], lo[q] + step[q] - 1)
    kth = spark.sparkContext.broadcast(np.array(lo, np.int64))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tied: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        names = ["q", "vec_id", "score"]
        for q, ids, scores in _each(batches, *sent.value):
            low = kth.value[q]
            r, c = np.nonzero(scores > np.where(low == NONE + 1, NONE, low)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(q.start + r), pa.array(ids[c]), pa.array(scores[r, c])], names)
            r, c = np.nonzero((scores == low[:, None]) & (low > NONE + 1)[:, None])
            for j in np.unique(r):
                tied[q.start + j] = np.sort(np.concatenate([tied[q.start + j], ids[c[r == j]]]), kind="stable")[:k]
        of = np.repeat(np.arange(n), [len(t) for t in tied])
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate([*tied, np.zeros(0, np.int64)])), pa.array(kth.value[of])], names)

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    kept = vectors.mapInArrow(keep, "q long, vec_id long, score long").withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, int(i)) for q, i in enumerate(qids)], "q long, query_id long")  # a row for each query of the block
    return kept.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score"), [sent, kth]


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
