"""Exact top-k search (operator 1) by distributed histogram selection.

Queries are worked off in blocks of about QUERY_BLOCK, so what is broadcast has a fixed size. For a block, each round scores every
candidate and counts the scores of each query in BINS bins of the range that still holds its k-th best; the bin of the k-th best is
the next, narrower range. Scores are whole numbers, so the range shrinks to one value. A last pass keeps what scores above it, and of
those that equal it the smallest ids that are still needed. A task reports of a query's histogram only the upper bins down to where
its own count reaches what is needed: the k-th best of all rows cannot lie lower.

Nulls and edge cases: vectors that are null or hold a null or non-finite component take no part; a null id takes no part; vectors of
another length than the query's are not its candidates; all candidates are returned if there are fewer than k; rows that repeat an id
are candidates each, but none with the query's own id is; queries that repeat give their rows once for each different vector and id;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common

SCALE, K, EVERY = 256, 5, 50
QUERY_BLOCK, BINS, SLICE = 2048, 1024, 2048
EXACT = float(1 << 53)


def valid(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)


def matrices(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole-number vectors as doubles) by length of vector; a few thousand rows at most."""
    lists = batch.column(1)
    lengths = np.diff(lists.offsets.to_numpy())
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        for at in range(0, len(rows), SLICE):
            part = lists.take(pa.array(rows[at : at + SLICE])).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield batch.column(0).to_numpy()[rows[at : at + SLICE]], np.floor(part * scale).reshape(-1, int(length))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows as int64."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], dtype=object) for m in (a, b)]
    return (whole[0] @ whole[1].T).astype(np.int64)  # too large for a long: an OverflowError


class Block:
    """Queries of a block, by length of vector, with the range that holds each one's k-th best."""

    def __init__(self, ids: list[int], vectors: list[list[float]], scale: int, largest: float, k: int):
        self.scale = scale
        self.ids = np.array(ids, dtype=np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(v) for v in vectors])
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            self.by_length[int(n)] = rows, np.floor(np.array([vectors[i] for i in rows], dtype=np.float64).reshape(len(rows), int(n)) * scale)
        reach = np.zeros(len(ids))
        for rows, m in self.by_length.values():
            reach[rows] = np.abs(m).sum(axis=1) * largest
        if len(reach) and reach.max() >= float(1 << 61):
            raise OverflowError("a score would not fit in a long")
        self.low = -np.ceil(reach).astype(np.int64)
        self.span = 1 - 2 * self.low  # scores from low on, span values of them, hold the k-th best
        self.width = np.maximum(1, -(-self.span // BINS))
        self.need = np.full(len(ids), k, dtype=np.int64)
        self.all = np.zeros(len(ids), dtype=bool)  # fewer candidates than k: every one is wanted

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, candidate ids, scores by query and candidate, which of them count)."""
        for ids, m in matrices(batch, self.scale):
            if (own := self.by_length.get(m.shape[1])) is not None:
                rows, q = own
                yield rows, ids, inner(q, m), self.ids[rows][:, None] != ids[None, :]


def _histograms(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        n = len(block.ids)
        bins = np.zeros(n * BINS, dtype=np.int64)
        for batch in batches:
            for rows, _, s, counts in block.scores(batch):
                above = s - block.low[rows][:, None]
                inside = counts & (above >= 0) & (above < block.span[rows][:, None])
                at = above // block.width[rows][:, None]
                bins += np.bincount((rows[:, None] * BINS + at)[inside], minlength=n * BINS)
        falling = bins.reshape(n, BINS)[:, ::-1]
        before = np.cumsum(falling, axis=1) - falling
        q, b = np.nonzero((falling > 0) & (before < block.need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(BINS - 1 - b), pa.array(falling[q, b]), pa.array(block.need[q])], ["q", "bin", "n", "need"])

    return run


def _best(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        ties: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(block.ids)
        for batch in batches:
            for rows, ids, s, counts in block.scores(batch):
                edge = block.low[rows][:, None]
                q, c = np.nonzero(counts & ((s > edge) | block.all[rows][:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(rows[q]), pa.array(block.ids[rows[q]]), pa.array(ids[c]), pa.array(s[q, c])], ["q", "query_id", "vec_id", "score"])
                for i in np.flatnonzero((counts & (s == edge)).any(axis=1)):
                    if not block.all[rows[i]]:
                        ties[rows[i]] = np.sort(np.r_[ties[rows[i]], ids[counts[i] & (s[i] == block.low[rows[i]])]])[: block.need[rows[i]]]
        q = np.repeat(np.arange(len(ties)), [len(t) for t in ties])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(block.ids[q]), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *ties])), pa.array(block.low[q])], ["q", "query_id", "vec_id", "score"])

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of the highest inner product of each query. Both tables: vec_id, embedding."""
    spark = common.prepare(queries.sparkSession)
    queries, candidates = (valid(x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))) for x in (queries, candidates))
    queries = queries.distinct().checkpoint()
    largest = candidates.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double")))))).first()[0] or 0.0
    out, blocks = common.shared_dir(spark, "top-k"), max(1, math.ceil(queries.count() / QUERY_BLOCK))
    for number in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).orderBy("vec_id").collect()  # about QUERY_BLOCK vectors
        block = Block([r[0] for r in rows], [r[1] for r in rows], scale, float(largest), k)
        while True:
            shared = spark.sparkContext.broadcast(block)
            counted = candidates.mapInArrow(_histograms(shared), "q long, bin long, n long, need long").groupBy("q", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
            falling = Window.partitionBy("q").orderBy(F.desc("bin"))
            reached = counted.withColumn("upto", F.sum("n").over(falling.rowsBetween(Window.unboundedPreceding, 0)))
            found = reached.where("upto >= need AND upto - n < need").select("q", "bin", (F.col("upto") - F.col("n")).alias("above")).collect()
            shared.destroy()
            final = block.width.max(initial=1) == 1
            seen = np.zeros(len(block.ids), dtype=bool)
            for q, b, above in found:
                seen[q] = True
                block.low[q] += b * block.width[q]
                block.need[q] -= above
            block.all |= ~seen
            if final:
                break
            block.span = block.width
            block.width = np.maximum(1, -(-block.span // BINS))
        shared = spark.sparkContext.broadcast(block)
        best = candidates.mapInArrow(_best(shared), "q long, query_id long, vec_id long, score long")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
        shared.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors.where(F.col("vec_id") % EVERY == 0), vectors)


#: All inner products of the stated queries, ranked.
SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0 AND len(q.e) = len(c.e)
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
