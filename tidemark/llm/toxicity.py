"""Toxicity (operator 8): a factorization machine over hashed terms.

A document is the set of its terms: each lower-cased word and each of the word's prefixes of three to ten bytes, hashed into 2**20
buckets. The buckets that speak most for toxic rows are kept (a bounded number), and the machine learns a weight and a short
vector for each, so that a pair of terms can count for more or less than the two weights would add up to.

What is bounded: the fit uses about FIT_TOXIC toxic and FIT_CLEAN clean labelled rows, picked by a hash of doc_id at rates that
follow from the counts, and SELECTED buckets. Scores cover every whole text. The model is a few hundred kilobytes at most.

Nulls and edge cases: a null or empty text has no terms and scores the bias alone; a null doc_id is never a training row;
without any training row, or with one class only, every score is the share of toxic rows (0 without rows); rows that repeat are
scored each; a doc_id with several labels takes part once for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

BUCKETS, PREFIXES = 1 << 20, range(3, 11)
FIT_TOXIC, FIT_CLEAN, SELECTED, FACTORS = 6_000, 10_000, 4_096, 4
#: A bucket is kept if toxic rows have it exp(MIN_ODDS) times as often, and often enough.
MIN_ODDS, MIN_Z = 0.8, 2.0
THRESHOLD = 0.7
#: Bytes of text that are hashed at once; a longer text is cut at white space, and its parts count as one row.
PIECE = 1 << 20
LETTER = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to each power that a piece can need."""
    ups, downs = np.full(2 * PIECE + 64, BASE), np.full(2 * PIECE + 64, UNBASE)
    ups[0] = downs[0] = 1
    return np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)


def pieces(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """Lower-cased texts, joined up to about PIECE bytes: (bytes, where each part starts, row of the first part).

    Parts are in the order of the rows; a row of more than one piece ends one and begins the next.
    """
    held: list[bytes] = []
    size = first = 0
    for row, text in enumerate(texts):
        raw = (text or "").lower().encode("utf-8", "surrogatepass")
        if held and size + len(raw) > PIECE:
            yield b" ".join(held), np.cumsum([0, *(len(x) + 1 for x in held[:-1])]), first
            held, size, first = [], 0, row
        while len(raw) > PIECE:
            cut = raw.rfind(b" ", 1, PIECE) if raw.rfind(b" ", 1, PIECE) > 0 else PIECE
            yield raw[:cut], np.zeros(1, dtype=np.int64), row
            raw = raw[cut:]
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield b" ".join(held), np.cumsum([0, *(len(x) + 1 for x in held[:-1])]), first


def terms_of(texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs, sorted, each once. keep: position of each bucket that counts, else -1; then positions are returned.

    Words are runs of a-z, 0-9 and non-ASCII bytes; the hash of any stretch is a difference of running polynomial sums.
    """
    ups, downs = powers()
    found = []
    for raw, starts, first in pieces(texts):
        data = np.frombuffer(raw, dtype=np.uint8)
        if not len(data):
            continue
        inside = np.r_[False, LETTER[data], False]
        at, end = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        if not len(at):
            continue
        row = first + np.searchsorted(starts, at, side="right") - 1
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ups[: len(data)], dtype=np.uint64)]
        base, unit, length = sums[at], downs[at], end - at
        hashes = [((sums[end] - base) * unit) ^ np.uint64(0x5851F42D4C957F2D)]
        rows = [row]
        for k in PREFIXES:
            long = length >= k
            hashes.append((sums[at[long] + k] - base[long]) * unit[long])
            rows.append(row[long])
        bucket = (common.mix64(np.concatenate(hashes)) % np.uint64(BUCKETS)).astype(np.int64)
        row = np.concatenate(rows)
        if keep is not None:
            bucket = keep[bucket]
            row, bucket = row[bucket >= 0], bucket[bucket >= 0]
        found.append(np.unique(row * BUCKETS + bucket))
    both = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *found]))
    return both // BUCKETS, both % BUCKETS


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets as packed 32-bit numbers: nested columns of growing size are costly to hand over."""
    for batch in batches:
        packed: list[bytes] = []
        for _, texts in common.texts_of(batch.column(1)):
            row, bucket = terms_of(texts)
            packed += [x.astype("<i4").tobytes() for x in np.split(bucket, np.searchsorted(row, np.arange(1, len(texts))))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["toxic", "terms"])


class Machine:
    """score = sigmoid(bias + sum of weights + half of (square of sum - sum of squares) of the vectors of the terms present)."""

    def __init__(self, keep: dict[int, int], bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors
        self.places = np.full(BUCKETS, -1, dtype=np.int32)
        self.places[list(keep)] = list(keep.values())

    def scores(self, texts: list[str | None]) -> np.ndarray:
        row, at = terms_of(texts, self.places)
        n, v = len(texts), self.vectors[at]
        sums = np.stack([np.bincount(row, v[:, f], n) for f in range(v.shape[1])], axis=1)
        raw = self.bias + np.bincount(row, self.weights[at], n) + 0.5 * ((sums * sums).sum(axis=1) - np.bincount(row, (v * v).sum(axis=1), n))
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit_machine(rows: list[list[int]], toxic: np.ndarray, keep: dict[int, int], steps: int = 300, rate: float = 0.05, l2: float = 2e-4, seed: int = 7) -> Machine:
    """Full-batch Adam on the log loss with both classes weighing by their sizes' square roots; rows hold positions of keep."""
    rng = np.random.default_rng(seed)
    n, m = len(rows), max(1, len(keep))
    share = float(toxic.mean()) if n else 0.0
    none = Machine({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(1), np.zeros((1, FACTORS)))
    if not n or share in (0.0, 1.0) or not keep:
        return none
    col = np.fromiter((t for r in rows for t in r), dtype=np.int64)
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    weight = np.where(toxic == 1, np.sqrt((1 - share) / share), 1.0)
    weight /= weight.sum()
    params = [np.array([none.bias]), np.zeros(m), rng.normal(0, 0.02, (m, FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        bias, w, v = params
        s = np.stack([np.bincount(doc, v[col, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(doc, (v * v).sum(axis=1)[col], n)
        y = bias + np.bincount(doc, w[col], n) + 0.5 * ((s * s).sum(axis=1) - squares)
        g = weight * (1 / (1 + np.exp(-np.clip(y, -40, 40))) - toxic)
        gv = np.stack([np.bincount(col, g[doc] * (s[doc, f] - v[col, f]), m) for f in range(FACTORS)], axis=1)
        grads = [np.array([g.sum()]), np.bincount(col, g[doc], m) + l2 * w, gv + 10 * l2 * v]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(keep, float(params[0][0]), params[1], params[2])


def held_out(column: str) -> F.Column:
    """crc32 of the doc_id as text, by 3, leaves 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """Learn from labelled rows that are not held out. labels: doc_id, toxic (0 or 1, null: no label)."""
    spark = common.prepare(docs.sparkSession)
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out("doc_id"))
    counts = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    million = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    rate = F.when(F.col("toxic") == 1, F.lit(1e6 * FIT_TOXIC / max(1, counts.get(1, 0)))).otherwise(F.lit(1e6 * FIT_CLEAN / max(1, counts.get(0, 0))))
    sample = labels.where(million < rate)
    # about FIT_TOXIC + FIT_CLEAN rows of two numbers, whatever the input
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")
    rows = picked.mapInArrow(_features, "toxic int, terms binary").checkpoint()
    per_class = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic_n, clean_n = per_class.get(1, 0), per_class.get(0, 0)
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for toxic, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                both[toxic][np.frombuffer(packed, dtype="<i4")] += 1
        hit = np.flatnonzero(both.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(both[1][hit]), pa.array(both[0][hit])], ["term", "a", "b"])

    seen = rows.mapInArrow(count, "term long, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("a") + 0.5) / F.lit(toxic_n + 1.0)) - F.log((F.col("b") + 0.5) / F.lit(clean_n + 1.0))
    telling = seen.where("a >= 2").withColumn("odds", odds).withColumn("z", F.col("odds") * F.sqrt("a")).where((F.col("odds") > MIN_ODDS) & (F.col("z") > MIN_Z))
    keep = {int(r[0]): i for i, r in enumerate(telling.orderBy(F.desc("z"), "term").limit(SELECTED).select("term").collect())}
    table = np.full(BUCKETS, -1, dtype=np.int64)
    table[list(keep)] = list(keep.values())
    places = spark.sparkContext.broadcast(table)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [places.value[np.frombuffer(x, dtype="<i4")] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.sort(x[x >= 0]).tobytes() for x in found], pa.binary())], ["toxic", "terms"])

    # FIT_TOXIC + FIT_CLEAN rows of a few numbers
    got = sorted((r["toxic"], bytes(r["terms"])) for r in rows.mapInArrow(choose, "toxic int, terms binary").collect())
    return fit_machine([np.frombuffer(t, dtype=np.int64).tolist() for _, t in got], np.array([float(x) for x, _ in got]), keep)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.concatenate([np.zeros(0), *(shared.value.scores(texts) for _, texts in common.texts_of(batch.column(1)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents scored THRESHOLD or higher go. Fitted on what is left of the documents."""
    shared = spark.sparkContext.broadcast(fit(docs, common.table(spark, sf_dir, "labels")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.concatenate([np.zeros(0), *(shared.value.scores(texts) for _, texts in common.texts_of(batch.column(at)))])
            yield batch.filter(pc.less(pa.array(out), pa.scalar(THRESHOLD)))

    return docs.mapInArrow(run, docs.schema)
