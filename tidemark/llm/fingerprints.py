"""Document fingerprints (operator 2): SimHash, and permuted block tables to find neighbours.

Terms of a text are its pairs of neighbouring words, each weighing 1 + ln(times); a text of fewer than SHORT words has its words
and their runs of four bytes besides, so that short texts differ by degrees. The hash of a term has BITS bits, and each term votes
its weight for or against every bit. The likeness of two fingerprints is the cosine that their differing bits stand for, 0 at least.

Neighbours within a radius r: bits are cut into blocks, more than r of them; two fingerprints within r bits agree on all but r blocks
at most, so a table for every choice of blocks - r blocks, with those blocks in front as its key, has each pair in some table.

Nulls and edge cases: a null text counts as empty; a text without words has the fingerprint of all zeros, and two of them have
likeness 1; equal texts have equal fingerprints; rows with one doc_id stand in the order of their texts' hashes; a null doc_id comes
last; a lone document is its own next one; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

BITS, SHORT, RADIUS, COARSE = 256, 8, 3, 64
CHUNK = 1 << 14


def term_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(different 64-bit term hashes, their weights)."""
    words = common.words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    terms = common.mix64(h[:-1] * np.uint64(3) + common.mix64(h[1:]))
    if len(words) < SHORT:
        joined = b" ".join(words)
        runs = [xxhash.xxh3_64_intdigest(joined[i : i + 4]) for i in range(max(1, len(joined) - 3))]
        terms = np.r_[terms, h, np.array(runs, dtype=np.uint64)]
    different, times = np.unique(terms, return_counts=True)
    return different, 1 + np.log(times)


def fingerprint(text: str | None, bits: int = BITS) -> bytes:
    """bits / 8 bytes; bit by bit the sign of the weighted votes."""
    hashes, weights = term_hashes(text or "")
    votes = np.zeros(bits)
    for at in range(0, len(hashes), CHUNK):
        part, weight = hashes[at : at + CHUNK], weights[at : at + CHUNK]
        streams = np.stack([common.mix64(part + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))) for k in range(bits // 64)], axis=1)
        signs = np.unpackbits(streams.view(np.uint8), axis=1).astype(np.float32)
        votes += 2 * (weight.astype(np.float32) @ signs).astype(float) - weight.sum()
    return np.packbits(votes > 1e-6 * (1 + weights.sum())).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    differ = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, float(np.cos(np.pi * differ / (8 * len(a)))))


def _bucket(bounds: list[int], per: int) -> Column:
    """Place of key in falling order: quantiles cut the range, and each part is cut evenly. A tree of comparisons, six deep."""

    def leaf(i: int) -> Column:
        high, low = bounds[i], bounds[i + 1]
        return F.lit(i * per) + F.least(F.lit(per - 1), F.greatest(F.lit(0), F.floor((F.lit(float(high)) - F.col("key").cast("double")) * F.lit(per / max(1.0, float(high) - float(low) + 1))))).cast("int")

    def tree(a: int, b: int) -> Column:
        if b - a == 1:
            return leaf(a)
        mid = (a + b) // 2
        return F.when(F.col("key") > F.lit(bounds[mid]), tree(a, mid)).otherwise(tree(mid, b))

    return tree(0, len(bounds) - 1)


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, extra, key, doc_id, text) dealt and sorted by falling doc_id so that each row that is not extra is followed by its next.

    Texts move once. Each bucket ends with a copy of the first row of the bucket after it; the last with the first of all.
    """
    spark = common.prepare(docs.sparkSession)
    least = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(least)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.where(F.col("doc_id").isNotNull()).agg(F.percentile_approx("doc_id", [i / COARSE for i in range(COARSE + 1)], 10_000)).first()[0] or []
    bounds = sorted(set(cuts), reverse=True) or [0]
    bounds = [bounds[0] + 1, *bounds[1:-1], min(bounds[-1], bounds[0]) - 1]
    bounds = sorted(set(bounds), reverse=True)
    per = max(1, ceil(8 * parts / (len(bounds) - 1)))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(per * len(bounds))).otherwise(_bucket(bounds, per)))
    firsts = sorted(rows.groupBy("bucket").agg(F.max("key")).collect())  # a row for each bucket
    if not firsts:
        return rows.select("bucket", F.lit(0).alias("extra"), "key", "doc_id", "text")
    lead = [(bucket, firsts[(i + 1) % len(firsts)][1]) for i, (bucket, _) in enumerate(firsts)]
    ends = spark.createDataFrame(lead, "bucket int, key long")
    extra = rows.drop("bucket").join(F.broadcast(ends), "key").select("bucket", F.lit(1).alias("extra"), "key", "doc_id", "text")
    both = rows.select("bucket", F.lit(0).alias("extra"), "key", "doc_id", "text").unionByName(extra)
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", F.desc("key"), F.xxhash64("text"))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[int | None, str, bytes] | None = None
    for batch in batches:
        extras, ids = batch.column(1).to_pylist(), batch.column(3).to_pylist()
        out: list[tuple] = []
        for at, texts in common.texts_of(batch.column(4)):
            for doc_id, extra, text in zip(ids[at : at + len(texts)], extras[at : at + len(texts)], texts, strict=True):
                text = text or ""
                print_ = fingerprint(text)
                if last:
                    own_id, own, own_print = last
                    n = len(own)
                    edited = own[: n - n // 3] + text[: n // 3]
                    after = fingerprint(edited)
                    out.append((own_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_print.hex(), after.hex(), likeness(own_print, after), likeness(own_print, print_)))
                last = None if extra else (doc_id, text, print_)
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(common.table(spark, sf_dir, "documents"))
    return rows.mapInArrow(_described, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t).hex() for _, texts in common.texts_of(batch.column(1)) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint in hex) of each row's whole text."""
    common.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints, "doc_id long, fingerprint string")


def neighbours(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(a, b, differ): pairs of different fingerprints, a < b, within radius bits; prints: a column fingerprint of equal-length hex.

    Copies are one fingerprint here; membership is prints itself. Keys hold 64 bits or more by default (256 bits, radius 3).
    """
    distinct = prints.select(F.col("fingerprint").alias("f")).where("f IS NOT NULL").distinct()
    n = distinct.agg(F.max(F.length("f"))).first()[0] or 16
    blocks = blocks or radius + 1
    edges = [round(n * i / blocks) for i in range(blocks + 1)]
    part = [F.substring("f", a + 1, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    tables = [F.concat(*[part[i] for i in kept]) for kept in combinations(range(blocks), blocks - radius)]
    keyed = distinct.select("f", F.posexplode(F.array(*tables)).alias("at", "key"))
    a, b = keyed.withColumnRenamed("f", "a"), keyed.withColumnRenamed("f", "b")
    word = lambda c, i: F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long")
    differ = sum((F.bit_count(word("a", i).bitwiseXOR(word("b", i))) for i in range(ceil(n / 8))), F.lit(0))
    return a.join(b, ["at", "key"]).where("a < b").withColumn("differ", differ.cast("int")).where(F.col("differ") <= radius).select("a", "b", "differ").distinct()
