"""Language-model scoring (operator 10) by deleted interpolation.

P(word | previous) = l(b) * c(previous, word) / c(previous) + (1 - l(b)) * (c(word) + 1) / (N + V + 1)

where b is the bucket of how often the context was seen (a power of two), and l is learned for each bucket by expectation-
maximisation on held-out counts: every training token is scored by the counts of all the others (its own occurrence deleted), and
the tokens enter the iteration as a histogram, per bucket, of the ratio of the two estimates.

How counts move: documents are gathered into chunks of about CHUNK_TOKENS tokens. A chunk asks for each different word and pair of
its own once, with its own training count; requests go by hash to buckets, are summed there, and the sums go back to the chunks that
asked. So a frequent word is one row for each chunk, no matter how often it occurs; buckets are even, as keys are hashes; and no table
of words is ever on the driver or broadcast. Words are known by 64-bit hashes.

Nulls and edge cases: a null text is empty and has the end token alone; a null doc_id is a training row; rows that repeat are counted
and scored each; without training rows all counts are 0 and every token has probability 1; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

CHUNK_TOKENS, BYTES_PER_BUCKET = 1_300_000, 6 << 20
HELD_OUT_OF, HELD_OUT = 7, 2
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0xE6546B6485EBCA6B)
STEPS_PER_OCTAVE, OCTAVES, ROUNDS = 8, 48, 60
CHUNKS = "chunk long, docs binary, tokens binary, words binary"
ANSWERS = "chunk long, level int, bucket long, counts binary"


def packed(x: np.ndarray) -> bytes:
    """Little-endian numbers, byte planes one after the other, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def keys_packed(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint64(0)))


def keys_unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, "<u8"), dtype=np.uint64)


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of whole texts as positions in the chunk's own sorted word keys."""
    task, number, held = TaskContext.get().partitionId(), 0, 0
    ids: list[int | None] = []
    lengths: list[int] = []
    parts: list[np.ndarray] = []
    places: defaultdict[bytes, int] = defaultdict(count().__next__)

    def chunk() -> pa.RecordBatch:
        keys = np.fromiter((word_key(w) for w in places), dtype=np.uint64, count=len(places))
        words, place = np.unique(np.r_[keys, END], return_inverse=True)
        tokens = np.concatenate([np.r_[place[p], place[-1]] for p in parts]).astype("<u4")
        known = np.array([i is not None for i in ids])
        train = np.array([i is None or zlib.crc32(str(i).encode()) % HELD_OUT_OF != HELD_OUT for i in ids])
        docs = np.array([[0 if i is None else i for i in ids], known, train, np.array(lengths) + 1], dtype="<i8")
        return pa.RecordBatch.from_arrays([pa.array([(task << 24) + number]), *(pa.array([x], pa.binary()) for x in (packed(docs.reshape(-1)), packed(tokens), keys_packed(words)))], ["chunk", "docs", "tokens", "words"])

    for batch in batches:
        all_ids = batch.column(0).to_pylist()
        for at, texts in common.texts_of(batch.column(1), 64):
            for doc_id, text in zip(all_ids[at : at + len(texts)], texts, strict=True):
                words = common.words_of(text)
                ids.append(doc_id)
                lengths.append(len(words))
                parts.append(np.fromiter(map(places.__getitem__, words), dtype=np.int64, count=len(words)))
                held += len(words) + 1
                if held >= CHUNK_TOKENS:
                    yield chunk()
                    number, held = number + 1, 0
                    ids, lengths, parts, places = [], [], [], defaultdict(count().__next__)
    if ids:
        yield chunk()


class Chunk:
    """A chunk's tokens with their pairs. words and pairs are sorted keys; word and pair are each token's place among them."""

    def __init__(self, docs: bytes, tokens: bytes, words: bytes):
        self.ids, self.known, self.train, self.lengths = unpacked(docs, "<i8").reshape(4, -1)
        self.word = unpacked(tokens, "<u4").astype(np.int64)
        self.words = keys_unpacked(words)
        self.starts = np.cumsum(self.lengths) - self.lengths
        key = self.words[self.word]
        self.before = np.r_[0, self.word[:-1]]
        before = np.r_[BEGIN, key[:-1]]
        before[self.starts] = BEGIN
        self.pairs, self.pair = np.unique(common.mix64(before * np.uint64(3) + common.mix64(key)), return_inverse=True)
        self.trained = np.repeat(self.train, self.lengths) == 1

    def requests(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for level, keys, place in ((1, self.words, self.word), (2, self.pairs, self.pair)):
            yield level, keys, np.bincount(place[self.trained], minlength=len(keys)).astype("<u4")

    def counts(self, answers: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training counts of each token's word, pair and context."""
        ends = np.searchsorted(self.words, END)
        one, two = answers[1], answers[2]
        context = one[self.before]
        context[self.starts] = one[ends]  # a text's first token follows the beginning, seen once in each training text
        return one[self.word], two[self.pair], context


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 more than the power of two that it reaches."""
    return np.frexp(context.astype(float))[1]


def ratio_bin(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 where a is 0, else a step of the logarithm of a / b."""
    with np.errstate(divide="ignore"):
        steps = np.round(np.log2(np.maximum(a, 1e-300) / b) * STEPS_PER_OCTAVE) + OCTAVES * STEPS_PER_OCTAVE
    return np.where(a > 0, np.clip(steps, 1, 2 * OCTAVES * STEPS_PER_OCTAVE), 0).astype(np.int64)


def learn(histogram: list[tuple[int, int, int]]) -> dict[int, float]:
    """Weights by bucket from (bucket, ratio bin, tokens): expectation-maximisation of the two parts' mixture."""
    weights = {}
    for b in sorted({h[0] for h in histogram}):
        own = [(r, n) for k, r, n in histogram if k == b]
        bins, n = np.array([r for r, _ in own], dtype=float), np.array([k for _, k in own], dtype=float)
        ratio = np.where(bins > 0, 2.0 ** ((bins - OCTAVES * STEPS_PER_OCTAVE) / STEPS_PER_OCTAVE), 0.0)
        x = 0.5
        for _ in range(ROUNDS):
            x = float((n * x * ratio / (x * ratio + 1 - x)).sum() / n.sum())
            x = min(max(x, 1e-6), 1 - 1e-6)
        weights[b] = x if b else 0.0
    return weights


class Totals:
    def __init__(self, tokens: int, words: int):
        self.tokens, self.words = tokens, words

    def base(self, one: np.ndarray) -> np.ndarray:
        return (one + 1) / (self.tokens + self.words + 1)


def _answers(group: pa.Table) -> dict[int, np.ndarray]:
    rows = sorted((r["level"], r["bucket"], r["counts"]) for r in group.select(["level", "bucket", "counts"]).to_pylist() if r["level"])
    return {k: np.concatenate([np.zeros(0, dtype=np.int64), *(unpacked(c, "<u4").astype(np.int64) for level, _, c in rows if level == k)]) for k in (1, 2)}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = common.prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    at = common.shared_dir(spark, "chunks")
    rows.mapInArrow(_chunks, CHUNKS).write.option("compression", "none").parquet(at)
    chunks = spark.read.schema(CHUNKS).parquet(at)
    size = chunks.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    bits = max(4, min(40, (2 * size // BYTES_PER_BUCKET).bit_length()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = []
                for level, keys, counts in Chunk(row["docs"], row["tokens"], row["words"]).requests():
                    buckets = (keys >> np.uint64(64 - bits)).astype(np.int64)
                    first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
                    found += [(row["chunk"], level, int(buckets[a]), keys_packed(keys[a:b]), packed(counts[a:b])) for a, b in zip(first, np.r_[first[1:], len(keys)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["chunk", "level", "bucket", "keys", "counts"])

    def add_up(group: pa.Table) -> pa.Table:
        """Sum a bucket's requests; answer each in its own order. A bucket holds about BYTES_PER_BUCKET of tokens' keys."""
        rows = group.to_pylist()
        keys, counts = [keys_unpacked(r["keys"]) for r in rows], [unpacked(r["counts"], "<u4") for r in rows]
        different, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts).astype(float), len(different)).astype(np.int64)
        level, bucket = rows[0]["level"], rows[0]["bucket"]
        out = [(-1, level, bucket, packed(np.array([total.sum(), (total > 0).sum()], dtype="<u8")))]
        begin = 0
        for r, k in zip(rows, keys, strict=True):
            out.append((r["chunk"], level, bucket, packed(total[place[begin : begin + len(k)]].astype("<u4"))))
            begin += len(k)
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["chunk", "level", "bucket", "counts"])

    answered = common.shared_dir(spark, "answers")
    chunks.mapInArrow(ask, "chunk long, level int, bucket long, keys binary, counts binary").groupBy("level", "bucket").applyInArrow(add_up, ANSWERS).write.option("compression", "none").parquet(answered)
    answers = spark.read.schema(ANSWERS).parquet(answered)
    sums = [unpacked(bytes(r[0]), "<u8") for r in answers.where("chunk = -1 AND level = 1").select("counts").toLocalIterator()]
    totals = Totals(sum(int(s[0]) for s in sums), sum(int(s[1]) for s in sums))
    own = chunks.select("chunk", F.lit(0).alias("level"), F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("counts"), "docs", "tokens", "words")
    got = answers.where("chunk >= 0").select("*", *[F.lit(None).cast("binary").alias(c) for c in ("docs", "tokens", "words")])
    by_chunk = own.unionByName(got).groupBy("chunk")

    def opened(group: pa.Table) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
        mine = next(r for r in group.select(["level", "docs", "tokens", "words"]).to_pylist() if not r["level"])
        chunk = Chunk(mine["docs"], mine["tokens"], mine["words"])
        return chunk, *chunk.counts(_answers(group))

    def compare(group: pa.Table) -> pa.Table:
        chunk, one, two, context = opened(group)
        one, two, context = (x[chunk.trained].astype(float) for x in (one, two, context))
        pair = np.where(context > 1, (two - 1) / np.maximum(context - 1, 1), 0.0)
        cell, n = np.unique(bucket_of(context).astype(np.int64) * 10_000 + ratio_bin(pair, one / max(1, totals.tokens + totals.words)), return_counts=True)
        return pa.Table.from_arrays([pa.array(cell // 10_000), pa.array(cell % 10_000), pa.array(n)], ["bucket", "ratio", "n"])

    histogram = by_chunk.applyInArrow(compare, "bucket long, ratio long, n long").groupBy("bucket", "ratio").agg(F.sum("n").alias("n")).collect()  # 64 buckets of 769 bins at most
    weights = learn([tuple(r) for r in histogram])
    table = np.array([weights.get(b, 0.0) for b in range(80)])

    def finish(group: pa.Table) -> pa.Table:
        chunk, one, two, context = opened(group)
        base = totals.base(one.astype(float))
        share = table[bucket_of(context)]
        mixed = share * two / np.maximum(context, 1) + (1 - share) * base
        add = lambda x: np.add.reduceat(x, chunk.starts)
        ids = pa.array(chunk.ids, mask=chunk.known == 0)
        return pa.Table.from_arrays([ids, pa.array(chunk.train == 0), pa.array(chunk.lengths), pa.array(add((one > 0).astype(np.int64))), pa.array(np.full(len(ids), totals.tokens)), pa.array(add(np.log10(base))), pa.array(add(np.log10(mixed)))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return by_chunk.applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
