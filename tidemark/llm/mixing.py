"""Mixing sources to target weights (operator 5) by Sainte-Lague apportionment.

Sizes are words. Sources share all words by their weights; a source stops at MOST times its own size and the excess goes to the
others by weight. The words become blocks of BLOCK words; blocks are apportioned by highest quotients, target / (2k + 1), first to
sources, then to each source's shards by their sizes. Within a shard documents stand in a seeded order and are cut into equal
blocks; a quota of q blocks out of n takes every block q // n times and q % n more in a row from a seeded place on, so that at
most two documents of a shard are taken in part.

Scale: a source is split into shards by a hash of doc_id, so that a hot source is many tasks. There are at most MOST_SHARDS shards
besides one for each source; their sizes and quotas are all that reaches the driver, and MOST_SOURCES is checked.

Nulls and edge cases: a null or empty text has size 0 and takes 0; a null source is a source, last in order; rows that repeat count
each; an empty table gives no row; sources without words have target 0. Reruns agree, as all choices are hashes of seed and doc_id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm import common

BLOCK, MOST, SHARD_WORDS, MOST_SHARDS, MOST_SOURCES, SEED = 16, 3, 1 << 18, 4096, 1_000_000, 20240229
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = MOST) -> dict[str | None, float]:
    """Words for each source: shares of all words by weight, no more than most times a source's size, the excess reshared."""
    found: dict[str | None, float] = {}
    total, open_ = float(sum(sizes.values())), set(sizes)
    while open_:
        rest, weight = total - sum(found.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / weight >= most * sizes[s]}
        if not over:
            return found | {s: rest * weights[s] / weight for s in open_}
        found |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
    return found


def apportion(votes: list[float], seats: int, limits: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2k + 1), ties to the earlier; nobody gets more than its limit."""
    seats, total = min(seats, sum(limits)), sum(votes)
    if not seats or total <= 0:
        return [0] * len(votes)
    given = [min(int(v * seats / total + 0.5), limit) for v, limit in zip(votes, limits, strict=True)]
    over = sum(given) - seats
    heap = [((votes[i] / (2 * k - 1)), -i) for i, k in enumerate(given) if k] if over > 0 else [(-(votes[i] / (2 * k + 1)), i) for i, k in enumerate(given) if k < limits[i]]
    heapq.heapify(heap)
    while over:
        _, i = heapq.heappop(heap)
        if over > 0:
            i, over = -i, over - 1
            given[i] -= 1
            if given[i]:
                heapq.heappush(heap, (votes[i] / (2 * given[i] - 1), -i))
        else:
            given[i], over = given[i] + 1, over + 1
            if given[i] < limits[i]:
                heapq.heappush(heap, (-(votes[i] / (2 * given[i] + 1)), i))
    return given


def text_key() -> Column:
    """Tells rows of one doc_id and source with different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, block: int = BLOCK, most: int = MOST, keyed: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, whole, from1, to1, from2, to2) for each row of docs.

    whole: times the document is taken whole; from..to: the words of it that are taken once more (at most two runs).
    weights: by source; without them sources by code point, null last, weigh 1, 2, 3 and again from 1.
    keyed: one more column, key, as by text_key().
    """
    spark = common.prepare(docs.sparkSession)
    # texts are read once; what is kept of them is a number
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), text_key().alias("key") if keyed else F.lit(0).alias("key")).checkpoint()
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r["source"]: r["size"] for r in rows}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weights = weights or {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    goal = targets(sizes, weights, most)
    total = sum(sizes.values())
    per_shard = max(SHARD_WORDS, math.ceil(total / MOST_SHARDS))
    shards = {s: max(1, math.ceil(sizes[s] / per_shard)) for s in order}
    few = spark.createDataFrame([(i, s, sizes[s], goal[s], shards[s]) for i, s in enumerate(order)], "source_number int, name string, source_size long, target double, shards int")
    dealt = sized.join(F.broadcast(few), sized["source"].eqNullSafe(few["name"])).drop("name")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")).cast("int"))
    lengths = {(r[0], r[1]): r[2] for r in dealt.groupBy("source_number", "shard").agg(F.sum("size")).collect()}  # MOST_SHARDS + sources rows
    by_source = apportion([goal[s] for s in order], round(total / block), [most * math.ceil(sizes[s] / block) for s in order])
    plan = []
    for i, _ in enumerate(order):
        own = sorted(k for k in lengths if k[0] == i)
        blocks = [math.ceil(lengths[k] / block) for k in own]
        for k, n, quota in zip(own, blocks, apportion([float(lengths[k]) for k in own], by_source[i], [most * n for n in blocks]), strict=True):
            plan.append((*k, lengths[k], n, quota // n if n else 0, quota % n if n else 0))
    quotas = spark.createDataFrame(plan, "source_number int, shard int, words long, blocks long, whole long, more long")
    seeded = Window.partitionBy("source_number", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", "key")
    placed = dealt.withColumn("end", F.sum("size").over(seeded.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    placed = placed.join(F.broadcast(quotas), ["source_number", "shard"])
    first = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "source_number", "shard"), F.col("blocks"))).otherwise(F.lit(0))
    placed = placed.withColumn("first", first)
    # two stretches of the shard's words: from the seeded block on, and from the shard's start if that runs over its end
    stretch = {"1": (F.col("first") * block, F.least((F.col("first") + F.col("more")) * block, F.col("words"))), "2": (F.lit(0), (F.col("first") + F.col("more") - F.col("blocks")) * block)}
    for n, (a, b) in stretch.items():
        begin = F.greatest(a, F.col("begin")) - F.col("begin")
        end = F.least(b, F.col("end")) - F.col("begin")
        placed = placed.withColumn(f"from{n}", F.when(end > begin, begin).otherwise(F.lit(0)).cast("long")).withColumn(f"to{n}", F.when(end > begin, end).otherwise(F.lit(0)).cast("long"))
    taken = F.col("whole") * F.col("size") + F.col("to1") - F.col("from1") + F.col("to2") - F.col("from2")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "whole", "from1", "to1", "from2", "to2", *(["key"] if keyed else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def cut(text: str, begin: int, end: int) -> str:
    """Words begin to end of a text, with the white space between them as it is."""
    raw = text.encode("utf-8", "surrogatepass")
    at, seen, start = 0, -1, 0
    for word in raw.split():
        at = raw.index(word, at)
        seen += 1
        if seen == begin:
            start = at
        at += len(word)
        if seen == end - 1:
            break
    return raw[start:at].decode("utf-8", "surrogatepass")


def repeat(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: each document as often as the mix takes it whole, and once more for each run of words taken besides.

    A document of which the mix takes nothing goes. A copy that is cut has its own n_chars. Each row of docs meets its own row of the
    mix: by doc_id, source and text, and where rows agree in all three, by their number among those.
    """
    names, fields = docs.columns, ("whole", "size", "from1", "to1", "from2", "to2")
    own = [docs["doc_id"].cast("long"), docs["source"], text_key()]
    plan = mix(docs, keyed=True).select(*[F.col(c).alias(f"__mix_{c}") for c in ("doc_id", "source", "key", "taken", *fields)])
    place = ["__mix_doc_id", "__mix_source", "__mix_key"]
    plan = plan.withColumn("__mix_n", F.row_number().over(Window.partitionBy(*place).orderBy(*[f"__mix_{c}" for c in ("taken", *fields)]))).checkpoint()
    same = own[0].eqNullSafe(plan[place[0]]) & own[1].eqNullSafe(plan[place[1]]) & (own[2] == plan[place[2]])
    repeated = plan.where("__mix_n = 2").select(*place)
    if repeated.isEmpty():
        joined = docs.join(plan.where("__mix_taken > 0"), same)
    else:  # only rows that repeat are numbered, by a second look at the documents
        several = repeated.select(*[F.col(c).alias(f"{c}s") for c in place])
        match = lambda key: key[0].eqNullSafe(several[f"{place[0]}s"]) & key[1].eqNullSafe(several[f"{place[1]}s"]) & (key[2] == several[f"{place[2]}s"])
        once = plan.join(several, match([plan[c] for c in place]), "left_anti").where("__mix_taken > 0")
        again = docs.join(several, match(own)).withColumn("__mix_row", F.row_number().over(Window.partitionBy(*[f"{c}s" for c in place]).orderBy(*[F.col(c) for c in names if c != "text"])))
        numbered = [again[f"{place[0]}s"].eqNullSafe(plan[place[0]]), again[f"{place[1]}s"].eqNullSafe(plan[place[1]]), again[f"{place[2]}s"] == plan[place[2]], again["__mix_row"] == plan["__mix_n"]]
        wanted = [*names, *[f"__mix_{c}" for c in fields]]
        joined = docs.join(once, same).select(*wanted).unionByName(again.join(plan.where("__mix_taken > 0"), numbered).select(*wanted))
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{c: r[f"__mix_{c}"] for c in fields} for r in batch.select([f"__mix_{c}" for c in fields]).to_pylist()]
            part = batch.select(names)
            for k in range(max((r["whole"] for r in rows), default=0)):
                yield part.filter(pa.array([r["whole"] > k for r in rows]))
            runs = [(i, r[f"from{n}"], r[f"to{n}"]) for n in "12" for i, r in enumerate(rows) if r[f"to{n}"] > r[f"from{n}"]]
            for at in range(0, len(runs), 256):
                some = runs[at : at + 256]
                out = part.take(pa.array([i for i, _, _ in some]))
                texts = [t if b == 0 and e == rows[i]["size"] else cut(t, b, e) for t, (i, b, e) in zip(out.column(text_at).to_pylist(), some, strict=True)]
                out = out.set_column(text_at, names[text_at], pa.array(texts, part.schema.field(text_at).type))
                if chars_at is not None:
                    out = out.set_column(chars_at, names[chars_at], pa.array([len(t) for t in texts], part.schema.field(chars_at).type))
                yield out

    return joined.mapInArrow(copies, T.StructType(docs.schema.fields))
