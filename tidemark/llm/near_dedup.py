"""SimHash near-duplicates (operator 6): a byte-position inverted index with count filtering.

A fingerprint has positional bytes. Two fingerprints of eight bytes within two bits differ in two bytes at most, so they share at
least six: the guaranteed minimum. A posting list for each byte and position would hold 1/256 of all rows, and tallying all its pairs
would grow with the square of the corpus. So a list is that of several positions at once with their bytes, chosen so that every pair
that reaches the minimum meets: two differing bytes touch two of the four byte pairs, and the other two pairs are a list's key (six
lists a fingerprint, of four bytes each). Within a list the shared positional bytes of each pair are tallied over all eight positions,
pairs under six are dropped, and the rest is verified on its bits.

Lists of over SHORT members are not paired off: they are cut again by all sets of six positions, where a pair meets exactly if its
tally reaches six. Members of such a part differ in two bytes, so it holds at most 65,536 fingerprints, whatever the corpus, and the
union over true neighbours gives a star per local component: linear in the members, no connectivity lost. Copies never meet in a
list, as only distinct fingerprints enter.

Nulls and edge cases: a null text counts as empty; empty texts have fingerprint zero and are linked like any other; a null
doc_id takes part, never names a component unless its component has no other, and repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
POSITIONS = BITS // 8
MIN_SHARED = POSITIONS - RADIUS
#: Positions of each list: two of the four byte pairs.
LISTS = [(*a, *b) for a, b in combinations([(p, p + 1) for p in range(0, POSITIONS, 2)], 2)]
PARTS = [sum(0xFF << (8 * p) for p in kept) for kept in combinations(range(POSITIONS), MIN_SHARED)]
#: All changes of at most two of the 16 bits that are left free in a part of a list.
FLIPS = np.array([1 << a for a in range(16)] + [(1 << a) | (1 << b) for a in range(16) for b in range(a)], dtype=np.int64)
ROWS_OF_HASHES, SHORT = 255, 32


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the rows of hashes (uint64, rows x words) set each bit; little-endian, so bit b of a word is its place b."""
    total = np.zeros(hashes.shape[1] * 64, dtype=np.int64)
    for at in range(0, len(hashes), ROWS_OF_HASHES):  # so many that a byte holds the count
        part = np.ascontiguousarray(hashes[at : at + ROWS_OF_HASHES]).view(np.uint8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str | None) -> int:
    """Bit b is set if it is set in over half of the XXH64 (seed 42) of the word shingles, repeats included."""
    words = common.words_of(text)
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
    n, total = len(shingles), np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        part = shingles[at : at + (1 << 15)]
        total += votes(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), dtype="<u8", count=len(part)).reshape(-1, 1))
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column is the text; the others stay as they are."""
    for batch in batches:
        out = np.empty(batch.num_rows, dtype=np.uint64)
        *kept, column = batch.columns
        for at, texts in common.texts_of(column):
            out[at : at + len(texts)] = [fingerprint(t) for t in texts]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(out.view(np.int64))], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally of each pair of rows: positions at which both have the same byte (uint8, rows x positions)."""
    return (a == b).sum(axis=1, dtype=np.uint8)


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches come sorted by their first column; the tables hold whole lists of it, so a list that goes on is carried over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        start = int(np.searchsorted(key, key[-1]))
        if held and (start or held[-1].column(0)[0].as_py() != key[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        elif start:
            yield pa.Table.from_batches([batch.slice(0, start)])
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal keys."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return first, np.diff(np.r_[first, len(key)])


def pairs_of(key: np.ndarray, length: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of all pairs within runs of at most `most`; length: that of each place's run."""
    some = np.flatnonzero((length > 1) & (length <= most))
    for d in range(1, int(length[some].max(initial=0))):
        i = some[some + d < len(key)]
        i = i[key[i] == key[i + d]]
        if len(i):
            yield i, i + d


def near_pairs(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of places share MIN_SHARED positional bytes or more and then differ in RADIUS bits or fewer."""
    marks = fp.view(np.uint8).reshape(-1, POSITIONS)
    enough = shared_bytes(marks[i], marks[j]) >= MIN_SHARED
    enough[enough] = np.bitwise_count(fp[i[enough]] ^ fp[j[enough]]) <= RADIUS
    return enough


def link_part(members: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a star for each component of two or more; members: distinct uint64 that share six bytes."""
    m = len(members)
    diff = int(np.bitwise_or.reduce(members ^ members[0]))
    free = [8 * p for p in range(POSITIONS) if (diff >> (8 * p)) & 0xFF]
    small = np.zeros(m, dtype=np.int64)
    for k, shift in enumerate(free):
        small |= ((members >> np.uint64(shift)) & np.uint64(0xFF)).astype(np.int64) << (8 * k)
    at = np.full(1 << 16, -1, dtype=np.int64)
    at[small] = np.arange(m)
    rows, cols = [], []
    for flip in FLIPS:
        other = at[small ^ flip]
        hit = np.flatnonzero(other >= 0)
        rows.append(hit)
        cols.append(other[hit])
    rows_, cols_ = np.concatenate(rows), np.concatenate(cols)
    root = np.arange(m)
    while True:
        new = root.copy()
        np.minimum.at(new, rows_, root[cols_])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(m))
    return list(zip(members[root[moved]].tolist(), members[moved].tolist(), strict=True))


def link_list(members: np.ndarray) -> list[tuple[int, int]]:
    """Edges within one long list that keep its components; members: distinct uint64."""
    edges = []
    for mask in PARTS:
        shared = members & np.uint64(mask)
        order = np.argsort(shared, kind="stable")
        sorted_, shared = members[order], shared[order]
        first, length = runs(shared)
        for i, j in pairs_of(shared, np.repeat(length, length), SHORT):
            good = near_pairs(sorted_, i, j)
            edges += zip(sorted_[i[good]].tolist(), sorted_[j[good]].tolist(), strict=True)
        for a, n in zip(first[length > SHORT], length[length > SHORT], strict=True):
            edges += link_part(sorted_[a : a + n])
    return edges


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_lists(batches):
        key, fp = table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64)
        first, length = runs(key)
        found = []
        for i, j in pairs_of(key, np.repeat(length, length), SHORT):
            good = near_pairs(fp, i, j)
            found.append(np.stack([fp[i[good]], fp[j[good]]], axis=1))
        for a, n in zip(first[length > SHORT], length[length > SHORT], strict=True):
            found.append(np.array(link_list(fp[a : a + n]), dtype=np.uint64).reshape(-1, 2))
        pairs = np.concatenate([np.zeros((0, 2), dtype=np.uint64), *found]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])


def postings(rows: DataFrame, keys: list[Column], *columns: str, only: DataFrame | None = None) -> DataFrame:
    """(list, columns, at): each row under its keys, of which at is the number; lists whole and sorted within partitions. Keys of different numbers may be equal.

    only: the lists that are wanted, (list); the others are left out before anything is dealt.
    """
    # by hash: two lists that fall together cost a few tallies and change no result
    keyed = rows.select(F.posexplode(F.array(*keys)).alias("at", "key"), *columns).select(F.xxhash64("at", "key").alias("list"), *columns, "at")
    if only is not None:
        keyed = keyed.join(only, "list", "left_semi")
    return keyed.repartition("list").sortWithinPartitions("list", columns[0])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): linked fingerprints out of a table of distinct ones; connectivity is that of all pairs within two bits."""
    masks = [sum(0xFF << (8 * p) for p in kept) for kept in LISTS]
    keys = [F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks]
    return postings(distinct, keys, "fp").drop("at").mapInArrow(_linked, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most two bits."""
    spark = common.prepare(docs.sparkSession)
    # The texts are read once; what later steps need of them is 16 bytes a document.
    prints = fingerprints(docs, id_col, text_col).checkpoint()
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")).checkpoint()
    roots = components.roots(spark, links(distinct))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id for every document."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_key() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def one_per_component(docs: DataFrame, named: DataFrame) -> DataFrame:
    """One row of docs per component: that of the smallest doc_id (null comes last), then of the smallest key.

    named: (doc_id, key, root) of every row, key as by text_key(). Rows that agree in doc_id and text are of one component.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "count")).alias("first")
    groups = named.groupBy("root", "doc_id", "key").count().groupBy("root").agg(first, F.sum("count").alias("rows"))
    groups = common.cut(groups, named.count())
    # a row alone in its component stays where it is; only those that may be of a larger one are dealt out with their texts
    larger = common.bitmap(groups.where("rows > 1").select("root")).checkpoint()
    members = common.bitmap(common.marked(named, F.col("root"), larger).select(F.xxhash64("doc_id", "key"))).checkpoint()
    hashed = F.xxhash64(F.col("doc_id").cast("long"), text_key())
    keep = groups.select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_text"), F.col("first.count").alias("_n"))
    keep = common.marked(keep, F.xxhash64("_id", "_text"), members).checkpoint()
    keyed = common.marked(docs, hashed, members).withColumn("_key", text_key())
    same = lambda other: keyed["doc_id"].cast("long").eqNullSafe(other["_id"]) & (keyed["_key"] == other["_text"])
    once, several = keep.where("_n = 1"), keep.where("_n > 1")
    kept = keyed.join(once, same(once), "left_semi")
    if not several.isEmpty():
        kept = kept.unionByName(keyed.join(several, same(several), "left_semi").dropDuplicates(["doc_id", "_key"]))
    return common.marked(docs, hashed, members, "left_anti").unionByName(kept.drop("_key"))
