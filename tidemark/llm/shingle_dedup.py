"""Near copies by shared word runs: the pipeline's near-copy stage, on operator 6's byte-position index.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of at least 0.8. A text's fingerprint is
the SimHash of that set in 320 bits, 40 positional bytes. At a similarity of 0.8 two fingerprints differ in about 47 bits and share
about 11 positional bytes; strangers differ in 160 and share less than one.

Index: the positions form ten groups of four, and a list is that of two positions of a group with their bytes (60 lists a text).
By the pigeonhole principle a pair that shares eleven positional bytes or more is sure to meet; with fewer it meets if two of them are
of one group. Within a list the shared positional bytes of each pair are tallied over all forty positions; a pair must reach
MIN_SHARED and then differ in RADIUS bits or fewer. What is linked is linked by its exact similarity, on the shingles of whole texts.

Bounds: a list of over SHORT members is not paired off. Its members, in order of their hashes, look at the first HUBS, then the next, and
a member with MOST candidates is done, so a large group of near copies gives links in line with its members; where over LONG are left
after that, they are cut by pairs of positions so that every pair that reaches the minimum still meets. When these links are verified and
their components known, an exact pass goes over the lists in which a member was done early: all candidate pairs whose ends are in
different components are verified too, each in the first list that it is in (where that list went to its end, it has been verified).
So no link is lost to MOST.

Before texts are fetched, sketches of the shingle sets (which of SKETCH buckets their hashes take) bound the similarity of each candidate
pair from above: a shingle in a bucket that the other set leaves empty is not shared. A pair whose bound is below SIMILAR is dropped, so no
link is lost. The exact pass applies this within the lists: only pairs that may be links leave them.

Nulls and edge cases: a null text counts as empty; texts under five words have one shingle, the whole text, and match exactly; a null
doc_id is one like any other, last in order; rows that repeat are copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common, components, near_dedup

SHINGLE, SIMILAR, SEED = 5, 0.8, 42
POSITIONS, GROUP = 40, 4
MIN_SHARED, RADIUS = 6, 60
SKETCH = 2048
LISTS = [pair for g in range(0, POSITIONS, GROUP) for pair in combinations(range(g, g + GROUP), 2)]
#: Pairs that cut a long list. Of the positions in CUTS groups, CUTS + 1 shared ones put two into one group; the list's key has two.
CUTS = MIN_SHARED - 3
SUBLISTS = [pair for g in range(CUTS) for pair in combinations(range(g, POSITIONS, CUTS), 2)]
SHORT, HUBS, ROWS, LONG, MOST = 16, 512, 1024, 4096, 2
#: So many pairs of fingerprints are compared at once.
PAIRS = 1 << 15
#: Texts of so many bytes in all are broadcast to be verified; more are dealt with the pairs.
TEXT_BYTES, KEPT_BYTES = 16 << 20, 32 << 20
#: So many lists that stopped early are broadcast.
EARLY = 100_000
STREAMS = np.array([0x9E3779B97F4A7C15 * (k + 1) % (1 << 64) for k in range(POSITIONS // 8)], dtype=np.uint64)


def shingles(words: list[bytes]) -> np.ndarray:
    """The different hashes of the word runs, sorted."""
    runs = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), dtype=np.uint64))


def fingerprint(hashes: np.ndarray) -> bytes:
    """Each bit is that of over half of the shingles, in as many streams of their hashes as there are words of 64 bits."""
    total = np.zeros(8 * POSITIONS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 13):
        total += near_dedup.votes(common.mix64(hashes[at : at + (1 << 13), None] + STREAMS))
    return np.packbits(2 * total > len(hashes)).tobytes()


def sketch(hashes: np.ndarray) -> bytes:
    """Four bytes of their number, then a bit for each bucket that one of the hashes takes."""
    taken = np.zeros(SKETCH, dtype=np.uint8)
    taken[hashes % np.uint64(SKETCH)] = 1
    return np.uint32(len(hashes)).tobytes() + np.packbits(taken).tobytes()


def possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows of sketches may have a similarity of SIMILAR: no pair that has it is left out."""
    may = np.empty(len(a), dtype=bool)
    for at in range(0, len(a), PAIRS):
        x, y = a[at : at + PAIRS], b[at : at + PAIRS]
        n, m = (np.ascontiguousarray(z[:, :4]).view(np.uint32)[:, 0].astype(np.int64) for z in (x, y))
        x, y = x[:, 4:], y[:, 4:]
        most = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
        may[at : at + PAIRS] = most >= SIMILAR * (n + m - most)
    return may


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, the hash of the words, and the fingerprint and sketch of texts that can have near copies."""
    for batch in batches:
        nodes, prints, sketches = [], [], []
        for _, texts in common.texts_of(batch.column(2)):
            for text in texts:
                words = common.words_of(text)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                hashes = shingles(words) if len(words) >= SHINGLE else None
                prints.append(None if hashes is None else fingerprint(hashes))
                sketches.append(None if hashes is None else sketch(hashes))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "key", "node", "print", "sketch"])


def marks_of(column: pa.ChunkedArray, width: int = POSITIONS) -> np.ndarray:
    """Fingerprints as rows of positional bytes, or sketches as rows of theirs."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1, dtype=np.int64)


def tallied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Candidates among all rows of a and of b (a mask): MIN_SHARED positional bytes, then RADIUS bits."""
    tally = np.zeros((len(a), len(b)), dtype=np.uint8)
    for p in range(POSITIONS):
        tally += a[:, p, None] == b[None, :, p]
    near = tally >= MIN_SHARED
    i, j = np.nonzero(near)
    for at in range(0, len(i), PAIRS):
        p, q = i[at : at + PAIRS], j[at : at + PAIRS]
        near[p, q] = bits_between(a[p], b[q]) <= RADIUS
    return near


def near_pairs(marks: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of places that are candidates."""
    enough = near_dedup.shared_bytes(marks[i], marks[j]) >= MIN_SHARED
    i, j = i[enough], j[enough]
    near = bits_between(marks[i], marks[j]) <= RADIUS
    return i[near], j[near]


def _cut(marks: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Candidate pairs (rows of u, v, u < v) of the places left of a list, by sublists."""
    found = []
    for p, q in SUBLISTS:
        code = marks[left, p].astype(np.int64) << 8 | marks[left, q]
        order = np.argsort(code, kind="stable")
        at, code = left[order], code[order]
        first, length = near_dedup.runs(code)
        for i, j in near_dedup.pairs_of(code, np.repeat(length, length), SHORT):
            found.append(np.stack(near_pairs(marks, at[i], at[j]), axis=1))
        for a, n in zip(first[length > SHORT], length[length > SHORT], strict=True):
            own = at[a : a + n]
            found += [own[pair] for pair in _hubs(marks[own], np.arange(n), len(own))[0]]
    return np.unique(np.concatenate([np.zeros((0, 2), dtype=np.int64), *found]), axis=0)


def _hubs(marks: np.ndarray, left: np.ndarray, until: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(parts of rows u, v), places left, candidates found of each place: members look at hubs before them, block by block."""
    count, found = np.zeros(len(marks), dtype=np.int64), []
    for h in range(0, until, HUBS):
        hubs, rows = np.arange(h, min(h + HUBS, until)), left[left > h]
        for r in range(0, len(rows), ROWS):
            some = rows[r : r + ROWS]
            near = tallied(marks[some], marks[hubs]) & (hubs[None, :] < some[:, None])
            near &= near.cumsum(axis=1) + count[some, None] <= MOST
            i, j = np.nonzero(near)
            found.append(np.stack([hubs[j], some[i]], axis=1))
            count[some] += near.sum(axis=1)
        left = left[count[left] < MOST]
    return found, left, count


def candidates(marks: np.ndarray) -> tuple[np.ndarray, bool]:
    """(rows of places u, v, whether a member was done early) of one long list."""
    m = len(marks)
    found, left, count = _hubs(marks, np.arange(m), m if m <= LONG else HUBS)
    early = bool((count >= MOST).any())
    if m > LONG:
        if len(left) <= LONG:
            more, _, again = _hubs(marks[left], np.arange(len(left)), len(left))
            found += [left[x] for x in more]
            early |= bool((again >= MOST).any())
        else:
            pairs = _cut(marks, left)
            pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))]
            first, length = near_dedup.runs(pairs[:, 1]) if len(pairs) else (np.zeros(0, int), np.zeros(0, int))
            found.append(pairs[np.arange(len(pairs)) - np.repeat(first, length) < MOST])
            early |= bool((length >= MOST).any())
    return np.concatenate([np.zeros((0, 2), dtype=np.int64), *found]), early


def across(marks: np.ndarray, label: np.ndarray) -> Iterator[np.ndarray]:
    """All candidate pairs (rows of places) of one list whose labels differ. Linear in the members where nearly all have one label."""
    values, place, count = np.unique(label, return_inverse=True, return_counts=True)
    few = np.flatnonzero(place != count.argmax())
    for r in range(0, len(few), ROWS):
        some = few[r : r + ROWS]
        for c in range(0, len(marks), HUBS):
            others = np.arange(c, min(c + HUBS, len(marks)))
            near = tallied(marks[some], marks[others]) & (place[some, None] != place[None, others])
            i, j = np.nonzero(near)
            yield np.stack([some[i], others[j]], axis=1)


def first_list(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of the first list in which each pair of rows meets."""
    same = a == b
    return np.argmax(same[:, [p for p, _ in LISTS]] & same[:, [q for _, q in LISTS]], axis=1)


def _pairs(node: np.ndarray, marks: np.ndarray, found: list[np.ndarray]) -> list[np.ndarray]:
    """Nodes u < v and their differing bits."""
    places = np.concatenate([np.zeros((0, 2), dtype=np.int64), *found])
    ends = np.sort(node[places], axis=1)
    return [ends[:, 0], ends[:, 1], bits_between(marks[places[:, 0]], marks[places[:, 1]])]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, u, v, differ); a list in which a member was done early has one more row, without u and v."""
    for table in near_dedup.whole_lists(batches):
        key, node, marks = table.column(0).to_numpy(), table.column(1).to_numpy(), marks_of(table.column(2))
        first, length = near_dedup.runs(key)
        found = [np.stack(near_pairs(marks, i, j), axis=1) for i, j in near_dedup.pairs_of(key, np.repeat(length, length), SHORT)]
        early = []
        for a, n in zip(first[length > SHORT], length[length > SHORT], strict=True):
            pairs, capped = candidates(marks[a : a + n])
            found.append(pairs + a)
            early += [key[a]] * capped
        u, v, differ = _pairs(node, marks, found)
        lists = np.r_[np.zeros(len(u), dtype=np.int64), np.array(early, dtype=np.int64)]
        none = np.arange(len(lists)) >= len(u)
        columns = [pa.array(np.r_[x, np.zeros(len(early), dtype=np.int64)], mask=none) for x in (u, v, differ)]
        yield pa.RecordBatch.from_arrays([pa.array(lists, mask=~none), *columns], ["list", "u", "v", "differ"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in near_dedup.whole_lists(batches):
        key, node, marks, label, at = table.column(0).to_numpy(), table.column(1).to_numpy(), marks_of(table.column(2)), table.column(3).to_numpy(), table.column(5).to_numpy()
        sketches = marks_of(table.column(4), SKETCH // 8 + 4)
        for a, n in zip(*near_dedup.runs(key), strict=True):
            for found in across(marks[a : a + n], label[a : a + n]):
                for k in range(0, len(found), PAIRS):
                    part = found[k : k + PAIRS] + a
                    part = part[first_list(marks[part[:, 0]], marks[part[:, 1]]) == at[a]]
                    part = part[possible(sketches[part[:, 0]], sketches[part[:, 1]])]
                    u, v, _ = _pairs(node, marks, [part])
                    yield pa.RecordBatch.from_arrays([pa.array(u.copy()), pa.array(v.copy())], ["u", "v"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are the sketches of a pair; the others of pairs that may be links stay as they are."""
    for batch in batches:
        *kept, a, b = batch.columns
        may = possible(*(marks_of(c, SKETCH // 8 + 4) for c in (a, b)))
        yield pa.RecordBatch.from_arrays(kept, batch.schema.names[:-2]).filter(pa.array(may))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs come sorted by u. Shingles of texts are kept while they take KEPT_BYTES or less."""
    known: dict[str, np.ndarray] = {}
    held = 0

    def of(text: str) -> np.ndarray:
        nonlocal held
        if (found := known.get(text)) is None:
            if held > KEPT_BYTES:
                known.clear()
                held = 0
            found = known[text] = shingles(common.words_of(text))
            held += found.nbytes + 4 * len(text)
        return found

    for batch in batches:
        good = []
        for at, texts in common.texts_of(batch.column(2)):
            for a, b in zip(texts, batch.column(3).slice(at, len(texts)).to_pylist(), strict=True):
                x, y = of(a), of(b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= SIMILAR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))


def nodes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, node, print, sketch) of every row: node is the hash of a text's words; texts under five words have no print and sketch."""
    common.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), near_dedup.text_key().alias("key"), "text").mapInArrow(_nodes, "doc_id long, key long, node long, print binary, sketch binary").checkpoint()


def _lists(prints: DataFrame, *more: str, only: DataFrame | None = None) -> DataFrame:
    keys = [F.concat(F.substring("print", p + 1, 1), F.substring("print", q + 1, 1)) for p, q in LISTS]
    return near_dedup.postings(prints, keys, "node", "print", *more, only=only)


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): nodes with a similarity of at least SIMILAR, enough of them for the components of all candidates that have it."""
    spark = docs.sparkSession
    rows = nodes.count()
    cut = lambda df: common.cut(df, rows)
    prints = nodes.where("print IS NOT NULL").groupBy("node").agg(F.first("print").alias("print"), F.first("sketch").alias("sketch"))
    found = cut(_lists(prints).drop("at").mapInArrow(_candidates, "list long, u long, v long, differ long"))
    # u is the smaller of a pair; the likeliest of each v is verified first, the rest only where it still joins something
    pairs = found.where("u IS NOT NULL").select("u", "v", "differ").distinct()
    one, two = (prints.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "uv")
    pairs = pairs.join(one, "u").join(two, "v").select("u", "v", "differ", "sketch_u", "sketch_v").mapInArrow(_possible, "u long, v long, differ long")
    pairs = cut(pairs.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("differ", "u"))))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), near_dedup.text_key().alias("key"), "text")

    def texts_of(some: DataFrame) -> DataFrame:
        """One text of each node in a pair."""
        wanted = some.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("at")
        place = cut(nodes.join(wanted, "node").groupBy("node").agg(least).select("node", F.col("at.doc_id").alias("_id"), F.col("at.key").alias("_key")))
        near = common.marked(keyed, F.xxhash64("doc_id", "key"), common.bitmap(place.select(F.xxhash64("_id", "_key"))))  # the other texts are not dealt out
        return cut(near.join(place, (near["key"] == place["_key"]) & near["doc_id"].eqNullSafe(place["_id"])).groupBy("node").agg(F.first("text").alias("text")))

    def verified(some: DataFrame, texts: DataFrame) -> DataFrame:
        few = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= TEXT_BYTES
        one, two = texts.select(F.col("node").alias("u"), F.col("text").alias("a")), texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
        if few:
            both = some.select("u", "v").repartition("u").join(F.broadcast(two), "v").join(F.broadcast(one), "u")
        else:
            both = some.select("u", "v").join(two, "v").join(one, "u")
        return cut(both.select("u", "v", "a", "b").sortWithinPartitions("u").mapInArrow(_verified, "u long, v long"))

    def between(some: DataFrame, root: DataFrame) -> DataFrame:
        of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        return some.join(of("u"), "u", "left").join(of("v"), "v", "left").where("coalesce(root_u, u) <> coalesce(root_v, v)").select("u", "v")

    texts = texts_of(pairs)
    first = verified(pairs.where("n = 1"), texts)
    rest = cut(between(pairs.where("n > 1"), components.roots(spark, first, rows)))
    wanted = rest.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    good = first.unionByName(verified(rest, cut(texts.join(wanted, "node", "left_semi"))))
    early = found.where("u IS NULL").select("list").distinct()
    early = cut(early)
    if early.isEmpty():
        return good
    # the exact pass: candidate pairs between components in the lists that stopped early, less those that are verified
    root = components.roots(spark, good, rows)
    labelled = prints.join(root, "node", "left").select("node", "print", F.coalesce("root", "node").alias("label"), "sketch")
    again = _lists(labelled, "label", "sketch", only=F.broadcast(early) if early.count() <= EARLY else early)
    more = again.mapInArrow(_across, "u long, v long").distinct()
    more = cut(more.join(pairs.where("n = 1").select("u", "v").unionByName(rest), ["u", "v"], "left_anti"))
    return good if more.isEmpty() else good.unionByName(verified(more, texts_of(more)))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each component exactly one row stays, that with the smallest doc_id."""
    nodes = nodes_of(docs)
    root = components.roots(spark, links(docs, nodes), nodes.count())
    named = common.cut(nodes.select("doc_id", "key", "node").join(root, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root")), nodes.count())
    return near_dedup.one_per_component(docs, named)
