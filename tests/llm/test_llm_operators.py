"""Each operator against brute force, and on awkward and empty tables."""

import collections
import concurrent.futures
import hashlib
import itertools
import math
import random
import textwrap
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, components, fingerprints, language_id, licenses, lm_scoring, mixing, near_dedup, packing, registry, sharding, shingle_dedup, topk, toxicity


def rows(df):
    return [r.asDict() for r in df.collect()]


# 1


def brute_top(vectors, queries, k):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in whole:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("bins", [4, 1024])
def test_topk(spark, monkeypatch, bins):
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = random.Random(2)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    vectors += [(100 + i, vectors[0][1]) for i in range(12)] + [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (204, [1.0, 2.0]), (210, [0.5, 0.25])]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<float>, rank int, score string").repartition(4)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.search(df.where("vec_id % 10 = 0"), df)))
    assert got == brute_top(single, [i for i, _ in vectors if i % 10 == 0], 5)


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, df).count() == 0


def test_topk_exact_for_large_values():
    a, b = np.array([[float(1 << 40), 1.0]]), np.array([[float(1 << 20), 3.0]])
    assert topk.inner(a, b).tolist() == [[(1 << 60) + 3]]


# 2


def test_fingerprint_rows(spark, odd, none, monkeypatch, tmp_path):
    got = rows(fingerprints.with_next(odd).mapInArrow(fingerprints._described, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))
    docs = sorted(((r["doc_id"], r["text"] or "") for r in rows(odd.select("doc_id", "text"))), key=lambda r: -(r[0] if r[0] is not None else -(1 << 63)))
    want = collections.Counter()
    for i, (doc_id, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        e = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        want[doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.fingerprint(t).hex(), fingerprints.fingerprint(e).hex()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.with_next(none).count() == 0


def test_fingerprint_tells_edits_from_strangers(spark, sf):
    got = rows(fingerprints.query(spark, sf))
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.97 * len(got)


@pytest.mark.parametrize("bits, radius, blocks", [(64, 3, None), (64, 3, 6), (128, 2, None)])
def test_neighbours(spark, bits, radius, blocks):
    rng = random.Random(3)
    values = [rng.getrandbits(bits) for _ in range(30)]
    for v in list(values):
        for _ in range(4):
            values.append(v ^ sum(1 << b for b in rng.sample(range(bits), rng.randint(0, radius + 2))))
    prints = sorted({f"{v:0{bits // 4}x}" for v in values})
    want = {(a, b) for a, b in itertools.combinations(prints, 2) if (int(a, 16) ^ int(b, 16)).bit_count() <= radius}
    df = spark.createDataFrame([(p,) for p in prints * 2], "fingerprint string")
    assert {(r["a"], r["b"]) for r in rows(fingerprints.neighbours(df, radius, blocks))} == want


# 3


def check_packed(df, pieces, length):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    tk.encode_special_tokens = False
    want = collections.Counter()
    for r in rows(df.select("doc_id", "text")):
        want[r["doc_id"], np.array([*tk.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID], "<u4").tobytes()] += 1
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in rows(pieces):
        assert p["length"] * 4 == len(p["ids"])
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1]] and sum(p["length"] for p in own) <= length
    sizes = [sum(p["length"] for p in own) for own in by_sequence.values()]
    assert sum(0 if n & (n - 1) == 0 else length - n for n in sizes) == 0
    spare = collections.Counter()
    for (doc_id, ids), n in want.items():
        own = by_doc[doc_id, len(ids) // 4]
        got = collections.Counter((p["start"], bytes(p["ids"])) for p in own)
        covered = sum(len(b) * k for (s, b), k in got.items() if ids[4 * s : 4 * s + len(b)] == b)
        assert covered >= n * len(ids)
        spare[doc_id] += n * len(ids)
    assert sum(spare.values()) == sum(4 * p["length"] for own in by_doc.values() for p in own)


def test_packing(odd, none):
    for length in (64, 4096):
        check_packed(odd, packing.pack(odd, length=length, open_windows=4), length)
    assert packing.pack(none).count() == 0


def test_windows_are_bounded():
    rng, windows = random.Random(4), packing.Windows(100, 3)
    done = []
    for d in range(500):
        done += list(windows.add(d, bytes(4 * rng.randint(1, 99))))
        assert len(windows.held) <= 3
    full, rest = windows.merge()
    assert all(sum(len(p[2]) for p in s) == 400 for s in [*done, *full])
    assert all((sum(len(p[2]) // 4 for p in s) & (sum(len(p[2]) // 4 for p in s) - 1)) == 0 for s in packing.in_powers(rest))


# 4


def test_store(spark, odd, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s", target=60_000, fan_in=3)
    for k in range(4):
        store.append(odd.where(F.pmod(F.xxhash64("text"), F.lit(4)) == k))
    first, before = store.version(), len(store.shards())
    last = store.compact()
    assert last > first and len(store.shards()) < before
    key = lambda df: sorted(map(str, df.select(*odd.columns).collect()))
    assert key(store.read()) == key(odd)
    assert not store.plan(store.shards())
    with pytest.raises(FileExistsError):
        store._commit([], last - 1)
    with pytest.raises(FileNotFoundError):
        sharding.Store(spark, f"file://{tmp_path}/none").read()
    empty = sharding.Store(spark, f"file://{tmp_path}/e")
    empty.append(odd.limit(0))
    assert empty.read().count() == 0 if empty.shards() else True


def test_vacuum_spares_readers_and_writers(spark, odd, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s", target=60_000, fan_in=2)
    for k in range(2):
        store.append(odd.where(F.pmod(F.xxhash64("text"), F.lit(2)) == k))
    old = store.read()
    store.compact()
    key = lambda df: sorted(map(str, df.select(*odd.columns).collect()))
    assert key(old) == key(odd) and key(store.read(2)) == key(odd)  # a reader of the version before goes on
    arrival = store._write(odd)  # an arrival that is written, but not yet committed
    assert store.vacuum() == 0
    store._commit([*store.shards(), *arrival], store.version())
    assert store.read().count() == 2 * odd.count()
    assert store.vacuum(grace=-10.0) > 0 and store.read().count() == 2 * odd.count()


def test_one_of_two_writers_commits(spark, odd, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s")
    store.append(odd)
    one, two = store._write(odd), store._write(odd)
    before = store.version()
    with concurrent.futures.ThreadPoolExecutor(2) as pool:
        tries = [pool.submit(store._commit, [*store.shards(before), *part], before) for part in (one, two)]
    failed = [t.exception() for t in tries if t.exception()]
    assert len(failed) == 1 and isinstance(failed[0], FileExistsError)
    assert store.version() == before + 1 and store.read().count() == 2 * odd.count()


def test_arrivals_of_other_columns(spark, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s", fan_in=2)
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, "b", 5)], "doc_id long, text string, more int"))
    store.compact()
    assert sorted(map(tuple, store.read().select("doc_id", "text", "more").collect())) == [(1, "a", None), (2, "b", 5)]


def test_sharding_query(spark, sf, documents):
    got = rows(sharding.query(spark, sf))
    want = documents.select("doc_id", F.xxhash64("text").alias("h")).collect()
    assert sorted((r["doc_id"], r["text_hash"]) for r in got) == sorted(map(tuple, want))
    assert all(r["shard"] for r in got) and len({r["version"] for r in got}) == 1


# 5


def test_targets():
    got = mixing.targets({"a": 100, "b": 10, "c": 1000, None: 0}, {"a": 1, "b": 2, "c": 3, None: 1})
    assert got["b"] == 30 and got[None] == 0 and sum(got.values()) == pytest.approx(1110) and got["c"] == pytest.approx(3 * got["a"])


def test_apportion_is_highest_quotients():
    rng = random.Random(6)
    for _ in range(50):
        votes = [rng.choice([0.0, rng.uniform(1, 50)]) for _ in range(6)] + [1.0]
        limits, seats = [rng.randint(1, 40) for _ in votes], rng.randint(0, 60)
        want = [0] * len(votes)
        for _ in range(min(seats, sum(n for v, n in zip(votes, limits, strict=True) if v))):
            i = max((i for i in range(len(votes)) if want[i] < limits[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        got = mixing.apportion(votes, sum(want), limits)
        assert sum(got) == sum(want) and got == want


def test_mix(odd, none):
    got = rows(mixing.mix(odd, block=4))
    assert len(got) == odd.count()
    size = {(r["doc_id"], common.word_count(r["text"])) for r in rows(odd.select("doc_id", "text"))}
    assert {(r["doc_id"], r["size"]) for r in got} == size and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for own in by.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own) and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 16
    key = lambda xs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in xs)
    assert key(rows(mixing.mix(odd.repartition(7), block=4))) == key(got)
    assert mixing.mix(none).count() == 0


def test_mix_stage(spark, odd, none, sf):
    """Rows with null and repeated ids, repeated rows too: the words that come out are those that the mix takes, row by row."""
    rng = random.Random(5)
    ids = [None, None, None, 7, 7, 7, 1, 2, 3, 3]
    texts = [" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randint(30, 300))) for _ in ids]
    texts[9] = texts[8]
    clones = spark.createDataFrame([(i, t, "en", "ab"[k % 2], len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))] * 2 + [(9, texts[0], "en", "c", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (odd, clones.repartition(3)):
        out = mixing.repeat(spark, df, sf)
        assert out.dtypes == df.dtypes
        taken, got = collections.Counter(), collections.Counter()
        for r in rows(mixing.mix(df)):
            taken[r["doc_id"], r["source"]] += r["taken"]
        whole = collections.defaultdict(list)
        for r in rows(df):
            whole[r["doc_id"], r["source"]].append(r["text"] or "")
        for r in rows(out):
            got[r["doc_id"], r["source"]] += common.word_count(r["text"])
            assert any(r["text"] in t for t in whole[r["doc_id"], r["source"]])
        assert got == +taken
        most = collections.Counter()
        for r in rows(df):
            most[r["text"]] += 3 * common.word_count(r["text"])
        for t, r in itertools.groupby(sorted((r for r in rows(out) if r["text"] in most), key=lambda r: r["text"]), key=lambda r: r["text"]):
            assert sum(common.word_count(x["text"]) for x in r) <= most[t]
    assert mixing.repeat(spark, none, sf).count() == 0


# 6


def brute_components(docs):
    prints = [(i, near_dedup.fingerprint(t)) for i, t in docs]
    root = {f: f for _, f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[find(f)].append(i)
    return sorted((str(i), f, min(least[find(f)], default=None)) for i, f in prints)


def test_near_dedup(odd, none, documents):
    for df in (odd, documents):
        got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in rows(near_dedup.near_duplicates(df)))
        assert got == brute_components([(r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text"))])
    assert near_dedup.near_duplicates(none).count() == 0


def test_fingerprint_definition():
    words = "Some words OF a text, and some more words".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert near_dedup.fingerprint("Some words OF a text,\tand some more words") == want
    assert near_dedup.fingerprint("two Words") == xxhash.xxh64_intdigest("two words", 42) and near_dedup.fingerprint(None) == near_dedup.fingerprint(" \n") == 0


def test_lists_meet_every_pair_of_the_least_tally():
    for differ in itertools.combinations(range(8), 2):
        assert any(not set(differ) & set(kept) for kept in near_dedup.LISTS)


def test_tally():
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fp = np.array([base, base ^ 1, base ^ 0x0101, base ^ 0x010101, base ^ 0x03, base ^ 0x07, rng.getrandbits(64)], dtype=np.uint64)
    i, j = np.triu_indices(len(fp), 1)
    marks = fp.view(np.uint8).reshape(-1, 8)
    want = [sum(x == y for x, y in zip(int(fp[a]).to_bytes(8), int(fp[b]).to_bytes(8), strict=True)) for a, b in zip(i, j, strict=True)]
    assert near_dedup.shared_bytes(marks[i], marks[j]).tolist() == want
    bits = [(int(fp[a]) ^ int(fp[b])).bit_count() for a, b in zip(i, j, strict=True)]
    assert near_dedup.near_pairs(fp, i, j).tolist() == [b <= 2 for b in bits]  # two bits imply six bytes


def whole_or_linked(found, members):
    """Components of members by the edges found, as sets."""
    root = {m: m for m in members}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for m in members:
        groups[find(m)].add(m)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("free, flips, n", [(16, 6, 300), (40, 5, 400), (64, 3, 40)])
def test_long_lists(spark, free, flips, n):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    members = sorted({base ^ sum(1 << b for b in rng.sample(range(free), rng.randint(0, flips))) for _ in range(n)})
    want = whole_or_linked([(a, b) for a, b in itertools.combinations(members, 2) if (a ^ b).bit_count() <= 2], members)
    assert whole_or_linked(near_dedup.link_list(np.array(members, dtype=np.uint64)), members) == want
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in members]
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in near_dedup.links(spark.createDataFrame(signed, "fp long")).collect()]
    assert whole_or_linked(edges, members) == want


@pytest.mark.parametrize("chunk", [1, 7, 60, 1000])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(9)
    edges = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(45)] + [(1000 + i, 1001 + i) for i in range(30)]
    got = {r["node"]: r["root"] for r in rows(components.roots(spark, spark.createDataFrame(edges, "u long, v long")))}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: r for x, r in root.items() if x in linked}


def test_contracted_chunks():
    rng = np.random.default_rng(2)
    for links in (1, 30, 3000):
        u, v = rng.integers(-(1 << 63), 1 << 63, (2, 2000))[:, rng.integers(0, 2000, (2, links))[0]]
        u, v = np.r_[u, v[:-1]], np.r_[v, v[1:]]
        low, node = components.contracted(u, v)
        assert (low < node).all() and len(set(node.tolist())) == len(node)
        root = dict(zip(node.tolist(), low.tolist(), strict=True))
        assert all(root.get(a, a) == root.get(b, b) for a, b in zip(u.tolist(), v.tolist(), strict=True))


def test_bitmap_misses_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "WORD_BITS", 6)
    some, all_ = spark.range(0, 3000, 30).select(F.xxhash64("id").alias("h")), spark.range(3000).select("id", F.lit(1).alias("_word"))
    bits = common.bitmap(some)
    assert bits.count() <= 64
    inside, outside = ({r["id"] for r in common.marked(all_, F.xxhash64("id"), bits, how).collect()} for how in ("left_semi", "left_anti"))
    assert set(range(0, 3000, 30)) <= inside and inside | outside == set(range(3000)) and not inside & outside and len(outside) > 2000


def test_keep_one_of_null_and_repeated_ids(spark, sf):
    rng = random.Random(3)
    a, b, c, d, e = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(5)]
    docs = spark.createDataFrame([(None, a, "x"), (None, b, "x"), (None, b, "y"), (5, c, "x"), (5, d, "x"), (5, d, "y"), (3, e, "x"), (5, e, "x"), (None, e, "x"), (None, c, "x")], "doc_id long, text string, lang string").repartition(3)
    got = collections.Counter((r["doc_id"], r["text"]) for r in rows(shingle_dedup.keep_one(spark, docs, sf)))
    assert got == {(None, a): 1, (None, b): 1, (5, c): 1, (5, d): 1, (3, e): 1}


def near_texts(rng, families, changes):
    texts = []
    for _ in range(families):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 200))]
        for n in changes:
            copy = list(words)
            for at in rng.sample(range(len(words)), n):
                copy[at] = f"w{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    return texts


def similar(texts):
    """Pairs of places with a similarity of 0.8 or more, by all pairs."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return [(j, i) for j, i in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def test_stage_finds_near_copies_by_similarity(spark, sf):
    """The stage against all pairs: nothing that has no near copy goes, and nine of ten near copies at least do."""
    texts = near_texts(random.Random(4), 30, (0, 1, 1, 2, 3, 6))
    texts += ["one two", "One  two", "", None, "one two three four five", "one two three four five six"]
    groups = whole_or_linked(similar(texts), range(len(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in rows(dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf))}
    assert all(g[0] in got for g in groups)
    gone = len(texts) - len(got)
    assert 0.9 * (len(texts) - len(groups)) <= gone <= len(texts) - len(groups)
    assert shingle_dedup.keep_one(spark, docs.limit(0), sf).count() == 0


@pytest.mark.parametrize("families, times", [(3, 1), (1, 6)])
def test_links_connect_all_candidates(spark, families, times):
    """The components are those of all pairs that meet, reach the tally and are similar; lists of over SHORT, with an exact pass, too."""
    texts = near_texts(random.Random(7), families, (0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9) * times)
    prints = [np.frombuffer(shingle_dedup.fingerprint(shingle_dedup.shingles(common.words_of(t))), dtype=np.uint8) for t in texts]
    meet = lambda a, b: any((a[list(kept)] == b[list(kept)]).all() for kept in shingle_dedup.LISTS)
    near = lambda a, b: (a == b).sum() >= shingle_dedup.MIN_SHARED and np.bitwise_count(a ^ b).sum() <= shingle_dedup.RADIUS
    want = whole_or_linked([(i, j) for i, j in similar(texts) if meet(prints[i], prints[j]) and near(prints[i], prints[j])], range(len(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    nodes = shingle_dedup.nodes_of(docs)
    rows_of = nodes.collect()
    place = {r["node"]: r["doc_id"] for r in rows_of}
    copies = [(place[r["node"]], r["doc_id"]) for r in rows_of]
    found = [(place[r["u"]], place[r["v"]]) for r in shingle_dedup.links(docs, nodes).collect()]
    assert set(map(tuple, map(sorted, found))) <= set(similar(texts))
    assert whole_or_linked(found + copies, range(len(texts))) == want


@pytest.mark.parametrize("short, hubs, long", [(32, 512, 4096), (2, 8, 16), (3, 50, 100)])
def test_long_list_of_strangers_and_copies(monkeypatch, short, hubs, long):
    for name, value in {"SHORT": short, "HUBS": hubs, "LONG": long}.items():
        monkeypatch.setattr(shingle_dedup, name, value)
    rng = np.random.default_rng(1)
    marks = rng.integers(0, 256, (300, shingle_dedup.POSITIONS), dtype=np.uint8)
    marks[100:] = marks[0]
    for k in range(100, 300):
        marks[k, rng.integers(0, 40, 5)] ^= 3
    marks[:, :2] = 7
    marks[50:52, 10:18] = marks[60:62, 10:18]
    marks[50:52, 18:] = marks[60:62, 18:] ^ 1
    found, early = shingle_dedup.candidates(marks)
    near = shingle_dedup.tallied(marks, marks)
    pairs = {tuple(sorted(p)) for p in found.tolist()}
    assert early and all(near[a, b] for a, b in pairs) and len(pairs) <= 300 * shingle_dedup.MOST
    assert {(50, 60), (51, 61)} <= pairs
    label = np.zeros(300, dtype=np.int64)
    label[[5, 120, 121]] = 1, 2, 3
    got = {tuple(sorted(p)) for part in shingle_dedup.across(marks, label) for p in part.tolist()}
    assert got == {(a, b) for a, b in itertools.combinations(range(300), 2) if near[a, b] and label[a] != label[b]}


# 7


def test_sketches_lose_no_link():
    """The bound is never below the similarity, and most pairs under the limit are told from links without their texts."""
    rng = np.random.default_rng(8)
    sets, links, kept, pairs = [], 0, 0, 0
    for n in (1, 5, 60, 150, 400, 3000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for changed in (0.0, 0.05, 0.11, 0.12, 0.18, 0.3):
            other = base.copy()
            other[: int(changed * n)] = rng.integers(0, 1 << 63, int(changed * n), dtype=np.uint64)
            sets.append(np.unique(other))
    sketches = np.frombuffer(b"".join(map(shingle_dedup.sketch, sets)), dtype=np.uint8).reshape(len(sets), -1)
    i, j = np.triu_indices(len(sets), 1)
    may = shingle_dedup.possible(sketches[i], sketches[j])
    for a, b, found in zip(i, j, may, strict=True):
        both = len(np.intersect1d(sets[a], sets[b]))
        link = both >= shingle_dedup.SIMILAR * (len(sets[a]) + len(sets[b]) - both)
        assert found or not link
        links, kept, pairs = links + link, kept + found, pairs + 1
    assert links >= 30 and kept < links + 0.1 * (pairs - links)


def test_checkpoints_of_small_tables_have_few_files(spark):
    common.prepare(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        df = spark.range(5000, numPartitions=211)
        few, many = common.cut(df, 5000), common.cut(df, 10**7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert few.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() == 211
    assert few.count() == many.count() == 5000


def test_language_id(spark, odd, none, sf):
    got = rows(language_id.query(spark, sf))
    assert sum(r["language"] == r["declared"] for r in got) > 0.95 * len(got) and len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    model = language_id.fit_text(common.table(spark, sf, "documents"))
    as_rows = lambda df: df.select("doc_id", "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))
    found = rows(language_id.identify(as_rows(odd), model))
    assert len(found) == odd.count() and {r["language"] for r in found if r["doc_id"] in (100, 101, 102)} == {"und"}
    assert language_id.identify(as_rows(none), model).count() == 0
    assert {r["language"] for r in rows(language_id.identify(as_rows(odd), language_id.fit_text(none)))} == {"und"}


def test_language_evidence_decides_ties():
    even, has = np.zeros((3, 2)), np.array([True] * 3)
    sums = {k: np.array([[3.0, 1.0]] * 3) for k in ("host", "domain", "suffix")} | {"declared": np.array([[0.5, 9.5], [9.5, 0.5], [5.0, 5.0]])}
    p = language_id.posteriors(even, has, sums, np.array([10.0, 10.0]), {"declared": 2, "suffix": 2})
    assert p[0, 1] > 0.5 and p[1, 0] > 0.9 and p[2, 0] > 0.5 and np.allclose(p.sum(axis=1), 1)


def test_fusion_equals_brute_force(spark, monkeypatch, odd, sf):
    """All sums, priors and posteriors again, row by row in plain Python."""
    model = language_id.fit_text(common.table(spark, sf, "documents"))
    rng = random.Random(2)
    hosts = ["a.x.com", "b.x.com", "x.com", "y.org", None, "é.de"]
    plain = [(k, r["text"], rng.choice(["EN", "de", None, "fr"]), rng.choice(["com", "de", None]), rng.choice(hosts)) for k, r in enumerate(rows(odd.select("text")))]
    table = spark.createDataFrame(plain, "row int, text string, declared string, suffix string, host string")
    n, out = len(model.languages), []
    for _, text, declared, suffix, host in plain:
        own = model.likelihood(text or "")
        share = np.exp(own) / np.exp(own).sum() if own is not None else np.zeros(n)
        host = (host or "").lower()
        parts = host.split(".")
        domain = ".".join(parts[-2:]) if len(parts) > 1 and all(parts[-2:]) else ""
        out.append((own, share, {"declared": (declared or "").lower(), "suffix": (suffix or "").lower(), "host": host, "domain": domain}))
    want = []
    for i, (own, _, keys) in enumerate(out):
        if own is None:
            want.append(("und", 0.0))
            continue
        others = lambda k, i=i, keys=keys: sum((s for j, (_, s, x) in enumerate(out) if j != i and x[k] == keys[k]), np.zeros(n))
        total = sum(s for _, s, _ in out)
        prior = (total + 1) / (total.sum() + n)
        for k in ("domain", "host"):
            prior = (others(k) + 5 * prior) / (others(k).sum() + 5)
        value = np.array(own) + np.log(prior)
        for k in ("declared", "suffix"):
            value = value + np.log((others(k) + 1) / (total - out[i][1] + len({x[k] for _, _, x in out})))
        p = np.exp(value - value.max())
        want.append((model.languages[int(p.argmax())], float(p.max() / p.sum())))
    for share in (1e-3, 0.2, 1.0):  # all values hot, some, none
        monkeypatch.setattr(language_id, "HOT_SHARE", share)
        got = {r["row"]: r for r in rows(language_id.identify(table, model))}
        assert len(got) == len(plain)
        for i, (language, posterior) in enumerate(want):
            assert got[i]["language"] == language and math.isclose(got[i]["posterior"], posterior, rel_tol=1e-6, abs_tol=1e-9)


def test_many_languages(spark):
    data = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3} " * 20, f"l{i:03d}") for i in range(100)]
    model = language_id.fit_text(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert len(model.languages) == 100
    assert all(model.languages[int(np.argmax(model.likelihood(t)))] == lang for _, t, lang in data)


def test_visible_is_linear():
    for mark in ("<script>", "<!-- ", "<style ", "< ", "</script  "):
        began = time.perf_counter()
        assert "é" in language_id.visible("&eacute; " + mark * 40_000)
        assert time.perf_counter() - began < 2


def test_language_stage(spark, odd, documents, sf):
    kept = language_id.keep_identified(spark, odd, sf)
    assert kept.dtypes == odd.dtypes and not {100, 101, 102} & {r["doc_id"] for r in rows(kept)}
    assert language_id.keep_identified(spark, documents, sf).count() == documents.count()


def test_visible():
    assert language_id.visible("<html><script>var a='<p>';</script><p>caf&eacute;<!-- no --> b</p>").split() == ["café", "b"] and language_id.visible(None) == ""


# 8


def test_toxicity(spark, odd, none, labels):
    machine = toxicity.fit(odd, labels)
    got = rows(toxicity.score(odd, machine))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(none, machine).count() == 0
    blank = rows(toxicity.score(odd, toxicity.fit(odd, labels.limit(0))))
    assert {round(r["score"], 3) for r in blank} == {0.0}


def test_toxicity_learns_pairs():
    rng = random.Random(10)
    data = [(sorted({a, b}), float(a == 0 and b == 1)) for a, b in ((rng.choice([0, 2]), rng.choice([1, 3])) for _ in range(400))]
    machine = toxicity.fit_machine([r for r, _ in data], np.array([y for _, y in data]), {i: i for i in range(4)}, steps=600, l2=1e-5)
    raw = lambda t: machine.bias + machine.weights[t].sum() + 0.5 * ((machine.vectors[t].sum(axis=0) ** 2).sum() - (machine.vectors[t] ** 2).sum())
    assert raw([0, 1]) > 0 > max(raw([0, 3]), raw([2, 1]), raw([2, 3]))


def test_scores_equal_brute_force(odd, labels):
    """The machine's sum over all pairs of a text's kept terms, term by term."""
    machine = toxicity.fit(odd, labels)
    for text in [r["text"] for r in rows(odd.select("text")) if len(r["text"] or "") < 5000]:
        kept = [int(machine.places[t]) for t in toxicity.terms_of([text])[1] if machine.places[t] >= 0]
        raw = machine.bias + sum(float(machine.weights[i]) for i in kept)
        raw += sum(float(machine.vectors[i] @ machine.vectors[j]) for i, j in itertools.combinations(kept, 2))
        assert math.isclose(machine.scores([text])[0], 1 / (1 + math.exp(-raw)), rel_tol=1e-6, abs_tol=1e-9)


def test_toxicity_quality_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest table has five toxic rows that are held out
    truth = {r["doc_id"]: r["toxic"] for r in rows(spark.read.parquet(f"{sf}/labels.parquet")) if r["toxic"] is not None}
    got = [(r["score"], truth[r["doc_id"]]) for r in rows(toxicity.query(spark, sf)) if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [s for s, t in got if t], [s for s, t in got if not t]
    if toxic and clean:
        assert sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) > 0.9 * len(toxic) * len(clean)


def test_clean_stage_on_awkward_rows(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = toxicity.keep_clean(spark, odd, str(tmp_path))
    scores = {(r["doc_id"], r["n"]): r["score"] for r in rows(toxicity.score(odd, toxicity.fit(odd, labels)).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("score").alias("score")))}
    assert kept.dtypes == odd.dtypes and {r["doc_id"] for r in rows(kept)} >= {i for (i, n), s in scores.items() if s < toxicity.THRESHOLD}
    assert toxicity.keep_clean(spark, none, str(tmp_path)).count() == 0


def test_toxicity_held_out(spark, documents, sf):
    got = {r["doc_id"]: r for r in rows(toxicity.query(spark, sf))}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())


def test_terms_are_the_same_in_pieces(monkeypatch):
    texts = ["Some idiot! wrote   a_b,c", None, "", "x" * 50, "ÀÉ éa " * 40]
    want = [toxicity.terms_of([t])[1].tolist() for t in texts]
    row, bucket = toxicity.terms_of(texts)
    assert [bucket[row == i].tolist() for i in range(len(texts))] == want
    monkeypatch.setattr(toxicity, "PIECE", 60)
    row, bucket = toxicity.terms_of(texts)
    assert [bucket[row == i].tolist() for i in range(len(texts))] == want


# 9


def test_licenses(odd, none):
    got = {r["doc_id"]: r for r in rows(licenses.scan(odd))}
    assert got[108]["licenses"] == "MIT" and got[100]["n_sentences"] == 0 and len(rows(licenses.scan(odd))) == odd.count()
    assert licenses.scan(none).count() == 0


def test_license_rules():
    known = licenses.known_sentences()
    text = "\n".join([licenses.BODIES["mit.grant"], "Words in between.", licenses.BODIES["mit.notice"], licenses.BODIES["mit.warranty"], "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."])
    ids = [known.get(s) for s in licenses.sentences(text)]
    assert [m[1] for m in licenses.match(ids)] == ["MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"]
    assert licenses.match(["mit.grant", None, None, "mit.notice"])[0][0] == "mit.grant"
    assert licenses.match(["mit.notice", "mit.warranty"]) == []


@pytest.mark.parametrize("prefix", ["", " * ", "# ", "// "])
def test_wrapped_licences(prefix):
    b = licenses.BODIES
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
    cases = {
        "MIT": [b["mit.grant"], b["mit.notice"], b["mit.warranty"]],
        "BSD-3-Clause": [b["bsd.redistribution"], "1. " + b["bsd.source"], "2. " + b["bsd.binary"], "3. " + b["bsd.endorse"]],
        "Apache-2.0": [apache, "http://www.apache.org/licenses/LICENSE-2.0", b["apache.basis"]],
        "GPL-2.0": [b["gnu.free2"], b["gnu.hope"]], "GPL-3.0": [b["gnu.free3"], b["gnu.hope"]], "LGPL-2.1": [b["gnu.lesser2"]], "AGPL-3.0": [b["gnu.affero3"]], "MPL-2.0": [b["mpl.terms"]], "ISC": [b["isc.grant"]],
    }
    known = licenses.known_sentences()
    for licence, paragraphs in cases.items():
        wrapped = "\n\n".join(textwrap.fill(p, 70) for p in paragraphs)
        for text in ("\n".join(prefix + line for line in wrapped.split("\n")), " ".join(paragraphs)):
            assert [m[1] for m in licenses.match([known.get(s) for s in licenses.sentences(text)])] == [licence], (licence, text)
    assert licenses.sentences("One line\nand the next. End") == ["one line", "and the next", "end"]


# 10


def brute_lm(docs):
    split = {n: [*(w for w in common.words_of(t)), None] for n, (_, t) in enumerate(docs)}
    train = [n for n, (i, _) in enumerate(docs) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = collections.Counter(), collections.Counter()
    for n in train:
        one.update(split[n])
        two.update(zip(["<s>", *split[n]], split[n], strict=False))
    context = lambda w: one[None] if w == "<s>" else one[w]
    total, words = sum(one.values()), len(one)
    base = lambda w: (one[w] + 1) / (total + words + 1)
    bucket = lambda c: math.frexp(c)[1] if c else 0
    return split, train, one, two, context, total, base, bucket


def test_lm(odd, none, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", 300)
    docs = [(r["doc_id"], r["text"]) for r in rows(odd.select("doc_id", "text"))]
    split, train, one, two, context, total, base, bucket = brute_lm(docs)
    pairs = collections.defaultdict(list)
    for n in train:
        for a, b in zip(["<s>", *split[n]], split[n], strict=False):
            c = context(a)
            pairs[bucket(c)].append(((two[a, b] - 1) / (c - 1) if c > 1 else 0.0, one[b] / (total + len(one))))
    weight = {0: 0.0}
    for k, xs in pairs.items():
        x = 0.5
        for _ in range(lm_scoring.ROUNDS):
            x = min(max(sum(x * p / (x * p + (1 - x) * q) for p, q in xs) / len(xs), 1e-6), 1 - 1e-6)
        weight[k] = x
    got = collections.Counter()
    for r in rows(lm_scoring.score(odd)):
        got[r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)] += 1
        n = next(n for n, (i, _) in enumerate(docs) if i == r["doc_id"])
        exact = sum(math.log10(weight.get(bucket(context(a)), 0.0) * two[a, b] / max(context(a), 1) + (1 - weight.get(bucket(context(a)), 0.0)) * base(b)) for a, b in zip(["<s>", *split[n]], split[n], strict=False))
        assert r["score"] == pytest.approx(exact, rel=0.01)
    want = collections.Counter((i, len(split[n]), sum(one[w] > 0 for w in split[n]), total, round(sum(math.log10(base(w)) for w in split[n]), 5)) for n, (i, _) in enumerate(docs))
    assert got == want
    assert lm_scoring.score(none).count() == 0


def test_lm_codec():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm_scoring.keys_unpacked(lm_scoring.keys_packed(keys)) == keys).all()
    for x in (np.arange(7, dtype="<u4"), np.zeros(0, dtype="<u8")):
        assert (lm_scoring.unpacked(lm_scoring.packed(x), x.dtype.str) == x).all()


# all


def test_registered():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{i}" for i in range(1, 11)]


def test_top_k_equals_sql(spark, sf, duck):
    want = sorted(map(tuple, duck.sql(registry.oracle_sql()["op1_exact_top_k"]).fetchall()))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(registry.queries()["op1_exact_top_k"](spark, sf)))
    names = duck.sql(registry.oracle_sql()["op1_exact_top_k"]).columns
    assert got == sorted(tuple(dict(zip(names, w, strict=True))[c] for c in ("query_id", "rank", "vec_id", "score")) for w in want)


def test_pipeline(spark, documents, sf):
    import corpus_pipeline

    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == documents.dtypes, name
        docs = spark.createDataFrame(out.collect(), documents.schema)
    assert rows(corpus_pipeline.STAGES[-1][1](spark, docs, sf))


def test_pipeline_on_awkward_and_empty_tables(spark, odd, none, labels, tmp_path):
    """All stages on nulls, repeats and clashing columns; what each keeps is accounted for."""
    stages = dict(corpus_pipeline.STAGES)
    for name, docs in (("odd", odd), ("none", none)):
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        before = spark.read.parquet(f"{at}/documents.parquet")
        for stage in ("language_id", "toxicity", "near_dedup"):
            after = stages[stage](spark, before, at)
            assert after.dtypes == docs.dtypes
            plain = lambda df: collections.Counter(tuple(r) for r in rows(df))
            after.write.parquet(f"{at}/{stage}")
            after = spark.read.parquet(f"{at}/{stage}")
            assert not plain(after) - plain(before), "a stage only removes rows"
            if stage == "near_dedup":
                texts = [r["text"] or "" for r in rows(before)]
                assert {" ".join(t.lower().split()) for t in texts if len(t.split()) < 5} <= {" ".join((r["text"] or "").lower().split()) for r in rows(after)}
                assert len(rows(after)) >= len(whole_or_linked(similar(texts), range(len(texts))))
            before = after
        pieces = rows(corpus_pipeline.run(spark, at))
        assert bool(pieces) == (name == "odd")
        mixed = collections.Counter(r["doc_id"] for r in rows(stages["mixing"](spark, before, at)))
        assert {p["doc_id"] for p in pieces} == set(mixed)
