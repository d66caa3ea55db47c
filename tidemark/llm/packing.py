"""Packing (operator 3): bounded-space online best-fit with a final merge of leftovers.

Each task holds at most OPEN windows. A document's ids are cut at whole sequences first; what remains goes to the open window that
it fills best. When it fits nowhere and all windows are taken, the fullest is topped up with the beginning of the piece and emitted,
and the rest of the piece opens a window in its place. At a task's end its windows are merged into one; those of LEFTOVER_TASKS tasks
are merged again by group, so no task gathers more than LEFTOVER_TASKS windows. What is then left is emitted as sequences whose
lengths are powers of two, which need no padding.

Ids come from a public tokenizer. Its pieces never cross a space or a line feed, nor the border of Latin letters and the marks behind
them, so texts are cut there and each different part is encoded once while it is remembered (CACHED parts at most).

Nulls and edge cases: a null text counts as empty and has the end id alone; a null doc_id is kept; repeated rows are packed each;
an empty table gives no piece; a text of any length is packed whole.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

LENGTH, OPEN, LEFTOVER_TASKS, END_ID, CACHED = 4096, 64, 64, 2, 800_000
TOKENIZER = "word_bpe_49k.json"
WIDTH = 4  # bytes of an id
Piece = tuple[int | None, int, bytes, int]  # doc_id, start, ids, doc_tokens
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: A word that is one id and stands between the parts that are encoded together; a part that holds it is encoded alone.
BETWEEN, TOGETHER = "\x02", 256
PIECE, LONG = 1 << 20, 64  # bytes that are cut at once; longest part that is known by its hash
SPACE, LETTER, MARK, OTHER = range(4)
KIND = np.array([SPACE if b in (10, 32) else LETTER if chr(b).isalpha() and b < 128 else MARK if 33 <= b <= 126 and chr(b) not in "'0123456789" else OTHER for b in range(256)], dtype=np.int8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


class Encoder:
    """Texts to little-endian 32-bit ids, without special tokens.

    Words are cut at spaces and line feeds. One of Latin letters with ASCII marks behind them (no apostrophe) is two parts, as the
    tokenizer cuts there and lower-cases the letters; any other word is one part. Parts are found by array operations over the bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = ids[0] if len(ids) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.place: dict[int | str, int] = {}  # hash of a simple part, or another part itself, to its number; number 0 has no ids
        self.ids, self.used = np.zeros(1 << 20, dtype="<u4"), 0
        self.begin, self.length, self.count = np.zeros(1 << 18, dtype=np.int64), np.zeros(1 << 18, dtype=np.int64), 1

    def _encoded(self, parts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each part: many in one text where they can be told apart again, as each call has its price."""
        for at in range(0, len(parts), 64 * TOGETHER):
            some = parts[at : at + 64 * TOGETHER]
            groups = [some[k : k + TOGETHER] for k in range(0, len(some), TOGETHER)]
            joined = [self.between is not None and not any(BETWEEN in p for p in g) for g in groups]
            together = self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(g) if j else "" for g, j in zip(groups, joined, strict=True)], add_special_tokens=False)
            for group, one, j in zip(groups, together, joined, strict=True):
                ids = np.array(one.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == self.between) if j else []
                if j and len(cuts) == len(group) - 1:
                    begins = [0, *(cuts + 1).tolist()]
                    yield from (ids[a:b] for a, b in zip(begins, [*cuts.tolist(), len(ids)], strict=True))
                else:
                    yield from (np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False))

    def _learn(self, keys: list[int] | list[str], parts: list[str]) -> None:
        for key, ids in zip(keys, self._encoded(parts), strict=True):
            n = len(ids)
            if self.used + n > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), n), dtype="<u4")])
            if self.count == len(self.begin):
                self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
            self.ids[self.used : self.used + n] = ids
            self.begin[self.count], self.length[self.count] = self.used, n
            self.place[key] = self.count
            self.used, self.count = self.used + n, self.count + 1

    def _numbers(self, at: np.ndarray, end: np.ndarray, low: bytes, sums: np.ndarray, downs: np.ndarray) -> np.ndarray:
        """The number of each stretch of lower-cased bytes; new ones are encoded."""
        hashes, first, place = np.unique(common.mix64((sums[end] - sums[at]) * downs[at] ^ ((end - at).astype(np.uint64) << np.uint64(57))), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        known = self.place
        new = [i for i, k in enumerate(keys) if k not in known]
        if new:
            self._learn([keys[i] for i in new], [low[at[first[i]] : end[first[i]]].decode() for i in new])
        return np.fromiter((known[k] for k in keys), dtype=np.int64, count=len(keys))[place]

    def _piece(self, raw: bytes, starts: np.ndarray) -> list[bytes]:
        """Ids of each of the texts that begin at starts; each but the last is followed by a line feed."""
        data = np.frombuffer(raw, dtype=np.uint8)
        kind = KIND[data]
        pair = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))  # the letters of U+00C0 to U+00FF
        kind[pair] = kind[pair + 1] = LETTER
        low = LOWER[data]
        upper = pair[data[pair + 1] <= 0x9E] + 1
        low[upper] += 0x20
        inside = np.r_[False, kind != SPACE, False]
        at, end = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        odd = kind == OTHER
        odd[1:] |= (kind[1:] == LETTER) & (kind[:-1] == MARK)
        odds, letters = np.r_[0, np.cumsum(odd)], np.r_[0, np.cumsum(kind == LETTER)]
        simple = (odds[end] - odds[at] == 0) & (end - at <= LONG)
        numbers = np.zeros((len(at), 2), dtype=np.int64)
        ups, downs = powers(len(data) + 1)
        sums = np.r_[np.uint64(0), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * ups[: len(low)], dtype=np.uint64)]
        middle, text = at + letters[end] - letters[at], low.tobytes()
        for slot, a, b in ((0, at, middle), (1, middle, end)):
            some = np.flatnonzero(simple & (b > a))
            if len(some):
                numbers[some, slot] = self._numbers(a[some], b[some], text, sums, downs)
        rest = np.flatnonzero(~simple)
        if len(rest):
            words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at[rest].tolist(), end[rest].tolist(), strict=True)]
            new = list({w for w in words if w not in self.place})
            self._learn(new, new)
            numbers[rest, 0] = [self.place[w] for w in words]
        flat = numbers.ravel()
        length = self.length[flat]
        upto = np.r_[0, np.cumsum(length)]
        ids = self.ids[np.repeat(self.begin[flat] - upto[:-1], length) + np.arange(upto[-1])].tobytes()
        cuts = upto[2 * np.searchsorted(at, np.r_[starts, len(data)])] * WIDTH
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        held: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                if len(self.place) > CACHED:
                    self.forget()
                out.extend(self._piece(b"\n".join(held), np.cumsum([0, *(len(x) + 1 for x in held[:-1])])))
            held, size = [], 0

        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            if size + len(raw) > PIECE:
                flush()
            if len(raw) > PIECE:
                parts = []
                while raw:
                    cut = raw.rfind(b" ", 1, PIECE)
                    cut = cut if cut > 0 and len(raw) > PIECE else raw.find(b" ", PIECE) if len(raw) > PIECE else len(raw)
                    cut = len(raw) if cut < 0 else cut
                    parts.append(self._piece(raw[:cut], np.zeros(1, dtype=np.int64))[0])
                    raw = raw[cut:]
                out.append(b"".join(parts))
                continue
            held.append(raw)
            size += len(raw) + 1
        flush()
        return out


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    ups, downs = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    ups[0] = downs[0] = 1
    return np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(PIECE + 2, 1 << n.bit_length()) if n > PIECE + 2 else PIECE + 2)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Windows:
    """Open windows by free room; done sequences come out as lists of pieces."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most = length, most
        self.free: list[tuple[int, int]] = []  # sorted (room, window)
        self.held: dict[int, list[Piece]] = {}
        self.made = 0

    def _put(self, room: int, window: int, piece: Piece) -> list[Piece] | None:
        self.held[window].append(piece)
        room -= len(piece[2]) // WIDTH
        if room:
            insort(self.free, (room, window))
            return None
        return self.held.pop(window)

    def _open(self, piece: Piece) -> list[Piece] | None:
        self.made += 1
        self.held[self.made] = []
        return self._put(self.length, self.made, piece)

    def add(self, doc_id: int | None, ids: bytes, start: int = 0, total: int | None = None) -> Iterator[list[Piece]]:
        """Place a document, or a piece that starts later in one; yields each sequence that is now full."""
        total = len(ids) // WIDTH if total is None else total
        at, whole = 0, self.length * WIDTH
        while len(ids) - at >= whole:
            yield [(doc_id, start + at // WIDTH, ids[at : at + whole], total)]
            at += whole
        if at == len(ids):
            return
        need = (len(ids) - at) // WIDTH
        fit = bisect_left(self.free, (need, 0))
        if fit < len(self.free):
            full = self._put(*self.free.pop(fit), (doc_id, start + at // WIDTH, ids[at:], total))
        elif len(self.held) < self.most:
            full = self._open((doc_id, start + at // WIDTH, ids[at:], total))
        else:  # none fits, so each has less room than the piece needs
            room, window = self.free.pop(0)
            cut = at + room * WIDTH
            yield self._put(room, window, (doc_id, start + at // WIDTH, ids[at:cut], total))
            full = self._open((doc_id, start + cut // WIDTH, ids[cut:], total))
        if full:
            yield full

    def merge(self) -> tuple[list[list[Piece]], list[Piece]]:
        """Join what is open, the fullest first: full sequences, and the pieces of one that isn't."""
        done, now, size = [], [], 0
        for _, window in sorted(self.free):
            for doc_id, start, ids, total in self.held[window]:
                while ids:
                    part = ids[: (self.length - size) * WIDTH]
                    now.append((doc_id, start, part, total))
                    size, start, ids = size + len(part) // WIDTH, start + len(part) // WIDTH, ids[len(part) :]
                    if size == self.length:
                        done.append(now)
                        now, size = [], 0
        self.free, self.held = [], {}
        return done, now


def in_powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Cut pieces of one unfinished sequence into sequences whose lengths are falling powers of two."""
    left = sum(len(p[2]) for p in pieces) // WIDTH
    now, need = [], 1 << max(0, left.bit_length() - 1)
    for doc_id, start, ids, total in pieces:
        while ids:
            part = ids[: need * WIDTH]
            now.append((doc_id, start, part, total))
            n = len(part) // WIDTH
            need, left, start, ids = need - n, left - n, start + n, ids[len(part) :]
            if not need:
                yield now
                now, need = [], 1 << max(0, left.bit_length() - 1)


def _table(sequences: list[tuple[int, list[Piece]]], extra: dict[str, object] | None = None) -> pa.RecordBatch:
    rows = [(d, s, len(i) // WIDTH, i, t, q) for q, pieces in sequences for d, s, i, t in pieces]
    lengths = [[len(p[2]) // WIDTH for p in pieces] for _, pieces in sequences]
    offsets = [o for one in lengths for o in np.cumsum([0, *one[:-1]]).tolist()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)] + [pa.array(offsets, pa.int64())]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    for name, value in (extra or {}).items():
        arrays.append(pa.array([value] * len(rows), pa.int64()))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, open_windows: int = OPEN, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its ids; sequences of one sequence_id are gapless by offset. path: a tokenizer's file on every machine."""
    spark = common.prepare(docs.sparkSession)
    path = path or tokenizer_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode, windows = TaskContext.get().partitionId(), encoder(path).encode, Windows(length, open_windows)
        first, done, size = task << 32, [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in common.texts_of(batch.column(1), 256):
                for doc_id, raw in zip(ids[at : at + len(texts)], encode(texts), strict=True):
                    for full in windows.add(doc_id, raw + end):
                        done.append((first + size, full))
                        size += 1
                if len(done) >= 256:
                    yield _table(done, {"leftover": None})
                    done = []
        merged, rest = windows.merge()
        yield _table([*done, *((first + size + k, full) for k, full in enumerate(merged))], {"leftover": None})
        if rest:
            yield _table([(0, rest)], {"leftover": task // LEFTOVER_TASKS})

    # Written once, as later steps need it twice and a lost executor must not bring other sequence numbers.
    at = common.shared_dir(spark, "packed")
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(place, PIECES + ", leftover long").write.option("compression", "zstd").parquet(at)
    placed = spark.read.schema(PIECES + ", leftover long").parquet(at)

    def finish(group: pa.Table) -> pa.Table:
        rows = group.select(["doc_id", "start", "ids", "doc_tokens", "offset"]).to_pylist()
        rows.sort(key=lambda r: (r["offset"], r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["ids"]))
        windows = Windows(length, open_windows)
        done = [full for r in rows for full in windows.add(r["doc_id"], r["ids"], r["start"], r["doc_tokens"])]
        merged, rest = windows.merge()
        base = (1 << 62) + (group["leftover"][0].as_py() << 32)
        return pa.Table.from_batches([_table([(base + k, x) for k, x in enumerate([*done, *merged, *in_powers(rest)])])])

    merged = placed.where("leftover IS NOT NULL").groupBy("leftover").applyInArrow(finish, PIECES)
    return placed.where("leftover IS NULL").drop("leftover").unionByName(merged)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(common.table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the pieces of all documents it is given."""
    return digest(pack(docs))
