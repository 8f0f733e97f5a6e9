"""Byte-level BPE, encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that is itself an
entry; any other is merged by a heap over its linked bytes, lowest rank first, leftmost first.
The rank file is read once on the driver (its path is a parameter, its size bounded by
``MAX_RANKS``) and broadcast as arrays. Tasks split whole texts into pre-tokens, look each
distinct one up once, and keep a bounded memory of the ones seen.

Defined results: a null text is encoded as the empty text (no ids). Code points that UTF-8
cannot hold (lone surrogates) become U+FFFD, as reading Parquet already does. Any length of
text or of a single pre-token is encoded in n log n. Repeated rows are encoded alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from inquest.llm.common import present

MAX_RANKS = 1 << 20       # entries; bounds what is broadcast
KEEP = 150_000            # pre-tokens a task remembers in each of two generations
SEED = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def fast_pattern(pattern: str) -> re.Pattern | None:
    """The same splitting for texts of Latin-1 characters, by the faster built-in matcher.

    The classes are spelled out from the general pattern's own classes; other patterns or
    texts use the general matcher.
    """
    def members(cls: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(256) if regex.fullmatch(cls, chr(c)))
    letters, digits = members(r"\p{L}"), members(r"\p{N}")
    space = members(r"[^\S\x1c-\x1f]")    # White_Space, as the tokenizer library reads \s
    swaps = {r"[^\s\p{L}\p{N}]": f"[^{space}{letters}{digits}]", r"\p{L}": f"[{letters}]",
             r"\p{N}": f"[{digits}]", r"\S": f"[^{space}]", r"\s": f"[{space}]"}
    for old, new in swaps.items():
        pattern = pattern.replace(old, new)
    return None if r"\p" in pattern else re.compile(pattern)


def mix64(h: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Scramble 64-bit hashes by a seed (multiply, xor, shift)."""
    with np.errstate(over="ignore"):
        h = (h ^ np.asarray(seed, dtype=np.uint64)) * np.uint64(SEED)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """A 64-bit polynomial hash of each byte string, computed for all of them at once."""
    lengths = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    data = np.frombuffer(b"".join(keys), dtype=np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    h = lengths.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(int(lengths.max(initial=0))):
            on = np.nonzero(lengths > i)[0]
            h[on] = (h[on] ^ (data[starts[on] + i] + np.uint64(1))) * np.uint64(0x100000001B3)
            h[on] ^= h[on] >> np.uint64(31)
    return h


class PerfectHash:
    """A minimal perfect hash: each key has its own slot among as many slots as keys.

    Keys are thrown into small groups; the largest first, each group gets the first seed that
    sends its keys to free slots. Looking up costs two hashes and one comparison.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.groups = len(keys), max(1, len(keys) // 4)
        h = key_hashes(keys)
        if len(np.unique(h)) != self.n:
            raise ValueError("two vocabulary entries share a hash")
        group = (mix64(h, 1) % np.uint64(self.groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        counts = np.bincount(group, minlength=self.groups)
        ends = np.cumsum(counts)
        self.seeds = np.zeros(self.groups, dtype=np.uint64)
        self.slot_key = np.zeros(self.n, dtype=np.int64)
        free = np.ones(self.n, dtype=bool)
        tries = np.arange(2, 514, dtype=np.uint64)
        for g in np.argsort(-counts, kind="stable"):
            mine = order[ends[g] - counts[g]:ends[g]]
            if not len(mine):
                break
            start = 0
            while True:
                seeds = tries + np.uint64(start)
                slots = (mix64(h[mine][:, None], seeds[None, :]) % np.uint64(self.n)).astype(np.int64)
                good = free[slots].all(axis=0)
                if len(mine) > 1:
                    good &= (np.diff(np.sort(slots, axis=0), axis=0) > 0).all(axis=0)
                if good.any():
                    at = int(np.argmax(good))
                    break
                start += len(tries)
            self.seeds[g] = seeds[at]
            free[slots[:, at]] = False
            self.slot_key[slots[:, at]] = mine

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = key_hashes(keys)
        seeds = self.seeds[(mix64(h, 1) % np.uint64(self.groups)).astype(np.int64)]
        return (mix64(h, seeds) % np.uint64(self.n)).astype(np.int64)


class Vocabulary:
    """Ranks by byte string, their perfect hash, and the byte string of each id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        if len(pairs) > MAX_RANKS:
            raise ValueError(f"more than {MAX_RANKS} ranks")
        self.keys = [base64.b64decode(a) for a, _ in pairs]
        self.ids = np.array([int(b) for _, b in pairs], dtype=np.int64)
        self.pattern = pattern
        self.hash = PerfectHash(self.keys)

        self.coder: Coder | None = None

    def open(self) -> Coder:
        """The worker's coder; it stays with the broadcast value, so later tasks reuse it."""
        if self.coder is None:
            self.coder = Coder(self)
        return self.coder


class Coder:
    """A task's view of the vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        hashed = vocabulary.hash
        self.hash = hashed
        self.slot_key = [vocabulary.keys[i] for i in hashed.slot_key]
        self.slot_id = vocabulary.ids[hashed.slot_key].tolist()
        self.rank = dict(zip(self.slot_key, self.slot_id))
        self.piece: list = [b""] * (max(self.slot_id, default=0) + 1)
        for i, key in zip(self.slot_id, self.slot_key):
            self.piece[i] = key
        self.text = list(map(str, range(len(self.piece))))
        self.general = regex.compile(vocabulary.pattern.replace(r"\s", r"\p{White_Space}")
                                     .replace(r"\S", r"\P{White_Space}"))
        self.fast = fast_pattern(vocabulary.pattern)
        self.seen: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def split(self, text: str) -> list[str]:
        if self.fast is not None:
            try:
                text.encode("latin-1")
                return self.fast.findall(text)
            except UnicodeEncodeError:
                pass
        return self.general.findall(text)

    def merge(self, piece: bytes) -> list[int]:
        """Merge neighbours of lowest rank first; equal ranks from the left.

        A heap entry is one whole number, rank and start of a pair; it is stale when the pair
        that starts there has another rank by now.
        """
        get, n = self.rank.get, len(piece)
        bits = n.bit_length()
        low = (1 << bits) - 1
        pair = [get(piece[i:i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        end = list(range(1, n + 1))         # the part at i ends at end[i], where the next starts
        prev = list(range(-1, n))           # and the part before it starts at prev[i]
        while heap:
            top = heappop(heap)
            i = top & low
            if pair[i] != top >> bits:
                continue
            middle = end[i]
            stop = end[middle]
            end[i] = stop
            prev[stop] = i
            pair[middle] = -1
            if stop < n:
                pair[i] = r = get(piece[i:end[stop]], -1)
                if r >= 0:
                    heappush(heap, r << bits | i)
            else:
                pair[i] = -1
            if i:
                before = prev[i]
                pair[before] = r = get(piece[before:stop], -1)
                if r >= 0:
                    heappush(heap, r << bits | before)
        out, i, rank = [], 0, self.rank
        while i < n:
            stop = end[i]
            out.append(rank[piece[i:stop]])
            i = stop
        return out

    def learn(self, tokens: set[str]) -> None:
        """Resolve pre-tokens not remembered: the hash for entries, the heap for the rest."""
        if len(self.seen) + len(tokens) > KEEP:
            self.old, self.seen = self.seen, {}
        seen, old, new = self.seen, self.old, []
        for token in tokens:
            if token not in seen:
                if token in old:
                    seen[token] = old[token]
                else:
                    new.append(token)
        if not new:
            return
        raw = [t.encode("utf-8", "replace") for t in new]
        for token, key, slot in zip(new, raw, self.hash.slots(raw).tolist()):
            if self.slot_key[slot] == key:
                seen[token] = (self.slot_id[slot],)
            else:
                seen[token] = tuple(self.merge(key))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for text in texts:
            tokens = self.split(text)
            ids: list[int] = []              # a very long text goes in pieces that fit the memory
            for at in range(0, len(tokens), KEEP // 2):
                piece = tokens[at:at + KEEP // 2]
                self.learn(set(piece))
                ids.extend(chain.from_iterable(map(self.seen.__getitem__, piece)))
            yield ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every document, ids as an array."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value.open()
        for part in parts:
            ids = list(mine.encode(part.column(1).to_pylist()))
            yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                  names=["doc_id", "ids"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       present(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` for every row of ``doc_id, ids``; null ids give no bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value.open()
        for part in parts:
            raw = [mine.decode(ids or []) for ids in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(raw, pa.binary())],
                                  names=["doc_id", "bytes"])
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, and decoded again."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value.open()
        for part in parts:
            count, ids_sha, text_sha = [], [], []
            for ids in mine.encode(part.column(1).to_pylist()):
                count.append(len(ids))
                ids_sha.append(sha(" ".join(map(mine.text.__getitem__, ids)).encode()))
                text_sha.append(sha(mine.decode(ids)))
            yield pa.record_batch([part.column(0), pa.array(count, pa.int64()),
                                   pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                  names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       present(F.col(text_col)).alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
