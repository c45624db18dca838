"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash finds pre-tokens that are in the vocabulary as a
whole; the others are merged by a heap over linked bytes. The ids are those that tiktoken gives.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, Pieces, map_rows, tune

#: Distinct pieces, and pre-tokens that are no whole tokens, of each of the two generations that a worker remembers.
REMEMBERED = 250_000
#: Bytes of a pre-token beyond which its links are packed arrays.
LONG = 4096


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys in n slots, one displacement for each small bucket of keys."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2) -> None:
        self.n, self.m = len(keys), max(1, len(keys) // per_bucket)
        self.keys: list[bytes | None] = [None] * self.n
        self.ids = [0] * self.n
        self.shift = [0] * self.m
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % self.m].append(i)
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            if len(buckets[b]) < 2:
                break
            for d in range(1 << 20):
                slots = [self._slot(hashes[i], d) for i in buckets[b]]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
            else:
                raise ValueError("no displacement fits; are there equal keys?")
            self.shift[b] = d
            for i, s in zip(buckets[b], slots, strict=True):
                self.keys[s], self.ids[s] = keys[i], i
        free = (s for s in range(self.n) if self.keys[s] is None)
        for b in range(self.m):
            if len(buckets[b]) == 1:
                s, i = next(free), buckets[b][0]
                self.shift[b] = -s - 1
                self.keys[s], self.ids[s] = keys[i], i

    def _slot(self, h: int, d: int) -> int:
        if d < 0:
            return -d - 1
        x = (h ^ d * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return (x >> 31) % self.n

    def find(self, key: bytes) -> int:
        """The index of a key, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        s = self._slot(h, self.shift[h % self.m])
        return self.ids[s] if self.keys[s] == key else -1


class Bpe:
    """Encoder and decoder for a rank file (lines of base64 token and rank)."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = list(self.ranks)
        self.whole = PerfectHash(tokens)
        self.rank_of = [self.ranks[t] for t in tokens]
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        # By two ids, the rank of their bytes together: every way to cut a token into two tokens.
        known = self.ranks.get
        self.pair = {a << 20 | b: r for t, r in self.ranks.items() for k in range(1, len(t)) if (a := known(t[:k])) is not None and (b := known(t[k:])) is not None}
        self.pattern = regex.compile(pattern)
        self.merged = Memory(REMEMBERED)
        self.pieces = Pieces(self._piece, REMEMBERED)

    def merge(self, word: bytes) -> list[int]:
        """Merges of least rank first, leftmost at ties.

        A heap entry is a rank and the place of a part that makes it with the part linked after it;
        it is stale when that place has another rank by now. Byte n, which joins with nothing, ends the links.
        """
        pair, n = self.pair.get, len(word)
        part = [self.byte[b] for b in word]
        rank = [pair(a << 20 | b, -1) for a, b in zip(part, part[1:])]
        bits = n.bit_length()
        heap = [r << bits | i for i, r in enumerate(rank) if r >= 0]
        if not heap:
            return part
        part.append(-1)
        rank += (-1, -1)
        nxt, prv = list(range(1, n + 2)), list(range(-1, n))
        if n > LONG:
            part, rank, nxt, prv = (array("i", x) for x in (part, rank, nxt, prv))
        heapq.heapify(heap)
        pop, push, mask = heapq.heappop, heapq.heappush, (1 << bits) - 1
        while heap:
            e = pop(heap)
            i, r = e & mask, e >> bits
            if rank[i] != r:
                continue
            j = nxt[i]
            part[i], part[j], rank[j] = r, -1, -1
            nxt[i] = k = nxt[j]
            prv[k] = i
            if k < n and (x := pair(r << 20 | part[k])) is not None:
                rank[i] = x
                push(heap, x << bits | i)
            else:
                rank[i] = -1
            if (p := prv[i]) >= 0:
                if (x := pair(part[p] << 20 | r)) is not None:
                    rank[p] = x
                    push(heap, x << bits | p)
                else:
                    rank[p] = -1
        return [x for x in part if x >= 0]

    def pre_token(self, token: str) -> tuple[int, ...]:
        """Ids of one match of the pattern: looked up whole, else as remembered, else merged."""
        word = token.encode()
        k = self.whole.find(word)
        if k >= 0:
            return (self.rank_of[k],)
        if (x := self.merged.get(word)) is None:
            x = tuple(self.merge(word))
            self.merged.put(word, x)
        return x

    def _piece(self, piece: str) -> tuple[int, ...]:
        if piece.isascii() and piece[piece[0] == " " :].isalpha():  # one match by itself
            return self.pre_token(piece)
        return tuple(chain.from_iterable(map(self.pre_token, self.pattern.findall(piece))))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return list(chain.from_iterable(self.pieces.cut(text))) if text else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every whole text; null and empty texts have none. No shuffle, one row for each input row."""
    tune(df.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        ids = [np.array(c.encode(t or ""), np.int32) for t in b.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, ids)])
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))], ["key", "ids"])

    return map_rows(df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")), run, "key long, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes): the bytes that ids stand for (null: none)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["key", "bytes"])

    return map_rows(df.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids")), run, "key long, bytes binary").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded again in one pass."""
    tune(df.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        digits = _digits(len(c.bytes_of))
        n, a, d = [], [], []
        for t in b.column(1).to_pylist():
            ids = c.encode(t or "")
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
            d.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_rows(df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")), run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


@lru_cache(maxsize=2)
def _digits(n: int) -> list[str]:
    return [str(i) for i in range(n)]
