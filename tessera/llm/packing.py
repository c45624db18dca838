"""Packing of documents into token sequences by bounded-space online best fit."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stage, tune

#: Tokens of a sequence, open windows of a partition, partitions whose leftovers are merged together.
LENGTH = 1024
WINDOWS = 32
MERGED = 1024

OUT = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "open"]
_KINDS = [pa.int64()] * 7 + [pa.binary(), pa.bool_()]


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file.

    tiktoken, loaded with the file's own vocabulary and pattern, gives the same ids about four
    times as fast; texts that hold an added token of the file go to tokenizers.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # The visible letters that stand for bytes: printable Latin-1 for itself, the others in order from 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.added = [t["content"] for t in model["added_tokens"]]
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in self.added}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        ids = self.tok.encode(text, add_special_tokens=False).ids if any(a in text for a in self.added) else self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Open windows; add() gives closed pieces. A piece is [key, start, ids, doc_tokens]."""

    def __init__(self, length: int, windows: int, first: int) -> None:
        self.length, self.windows, self.next = length, windows, first
        self.open: list[list] = []  # [free, pieces]
        self.out: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for key, start, ids, n in pieces:
            k = len(ids) // 4
            self.out.append((key, start, k, zlib.crc32(ids), n, self.next, at, ids, False))
            at += k
        self.next += 1

    def add(self, key: int | None, start: int, ids: bytes, n: int) -> None:
        """Full windows of a document close at once; the rest goes to the window it fits best.

        When it fits none, the fullest window is filled up by a cut and emitted.
        """
        size, whole = 4 * self.length, len(ids) // (4 * self.length)
        for at in range(0, whole * size, size):
            self._close([[key, start + at // 4, ids[at : at + size], n]])
        start, ids = start + whole * self.length, ids[whole * size :]
        while ids:
            need = len(ids) // 4
            fit = min((w for w in self.open if w[0] >= need), key=lambda w: w[0], default=None)
            if fit is None and len(self.open) < self.windows:
                fit = [self.length, []]
                self.open.append(fit)
            if fit is None:
                fullest = min(self.open, key=lambda w: w[0])
                free = fullest[0]
                fullest[1].append([key, start, ids[: 4 * free], n])
                self.open.remove(fullest)
                self._close(fullest[1])
                start, ids = start + free, ids[4 * free :]
                continue
            fit[0] -= need
            fit[1].append([key, start, ids, n])
            if not fit[0]:
                self.open.remove(fit)
                self._close(fit[1])
            return

    def merge(self) -> list[list]:
        """Fills the fullest open windows from the emptiest; the pieces left fill less than one sequence."""
        pieces = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        self.open, held, room = [], [], self.length
        for key, start, ids, n in pieces:
            while len(ids) // 4 >= room:
                held.append([key, start, ids[: 4 * room], n])
                self._close(held)
                start, ids, held, room = start + room, ids[4 * room :], [], self.length
            if ids:
                held.append([key, start, ids, n])
                room -= len(ids) // 4
        return held

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, _KINDS, strict=True)], _NAMES)


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, windows: int = WINDOWS, end: int = 0) -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of all documents; ids are little-endian 32-bit numbers.

    A document is its ids and one id `end` (null and empty texts: `end` alone); repeated
    rows are packed each, null keys too. Each partition packs its own rows with a fixed
    number of open windows; what is left fills less than one sequence, and the leftovers
    of MERGED partitions are merged by one task, which so holds at most MERGED * length ids.
    One sequence of each such task stays short. Sequence ids are unique, not gapless.
    """
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        part = TaskContext.get().partitionId()
        packer, enc = Packer(length, windows, part << 32), encoder(path)
        stop = np.array([end], "<u4").tobytes()
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = enc.encode(t or "")
                packer.add(k, 0, x + stop, len(x) // 4 + 1)
            yield _batch(packer.take())
        left = packer.merge()
        yield _batch(packer.take() + [(k, s, len(x) // 4, 0, n, part, i, x, True) for i, (k, s, x, n) in enumerate(left)])

    placed = stage(df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{OUT}, open boolean"), "packed")

    def last(t: pa.Table) -> pa.Table:
        group = t.column("sequence_id")[0].as_py() // MERGED
        packer = Packer(length, 1, (1 << 62) + (group << 32))
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("sequence_id", "offset", "key", "start", "ids", "doc_tokens")), strict=True), key=lambda r: r[:2])
        packer.open = [[0, [[k, s, x, n] for _, _, k, s, x, n in rows]]]
        rest = packer.merge()
        if rest:
            packer._close(rest)
        return pa.Table.from_batches([_batch(packer.take())]).drop_columns("open")

    merged = placed.where("open").groupBy(F.expr(f"sequence_id div {MERGED}").alias("g")).applyInArrow(last, OUT)
    return placed.where("not open").drop("open").unionByName(merged).withColumnRenamed("key", key)
