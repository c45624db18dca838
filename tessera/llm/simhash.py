"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, binary, components, map_rows, stage, tune

BITS = 64
#: Blocks of a fingerprint, one of which is left out of a variant.
BLOCKS = 4
SPAN = BITS // BLOCKS


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the shingles; no words: zero."""
    w = text.translate(ASCII_LOWER).split()
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    # Ends of words in the line; a shingle is a slice of it.
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - shingle + 1].tolist()
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    h = np.array([digest(view[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65_536):
        total += np.unpackbits(h[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp): the 64-bit fingerprint of every whole text as a signed long. No shuffle."""
    tune(df.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[bytes, int] = {}
        out = []
        for t in binary(b.column(1)):
            if (f := seen.get(t)) is None:
                f = seen[t] = fingerprint(t, shingle, seed)
            out.append(f)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["key", "fp"])

    return map_rows(df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")), run, "key long, fp long").withColumnRenamed("key", key)


def _low(block: int) -> np.uint64:
    return np.uint64((1 << SPAN) - 1) << np.uint64(block * SPAN)


def _turned(x: np.ndarray, by: int | np.ndarray) -> np.ndarray:
    """Rotated left by so many bits."""
    by = np.asarray(by, np.uint64) % np.uint64(BITS)
    return (x << by) | (x >> (np.uint64(BITS) - by) % np.uint64(BITS))


#: Bit 0 for none, else each bit outside the lowest block.
_FLIPS = np.array([0, *(1 << i for i in range(SPAN, BITS))], np.uint64)


def _variants(fp: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, 1 + kept bits) twice: each with a block cleared, as it is and with each other bit flipped, and what gives the fingerprint back.

    The block is turned to the lowest bits, where its number stands instead; the second is its value and which of _FLIPS it is.
    """
    turned = _turned(fp, -block * SPAN % BITS)
    bare, value = turned & ~_low(0), (turned & _low(0)).astype(np.int32)
    return bare[:, None] ^ _FLIPS | np.uint64(block), value[:, None] | np.arange(len(_FLIPS), dtype=np.int32) << SPAN


def _fingerprints(variant: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block, the variant with that block cleared and the fingerprint of rows of _variants."""
    block = variant & _low(0)
    bare, back = variant & ~_low(0), block * np.uint64(SPAN)
    return block.astype(np.int32), _turned(bare, back), _turned(bare ^ _FLIPS[mark >> SPAN] | (mark & (1 << SPAN) - 1).astype(np.uint64), back)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.asarray(b.column(0)).view(np.uint64)
        for i in range(0, len(fps), 512):
            for k in range(BLOCKS):
                v, mark = _variants(fps[i : i + 512], k)
                yield pa.RecordBatch.from_arrays([pa.array(v.ravel().view(np.int64)), pa.array(mark.ravel())], ["variant", "mark"])


def _near() -> dict[int, np.ndarray]:
    """Masks of one, two and three bits of a block."""
    return {d: np.array([sum(1 << i for i in c) for c in combinations(range(SPAN), d)], np.int64) for d in (1, 2, 3)}


def _bucket(block: int, variant: int, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all members of a bucket whose distance is at most radius, as far as the bucket can tell.

    Outside its block a member differs from the bucket's variant in one bit or none (its
    mark), so two members differ there in 0 bits (same mark), 1 (one has none) or 2; in
    the block they differ as their block values do. Members of one block value are
    all within 2 and are linked to one of them. Between two block values it is enough
    to know which marks occur: a sum within the radius is a verified pair. Values are
    met by their distance (each has 696 neighbours within 3), so the work is in proportion to
    the members.
    """
    keep = ~np.uint64(_low(block))
    marks = (fps ^ np.uint64(variant)) & keep
    values = ((fps & _low(block)) >> np.uint64(block * SPAN)).astype(np.int64)
    by: dict[int, dict[int, int]] = {}
    out: list[tuple[int, int]] = []
    for f, m, v in zip(fps.tolist(), marks.tolist(), values.tolist(), strict=True):
        held = by.setdefault(v, {})
        if held and radius >= 2:
            out.append((f, next(iter(held.values()))))
        held[m] = f
    if radius < 2:
        for held in by.values():
            if 0 in held and radius == 1:
                out += [(f, held[0]) for m, f in held.items() if m]
    near = _near() if len(by) > 1500 else None
    keys = np.array(sorted(by), np.int64)

    def meet(v: int, w: int, d: int) -> None:
        a, b, left = by[v], by[w], radius - d
        if left >= 2:
            out.append((next(iter(a.values())), next(iter(b.values()))))
        elif left == 1 and 0 in a:
            out.append((a[0], next(iter(b.values()))))
        elif left == 1 and 0 in b:
            out.append((next(iter(a.values())), b[0]))
        elif left >= 0 and (same := a.keys() & b.keys()):
            m = min(same)
            out.append((a[m], b[m]))

    if near is None:
        for i, v in enumerate(keys.tolist()):
            rest = keys[i + 1 :]
            d = np.bitwise_count(rest ^ v)
            for w, x in zip(rest[d <= radius].tolist(), d[d <= radius].tolist(), strict=True):
                meet(v, w, x)
    else:
        for v in keys.tolist():
            for d, masks in near.items():
                if d <= radius:
                    for w in (v ^ masks).tolist():
                        if w > v and w in by:
                            meet(v, w, d)
    return out


def _collide(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by variant; a run of equal ones may go over several batches."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def cut(block: np.ndarray, variant: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero((variant[1:] != variant[:-1]) | (block[1:] != block[:-1])) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(fp)]))
            big = ends - starts > 1
            links: set[tuple[int, int]] = set()
            for s, e in zip(starts[big].tolist(), ends[big].tolist(), strict=True):
                links.update(_bucket(int(block[s]), int(variant[s]), np.unique(fp[s:e]), radius))
            if links:
                u = np.array(sorted(links), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            now = _fingerprints(np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1)))
            held.append(now)
            if held[0][1][0] == now[1][-1] and held[0][0][0] == now[0][-1]:
                continue
            block, variant, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.flatnonzero((variant != variant[-1]) | (block != block[-1]))[-1]) + 1
            yield from cut(block[:last], variant[:last], fp[:last])
            held = [(block[last:], variant[last:], fp[last:])]
        if held:
            yield from cut(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp) within radius bits of each other.

    A pair within 3 bits differs in a block or not at all: without that block, within 2.
    Each fingerprint emits, for each block left out, the variants within half of
    that (one bit): 4 * 49 rows. Any such pair meets in a variant; the pairs that meet are
    verified over all 64 bits. In a bucket only links that span its classes are emitted, never all pairs.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the radius is 0 to 3")
    met = distinct.select("fp").mapInArrow(_emit, "variant long, mark int")
    met = met.repartition("variant").sortWithinPartitions("variant")
    return met.mapInArrow(_collide(radius), "a long, b long")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp, component): fingerprint and the least key reachable by links of at most radius bits.

    Equal fingerprints are one class and are reduced to their least key before anything
    is shuffled by variant. Texts that are null or without words have fingerprint zero and link like
    any other. Null keys never win: a component of null keys only has a null id. One row for each input row.
    """
    f = stage(fingerprints(df, key, text, shingle, seed).withColumnRenamed(key, "key"), "fingerprints")
    least = stage(f.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    cc = components(links(least, radius))
    rooted = least.join(cc, least.fp == cc.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(of_root, "root").select("fp", "component")
    return f.join(named, "fp").select(F.col("key").alias(key), "fp", "component")
