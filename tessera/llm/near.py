"""Near-duplicates by the Jaccard likeness of distinct shingles.

Texts of one shingle set are one node. SimHash (op 4: its fingerprints, met in the middle) finds
the first links. Texts that are alike but further apart than its radius meet in a band: BANDS bands of ROWS minima
of the set under random orders, so a pair at a likeness of 0.8 is missed in all of them with
a chance of 1e-7. A bucket's members are each compared with its least one; where that
leaves a bucket in more than one component, all its pairs across components are
compared too, each in the first bucket where it meets, but for those that share too few of all minima (FEW). Each
comparison is the exact likeness of the two texts' shingle sets (as 64-bit hashes), which SimHash's links pass as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import ASCII_LOWER, UnionFind, binary, components, drop_staged, lean, map_rows, stage, tune

BANDS, ROWS = 40, 5
#: Minima of BANDS * ROWS that texts at 0.8 share at least: the mean is 160, the deviation 5.7; fewer have a chance of 1e-8.
FEW = 128
#: Jobs that the comparisons with one text are dealt to at most.
DEALT = 64
#: Members of a bucket that are compared with others at a time.
STRIP = 64
#: Members of a bucket whose texts a job holds at most on each of its two sides.
BLOCK = 4096


def shingles(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles (fewer words: all of them as one; none: empty)."""
    w = text.translate(ASCII_LOWER).split()
    k = min(shingle, len(w))
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    out = np.full(len(w) - k + 1 if k else 0, k, np.uint64)
    for j in range(k):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(out)])
    return np.unique(out)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of shingles."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_ORDERS = np.random.default_rng(12_345).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32, endpoint=False) | np.uint32(1)


def minima(h: np.ndarray) -> np.ndarray:
    """The least of a set of shingles under each order, of 32 bits of their hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    h = (h >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(h), 1024):
        x = h[k : k + 1024] ^ _ORDERS[0]
        x *= _ORDERS[1]
        np.minimum(least, x.min(1), out=least)
    return least.astype(np.uint64)


def bands(least: np.ndarray) -> np.ndarray:
    """A hash for each band of minima."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for x in least.reshape(BANDS, ROWS).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + x)
    return out


def signature(least: np.ndarray) -> bytes:
    """A byte of each minimum: other minima share it with a chance of 1 in 256."""
    return _mixed(least).astype(np.uint8).tobytes()


def _described(shingle: int):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[bytes, tuple[bytes, bytes, bytes, int]] = {}
        out = []
        for t in binary(b.column(1)):
            if (s := seen.get(t)) is None:
                h = shingles(t, shingle)
                least = minima(h)
                s = seen[t] = xxhash.xxh3_128_digest(h.tobytes()), signature(least), bands(least).tobytes() if len(h) else b"", simhash.fingerprint(t)
            out.append(s)
        fp = pa.array(np.array([s[3] for s in out], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array([s[i] for s in out], pa.binary()) for i in range(3)), fp], ["row", "whole", "sig", "bands", "fp"])

    return run


def _emit(b: pa.RecordBatch) -> pa.RecordBatch:
    raw = b.column(1).to_pylist()
    n = np.fromiter((len(x) // 8 for x in raw), np.int64, len(raw))
    return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(np.repeat(np.asarray(b.column(0)), n))], ["variant", "cid"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by variant and cid, all but each bucket's least cid, with that one."""
    before = pivot = None
    for b in batches:
        if not b.num_rows:
            continue
        key, cid = np.asarray(b.column(0)), np.asarray(b.column(1))
        new = np.concatenate(([int(key[0]) != before], key[1:] != key[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        least = np.where(at < 0, cid[0] if pivot is None else pivot, cid[np.maximum(at, 0)])
        k = ~new
        yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(least[k]), pa.array(cid[k])], ["variant", "a", "b"])
        before, pivot = int(key[-1]), int(least[-1])


def _judge(similarity: float, shingle: int):
    """Of rows (a, part, cid, text) sorted so that a's own text comes first, the links (a, cid) of a likeness of at least similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        job, own = None, np.zeros(0, np.uint64)
        for b in batches:
            links = []
            for a, part, cid, text in zip(*(b.column(i).to_pylist() for i in range(3)), binary(b.column(3)), strict=True):
                h = shingles(text, shingle)
                if (a, part) != job:
                    job, own = (a, part), h
                elif min(len(h), len(own)) >= similarity * max(len(h), len(own)) and likeness(own, h) >= similarity:
                    links.append((a, cid))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])
        lean()

    return run


def _starts(t: pa.Table, keys: int) -> np.ndarray:
    """Where runs of rows with the same first columns begin."""
    cols = [np.asarray(t.column(i)) for i in range(keys)]
    return np.concatenate(([0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1))


def _whole(batches: Iterator[pa.RecordBatch], keys: int = 1, least: int = 20_000) -> Iterator[pa.Table]:
    """Rows sorted by their first columns as tables of about `least` rows that end where those change; a run may go over several batches."""
    lean()
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(h.num_rows for h in held) < least or all(held[0].column(i)[0] == b.column(i)[-1] for i in range(keys)):
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = int(_starts(t, keys)[-1])
        yield t.slice(0, last)
        held = t.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    lean()


def _bytes(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _close(sig: np.ndarray, group: np.ndarray, few: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strip by strip the pairs (x, y), x < y, of a bucket's members of different groups that share `few` minima at least."""
    n = len(sig)
    for a in range(0, n, STRIP):
        for b in range(a, n, 16 * STRIP):
            x, y = np.nonzero(group[a : a + STRIP, None] != group[None, b : b + 16 * STRIP])
            x, y = x + a, y + b
            k = x < y
            x, y = x[k], y[k]
            near = np.concatenate([(sig[x[k : k + 50_000]] == sig[y[k : k + 50_000]]).sum(1) >= few for k in range(0, len(x), 50_000)] or [np.zeros(0, bool)])
            if near.any():
                yield x[near], y[near]


def _first(variant: int, bands_: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a bucket is that of the first band that x and y share."""
    at = np.concatenate([(bands_[x[k : k + 50_000]] == bands_[y[k : k + 50_000]]).argmax(1) for k in range(0, len(x), 50_000)])
    return bands_[x, at].view(np.int64) == variant


def _verify(few: int):
    """Of rows (variant, cid, sig, root) sorted by variant, all pairs of a bucket across components that share `few` minima at least, the lesser first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            cid, sig, group = np.asarray(t.column(1)), _bytes(t.column(2), np.uint8, BANDS * ROWS), np.asarray(t.column(3))
            starts = _starts(t, 1).tolist()
            for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
                for x, y in _close(sig[s:e], group[s:e], few):
                    u = np.sort(np.stack((cid[s:e][x], cid[s:e][y]), 1), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], ["a", "b"])

    return run


def _wanted(few: int):
    """Of rows (variant, cid, sig, root, bands) sorted by variant, the members of pairs that _judge_bucket is to compare, by job.

    A job (variant, part) has a bucket's members of one block, or of two as its sides, so that what it
    holds is bounded. Rows are at most the bucket's members times its blocks, never its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            key, sig, group, met = np.asarray(t.column(0)), _bytes(t.column(2), np.uint8, BANDS * ROWS), np.asarray(t.column(3)), _bytes(t.column(4), np.uint64, BANDS)
            starts, out = _starts(t, 1).tolist(), []
            for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
                take = np.zeros(e - s, bool)
                for x, y in _close(sig[s:e], group[s:e], few):
                    k = _first(int(key[s]), met[s:e], x, y)
                    take[x[k]] = take[y[k]] = True
                at = np.flatnonzero(take) + s
                blocks = [at[k : k + BLOCK] for k in range(0, len(at), BLOCK)]
                for i, p in enumerate(blocks):
                    out += [(p, i * len(blocks) + j, 0) for j in range(i, len(blocks))] + [(p, j * len(blocks) + i, 1) for j in range(i)]
            if out:
                n = [len(p) for p, _, _ in out]
                got = t.take(pa.array(np.concatenate([p for p, _, _ in out])))
                part, side = (pa.array(np.repeat([o[i] for o in out], n).astype(np.int32)) for i in (1, 2))
                yield from pa.table([got.column(0), part, side, *got.columns[1:]], ["variant", "part", "side", "cid", "sig", "root", "bands"]).to_batches(10_000)

    return run


def _judge_bucket(few: int, similarity: float, shingle: int):
    """Of rows (variant, part, side, cid, sig, root, bands, text) sorted by the first four, links of a likeness of at least `similarity` that join all components of a job that its pairs join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, 2, 2_000):
            key, side, cid, group = (np.asarray(t.column(i)) for i in (0, 2, 3, 5))
            sig, met = _bytes(t.column(4), np.uint8, BANDS * ROWS), _bytes(t.column(6), np.uint64, BANDS)
            starts, links = _starts(t, 2).tolist(), []
            for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
                h = [shingles(x, shingle) for x in binary(t.column(7).slice(s, e - s))]
                joined, two = UnionFind(), bool(side[s:e].any())
                for x, y in _close(sig[s:e], group[s:e], few):
                    k = _first(int(key[s]), met[s:e], x, y)
                    if two:
                        k &= side[s:e][x] != side[s:e][y]
                    for i, j in zip(x[k].tolist(), y[k].tolist(), strict=True):
                        p, q = int(group[s + i]), int(group[s + j])
                        if joined.find(p) != joined.find(q) and min(len(h[i]), len(h[j])) >= similarity * max(len(h[i]), len(h[j])) and likeness(h[i], h[j]) >= similarity:
                            joined.join(p, q)
                            links.append(sorted((int(cid[s + i]), int(cid[s + j]))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def numbered(df: DataFrame) -> DataFrame:
    """df staged with a number for each row, `row`."""
    tune(df.sparkSession)
    return stage(df.withColumn("row", F.monotonically_increasing_id()), "numbered")


def _links(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Of distinct pairs of rows (a, b), a < b, those of a likeness of at least `similarity`, staged. Comparisons with one text are dealt to DEALT jobs.

    What texts are needed is staged first, so that Spark knows its size and moves the smaller side.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(DEALT)))
    needs = stage(dealt.select("a", "part", F.col("a").alias("cid")).distinct().unionByName(dealt.select("a", "part", F.col("b").alias("cid"))), "needs")
    jobs = needs.join(texts, F.col("cid") == F.col("row")).select("a", "part", "cid", "text")
    got = stage(jobs.repartition("a", "part").sortWithinPartitions("a", "part", "cid").mapInArrow(_judge(similarity, shingle), "a long, b long"), "likely")
    drop_staged(needs)
    return got


def _balls(nodes: DataFrame) -> DataFrame:
    """Pairs of rows (a, b), a < b, that SimHash finds, staged: texts of one fingerprint with the least of them, and the least ones of fingerprints that it links."""
    least = stage(nodes.groupBy("fp").agg(F.min("cid").alias("least")), "fingerprints")
    linked = stage(simhash.links(least).distinct(), "balls")
    across = linked.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = nodes.select("fp", "cid").join(least, "fp").where("cid <> least").select(F.col("least").alias("a"), F.col("cid").alias("b"))
    got = stage(across.unionByName(same).distinct(), "pairs")
    drop_staged(least, linked)
    return got


def groups(rows: DataFrame, text: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(row, root) of a numbered table: the least row reachable by links between texts of a likeness of at least `similarity`.

    Null and empty texts are alike. A bucket of texts that are near but not alike is compared pair by pair.
    """
    texts = rows.select("row", F.col(text).cast("string").alias("text"))
    f = stage(map_rows(texts, _described(shingle), "row long, whole binary, sig binary, bands binary, fp long"), "signatures")
    nodes = stage(f.groupBy("whole").agg(F.min(F.struct("row", "sig", "bands", "fp")).alias("of")).select("whole", F.col("of.row").alias("cid"), "of.sig", "of.bands", "of.fp"), "distinct")
    balls = _balls(nodes)
    links = _links(balls, texts, similarity, shingle)
    cc = components(links)
    of = lambda cc, c: (cc.select(F.col("node").alias(f"node_{c}"), F.col("root").alias(f"root_{c}")), F.col(c) == F.col(f"node_{c}"), "left")
    apart = lambda cc, pairs: pairs.join(*of(cc, "a")).join(*of(cc, "b")).where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    met = map_rows(nodes.select("cid", "bands"), _emit, "variant long, cid long")
    met = stage(met.repartition("variant").sortWithinPartitions("variant", "cid").mapInArrow(_stars, "variant long, a long, b long"), "met")
    first = stage(met.select("a", "b").distinct(), "pairs")
    some = _links(apart(cc, first), texts, similarity, shingle)
    drop_staged(balls, cc)
    cc = components(links.unionByName(some))
    open_ = stage(met.join(apart(cc, first), ["a", "b"], "left_semi").select("variant").distinct(), "open")
    still = met.join(open_, "variant", "left_semi")
    members = still.select("variant", F.col("b").alias("cid")).unionByName(still.select("variant", F.col("a").alias("cid")).distinct())
    members = members.join(nodes.select("cid", "sig", "bands"), "cid").join(*of(cc, "cid")).select("variant", "cid", "sig", F.coalesce("root_cid", "cid").alias("root"), "bands")
    wanted = stage(members.repartition("variant").sortWithinPartitions("variant").mapInArrow(_wanted(FEW), "variant long, part int, side int, cid long, sig binary, root long, bands binary"), "wanted")
    needs = stage(wanted.select(F.col("cid").alias("row")).distinct(), "needs")
    few = stage(texts.join(needs, "row", "left_semi"), "texts")
    jobs = wanted.join(few, F.col("cid") == F.col("row")).drop("row").repartition("variant", "part").sortWithinPartitions("variant", "part", "side", "cid")
    more = stage(jobs.mapInArrow(_judge_bucket(FEW, similarity, shingle), "a long, b long"), "likely")
    drop_staged(met, first, open_, wanted, needs, few, cc)
    cc = components(links.unionByName(some).unionByName(more))
    named = nodes.join(cc, F.col("cid") == F.col("node"), "left").select("whole", F.coalesce("root", "cid").alias("root"))
    found = stage(f.select("row", "whole").join(named, "whole").select("row", "root"), "groups")
    drop_staged(f, nodes, links, some, more, cc)
    return found


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(key, component): the least key reachable by links between texts of a likeness of at least `similarity`.

    Null keys never win; null and empty texts are alike. One row for each input row.
    """
    rows = numbered(df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")))
    found = stage(rows.select("row", "key").join(groups(rows, "text", similarity, shingle), "row"), "found")
    least = found.groupBy("root").agg(F.min("key").alias("component"))
    return found.join(least, "root").select(F.col("key").alias(key), "component")
