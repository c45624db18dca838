"""Language-model scores by online logistic mixing of hashed contexts.

A text is a sequence of binary decisions: each byte (A-Z lower-cased, byte 0 at the end)
is spelled by a prefix code that depends on the byte before. Several predictors give a
decision's log-odds from counts hashed by a context (two bytes, four bytes, the word so
far) and the decision; the counts are taken over all training texts. A mixer adds
the log-odds by weights from two sets, gated by whether the longest context is known, and
a second stage refines gain and bias; both learn online after every decision.
Texts are cut into segments of SEGMENT bytes, which keep their contexts but each start
with fresh weights, so that a chunk's segments run side by side as lanes of vectors. The
sum of a text's decisions is its log-probability, total bits over bytes its bits per byte.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, CHUNK_BYTES, drop_staged, lean, open_chunk, release, stage, stage_chunks

#: Slots of a predictor's table at least; slots for each distinct training context and byte; registers of their count, of one context in THIN.
SLOTS = 1 << 18
ROOM = 4
REGISTERS = 1 << 12
THIN = 16
#: Slots of a predictor's table at most: a bound for what is broadcast (48 MB) and counted by a task (384 MB).
MOST = 1 << 24
#: Predictors; bytes of a text that are spelled at a time; texts side by side.
CONTEXTS = 3
SPAN = 1024
LANES = 384
#: Decisions after which weights move, by the spans before: from the given span on.
STEPS = ((0, 16), (1, 32), (4, 128), (16, 256))
#: Bytes whose decisions are counted at a time, and bytes that are hashed at a time (arrays stay in a core's cache).
PART = 1 << 20
HASHED = 1 << 15
#: Bytes of a word's beginning that its context holds, and the base of its hash.
REACH = 24
BASE = 0x9E3779B97F4A7C15
#: Slots of a block of counts; partitions merged by one task at each level.
BLOCK = 1 << 16
MERGED = 256
#: Counts that both outcomes start with; log-odds are kept in sixteenths.
PRIOR = 0.1
UNIT = 16.0
RATE, RATE_2, START = 0.005, 0.005, 0.3


def is_training(key: int | None) -> bool:
    """One text of seven, by the CRC-32 of its key as text (null: empty), is held out and not learned from."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % 7 != 2


class Spelling:
    """Prefix codes of bytes by the byte before: decisions (node, bit) of each pair in flat arrays."""

    def __init__(self, pairs: np.ndarray) -> None:
        """pairs: counts (256, 256) of byte after byte. Every byte stays possible after every other."""
        start, node, bit = np.zeros(65_537, np.int64), [], []
        for before in range(256):
            heap = [(int(c) * 256 + 1, s, s) for s, c in enumerate(pairs[before].tolist())]
            heapq.heapify(heap)
            k = 256
            while len(heap) > 1:
                (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
                heapq.heappush(heap, (a + b, k, (x, y)))
                k += 1
            ways: list = [None] * 256
            queue = [(heap[0][2], ())]
            seen = 0
            for tree, way in queue:
                if isinstance(tree, int):
                    ways[tree] = way
                    continue
                # Nodes are numbered from the root down: frequent decisions of a context lie side by side.
                for one in (0, 1):
                    queue.append((tree[one], (*way, (seen, one))))
                seen += 1
            for s, way in enumerate(ways):
                start[before << 8 | s] = len(node)
                node += [n for n, _ in way]
                bit += [b for _, b in way]
        start[65_536] = len(node)
        self.start, self.length = start[:-1].astype(np.int32), np.diff(start).astype(np.int32)
        #: Node and bit of each decision as one number, node * 2 + bit.
        self.step = np.array(node, np.int32) << 1 | np.array(bit, np.int32)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and its inverse modulo 2 ** 64 for k below n; kept for the longest view so far."""
    if not _POWERS or len(_POWERS[0]) < n:
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[:1] = 1
            both.append(np.cumprod(x))
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


class Bytes:
    """The texts of a chunk as one array of bytes, and what each is spelled from."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = b"\0".join(texts) + b"\0" if texts else b""
        self.b = np.frombuffer(joined.translate(ASCII_LOWER), np.uint8)
        self.size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.end = np.cumsum(self.size)
        n = len(self.b)
        self.at = np.arange(n, dtype=np.int32) - np.repeat((self.end - self.size).astype(np.int32), self.size)  # place in the text
        self.pair = self._back(1).astype(np.int32) << 8 | self.b

    def _back(self, k: int) -> np.ndarray:
        """The byte k places before, or 0 beyond the text's start."""
        out = np.zeros(len(self.b), np.uint8)
        np.multiply(self.b[:-k], self.at[k:] >= k, out=out[k:])
        return out

    def contexts(self, slots: list[int]) -> np.ndarray:
        """(CONTEXTS, bytes) hashes, each predictor's below its slots."""
        return (self.hashes() >> np.array([[33 - n.bit_length()] for n in slots], np.uint32)).astype(np.int32)

    def hashes(self) -> np.ndarray:
        """(CONTEXTS, bytes) hashes of 32 bits."""
        back = [None] + [self._back(k).astype(np.uint32) for k in range(1, 5)]
        m = np.uint32(2654435761)
        two = (back[2] << np.uint32(8) | back[1]) + np.uint32(1)
        four = (back[4] << np.uint32(24) | back[3] << np.uint32(16) | back[2] << np.uint32(8) | back[1]) ^ np.uint32(0x5BD1E995)
        # The word so far, its last REACH bytes at most: a polynomial taken from sums over the whole array.
        n = len(self.b)
        place = np.arange(n, dtype=np.int32)
        begin = place * (back[1] <= 32)  # the byte before a text's start is 0
        begin = np.maximum(np.maximum.accumulate(begin), place - np.minimum(self.at, REACH)).astype(np.int64)
        power, inverse = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.b + np.uint64(1)) * power, out=sums[1:])
        word = ((sums[:-1] - sums[begin]) * inverse[begin] >> np.uint64(32)).astype(np.uint32)
        mix = lambda x: ((x * m) ^ (x * m >> np.uint32(15))) * np.uint32(2246822519)
        return np.stack([mix(two * np.uint32(3)), mix(four), mix(word ^ np.uint32(0x27D4EB2F))])


def _decisions(pair: np.ndarray, spelling: Spelling) -> tuple[np.ndarray, np.ndarray]:
    """(decisions of each byte, node * 2 + bit of each decision) of bytes with the byte before."""
    n = spelling.length[pair]
    ends = np.cumsum(n, dtype=np.int32)
    flat = np.repeat(spelling.start[pair] - (ends - n), n)
    flat += np.arange(len(flat), dtype=np.int32)
    return n, spelling.step.take(flat)


def _register(seen: np.ndarray, hashes: np.ndarray, b: np.ndarray) -> None:
    """Brings the registers (HyperLogLog) up to date with contexts and the bytes after them."""
    k = np.flatnonzero(hashes & np.uint32(THIN - 1) == 0)
    x = hashes[k].astype(np.uint64) << np.uint64(8) | b[k]
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    rank = 52 - np.frexp((x & np.uint64((1 << 51) - 1)).astype(np.float64))[1]
    np.maximum.at(seen, (x >> np.uint64(52)).astype(np.int64), rank.astype(np.int64))


def _distinct(seen: np.ndarray) -> float:
    n = len(seen)
    got = 0.7213 / (1 + 1.079 / n) * n * n / np.exp2(-seen.astype(np.float64)).sum()
    none = int((seen == 0).sum())
    return THIN * (n * math.log(n / none) if none and got < 2.5 * n else got)


def pair_counts(chunks: DataFrame, train) -> tuple[np.ndarray, list[int]]:
    """Counts (256, 256) of byte after byte in training texts, and each predictor's distinct contexts with a byte after (within 2 % or so)."""
    size = 65_536 + CONTEXTS * REGISTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        seen = total[65_536:].reshape(CONTEXTS, REGISTERS)
        for b in batches:
            for blob in b.column(1).to_pylist():
                lean()
                keys, texts = open_chunk(blob)
                x = Bytes([t for k, t in zip(keys, texts, strict=True) if train(k)])
                total[:65_536] += np.bincount(x.pair, minlength=65_536)
                for lo in range(0, len(x.b), PART):
                    hi = min(lo + PART, len(x.b))
                    for k, h in enumerate(_views(x, None, lo, hi)):
                        _register(seen[k], h, x.b[lo:hi])
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["pair", "n"])

    got = chunks.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    out = np.zeros(size, np.int64)
    for r in got:
        out[r.pair] = r.n if r.pair < 65_536 else r.most
    return out[:65_536].reshape(256, 256), [int(_distinct(x)) for x in out[65_536:].reshape(CONTEXTS, REGISTERS)]


def slots_for(distinct: int) -> int:
    """The power of two that gives each distinct context and byte ROOM slots (as a byte is several decisions), SLOTS at least and MOST at most."""
    return min(MOST, max(SLOTS, 1 << (ROOM * distinct - 1).bit_length()))


def _add(total: np.ndarray, context: np.ndarray, pair: np.ndarray, spelling: Spelling) -> None:
    """Adds the decisions of bytes to counts by slot and bit; bytes of one context and pair are spelled once, in order of slots."""
    at = context.astype(np.int64) << 16 | pair
    at.sort()
    begin = np.flatnonzero(np.concatenate(([len(at) > 0], at[1:] != at[:-1])))
    times = np.diff(begin, append=len(at)).astype(np.int32)
    at = at[begin]
    n, step = _decisions((at & 0xFFFF).astype(np.int32), spelling)
    # A node is less than 256, so a slot's number stays below slots.
    at = np.repeat(at >> 16 << 1, n)
    at ^= step
    np.add.at(total, at, np.repeat(times, n))


def _count(spelling, train, slots: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(n * 2, np.int32) for n in slots]
        for b in batches:
            for blob in b.column(1).to_pylist():
                lean()
                keys, texts = open_chunk(blob)
                x = Bytes([t for k, t in zip(keys, texts, strict=True) if train(k)])
                for lo in range(0, len(x.b), PART):
                    hi = min(lo + PART, len(x.b))
                    for k, sub in enumerate(_views(x, slots, lo, hi)):
                        _add(total[k], sub, x.pair[lo:hi], spelling.value)
        part = TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=1)
        for k in range(CONTEXTS):
            for i in range(0, slots[k], BLOCK):
                c = total[k][2 * i : 2 * (i + BLOCK)]
                if c.any():
                    yield pa.RecordBatch.from_arrays([pa.array([(sum(slots[:k]) + i) // BLOCK]), pa.array([part], pa.int64()), pa.array([press.compress(c.astype("<i8").tobytes())], pa.binary())], ["block", "part", "counts"])

    return run


def _cut(x: Bytes, slots: list[int] | None, lo: int, hi: int) -> np.ndarray:
    """Contexts (no slots: their hashes) of a range of bytes: those of a view with the bytes before it that contexts hold."""
    from_ = max(0, lo - REACH - 1)
    y = Bytes.__new__(Bytes)
    y.b, y.at = x.b[from_:hi], x.at[from_:hi]
    return (y.contexts(slots) if slots else y.hashes())[:, lo - from_ :]


def _views(x: Bytes, slots: list[int] | None, lo: int, hi: int) -> np.ndarray:
    """The same, HASHED bytes at a time."""
    out = np.empty((CONTEXTS, hi - lo), np.int32 if slots else np.uint32)
    for i in range(lo, hi, HASHED):
        j = min(i + HASHED, hi)
        out[:, i - lo : j - lo] = _cut(x, slots, i, j)
    return out


def _sum(t: pa.Table) -> pa.Table:
    total = 0
    for c in t.column("counts").to_pylist():
        total = total + np.frombuffer(zstandard.decompress(c), "<i8")
    return pa.table([pa.array([t.column("block")[0].as_py()]), pa.array([t.column("part")[0].as_py() // MERGED], pa.int64()), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], ["block", "part", "counts"])


def _odds(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zstandard.decompress(c), "<i8") for c in t.column("counts").to_pylist()).reshape(-1, 2)
    s = np.log((total[:, 1] + PRIOR) / (total[:, 0] + PRIOR)) * UNIT
    return pa.table([pa.array([t.column("block")[0].as_py()]), pa.array([np.clip(np.rint(s), -127, 127).astype(np.int8).tobytes()], pa.binary())], ["block", "odds"])


def tables(chunks: DataFrame, spelling, train, slots: list[int]) -> list[np.ndarray]:
    """Log-odds of every slot of each predictor from counts over all training texts.

    Counts are merged in levels of MERGED partitions, so that no task gets a list that grows
    with the input. A table has a byte a slot; score() takes the slots from the distinct training contexts.
    """
    staged = counts = stage(chunks.mapInArrow(_count(spelling, train, slots), "block long, part long, counts binary"), "counts")
    parts = (counts.agg(F.max("part")).first()[0] or 0) + 1
    while parts > MERGED:
        counts = counts.groupBy("block", F.expr(f"part div {MERGED}").alias("g")).applyInArrow(_sum, "block long, part long, counts binary")
        parts = -(-parts // MERGED)
    out = np.zeros(sum(slots), np.int8)
    for r in counts.groupBy("block").applyInArrow(_odds, "block long, odds binary").collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.odds, np.int8)
    drop_staged(staged)
    return np.split(out, np.cumsum(slots)[:-1])


class Mixer:
    """The weights of texts that run side by side."""

    def __init__(self, lanes: int) -> None:
        self.w = np.full((2, CONTEXTS, lanes), START, np.float32)
        self.w[1] = 0.1
        self.gain, self.bias = np.ones(lanes, np.float32), np.zeros(lanes, np.float32)
        self.nats = np.zeros(lanes)

    def learn(self, odds: np.ndarray, bit: np.ndarray, first: np.ndarray, n: np.ndarray, step: int) -> None:
        """Nats of the decisions first to first + n of odds (CONTEXTS, decisions) and bit, and the weights after them.

        Lanes are in falling order of n, so that those still going are the first ones. Weights move after every `step` decisions.
        """
        most = int(n[0]) if len(n) else 0
        going = np.searchsorted(-n, -np.arange(0, most, step), side="left")
        whole = np.searchsorted(-n, -np.arange(step, most + step, step), side="right")
        ahead = np.arange(step)[:, None]
        many = 4 if step % 8 else 8  # so many chances are multiplied before a logarithm: (1 + e ** 11) ** 8 is below 2 ** 128
        rate, rate_2 = np.float32(-RATE / UNIT * (8 / step) ** 0.5), np.float32(-RATE_2 * (8 / step) ** 0.5)
        # A decision is one number of four bytes, so that one look-up gets its odds and its sign.
        packed = np.empty((len(bit), 4), np.int8)
        for c in range(CONTEXTS):
            packed[:, c] = odds[c, : len(bit)]
        packed[:, CONTEXTS] = 1 - 2 * bit
        packed = packed.view(np.int32)[:, 0]
        at = first + ahead
        for t, (k, full) in enumerate(zip(going.tolist(), whole.tolist(), strict=True)):
            if k < at.shape[1]:
                at = at[:, :k].copy()
            # (decisions, lanes): lanes lie side by side, so that every operation runs along them. Beyond a lane's end anything is read.
            got = packed[t * step :].take(at, mode="clip").view(np.int8).reshape(step, k, 4)
            both = np.empty((4, step, k), np.float32)
            both[...] = got.transpose(2, 0, 1)
            # Odds stay in sixteenths (a power of two, so nothing is rounded otherwise); what multiplies them is scaled.
            x, sign = both[:CONTEXTS], both[CONTEXTS]
            gate = x[1] != 0
            w = self.w[:, :, :k] * np.float32(1 / UNIT)
            z, more, term = w[0, 0] * x[0], w[1, 0] * x[0], np.empty((step, k), np.float32)
            for c in range(1, CONTEXTS):
                z += np.multiply(w[0, c], x[c], out=term)
                more += np.multiply(w[1, c], x[c], out=term)
            more *= gate
            z += more
            e = np.multiply(z, self.gain[:k], out=more)
            e += self.bias[:k]
            np.clip(e, -11, 11, out=e)
            e *= sign
            np.exp(e, out=e)
            if full < k:
                e[t * step + ahead >= n[:k]] = 0
            q = np.add(e, 1, out=term)
            self.nats[:k] += np.log(q.reshape(-1, many, k).prod(1)).sum(0)
            # The error of the refined odds, the chance of the other outcome, moves both stages.
            e /= q
            e *= sign
            self.gain[:k] += rate_2 * np.float32(0.1) * np.einsum("bk,bk->k", e, z)
            self.bias[:k] += rate_2 * e.sum(0)
            self.w[0, :, :k] += rate * np.einsum("cbk,bk->ck", x, e)
            e *= gate
            self.w[1, :, :k] += rate * np.einsum("cbk,bk->ck", x, e)


def score_texts(texts: list[bytes], spelling: Spelling, odds: list[np.ndarray]) -> np.ndarray:
    """Natural-log probabilities of texts; equal texts are scored once.

    Texts go in groups of LANES in order of length, each SPAN bytes at a time: beside the bytes and their
    contexts, memory holds the decisions of LANES * SPAN bytes.
    """
    distinct = {t: i for i, t in enumerate(sorted(dict.fromkeys(texts), key=len, reverse=True))}
    out = np.zeros(len(distinct))
    slots = list(map(len, odds))
    x = Bytes(list(distinct))
    context = _views(x, slots, 0, len(x.b))
    for i in range(0, len(out), LANES):
        begin, size = (x.end - x.size)[i : i + LANES], x.size[i : i + LANES]
        mixer = Mixer(len(size))
        for span in range(-(-int(size[0]) // SPAN)):
            k = int(np.searchsorted(-size, -span * SPAN, side="left"))
            take = np.minimum(size[:k] - span * SPAN, SPAN)
            ends = np.cumsum(take)
            at = np.repeat(begin[:k] + span * SPAN - (ends - take), take) + np.arange(int(ends[-1]))
            n, step = _decisions(x.pair[at], spelling)
            s, node, bit = np.empty((CONTEXTS, len(step)), np.int8), step >> 1, (step & 1).astype(np.int8)
            for c in range(CONTEXTS):
                slot = np.repeat(context[c, at], n)
                slot ^= node
                odds[c].take(slot, out=s[c], mode="clip")
            total = np.concatenate(([0], np.cumsum(n)))
            first, count = total[ends - take], total[ends] - total[ends - take]
            order = np.argsort(-count, kind="stable")
            part = Mixer.__new__(Mixer)
            part.w, part.gain, part.bias, part.nats = mixer.w[:, :, order], mixer.gain[order], mixer.bias[order], mixer.nats[order]
            part.learn(s, bit, first[order], count[order], next(b for a, b in reversed(STEPS) if span >= a))
            mixer.w[:, :, order], mixer.gain[order], mixer.bias[order], mixer.nats[order] = part.w, part.gain, part.bias, part.nats
        out[i : i + LANES] = -mixer.nats
    return out[[distinct[t] for t in texts]] if texts else out


def _counted(keys: list, texts: list[bytes], train) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk its distinct tokens (binary) in order of first use, each one's count in training texts, the tokens of all texts as
    places in that order, and the number of tokens of each text; the end is the empty token, the last in the order."""
    # Arrow splits at the same bytes as bytes.split and makes no object of a word; beside white space at a text's edge it has empty words.
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    words = split.flatten()
    full = pa.compute.not_equal(pa.compute.binary_length(words), 0)
    ends = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))[split.offsets.to_numpy()] + np.arange(len(texts) + 1)
    coded = words.filter(full).dictionary_encode()
    inside = np.ones(int(ends[-1]), bool)
    inside[ends[1:] - 1] = False
    at = np.full(len(inside), len(coded.dictionary))
    at[inside] = coded.indices.to_numpy()
    size = np.diff(ends)
    learned = np.repeat(np.fromiter(map(train, keys), bool, len(keys)), size)
    place = pa.concat_arrays([coded.dictionary.view(pa.binary()), pa.array([b""] if texts else [], pa.binary())])
    return place, np.bincount(at[learned], minlength=len(place)), at, size


def _tokens(train):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, place, 96-bit hash, count in training texts) for each distinct token of a chunk."""
        for b in batches:
            for n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lean()
                place, count, _, _ = _counted(*open_chunk(blob), train)
                h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, place.to_numpy(zero_copy_only=False))), [("a", "<i8"), ("b", "<i4"), ("rest", "<i4")])
                size = len(place)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, n)), pa.array(np.arange(size, dtype=np.int32)), pa.array(h["a"].copy()), pa.array(h["b"].copy()), pa.array(count)], ["chunk", "place", "a", "b", "n"])

    return run


def score(df: DataFrame, train, key: str = "doc_id", text: str = "text", slots: list[int] | None = None, chunk_bytes: int = CHUNK_BYTES // 2) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every whole text.

    slots: of each predictor's table, powers of two, BLOCK at least; by default they grow with the distinct training contexts.
    train: function of a key that says whether its text is one to learn from. base_score: the
    log10 probability of lower-cased words and an end under add-one counts of training
    tokens; score: that of the mixed model; bits_per_byte: of the text's bytes and its end.
    Null and empty texts are the end alone. One row for each input row; rows of one key are
    scored each; other columns are not read. Tokens are counted once for each chunk before they are shuffled (as 96-bit hashes),
    and come back to each chunk that has them if others do too, so the commonest word is as many rows as there are chunks: its share
    of the rows is one in the distinct tokens of a chunk, some 200,000 here.
    """
    spark = df.sparkSession
    chunks = stage_chunks(df, key, text, chunk_bytes)
    pairs, known = pair_counts(chunks, train)
    spelling = Spelling(pairs)
    slots = slots or list(map(slots_for, known))
    shared = spark.sparkContext.broadcast(spelling)
    odds = spark.sparkContext.broadcast(tables(chunks, shared, train, slots))
    w = Window.partitionBy("a", "b")
    counted = chunks.mapInArrow(_tokens(train), "chunk long, place int, a long, b int, n long")
    counted = stage(counted.withColumns({"c": F.sum("n").over(w), "first": F.min("chunk").over(w) == F.col("chunk")}).select("chunk", "place", "c", "first", "n"), "tokens")
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("first") & (F.col("c") > 0)).cast("long")), F.lit(0))).first()
    below = math.log10(total + distinct + 1)
    release(spark)

    def run(k: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        lean()
        keys, texts = open_chunk(docs.column("blob")[0].as_py())
        _, c, at, n = _counted(keys, texts, train)
        c[np.asarray(told.column("place"))] = np.asarray(told.column("c"))
        ends = np.concatenate(([0], np.cumsum(n)))
        known = np.diff(np.concatenate(([0], np.cumsum(c[at] > 0)))[ends])
        value = np.log10(c + 1.0)[at] - below
        base = [math.fsum(value[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        del c, at, value
        lean()
        nats = score_texts(texts, shared.value, odds.value)
        size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        return pa.table({
            "key": pa.array(keys, pa.int64()), "n_tokens": pa.array(n), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(n), total)),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(nats / math.log(10)), "n_bytes": pa.array(size), "bits_per_byte": pa.array(-nats / math.log(2) / (size + 1)),
        })

    got = chunks.groupBy("chunk").cogroup(counted.where("c <> n").select("chunk", "place", "c").groupBy("chunk")).applyInArrow(run, "key long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
    return got.withColumnRenamed("key", key)
