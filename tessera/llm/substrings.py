"""Substring deduplication by repeated-phrase automata.

1. Phrases that recur are confirmed: of each window the least hashed phrase is selected,
   so equal windows select equal phrases; phrases selected at two places or more, counted over
   all chunks, recur.
2. The recurring phrases of each chunk are compiled, as words, into Aho-Corasick automata in shards of
   bounded size, and all its documents are streamed through them. The hits are the only source of
   places: a window is a candidate if the automata located its selected phrase.
3. Candidate windows are compared by 128 bits (their own hash and their phrase's) over all chunks; those that also start earlier
   go. What was located is staged for that last pass, which streams and hashes nothing again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, drop_staged, lean, open_chunk, release_executors, stage, stage_chunks

#: Words of a window and of a phrase; phrases of one automaton; bits of a letter that words are spelled with there.
WINDOW = 20
PHRASE = 8
SHARD = 50_000
LETTER = 5
#: Chunks of one phrase that are compared by one task; phrases of more chunks are reduced in levels.
FAN = 64

_M = 0x9E3779B97F4A7C15
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of a word beyond which it is hashed by itself.
LONG = 256
#: White space: space, and bytes 9 to 13.
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def _rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of k consecutive word hashes, by doubling."""
    by, size, m, out, length = h, 1, _M, None, 0
    while True:
        if k & size:
            if out is None:
                out, length, power = by, size, m
            else:
                n = min(len(out) - size, len(by))
                out = by[:n] * np.uint64(power) + out[size : size + n]
                length, power = length + size, power * m & (2**64 - 1)
        if size * 2 > k:
            break
        by = by[:-size] * np.uint64(m) + by[size:]
        m, size = m * m & (2**64 - 1), size * 2
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalised, so that the order of hashes is as good as random; never zero."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


def _slide(x: np.ndarray, k: int, f: np.ufunc) -> np.ndarray:
    """f over k consecutive values."""
    size = 1
    while size * 2 <= k:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (k - size)], x[k - size :]) if k > size else x


class Chunk:
    """The words of a chunk as arrays, documents in order of id. No word becomes a Python object."""

    def __init__(self, blob: bytes, window: int, phrase: int, hashed: bool = True) -> None:
        """hashed: words, windows and phrases too, and not only where words begin and end."""
        keys, texts = open_chunk(blob)
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0))
        self.keys = [keys[i] for i in order]
        self.window, self.phrase = window, phrase
        texts = [texts[i] for i in order]
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        white = _WHITE[self.bytes]
        edge = np.flatnonzero(np.diff(white, prepend=True))  # begins and ends of words by turns
        self.begin, self.end = edge[0::2], edge[1::2]
        text_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        #: Ends of the documents in words, and their lengths.
        self.ends = np.searchsorted(self.begin, text_end)
        self.lengths = np.diff(self.ends, prepend=0)
        self.starts = self.ends - self.lengths
        n, span = len(self.begin), window - phrase + 1
        self.empty = n < window
        if self.empty or not hashed:
            return
        self.words = self._hashes()
        self.phrases = _mixed(_rolling(self.words, phrase))
        end = np.repeat(self.ends, self.lengths)
        self.valid = np.arange(n - window + 1) + window <= end[: n - window + 1]
        least = _slide(self.phrases, span, np.minimum)
        #: The least phrase hash of each window; zero where a window would leave its document.
        self.least = np.where(self.valid, least, np.uint64(0))
        pad = np.zeros(span - 1, np.uint64)
        #: Places of phrases that some window selects (all of them at ties).
        self.selected = _slide(np.concatenate((pad, self.least, pad)), span, np.maximum) == self.phrases

    def _hashes(self) -> np.ndarray:
        """A hash of each word: Horner's rule over all words at once, byte by byte; long words one by one."""
        size = self.end - self.begin
        h = size.astype(np.uint64)
        at = np.flatnonzero(size <= LONG)
        k = 0
        while len(at):
            h[at] = h[at] * np.uint64(0xD6E8FEB86659FD93) + self.bytes[self.begin[at] + k]
            k += 1
            at = at[size[at] > k]
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh64_intdigest(self.bytes[self.begin[i] : self.end[i]].tobytes())
        return _mixed(h)

    def located(self, recurring: np.ndarray) -> np.ndarray:
        """Whether a recurring phrase stands at each place, by streaming the chunk through automata.

        The first place of each phrase gives its words. Automata have few edges a node, as their search
        is linear in them: each word of a shard's phrases is spelled by as many letters of LETTER bits, any other
        word is one letter of its own.
        """
        at = np.flatnonzero(self.selected)
        values, first = np.unique(self.phrases[at], return_index=True)
        first = at[first[_within(values, recurring)]]
        found = np.zeros(len(self.phrases), bool)
        for i in range(0, len(first), SHARD):
            places = first[i : i + SHARD]
            names = np.unique(self.words[places[:, None] + np.arange(self.phrase)])
            k = np.minimum(np.searchsorted(names, self.words), len(names) - 1)
            known = np.flatnonzero(names[k] == self.words)
            letters = max(1, -(-len(names).bit_length() // LETTER))
            size = np.ones(len(self.words), np.int64)
            size[known] = letters
            begin = np.cumsum(size) - size
            code = np.full(int(size.sum()), 65, np.uint8)
            for d in range(letters):
                code[begin[known] + d] = 66 + (k[known] >> LETTER * d & (1 << LETTER) - 1)
            line, length = code.tobytes().decode("latin-1"), letters * self.phrase
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for p in begin[places].tolist():
                automaton.add_word(line[p : p + length])
            automaton.make_automaton()
            hits = np.fromiter((e for e, _ in automaton.iter(line)), np.int64) - (length - 1)
            place = np.minimum(np.searchsorted(begin, hits), len(begin) - 1)
            found[place[begin[place] == hits]] = True  # a hit that begins inside a word is none
        return found

    def candidates(self, recurring: np.ndarray) -> np.ndarray:
        """Starts of the windows whose selected phrase the automata located."""
        if self.empty or not len(recurring):
            return np.empty(0, np.int64)
        here = np.where(self.located(recurring), self.phrases, _NONE)
        return np.flatnonzero((_slide(here, self.window - self.phrase + 1, np.minimum) == self.least) & self.valid)

    def hashed_windows(self, at: np.ndarray) -> np.ndarray:
        """(candidates, 2): the hash of each window that starts at one of the places, and that of its selected phrase."""
        return np.stack((_rolling(self.words, self.window)[at], self.least[at]), 1)

    def earliest(self, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc number, start in it, least candidate index with the same window, whether that one is elsewhere) for each candidate start.

        Documents are in order of id, so the first place in the array is the earliest,
        but for documents of one id: there the start decides, then the array's order.
        Places at one start of documents of one id are not elsewhere to each other.
        """
        doc = np.searchsorted(self.ends, at, side="right")
        start = at - self.starts[doc]
        ranks = {k: i for i, k in reversed(list(enumerate(self.keys)))}
        by_id = np.array([ranks[k] for k in self.keys], np.int64)[doc]
        order = np.lexsort((at, start, by_id, windows[:, 1], windows[:, 0]))
        w = windows[order]
        fresh = np.concatenate(([True], (w[1:] != w[:-1]).any(1)))[: len(at)]
        first = np.empty(len(at), np.int64)
        first[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        return doc, start, first, (by_id != by_id[first]) | (start != start[first])

    def without(self, drop: np.ndarray) -> list[bytes]:
        """The words of each document that are not dropped, joined by a space."""
        data = self.bytes.copy()
        data[self.end] = 32
        keep = np.zeros(len(data) + 1, np.int8)
        kept = ~drop
        keep[self.begin[kept]] = 1
        keep[self.end[kept] + 1] -= 1  # the byte after a word is its space
        left = data[np.cumsum(keep[:-1], dtype=np.int8).view(bool)].tobytes()
        size = np.concatenate(([0], np.cumsum((self.end - self.begin + 1) * kept)))
        at = size[np.concatenate(([0], self.ends))].tolist()
        return [left[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


def _within(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ones."""
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def _phrases(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lean()
                c = Chunk(blob, window, phrase)
                if not c.empty and c.selected.any():
                    values, times = np.unique(c.phrases[c.selected], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.full(len(values), n)), pa.array(times > 1)], ["phrase", "chunk", "again"])

    return run


_ROW = {"phrase": pa.int64(), "groups": pa.int64(), "chunk": pa.int64(), "key": pa.int64(), "start": pa.int64(), "at": pa.int64(), "hashes": pa.binary()}
_ROWS = "phrase long, groups long, chunk long, key long, start long, at long, hashes binary"


def _table(**columns) -> pa.Table:
    return pa.table({n: pa.array(columns.get(n, []), k) for n, k in _ROW.items()})


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, as differences."""
    return zstandard.compress(np.diff(np.stack(arrays), prepend=0).astype("<i8").tobytes(), 1)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), "<i8").reshape(n, -1), 1)


def _blocks(window: int, phrase: int, fan: int):
    """Of a chunk, rows of runs of windows that are its first of their kind, to be compared with other chunks'; and one row
    without a phrase: all candidates, the least index with the same window, and whether that is elsewhere, packed."""

    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        lean()
        if not docs.num_rows or not found.num_rows:
            return _table()
        c = Chunk(docs.column("blob")[0].as_py(), window, phrase)
        recurring = np.asarray(found.column("phrase")).view(np.uint64)
        order = np.argsort(recurring)
        recurring, n = recurring[order], np.asarray(found.column("n"))[order]
        at = c.candidates(recurring)
        if not len(at):
            return _table()
        windows = c.hashed_windows(at)
        doc, start, first, elsewhere = c.earliest(at, windows)
        told = _packed(at, first, elsewhere.astype(np.int64))
        mine = first == np.arange(len(at))
        at, doc, start, windows = at[mine], doc[mine], start[mine], windows[mine]
        value = c.least[at]
        # Runs of consecutive windows with one selected phrase go as one row.
        cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])) + 1
        begin = np.concatenate(([0], cut))
        data, ends = windows[:, 0].astype("<u8").tobytes(), np.concatenate((begin[1:], [len(at)]))
        number, size = key[0].as_py(), len(begin)
        return _table(
            phrase=[*value[begin].view(np.int64).tolist(), None],
            groups=[*(-(-n[np.searchsorted(recurring, value[begin])] // fan)).tolist(), None],
            chunk=[number] * (size + 1),
            key=[*[c.keys[d] for d in doc[begin].tolist()], None],
            start=[*start[begin].tolist(), None],
            at=[*at[begin].tolist(), None],
            hashes=[*[data[8 * s : 8 * e] for s, e in zip(begin.tolist(), ends.tolist(), strict=True)], told],
        )

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by phrase and group, those windows that another row of the phrase and group has earlier, as runs (chunk, at, start: how many);
    the others as rows with a phrase, to be compared further."""
    lean()
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        if not t.num_rows:
            return
        data = t.column("hashes").to_pylist()
        n = np.fromiter((len(x) // 8 for x in data), np.int64, len(data))
        row = np.repeat(np.arange(len(data)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        w = np.frombuffer(b"".join(data), "<u8")
        of = {c: np.asarray(t.column(c)) for c in ("phrase", "group", "groups", "start", "at", "chunk")}
        null, key = np.asarray(t.column("key").is_null()), np.asarray(t.column("key").fill_null(0))
        group, start = of["group"][row], of["start"][row] + step
        phrase = of["phrase"][row]
        order = np.lexsort((start, key[row], null[row], w, group, phrase))
        same = (group[order][1:] == group[order][:-1]) & (w[order][1:] == w[order][:-1]) & (phrase[order][1:] == phrase[order][:-1])
        moved = (key[row][order][1:] != key[row][order][:-1]) | (start[order][1:] != start[order][:-1]) | (null[row][order][1:] != null[row][order][:-1])
        # Within a run of equal windows, all that are not at the run's first (key, start).
        run = np.concatenate(([0], np.cumsum(~same)))
        place = np.concatenate(([0], np.cumsum(moved | ~same)))
        base = place[np.concatenate(([0], np.flatnonzero(~same) + 1))]
        late = np.zeros(len(row), bool)
        late[order[place > base[run]]] = True
        # Runs of windows of a row that are late, or are not.
        begin = np.concatenate(([0], np.flatnonzero((row[1:] != row[:-1]) | (late[1:] != late[:-1])) + 1))
        end = np.concatenate((begin[1:], [len(row)]))
        bytes_, r, late = w.tobytes(), row[begin], late[begin]
        yield _table(
            phrase=pa.array(of["phrase"][r], mask=late),
            groups=of["groups"][r],
            chunk=of["chunk"][r],
            key=pa.array(key[r], mask=null[r]),
            start=np.where(late, end - begin, start[begin]),
            at=of["at"][r] + step[begin],
            hashes=[None if x else bytes_[8 * a : 8 * b] for x, a, b in zip(late.tolist(), begin.tolist(), end.tolist(), strict=True)],
        ).combine_chunks().to_batches()[0]

    def unit(b: pa.RecordBatch, i: int) -> tuple:
        return b.column("phrase")[i].as_py(), b.column("group")[i].as_py()

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if unit(held[0], 0) == unit(b, b.num_rows - 1):
            continue
        t = pa.Table.from_batches(held)
        p, g = np.asarray(t.column("phrase")), np.asarray(t.column("group"))
        last = int(np.flatnonzero((p != p[-1]) | (g != g[-1]))[-1]) + 1
        yield from cut(t.slice(0, last))
        held = t.slice(last).combine_chunks().to_batches()
    if held:
        yield from cut(pa.Table.from_batches(held))


def _apply(window: int, phrase: int, out: list[str]):
    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        lean()
        c = Chunk(docs.column("blob")[0].as_py(), window, phrase, hashed=False)
        mark = np.zeros(len(c.begin) + 1, np.int64)
        own = [x for x in told.column("hashes").to_pylist() if x is not None]
        if own:
            at, first, elsewhere = _unpacked(own[0], 3)
            runs = told.filter(told.column("hashes").is_null())
            gone = np.zeros(len(c.begin) + 1, np.int64)
            np.add.at(gone, np.asarray(runs.column("at"), np.int64), 1)
            np.subtract.at(gone, np.asarray(runs.column("at"), np.int64) + np.asarray(runs.column("start"), np.int64), 1)
            # Equal windows of one chunk: all but those at the earliest (id, start) go; that one goes if another chunk has it earlier.
            late = at[(elsewhere > 0) | (np.cumsum(gone) > 0)[at[first]]]
            np.add.at(mark, late, 1)
            np.subtract.at(mark, late + window, 1)
        drop = np.cumsum(mark[:-1]) > 0
        removed = np.concatenate(([0], np.cumsum(drop)))[np.concatenate(([0], c.ends))]
        cols: dict[str, list] = {"key": c.keys, "n_words": c.lengths, "n_removed": np.diff(removed), "kept": c.without(drop)}
        if "kept_sha256" in out:
            cols["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in cols["kept"]]
        kinds = {"key": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary(), "kept_sha256": pa.string()}
        got = {n: pa.array(cols[n], kinds[n]) for n in out}
        if "kept" in got:
            got["kept"] = got["kept"].cast(pa.string())
        return pa.table(got)

    return run


_TYPES = {"key": "long", "n_words": "long", "n_removed": "long", "kept": "string", "kept_sha256": "string"}


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE, out: tuple[str, ...] = ("n_words", "n_removed", "kept"), chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """(key, *out): every document without the words of windows that also start earlier.

    Earlier: a smaller key, or the same key and an earlier start; null keys come last.
    Rows of one key are one document as far as order goes: windows at the same start of
    rows with one key do not remove each other. Windows are judged on the input.
    out: of n_words, n_removed, kept (the words left, joined by a space) and kept_sha256.
    Null and empty texts have no words. One row for each input row.

    What is shuffled: one hash for each distinct selected phrase of a chunk, then the
    windows of recurring phrases that are a chunk's first, eight bytes each. Both have at most
    one entry a chunk for a passage, however many documents of the chunk share it. A phrase
    of more than `fan` chunks is compared in groups of some `fan` chunks first, and only what each group has earliest
    goes on, so that no task gets more of one phrase as the input grows.

    Executors collect before each pass, so that a JVM's garbage of one is not held beside the Python workers of the next.
    """
    names = ["key", *out]

    def passed(df: DataFrame, name: str) -> DataFrame:
        release_executors(df.sparkSession)
        return stage(df, name)

    release_executors(df.sparkSession)
    chunks = stage_chunks(df, key, text, chunk_bytes)
    seen = passed(chunks.mapInArrow(_phrases(window, phrase), "phrase long, chunk long, again boolean"), "selected")
    often = seen.groupBy("phrase").agg(F.count("*").alias("n"), F.max("again").alias("twice")).where("n > 1 or twice").select("phrase", "n")
    recurring = passed(seen.join(often, "phrase").select("phrase", "chunk", "n"), "phrases")
    drop_staged(seen)
    most = -(-(recurring.agg(F.max("n")).first()[0] or 0) // fan)
    found = passed(chunks.groupBy("chunk").cogroup(recurring.groupBy("chunk")).applyInArrow(_blocks(window, phrase, fan), _ROWS), "located")
    told = [found.where("phrase is null")]
    left = found.where("phrase is not null")
    while most:
        # Phrases of several groups are compared within each; the others in whole, for the last time.
        dealt = left.withColumn("group", F.when(F.col("groups") > 1, F.pmod(F.xxhash64("chunk"), "groups")).otherwise(-1))
        dealt = dealt.repartition("phrase", "group").sortWithinPartitions("phrase", "group")
        left = passed(dealt.mapInArrow(_later, _ROWS), "later")
        told.append(left.where("phrase is null"))
        left = left.where("phrase is not null and groups > 1").withColumn("groups", F.ceil(F.col("groups") / fan))
        most = 0 if most == 1 else -(-most // fan)
    answers = told[0]
    for t in told[1:]:
        answers = answers.unionByName(t)
    release_executors(df.sparkSession)
    got = chunks.groupBy("chunk").cogroup(answers.select("chunk", "at", "start", "hashes").groupBy("chunk")).applyInArrow(_apply(window, phrase, names), ", ".join(f"{n} {_TYPES[n]}" for n in names))
    return got.withColumnRenamed("key", key)
