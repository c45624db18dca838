"""Token counts by trie-shared dynamic programming.

Distinct pre-tokens go into a trie. The unigram forward score of a trie node, the best
score of any segmentation of its prefix into vocabulary pieces, is computed once and
shared by all pre-tokens below it; the count of pieces of the best segmentation is
stored at terminals.
"""

from __future__ import annotations

import base64
import math
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Pieces, map_rows, tune

#: Trie nodes that a worker keeps; beyond it the trie begins anew.
NODES = 1_000_000
#: Distinct pieces of each of the two generations that a worker remembers.
REMEMBERED = 300_000
#: Bytes of a pre-token beyond which it stays out of the trie, whose size it would not bound.
LONG = 1024


def unigram_scores(path: str) -> dict[bytes, float]:
    """Natural-log scores of a rank file's pieces: a piece of rank r has weight 1 / (r + 1), the weights sum to one.

    Ranks order pieces by frequency, and Zipf's law turns the order into probabilities.
    """
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {t: -math.log(r + 1) - total for t, r in ranks.items()}


class Trie:
    """Best segmentation of byte strings. Ties go to the last piece that is shortest; every single byte must be a piece."""

    def __init__(self, scores: dict[bytes, float]) -> None:
        missing = [b for b in range(256) if bytes([b]) not in scores]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no score")
        # The pieces backwards, so that all that end at a node are met on one walk towards the root.
        self.last: dict = {}
        for piece, s in scores.items():
            at = self.last
            for b in reversed(piece):
                at = at.setdefault(b, {})
            at[-1] = s
        self.longest = max(map(len, scores))
        self._new()

    def _new(self) -> None:
        self.child: dict[int, int] = {}  # by node * 256 + byte
        self.up, self.byte = array("l", [-1]), array("h", [-1])
        self.best, self.count = array("d", [0.0]), array("l", [0])

    def insert(self, word: bytes) -> int:
        """The terminal node of a word; nodes that are new get their scores."""
        at, child, up, byte, best, count = 0, self.child, self.up, self.byte, self.best, self.count
        for b in word:
            key = at << 8 | b
            if (nxt := child.get(key)) is None:
                nxt = child[key] = len(up)
                up.append(at)
                byte.append(b)
                walk, node, c, top, pieces = self.last, at, b, -math.inf, 0
                while (walk := walk.get(c)) is not None:
                    if (s := walk.get(-1)) is not None and (x := best[node] + s) > top:
                        top, pieces = x, count[node] + 1
                    if not node:
                        break
                    c, node = byte[node], up[node]
                best.append(top)
                count.append(pieces)
            at = nxt
        return at

    def alone(self, word: bytes) -> tuple[int, float]:
        """The same for a word too long to share prefixes: scores of the last `longest` places only."""
        size = self.longest + 1
        best, count = [0.0] * size, [0] * size
        for i in range(len(word)):
            walk, top, pieces = self.last, -math.inf, 0
            for k in range(i, max(-1, i - self.longest), -1):
                if (walk := walk.get(word[k])) is None:
                    break
                if (s := walk.get(-1)) is not None and (x := best[k % size] + s) > top:
                    top, pieces = x, count[k % size] + 1
            best[(i + 1) % size], count[(i + 1) % size] = top, pieces
        return count[len(word) % size], best[len(word) % size]

    def count_of(self, word: bytes) -> tuple[int, float]:
        if len(word) > LONG:
            return self.alone(word)
        if len(self.up) > NODES:
            self._new()
        n = self.insert(word)
        return self.count[n], self.best[n]


class Counter:
    def __init__(self, path: str, pattern: str) -> None:
        self.trie = Trie(unigram_scores(path))
        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(self._of, REMEMBERED)

    def _of(self, text: str) -> tuple[int, int, float]:
        n, total, scores = 0, 0, []
        for x in self.pattern.finditer(text):
            count, score = self.trie.count_of(x[0].encode())
            n, total = n + 1, total + count
            scores.append(score)
        return n, total, math.fsum(scores)

    def count(self, text: str) -> tuple[int, int, float]:
        """(pre-tokens, tokens, score) of a whole text."""
        if not text:
            return 0, 0, 0.0
        n, k, s = zip(*self.pieces.cut(text), strict=True)
        return sum(n), sum(k), math.fsum(s)


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def count(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_pretokens, n_tokens, score) of every whole text under the best unigram segmentation of each pre-token.

    path: a rank file whose ranks give the scores (unigram_scores). score: the sum of
    natural-log scores, rounded to 4 places. Null and empty texts: zeros. One row for
    each input row, repeated ones too; no shuffle; a worker holds a trie of NODES + LONG nodes at most.
    """
    tune(df.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path, pattern)
        got = [c.count(t or "") for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64())))], ["key", "n_pretokens", "n_tokens", "score"])

    got = map_rows(df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")), run, "key long, n_pretokens long, n_tokens long, score double")
    return got.select(F.col("key").alias(key), "n_pretokens", "n_tokens", F.round("score", 4).alias("score"))
