"""Media columns: lossless WebP (VP8L) with prefix codes, back-references, colour cache and all transforms.

Pixels are arrays (height, width) of 32-bit ARGB. write() makes files with any of the
features; write_samples() is the fast form for bytes as samples: one byte a pixel in the
green channel, with prefix codes and back-references, a palette where few values occur
and a predictor where it helps. Both are read by read().
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, map_rows, tune

PREDICTOR, CROSS, GREEN, PALETTE = range(4)
#: The order in which lengths of the code length code stand.
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Near pixels (x to the left, y rows above) in order of distance; ties by |x|, left first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
BLACK = 0xFF000000
HASH = 0x1E35A7BD
WIDTH, MAX_HEIGHT = 64, 16_384
#: Bytes of a file whose bits are read at once, and how far the last token may go on (58 bits and a window).
READ, SPARE = 1 << 15, 16
#: Shortest match worth a copy, longest copy, farthest distance, tokens spelled at once.
SHORTEST, LONGEST, FARTHEST, SPELLED = 8, 4096, (1 << 20) - 120, 1 << 16


class Bits:
    """Reader and writer of bits, least significant first."""

    def __init__(self, data: bytes = b"") -> None:
        self.n, self.at = len(data) * 8, 0
        self.data, self.parts = data, []
        self.acc, self.filled = 0, 0

    def peek(self, n: int) -> int:
        """The next n bits; zeros beyond the end."""
        at = self.at
        chunk = int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little")
        return chunk >> (at & 7) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.n:
            raise ValueError("the file ends early")

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.skip(n)
        return value

    def write(self, value: int, n: int) -> None:
        self.acc |= value << self.filled
        self.filled += n
        while self.filled >= 64:
            self.parts.append((self.acc & (2**64 - 1)).to_bytes(8, "little"))
            self.acc >>= 64
            self.filled -= 64

    def bytes(self) -> bytes:
        return b"".join(self.parts) + self.acc.to_bytes((self.filled + 7) // 8, "little")


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Lengths of a Huffman code with at most `most` bits; counts are flattened until it fits."""
    used = [i for i, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0]] = 1
    if len(used) < 2:
        return out
    weights = [(counts[i], i) for i in used]
    while True:
        # The two least of the sorted leaves and of the merged nodes, which come in order by themselves.
        weights.sort()
        n = len(weights)
        sums = [w for w, _ in weights]
        above = [0] * (2 * n - 1)
        leaf, node = 0, n
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (node >= new or sums[leaf] <= sums[node]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, node = node, node + 1
                above[k] = new
                total += sums[k]
            sums.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth) <= most:
            break
        weights = [((w + 1) // 2, i) for w, i in weights]
    for (_, i), d in zip(weights, depth, strict=False):
        out[i] = d
    return out


def _backwards(bits: int) -> list[int]:
    """Each number of so many bits with its bits in reverse."""
    out = [0]
    for k in range(bits):
        out += [v | 1 << (bits - 1 - k) for v in out]
    return out


MOST = 15
_BACKWARDS = _backwards(MOST)


def codes_of(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol: (code with its first bit lowest, length), canonical."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        last = n
        if code >> n:
            raise ValueError("the code has too many words")
        out[s] = (_BACKWARDS[code] >> (MOST - n), n)
        code += 1
    if out and code != 1 << last and len(out) > 1:
        raise ValueError("the code is not complete")
    return out


class Reading:
    """A prefix code to read: a table by the next bits, of symbol * 16 + length."""

    def __init__(self, lengths: dict[int, int]) -> None:
        codes = codes_of(lengths)
        self.only = next(iter(codes)) if len(codes) == 1 else None
        self.most = 0 if self.only is not None else max((n for _, n in codes.values()), default=0)
        self.table = np.zeros(1 << self.most, np.int32)
        for s, (c, n) in codes.items():
            self.table[c :: 1 << n] = s << 4 | (n if self.most else 0)
        self.scalars: list[int] | None = None

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if not self.most:
            raise ValueError("no such code")
        if self.scalars is None:
            self.scalars = self.table.tolist()
        found = self.scalars[bits.peek(self.most)]
        bits.skip(found & 15)
        return found >> 4


def _read_code(bits: Bits, size: int) -> Reading:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        one = bits.read(8 if wide else 1)
        return Reading({s: 1 for s in (one, *([bits.read(8)] if two else []))})
    lengths = [0] * size
    first = [0] * 19
    for k in range(4 + bits.read(4)):
        first[ORDER[k]] = bits.read(3)
    code = Reading({s: n for s, n in enumerate(first) if n})
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        value, n = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + n > size:
            raise ValueError("a run of code lengths is too long")
        lengths[at : at + n] = [value] * n
        at += n
    return Reading({s: n for s, n in enumerate(lengths) if n})


def _write_code(bits: Bits, lengths: list[int]) -> dict[int, tuple[int, int]]:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        bits.write(1, 1)
        bits.write(len(used) - 1, 1)
        wide = used[0] > 1
        bits.write(wide, 1)
        bits.write(used[0], 8 if wide else 1)
        if len(used) == 2:
            bits.write(used[1], 8)
            return {used[0]: (0, 1), used[1]: (1, 1)}
        return {used[0]: (0, 0)}
    bits.write(0, 1)
    runs = []
    for value, same in groupby(lengths):
        n = len(list(same))
        if value:
            runs.append((value, 0, 0))
            n -= 1
            while n >= 3:
                k = min(n, 6)
                runs.append((16, k - 3, 2))
                n -= k
        while not value and n >= 3:
            k = min(n, 138)
            runs.append((18, k - 11, 7) if k >= 11 else (17, k - 3, 3))
            n -= k
        runs += [(value, 0, 0)] * n
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    first = code_lengths(counts, 7)
    n = max(4, max(k for k, s in enumerate(ORDER) if first[s]) + 1)
    bits.write(n - 4, 4)
    for s in ORDER[:n]:
        bits.write(first[s], 3)
    bits.write(0, 1)
    code = codes_of({s: n for s, n in enumerate(first) if n})
    if len(code) == 1:
        code = {s: (0, 0) for s in code}
    for s, extra, k in runs:
        bits.write(*code[s])
        bits.write(extra, k)
    code = codes_of({s: lengths[s] for s in used})
    return {s: (0, 0) for s in code} if len(code) == 1 else code


def prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits' value, their number) of a length or distance from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    half = v >> n & 1
    return 2 * n + 2 + half, v & ((1 << n) - 1), n


def _unprefix(bits: Bits, s: int) -> int:
    if s < 4:
        return s + 1
    n = (s - 2) >> 1
    return ((2 + (s & 1)) << n) + bits.read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


@lru_cache(maxsize=16)
def _near(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the near codes, and the least code of each of these distances (else 0)."""
    far = np.array([0] + [_distance(k, width) for k in range(1, len(NEAR) + 1)])
    codes = np.zeros(8 * width + 9, np.int64)
    codes[far[:0:-1]] = np.arange(len(NEAR), 0, -1)
    return far, codes


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Flat ARGB pixels of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    group_bits, groups, blocks = 0, None, 0
    n_groups = 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        blocks, rows = _sub(width, group_bits), _sub(height, group_bits)
        groups = (_read_image(bits, blocks, rows, False) >> 8 & 0xFFFF).tolist()
        n_groups = max(groups) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(bits, s) for s in sizes] for _ in range(n_groups)]
    total = width * height
    if groups is None and (fast := _read_samples(bits, codes[0], width, total, cache_bits)) is not None:
        return fast
    out: list[int] = []
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift = 32 - cache_bits
    while len(out) < total:
        at = len(out)
        green, red, blue, alpha, dist = codes[groups[(at // width >> group_bits) * blocks + (at % width >> group_bits)] if groups else 0]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = _unprefix(bits, s - 256)
            back = _distance(_unprefix(bits, dist.read(bits)), width)
            if back > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out.append(out[-back])
        else:
            out.append(cache[s - 280])
        if cache_bits:
            for p in out[at:]:
                cache[(HASH * p & 0xFFFFFFFF) >> shift] = p
    return np.array(out, np.uint32)


def _extra(symbols: np.ndarray) -> np.ndarray:
    """Number of extra bits of length and distance symbols."""
    return np.where(symbols < 4, 0, (symbols - 2) >> 1)


def _values(symbols: np.ndarray, extra: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.where(symbols < 4, symbols, ((2 + (symbols & 1)) << extra) + bits) + 1


def _read_samples(bits: Bits, codes: list[Reading], width: int, total: int, cache_bits: int) -> np.ndarray | None:
    """An image in which only green varies, without a cache: what a token would be is read at every bit of a block at once, then the tokens that follow each other are picked."""
    green, red, blue, alpha, dist = codes
    if cache_bits or None in (red.only, blue.only, alpha.only) or not green.most and (green.only is None or green.only > 255):
        return None
    rest = np.uint32(alpha.only << 24 | red.only << 16 | blue.only)
    if green.only is not None:
        return np.full(total, rest | np.uint32(green.only << 8), np.uint32)
    near = _near(width)[0]
    out = bytearray()
    while len(out) < total:
        if bits.at >= bits.n:
            raise ValueError("the file ends early")
        first, begin = bits.at >> 3, bits.at & 7
        raw = np.frombuffer(bits.data[first : first + READ + SPARE] + b"\0" * SPARE, np.uint8).astype(np.uint32)
        word = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        size = min(READ, len(bits.data) - first)
        window = (word[:size, None] >> np.arange(8, dtype=np.uint32)).ravel()
        found = green.table.take((window & np.uint32((1 << green.most) - 1)).view(np.int32))
        end = size * 8
        after = np.arange(end + SPARE * 8)  # positions from the end on stay
        after[:end] += found & 15
        symbol = found >> 4
        copies = np.flatnonzero(symbol > 255)
        length = back = np.zeros(0, np.int64)
        if len(copies):

            def peek(at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
                return (word[at >> 3] >> (at & 7).astype(np.uint32)).astype(np.int64) & ((1 << n) - 1)

            at, s = after[copies], symbol[copies] - 256
            n = _extra(s)
            length = _values(s, n, peek(at, n))
            at = at + n
            d = dist.table[peek(at, dist.most)]
            at, d = at + (d & 15), d >> 4
            n = _extra(d)
            back = _values(d, n, peek(at, n))
            back = np.where(back > len(NEAR), back - len(NEAR), near[np.minimum(back, len(NEAR))])
            after[copies] = at + n
        # Eight tokens a step; those between are filled in afterwards.
        two = after[after]
        four = two[two]
        tokens, p, follow = [], begin, memoryview(four[four])
        while p < end:
            tokens.append(p)
            p = follow[p]
        picked = np.array(tokens)
        for jump in (four, two, after):
            picked = np.stack((picked, jump[picked]), 1).ravel()
        picked = picked[picked < end]
        s = symbol[picked]
        of = np.flatnonzero(s > 255)
        which = np.searchsorted(copies, picked[of])
        advance = np.ones(len(s), np.int64)
        advance[of] = length[which]
        k = int(np.searchsorted(np.cumsum(advance), total - len(out))) + 1
        k = min(k, len(s))
        literals, before = s[:k].astype(np.uint8).tobytes(), 0
        for j, n, b in zip(of.tolist(), length[which].tolist(), back[which].tolist(), strict=True):
            if j >= k:
                break
            if dist.only is None and not dist.most:
                raise ValueError("a back-reference without distances")
            out += literals[before:j]
            before = j + 1
            start = len(out) - b
            if start < 0 or len(out) + n > total:
                raise ValueError("a back-reference leaves the image")
            out += out[start : start + n] if b >= n else (bytes(out[start:]) * (n // b + 1))[:n]
        out += literals[before:]
        bits.at = first * 8 + int(after[picked[k - 1]])
    if bits.at > bits.n:
        raise ValueError("the file ends early")
    return np.frombuffer(out, np.uint8).astype(np.uint32) << 8 | rest


def _split(p: np.ndarray) -> np.ndarray:
    """Channels of ARGB pixels in the last axis: alpha, red, green, blue."""
    return np.stack([p >> 24 & 255, p >> 16 & 255, p >> 8 & 255, p & 255], -1).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _from(c) -> int:
    a, r, g, b = c
    return a << 24 | r << 16 | g << 8 | b


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _select(left: int, top: int, corner: int) -> int:
    d = [(x, y, z) for x, y, z in zip(_channels(left), _channels(top), _channels(corner), strict=True)]
    to_left = sum(abs(y - z) for _, y, z in d)  # the estimate is left + top - corner
    to_top = sum(abs(x - z) for x, _, z in d)
    return left if to_left < to_top else top


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """The 14 predictions from the pixels left, above, above left and above right."""
    match mode:
        case 0:
            return BLACK
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _average(_average(left, right), top)
        case 6:
            return _average(left, corner)
        case 7:
            return _average(left, top)
        case 8:
            return _average(corner, top)
        case 9:
            return _average(top, right)
        case 10:
            return _average(_average(left, corner), _average(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return _from(_clamp(x + y - z) for x, y, z in zip(_channels(left), _channels(top), _channels(corner), strict=True))
        case 13:
            mean = _average(left, top)
            return _from(_clamp(x + int((x - z) / 2)) for x, z in zip(_channels(mean), _channels(corner), strict=True))
    return BLACK


def _predicted(x: int, y: int, out: list[int], width: int, modes: list[int], blocks: int, bits: int) -> int:
    at = y * width + x
    if not at:
        return BLACK
    if not y:
        return out[at - 1]
    if not x:
        return out[at - width]
    # At the right edge the pixel above right is the first of the present row.
    return predict(modes[(y >> bits) * blocks + (x >> bits)], out[at - 1], out[at - width], out[at - width - 1], out[at - width + 1])


def _add(a: int, b: int, sign: int = 1) -> int:
    return _from((x + sign * y) & 255 for x, y in zip(_channels(a), _channels(b), strict=True))


def _unpredict(p: np.ndarray, width: int, modes: np.ndarray, blocks: int, bits: int) -> np.ndarray:
    kinds = set(modes.tolist())
    height = len(p) // width
    if kinds == {1} or kinds == {2}:  # running sums
        c = _split(p).reshape(height, width, 4)
        c[0, 0, 0] += 255
        if kinds == {1}:
            c[:, 0] = np.cumsum(c[:, 0], 0)
            return _joined(np.cumsum(c, 1)).ravel()
        c[0] = np.cumsum(c[0], 0)
        return _joined(np.cumsum(c, 0)).ravel()
    out: list[int] = []
    modes = modes.tolist()
    for at, v in enumerate(p.tolist()):
        out.append(_add(v, _predicted(at % width, at // width, out, width, modes, blocks, bits)))
    return np.array(out, np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _cross(p: np.ndarray, width: int, elements: np.ndarray, blocks: int, bits: int, sign: int) -> np.ndarray:
    """sign 1 undoes the transform: red and blue get back what green and red predict of them."""
    at = np.arange(len(p))
    e = _split(elements)[(at // width >> bits) * blocks + (at % width >> bits)]
    c = _split(p)
    red_blue, green_blue, green_red = _signed(e[:, 1]), _signed(e[:, 2]), _signed(e[:, 3])
    green, red = _signed(c[:, 2]), c[:, 1]
    new_red = red + sign * (green_red * green >> 5)
    c[:, 3] += sign * ((green_blue * green >> 5) + (red_blue * _signed(new_red if sign > 0 else red) >> 5))
    c[:, 1] = new_red
    return _joined(c)


def _sub(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def read(data: bytes) -> np.ndarray:
    """Pixels (height, width) of one lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, seen, inner = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            k = bits.read(3) + 2
            sub = _read_image(bits, _sub(inner, k), _sub(height, k), False)
            undo.append((kind, inner, k, sub))
        elif kind == GREEN:
            undo.append((kind, inner, 0, None))
        else:
            n = bits.read(8) + 1
            table = _joined(np.cumsum(_split(_read_image(bits, n, 1, False)), 0))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, inner, pack, table))
            inner = _sub(inner, pack)
    p = _read_image(bits, inner, height, True)
    for kind, w, k, sub in reversed(undo):
        if kind == PREDICTOR:
            p = _unpredict(p, w, sub >> 8 & 15, _sub(w, k), k)
        elif kind == CROSS:
            p = _cross(p, w, sub, _sub(w, k), k, 1)
        elif kind == GREEN:
            c = _split(p)
            c[:, 1] += c[:, 2]
            c[:, 3] += c[:, 2]
            p = _joined(c)
        else:
            index = (p >> 8 & 255).reshape(height, -1)
            if k:
                each = 8 >> k
                index = (index[:, :, None] >> (np.arange(1 << k, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :w]
            full = np.zeros(256, np.uint32)
            full[: len(sub)] = sub
            p = full[index].ravel()
    return p.reshape(height, width)


def _write_image(bits: Bits, p: np.ndarray, width: int, main: bool, cache_bits: int = 0, matches: bool = False, group_bits: int = 0) -> None:
    """An entropy-coded image by plain Python, with back-references and a colour cache as asked."""
    values = p.tolist()
    tokens: list[tuple] = []
    cache, shift, last, at = [0] * (1 << cache_bits) if cache_bits else [], 32 - cache_bits, {}, 0

    def note(v: int) -> None:
        if cache_bits:
            cache[(HASH * v & 0xFFFFFFFF) >> shift] = v

    near = {}
    for k, (x, y) in enumerate(NEAR):
        near.setdefault(max(1, x + y * width), k + 1)
    while at < len(values):
        key, n, back = tuple(values[at : at + 3]), 0, 0
        if matches and (before := last.get(key)) is not None:
            back = at - before
            while at + n < len(values) and n < 4096 and values[at + n] == values[at + n - back]:
                n += 1
        if n >= 3:
            tokens.append(("copy", at, n, near.get(back, back + len(NEAR))))
        else:
            n, v = 1, values[at]
            slot = (HASH * v & 0xFFFFFFFF) >> shift if cache_bits else 0
            tokens.append(("slot", at, slot) if cache_bits and cache[slot] == v else ("pixel", at, v))
        for v in values[at : at + n]:
            last[tuple(values[at : at + 3])] = at
            note(v)
            at += 1
    bits.write(bool(cache_bits), 1)
    if cache_bits:
        bits.write(cache_bits, 4)
    group = lambda at: 0
    n_groups = 1
    if main:
        bits.write(bool(group_bits), 1)
        if group_bits:
            blocks, rows = _sub(width, group_bits), _sub(len(values) // width, group_bits)
            n_groups = min(2, blocks * rows)
            group = lambda at: ((at // width >> group_bits) * blocks + (at % width >> group_bits)) % n_groups
            bits.write(group_bits - 2, 3)
            _write_image(bits, (np.arange(blocks * rows, dtype=np.uint32) % n_groups) << 8, blocks, False)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * s for s in sizes] for _ in range(n_groups)]

    def spelled(t: tuple) -> list[tuple[int, int, int, int]]:
        """(alphabet, symbol, extra bits' value, their number) of a token."""
        if t[0] == "pixel":
            a, r, g, b = _channels(t[2])
            return [(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
        if t[0] == "slot":
            return [(0, 280 + t[2], 0, 0)]
        s, d = prefix(t[2]), prefix(t[3])
        return [(0, 256 + s[0], *s[1:]), (4, *d)]

    for t in tokens:
        for k, s, _, _ in spelled(t):
            counts[group(t[1])][k][s] += 1
    codes = [[_write_code(bits, code_lengths(c, 15)) for c in of] for of in counts]
    for t in tokens:
        for k, s, extra, n in spelled(t):
            bits.write(*codes[group(t[1])][k][s])
            bits.write(extra, n)


def _file(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def _head(width: int, height: int) -> Bits:
    if not (1 <= width <= 16_384 and 1 <= height <= 16_384):
        raise ValueError("a side has 1 to 16384 pixels")
    bits = Bits()
    bits.write(0x2F, 8)
    bits.write(width - 1, 14)
    bits.write(height - 1, 14)
    bits.write(1, 1)
    bits.write(0, 3)
    return bits


def write(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, matches: bool = True, group_bits: int = 0, block_bits: int = 3, modes=None, elements=None) -> bytes:
    """A file of pixels (height, width) with the transforms named, in that order. modes and elements: of the blocks of the predictor and cross-colour transforms."""
    height, width = pixels.shape
    bits, p, inner = _head(width, height), pixels.astype(np.uint32).ravel(), width
    for kind in transforms:
        bits.write(1, 1)
        bits.write(kind, 2)
        blocks, rows = _sub(inner, block_bits), _sub(height, block_bits)
        if kind == PREDICTOR:
            m = np.resize(np.array(modes if modes is not None else [11], np.uint32), blocks * rows)
            bits.write(block_bits - 2, 3)
            _write_image(bits, m << 8, blocks, False)
            v, ms = p.tolist(), m.tolist()
            p = np.array([_add(x, _predicted(i % inner, i // inner, v, inner, ms, blocks, block_bits), -1) for i, x in enumerate(v)], np.uint32)
        elif kind == CROSS:
            e = np.resize(np.array(elements if elements is not None else [BLACK], np.uint32), blocks * rows)
            bits.write(block_bits - 2, 3)
            _write_image(bits, e, blocks, False)
            p = _cross(p, inner, e, blocks, block_bits, -1)
        elif kind == GREEN:
            c = _split(p)
            c[:, 1] -= c[:, 2]
            c[:, 3] -= c[:, 2]
            p = _joined(c)
        else:
            table, index = np.unique(p, return_inverse=True)
            if len(table) > 256:
                raise ValueError("a palette has 256 colours at most")
            p, inner = _write_palette(bits, table, index.reshape(height, inner))
    bits.write(0, 1)
    _write_image(bits, p, inner, True, cache_bits, matches, group_bits)
    return _file(bits.bytes())


def _write_palette(bits: Bits, table: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, int]:
    n = len(table)
    pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    bits.write(n - 1, 8)
    c = _split(table)
    c[1:] -= c[:-1].copy()
    _write_image(bits, _joined(c), n, False)
    height, width = index.shape
    inner, each = _sub(width, pack), 8 >> pack
    wide = np.zeros((height, inner << pack), np.uint32)
    wide[:, :width] = index
    packed = (wide.reshape(height, inner, 1 << pack) << (np.arange(1 << pack, dtype=np.uint32) * each)).sum(2, dtype=np.uint32)
    return (packed << 8 | np.uint32(BLACK)).ravel(), inner


def _entropy(data: np.ndarray) -> float:
    """Bits that the bytes take with a perfect code of their own."""
    n = np.bincount(data)
    n = n[n > 0]
    return float(len(data) * np.log2(len(data)) - (n * np.log2(n)).sum())


def _residuals(rows: np.ndarray, mode: int) -> np.ndarray:
    """What the predictor leaves of rows of bytes: 1 the byte to the left, 2 the one above."""
    out = rows.copy()
    if mode == 1:
        out[:, 1:] -= rows[:, :-1]
        out[1:, 0] -= rows[:-1, 0]
    else:
        out[1:] -= rows[:-1]
        out[0, 1:] -= rows[0, :-1]
    return out


def _copies(data: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(starts, lengths, distances) of copies, greedily from the nearest place with the same first bytes."""
    starts, lengths, backs = [], [], []
    n = len(data) - SHORTEST + 1
    text = data.tobytes()
    key = np.ndarray(n, "<u8", text + b"\0" * 8, strides=(1,)) & np.uint64((1 << 8 * SHORTEST) - 1)
    # In order of a hash of 32 bits, by two stable passes of 16; only equal keys are matches.
    hashed = key * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort((hashed >> np.uint64(32)).astype(np.uint16), kind="stable")
    order = order[np.argsort((hashed >> np.uint64(48)).astype(np.uint16)[order], kind="stable")]
    ordered = key[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    before = np.full(n, -1)
    before[order[same + 1]] = order[same]
    spots = np.flatnonzero((before >= 0) & (np.arange(n) - before <= FARTHEST))
    at = 0
    for i, p in zip(spots.tolist(), before[spots].tolist(), strict=True):
        if i < at:
            continue
        k, most = SHORTEST, min(LONGEST, len(text) - i)
        for step in (64, 8):
            while k + step <= most and text[i + k : i + k + step] == text[p + k : p + k + step]:
                k += step
        while k < most and text[i + k] == text[p + k]:
            k += 1
        starts.append(i)
        lengths.append(k)
        backs.append(i - p)
        at = i + k
    return starts, lengths, backs


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """prefix() of many: symbols, extra bits' values, their numbers."""
    v = values - 1
    n = np.maximum(np.frexp(v)[1] - 2, 0)
    small = v < 4
    return np.where(small, v, 2 * n + 2 + (v >> n & 1)), np.where(small, 0, v & ((1 << n) - 1)), np.where(small, 0, n)


def _spelling(code: dict[int, tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    words, lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    for s, (c, n) in code.items():
        words[s], lengths[s] = c, n
    return words, lengths


def _write_samples(bits: Bits, data: np.ndarray, width: int, alpha: int) -> bytes:
    """The rest of a file: a main image whose green channel is data, with prefix codes and back-references."""
    starts, lengths, backs = (np.array(x, np.int64) for x in _copies(data))
    token = np.ones(len(data), bool)
    if len(starts):
        edge = np.zeros(len(data) + 1, np.int32)
        edge[starts] += 1
        edge[starts + lengths] -= 1
        token = np.cumsum(edge[:-1]) == 0
        token[starts] = True
    at = np.flatnonzero(token)
    symbols = data[at].astype(np.int64)
    of = np.searchsorted(at, starts)
    ls, l_extra, l_bits = _prefixes(lengths)
    symbols[of] = 256 + ls
    near = _near(width)[1]
    close = near[np.minimum(backs, len(near) - 1)]
    ds, d_extra, d_bits = _prefixes(np.where(close > 0, close, backs + len(NEAR)))
    bits.write(0, 1)  # no colour cache: with one channel a literal is one symbol as well
    bits.write(0, 1)  # one group of codes
    green = _write_code(bits, code_lengths(np.bincount(symbols, minlength=280).tolist(), MOST))
    for s in (0, 0, alpha):  # simple codes of one symbol
        bits.write(1 | (s > 1) << 2, 3)
        bits.write(s, 8 if s > 1 else 1)
    dist = _write_code(bits, code_lengths(np.bincount(ds, minlength=40).tolist(), MOST))
    words, sizes = _spelling(green, 280)
    value, n = words[symbols], sizes[symbols]
    words, sizes = _spelling(dist, 40)
    for more, k in ((l_extra.astype(np.uint64), l_bits), (words[ds], sizes[ds]), (d_extra.astype(np.uint64), d_bits)):
        value[of] |= more << n[of].astype(np.uint64)
        n[of] += k
    done = bits.bytes()
    left = np.unpackbits(np.frombuffer(done[-1:], np.uint8), bitorder="little")[: bits.filled & 7] if bits.filled & 7 else np.zeros(0, np.uint8)
    parts = [done[:-1] if len(left) else done]
    for i in range(0, len(value), SPELLED):
        k = n[i : i + SPELLED]
        bit = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        flat = np.concatenate((left, (np.repeat(value[i : i + SPELLED], k) >> bit.astype(np.uint64) & np.uint64(1)).astype(np.uint8)))
        whole = len(flat) & ~7 if i + SPELLED < len(value) else len(flat)
        parts.append(np.packbits(flat[:whole], bitorder="little").tobytes())
        left = flat[whole:]
    return b"".join(parts)


def write_samples(payload: np.ndarray) -> bytes:
    """One byte a pixel in the green channel, rows of 64; at most 16,384 rows.

    A palette where at most 16 values occur, else a predictor where it saves more than its cost.
    """
    height = len(payload) // WIDTH
    bits = _head(WIDTH, height)
    values = np.flatnonzero(np.bincount(payload, minlength=256))
    data, width, alpha = payload, WIDTH, 255
    if len(values) <= 16:
        bits.write(1, 1)
        bits.write(PALETTE, 2)
        index = np.searchsorted(values, payload)
        p, width = _write_palette(bits, (values.astype(np.uint32) << 8) | np.uint32(BLACK), index.reshape(height, WIDTH))
        data = (p >> 8 & 255).astype(np.uint8)
    else:
        rows = payload.reshape(height, WIDTH)
        cost = {0: _entropy(payload) - 256}
        rest = {mode: _residuals(rows, mode).ravel() for mode in (1, 2)}
        cost |= {mode: _entropy(r) for mode, r in rest.items()}
        if mode := min(cost, key=cost.__getitem__):
            bits.write(1, 1)
            bits.write(PREDICTOR, 2)
            bits.write(7, 3)  # blocks of 512 x 512
            _write_image(bits, np.full(_sub(WIDTH, 9) * _sub(height, 9), mode << 8, np.uint32), 1, False)
            data, alpha = rest[mode], 0
    bits.write(0, 1)  # no more transforms
    return _file(_write_samples(bits, data, width, alpha))


def store(payload: bytes) -> bytes:
    """Bytes, a positive multiple of 64 of them, as files one after the other, each of a MiB of samples at most."""
    data = np.frombuffer(payload, np.uint8)
    size = WIDTH * MAX_HEIGHT
    return b"".join(write_samples(data[i : i + size]) for i in range(0, len(data), size))


def load(media: bytes) -> bytes:
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append((read(media[at : at + n]) >> 8 & 255).astype(np.uint8).tobytes())
        at += n
    return b"".join(out)


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 64 or (64 if not data else 0))


def feature(payload: bytes) -> str:
    """Mean, deviation, distinct values and entropy in bits of the samples."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = n[n > 0] / len(payload)
    level = np.arange(256)
    mean = float((n * level).sum()) / len(payload)
    dev = float((n * (level - mean) ** 2).sum() / len(payload)) ** 0.5
    return f"{mean:.3f}/{dev:.3f}/{len(share)}/{abs(float((share * np.log2(share)).sum())):.4f}"


def media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): every whole text, padded to a positive multiple of 64 bytes, as lossless WebP. Null: empty. No shuffle."""
    tune(df.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([store(padded(t)) for t in binary(b.column(1))], pa.binary())], ["key", "media"])

    return map_rows(df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")), run, "key long, media binary").withColumnRenamed("key", key)


def pixels(df: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, samples): the bytes that stored media stand for. Null: null."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([None if m is None else load(m) for m in b.column(1).to_pylist()], pa.binary())], ["key", "samples"])

    return map_rows(df.select(F.col(key).cast("long").alias("key"), F.col(column).alias("media")), run, "key long, samples binary").withColumnRenamed("key", key)


_DIGEST = {"n_bytes": ("long", pa.int64()), "payload_bytes": ("long", pa.int64()), "payload_sha256": ("string", pa.string()), "tail_crc32": ("long", pa.int64()), "media_bytes": ("long", pa.int64()), "media_sha256": ("string", pa.string()), "feature": ("string", pa.string())}


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), one row for each input row.

    Each text is stored, and all but n_bytes and media_* are taken from what is read back. Null and empty texts: 64 zero bytes.
    """
    tune(df.sparkSession)

    def of(t: bytes) -> tuple:
        m = store(padded(t))
        back = load(m)
        return len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [of(t) for t in binary(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(_DIGEST.values()))], ["key", *_DIGEST])

    got = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, " + ", ".join(f"{n} {k}" for n, (k, _) in _DIGEST.items()))
    return got.withColumnRenamed("key", key)
