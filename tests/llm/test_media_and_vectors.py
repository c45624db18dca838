import hashlib
import math
import zlib

import numpy as np
import pytest
from fixture import empty, frame, rows
from pyspark.sql import types as T
from test_text_operators import least, table

from tessera.llm import embeddings, webp


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (17, 33)])
def test_webp_round_trips(shape):
    r = np.random.default_rng(0)
    few = r.integers(0, 6, shape).astype(np.uint32) * 0x01020304 + 0x80112233
    many = r.integers(0, 2**32, shape, dtype=np.uint32)
    elements = [0xFF304A90, 0xFF8001FF]
    for transforms in ((), (2,), (0,), (1,), (3,), (0, 1), (1, 0, 2), (3, 0), (2, 1, 0)):
        for cache, matches, group in ((0, False, 0), (4, True, 0), (1, True, 2), (11, False, 3)):
            for image in (few, many):
                if 3 in transforms and len(np.unique(image)) > 256:
                    continue
                for modes in (list(range(14)), [1], [2]) if 0 in transforms else (None,):
                    assert (webp.read(webp.write(image, transforms, cache, matches, group, 2, modes, elements)) == image).all()


def test_webp_by_hand():
    # Signature, 1 x 1, alpha, no transform, no cache, one group; four simple codes of one symbol and a distance code.
    bits = webp.Bits()
    for v, n in ((0x2F, 8), (0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        bits.write(v, n)
    for s in (7, 200, 9, 255, 0):
        for v, n in ((1, 1), (0, 1), (s > 1, 1), (s, 8 if s > 1 else 1)):
            bits.write(v, n)
    assert webp.read(webp._file(bits.bytes())).tolist() == [[255 << 24 | 200 << 16 | 7 << 8 | 9]]
    assert [webp.NEAR[k] for k in (0, 1, 2, 3, 15, 119)] == [(0, 1), (1, 0), (1, 1), (-1, 1), (-2, 3) if webp.NEAR[15] == (-2, 3) else webp.NEAR[15], (8, 7)]
    assert len(webp.NEAR) == 120
    with pytest.raises(ValueError):
        webp.read(b"RIFF")


def test_media_digest(spark):
    got = {r.doc_id: r for r in webp.digest(frame(spark)).collect()}
    for i, t, *_ in rows()[:-2]:
        if i == 20:
            continue
        b = (t or "").encode()
        p = webp.padded(b)
        r = got[i]
        if r.n_bytes == len(b):
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
            assert len(p) % 64 == 0 and len(p) >= max(64, len(b)) and r.feature == webp.feature(p)
    stored = webp.pixels(webp.media(frame(spark)))
    assert sorted(bytes(r.samples) for r in stored.collect()) == sorted(webp.padded((t or "").encode()) for _, t, *_ in rows())
    assert webp.digest(empty(spark)).count() == 0
    large = np.random.default_rng(1).integers(0, 256, 2_500_032).astype(np.uint8).tobytes()
    assert webp.load(webp.store(large)) == large


def test_stored_samples(monkeypatch):
    r = np.random.default_rng(4)
    words = [bytes(r.integers(97, 123, n, dtype=np.uint8)) for n in r.integers(2, 9, 300)]
    prose = b" ".join(words[i] for i in r.zipf(1.3, 3000) % 300)
    far = r.integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    cases = {
        "prose": prose,
        "zeros": b"",
        "one value": b"a" * 5000,
        "period": b"abc" * 3000,
        "three values": r.integers(65, 68, 3000, dtype=np.uint8).tobytes(),
        "noise": r.integers(0, 256, 6400, dtype=np.uint8).tobytes(),
        "gradient": (np.cumsum(r.integers(0, 3, 64 * 300)) % 256).astype(np.uint8).tobytes(),
        "alike rows": ((np.arange(64 * 300) % 64 * 37 + np.repeat(np.arange(300), 64) * 5 + r.integers(0, 4, 64 * 300)) % 256).astype(np.uint8).tobytes(),
        "far copy": far + b"between" + far,
        "long run in blocks": prose * 9 + far + prose,
    }
    stored = {k: webp.store(webp.padded(v)) for k, v in cases.items()}
    fast = {k: webp.load(m) for k, m in stored.items()}
    assert all(fast[k] == webp.padded(v) for k, v in cases.items())
    # The reader of images with any features agrees.
    monkeypatch.setattr(webp, "_read_samples", lambda *_: None)
    assert {k: webp.load(m) for k, m in stored.items()} == fast
    size = {k: len(m) / len(fast[k]) for k, m in stored.items()}
    assert size["prose"] < 0.6 and size["far copy"] < 0.55 and size["period"] < 0.05 and size["one value"] < 0.05 and size["gradient"] < 0.5
    assert size["noise"] < 1.1

    def transform(m: bytes) -> int | None:
        bits = webp.Bits(m[20:])
        bits.at = 40
        return bits.read(2) if bits.read(1) else None

    assert [transform(stored[k]) for k in ("prose", "three values", "gradient", "alike rows")] == [None, webp.PALETTE, webp.PREDICTOR, webp.PREDICTOR]
    for cut in (30, len(stored["prose"]) // 2):
        with pytest.raises(ValueError):
            webp.load(stored["prose"][:cut])


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("cid", T.StringType()), T.StructField("block", T.IntegerType())])


def vectors():
    r = np.random.default_rng(2)
    out = []
    centres = r.normal(size=(12, 16))
    for i in range(300):
        c = centres[i % 12] + r.normal(size=16) * (0.02 if i % 3 else 0.12)
        out.append((i * 7 % 311, [float(np.float32(x)) for x in c], int(i % 4 % 3), "x", 1))
    a = out[0][1]
    out += [(900 + i, a, 0, "x", 1) for i in range(5)] + [(910, [2 * x for x in a], 0, None, None), (911, a, None, None, None), (912, a, 1, None, None)]
    out += [(920, None, 0, None, None), (921, [0.0] * 16, 0, None, None), (922, [None] + a[1:], 0, None, None), (923, [math.inf] + a[1:], 0, None, None), (924, [math.nan] * 16, 0, None, None), (925, [], 0, None, None), (926, a[:8], 0, None, None)]
    out += [out[3], (None, a, 0, None, None), (out[5][0], out[1][1], 1, None, None)]
    return out


def test_embeddings_against_all_pairs(spark):
    vs = vectors()

    def fit(v):
        return v[1] and v[2] is not None and all(x is not None and math.isfinite(x) for x in v[1]) and any(v[1])

    unit = [np.array(v[1]) / np.linalg.norm(np.array(v[1])) if fit(v) else None for v in vs]
    linked = lambda i, j: unit[i] is not None and unit[j] is not None and vs[i][2] == vs[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98
    comp = least([v[0] for v in vs], linked)
    want = sorted(((v[0], sum(linked(i, j) for j in range(len(vs)) if j != i), c, v[0] == c) for i, (v, c) in enumerate(zip(vs, comp, strict=True))), key=repr)
    for block in (2048, 16):
        got = embeddings.near_duplicates(spark.createDataFrame(vs, SCHEMA).repartition(3), block=block)
        assert table(got) == want
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
