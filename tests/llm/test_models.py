import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
from fixture import SCHEMA, empty, frame, rows
from pyspark.sql import functions as F
from test_text_operators import WORD, least, low, plain_dedup

import corpus_pipeline
from tessera.llm import langid, mixing, queries

SF = "/root/testdata/sf0.001"


def test_lm_base_and_model(spark):
    train = mixing.is_training
    got = mixing.score(frame(spark), train, slots=[1 << 16] * 3, chunk_bytes=20_000).collect()
    tokens = [(r[0], WORD.findall(low(r[1])) + [None]) for r in rows()]
    c = Counter(t for k, ts in tokens if train(k) for t in ts)
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for k, ts in tokens:
        want[k].append((len(ts), sum(t in c for t in ts), math.fsum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)))
    assert len(got) == len(tokens)
    for r in got:
        assert r.train_tokens == n and r.score < 0
        assert any(r.n_tokens == a and r.n_known == b and math.isclose(r.base_score, s, rel_tol=1e-9) for a, b, s in want[r.doc_id])
    assert mixing.score(empty(spark), train, slots=[1 << 16] * 3).count() == 0


def test_lm_is_a_probability():
    """Over all continuations of a decision the chances sum to one: the two outcomes of every decision of a text."""
    texts = [b"the cat sat on the mat", b"the dog sat", b""]
    x = mixing.Bytes(texts)
    spelling = mixing.Spelling(np.bincount(x.pair, minlength=65_536).reshape(256, 256))
    bit = (mixing._decisions(x.pair, spelling)[1] & 1).astype(np.int8)
    rng = np.random.default_rng(0)
    odds = rng.integers(-60, 60, (mixing.CONTEXTS, len(bit))).astype(np.int8)

    def cost(z):
        m = mixing.Mixer(1)
        m.learn(odds, z, np.array([0]), np.array([len(z)]), 4)
        return m.nats[0]

    for k in range(1, 12):
        a, b = bit[:k].copy(), bit[:k].copy()
        b[-1] ^= 1
        assert math.isclose(math.exp(-cost(a)) + math.exp(-cost(b)), math.exp(-cost(a[:-1])), rel_tol=1e-5)
    # Every byte has a complete code after every byte.
    for before in (0, 32, 116):
        lengths = spelling.length[before << 8 : (before + 1) << 8]
        assert math.isclose(sum(2.0**-k for k in lengths.tolist()), 1)


def plain_mixed(text, learned, spelling):
    """The log10 probability of a text, decision by decision, from counts by slot."""

    def decisions(t):
        hashed = mixing.Bytes([t]).contexts([1 << 16] * 3)
        t = t + b"\0"
        for i, b in enumerate(t):
            before = t[i - 1] if i else 0
            k = before << 8 | b
            for step in spelling.step[spelling.start[k] : spelling.start[k] + spelling.length[k]].tolist():
                yield i, [(c, x ^ step >> 1) for c, x in enumerate(hashed[:, i].tolist())], step & 1

    counts = defaultdict(lambda: [0, 0])
    for t in learned:
        for _, slots, bit in decisions(t):
            for s in slots:
                counts[s][bit] += 1
    w, gain, bias, nats = [[mixing.START] * 3, [0.1] * 3], 1.0, 0.0, 0.0
    todo = list(decisions(text))
    while todo:
        span = todo[0][0] // mixing.SPAN
        size = [b for a, b in mixing.STEPS if span >= a][-1]
        here = [d for d in todo[:size] if d[0] // mixing.SPAN == span]
        todo = todo[len(here) :]
        moved, more, shift = [[0.0] * 3, [0.0] * 3], 0.0, 0.0
        for _, slots, bit in here:
            x = [max(-127, min(127, round(math.log((counts[s][1] + 0.1) / (counts[s][0] + 0.1)) * 16))) / 16 for s in slots]
            sets = [0, 1] if x[1] else [0]
            z = sum(w[g][c] * x[c] for g in sets for c in range(3))
            p = 1 / (1 + math.exp(-max(-11, min(11, gain * z + bias))))
            nats -= math.log(p if bit else 1 - p)
            err = bit - p
            for g in sets:
                for c in range(3):
                    moved[g][c] += err * x[c]
            more, shift = more + err * z, shift + err
        rate = (8 / size) ** 0.5
        w = [[w[g][c] + mixing.RATE * rate * moved[g][c] for c in range(3)] for g in (0, 1)]
        gain, bias = gain + mixing.RATE_2 * rate * 0.1 * more, bias + mixing.RATE_2 * rate * shift
    return -nats / math.log(10)


def test_lm_score_by_brute_force(spark):
    """Long and short texts, neighbours of any length, against one decision at a time."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.choice(list(b"abcdeT,."), k).astype(np.uint8)) for k in (1, 2, 3, 5, 7, 30)]
    texts = [b" ".join(words[j] for j in rng.integers(0, 6, n)) for n in (900, 1, 40, 3, 200)] + [b"", "é unseen".encode()]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    train = lambda k: k < 5
    got = {r.doc_id: r.score for r in mixing.score(docs, train, slots=[1 << 16] * 3, chunk_bytes=600).collect()}
    lower = [low(t.decode()).encode() for t in texts]
    x = mixing.Bytes(lower[:5])
    spelling = mixing.Spelling(np.bincount(x.pair, minlength=65_536).reshape(256, 256))
    for i, t in enumerate(lower):
        assert math.isclose(got[i], plain_mixed(t, lower[:5], spelling), rel_tol=1e-4), i


def test_lm_beats_single_bytes_on_held_out_text(spark):
    """Bits per byte of held-out text well below the entropy of its single bytes."""
    got = queries.op3_lm_scores(spark, SF).where("held_out").agg(F.sum(F.col("bits_per_byte") * (F.col("n_bytes") + 1)), F.sum(F.col("n_bytes") + 1)).first()
    texts = [low(r.text).encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if not mixing.is_training(r.doc_id)]
    c = Counter(b for t in texts for b in t + b"\0")
    n = sum(c.values())
    assert n == got[1] and got[0] / n < 0.8 * -sum(v / n * math.log2(v / n) for v in c.values())


def test_lm_views_of_contexts_agree():
    rng = np.random.default_rng(1)
    x = mixing.Bytes([bytes(rng.choice(list(b"abc \n"), k).astype(np.uint8)) for k in (500, 3, 0, 900)] + [b"x" * 400])
    some = [1 << 16, 1 << 18, 1 << 17]
    full = x.contexts(some)
    for lo, hi in ((0, 700), (100, 130), (1, len(x.b)), (1500, len(x.b))):
        assert (mixing._cut(x, some, lo, hi) == full[:, lo:hi]).all()


def test_lm_counts_spell_a_context_and_pair_once(monkeypatch):
    """Counts of a text that repeats itself: those of every decision, for the work of the distinct ones."""
    texts = [b"the cat sat on the mat. " * 2000, bytes(np.random.default_rng(3).choice(list(b"abc \n"), 3000).astype(np.uint8))]
    x = mixing.Bytes(texts)
    spelling = mixing.Spelling(np.bincount(x.pair, minlength=65_536).reshape(256, 256))
    slots = [1 << 16, 1 << 18, 1 << 17]
    n, step = mixing._decisions(x.pair, spelling)
    spelled, decisions = [], mixing._decisions
    monkeypatch.setattr(mixing, "_decisions", lambda pair, s: spelled.append(len(pair)) or decisions(pair, s))
    for k, sub in enumerate(mixing._views(x, slots, 0, len(x.b))):
        assert (sub == x.contexts(slots)[k]).all()
        want, got = np.zeros(slots[k] * 2, np.int32), np.zeros(slots[k] * 2, np.int32)
        np.add.at(want, np.repeat(sub.astype(np.int64) << 1, n) ^ step, 1)
        mixing._add(got, sub, x.pair, spelling)
        assert (got == want).all()
    assert max(spelled) < 0.1 * len(x.b)


def test_lm_tokens_of_a_chunk_make_no_objects():
    """Tokens as bytes.split has them after lower-casing A-Z, in a few numbers each (objects: 78 bytes a token)."""
    odd = [b"", b" ", bytes(range(1, 128)) * 2, "É ß x\u00a0y\x85z\u2003İ K".encode(), b" a", b"A\x00 ", b"\t\n\x0b\x0c\rA  b\x1cc", b"", b"A" * 100, b"a b a"]
    for texts in (odd, odd[:1], odd[1:2], odd[::-1], []):
        keys = [None, *range(len(texts))][: len(texts)]
        place, count, at, size = mixing._counted(keys, texts, mixing.is_training)
        split = [[*low(t.decode()).encode().split(), b""] for t in texts]
        learned = Counter(w for k, words in zip(keys, split, strict=True) if mixing.is_training(k) for w in words)
        place = place.to_pylist()
        assert [place[i] for i in at.tolist()] == sum(split, []) and size.tolist() == list(map(len, split))
        assert len(set(place)) == len(place) and count.tolist() == [learned[w] for w in place]
    texts = [b"The cat sat on the mat. " * 400] * 100
    tracemalloc.start()
    at = mixing._counted(list(range(100)), texts, mixing.is_training)[2]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) == 240_100 and most < 40 * len(at)


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    got = langid.identify(test, langid.fit(train), host="source", keep=("doc_id", "lang")).select("doc_id", F.col("lang").alias("said"), "language.*").collect()
    assert len(got) == test.count()
    assert sum(r.said == r.lang for r in got) >= 0.97 * len(got)
    assert sum(r.accepted for r in got) >= 0.99 * len(got)


def test_language_id_evidence(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog are on the mat" if i % 2 else "le chat et le chien sont sur le tapis", "en" if i % 2 else "fr", "h" + str(i % 2), None, None, None) for i in range(60)], SCHEMA)
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None, "fr", "h1", None, None, None), (2, "", None, None, None, None, None), (3, "le chat", "FR-ca", "h0", None, None, None), (3, "the dog", "xx", "nowhere", None, None, None), (4, "一二" * 50, None, None, None, None, None)] + [tuple(r) for r in docs.collect()], SCHEMA)
    got = defaultdict(list)
    for r in langid.identify(odd, model, declared="lang", host="source", keep=("doc_id",)).select("doc_id", "language.*").collect():
        got[r.doc_id].append((r.lang, r.accepted))
    assert ("fr", True) in got[3] and ("en", True) in got[3]
    assert not any(a for _, a in got[2] if _ is None) and len(got) == 60
    assert langid.identify(empty(spark), model).count() == 0
    assert langid.identify(docs, langid.fit(empty(spark))).where("language.lang is null").count() == 60


def test_page_evidence(spark):
    page = spark.createDataFrame([(1, "https://u@www.Site.example.ORG:80/fr/1?x=2", "<!DOCTYPE html><html class=a lang='fr-CA'><script>var t='<p>';</script><body><!-- x -->Un &amp; deux</body></html>"), (2, None, None)], "page_id long, url string, html string")
    a, b = sorted(langid.page_evidence(page).collect())
    assert (a.host, a.suffix, a.declared, a.body.split()) == ("www.Site.example.ORG", "ORG", "fr", ["Un", "deux"])
    assert b.body is None and b.host is None


def test_near_finds_edited_copies(spark):
    """Copies with words changed: of texts at a Jaccard likeness of 0.9 and more nearly all link, unrelated texts never."""
    from tessera.llm import near

    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        w = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((2 * k, " ".join(w), None, None, None, None, None))
        for _ in range(3):
            w[rng.integers(0, 300)] = "edited"
        rows.append((2 * k + 1, " ".join(w), None, None, None, None, None))
    rows += [(500, None, None, None, None, None, None), (501, "", None, None, None, None, None), (None, rows[0][1], None, None, None, None, None), rows[3]]
    got = near.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    pairs = {r.doc_id: r.component for r in got if r.doc_id is not None and r.doc_id < 500}
    assert all(c in (i, i - 1) for i, c in pairs.items())
    assert sum(c == i - 1 for i, c in pairs.items() if i % 2) >= 36
    assert {r.component for r in got if r.doc_id in (500, 501)} == {500} and {r.component for r in got if r.doc_id is None} == {0}
    assert near.classes(empty(spark)).count() == 0


def test_pairs_of_a_bucket_across_components():
    """All pairs of other components that share enough minima, whatever batches the bucket comes in."""
    import pyarrow as pa

    from tessera.llm import near

    r = np.random.default_rng(4)
    base = r.integers(0, 256, near.BANDS * near.ROWS)
    sig = np.stack([np.where(r.random(len(base)) < p, base, r.integers(0, 256, len(base))) for p in r.random(200)]).astype(np.uint8)
    key, group = np.sort(r.integers(0, 3, 200)), r.integers(0, 5, 200)
    rows = [pa.RecordBatch.from_arrays([pa.array(key[k : k + 37]), pa.array(np.arange(k, min(k + 37, 200))), pa.array([x.tobytes() for x in sig[k : k + 37]], pa.binary()), pa.array(group[k : k + 37])], ["variant", "cid", "sig", "root"]) for k in range(0, 200, 37)]
    got = [(a, b) for x in near._verify(near.FEW)(iter(rows)) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if key[i] == key[j] and group[i] != group[j] and (sig[i] == sig[j]).sum() >= near.FEW}
    assert set(got) == want and want


def test_pipeline_against_plain_python(spark, tmp_path):
    """After language ID the kept rows are those of brute force over fingerprints, windows and tokens."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.language(spark, docs, SF)
    assert one.columns == list(corpus_pipeline.COLUMNS)
    first = sorted(one.collect())
    assert len(first) >= 0.99 * docs.count()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (low(r.text).split() for r in first)]
    comp = least([r.doc_id for r in first], lambda i, j: 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    two = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(first, one.schema), SF)
    want = sorted(two.collect())
    assert want == [r for r, c in zip(first, comp, strict=True) if r.doc_id == c]
    three = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(want, one.schema), SF)
    plain = {k: (n, gone) for k, n, gone, _ in plain_dedup(want)}
    kept = {r.doc_id: r for r in three.collect()}
    assert set(kept) == {k for k, (n, gone) in plain.items() if gone < n or not gone}
    assert all(len(WORD.findall(r.text)) == plain[k][0] - plain[k][1] for k, r in kept.items())
    out = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in out} == set(kept) and all(r.n == r.t for r in out)
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0]) and zlib.crc32(b"") == 0
