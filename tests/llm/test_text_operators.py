import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
import xxhash
from fixture import empty, frame, rows
from tokenizers import Tokenizer

from tessera.llm import bpe, common, licenses, packing, queries, simhash, substrings, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_license_base_places(spark):
    got = licenses.report(licenses.scan(frame(spark))).drop("labels", "score", "n_places")
    want = []
    for i, t, *_ in rows():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        places = [(k, n) for n, p in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want.append((i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in places}))))
    assert table(got) == sorted(want, key=repr)
    assert licenses.scan(empty(spark)).count() == 0


def test_license_templates():
    auto = licenses.Automaton({"t": "a b <<beginOptional>>c <<beginOptional>>d<<endOptional>><<endOptional>> <<var;words=0-2>> e", "u": "a b c"})
    want = re.compile(r"a b (?:c (?:d )?)?(?:\w+ ){0,2}?e\b")
    for text in ("a b e", "a b c e", "a b c d e", "a b x y e", "a b c d x y e", "a b x y z e", "a b c", "z a b x e a b c d q", "a b d e", "b e"):
        spans = [(label, k, n) for label, k, n in auto.scan(text.encode().split()) if label == "t"]
        assert bool(spans) == bool(want.search(text)), text
    assert [x[0] for x in auto.scan(b"a b c d e".split())] == ["t", "u"]
    full = licenses.Automaton(licenses.TEMPLATES)
    found = {x[0] for x in full.scan(licenses.words(b"Copyright (c) 2020 Some Body. All rights reserved. Licensed under the Apache License, Version 2.0. Released under the MIT License"))}
    assert found == {"copyright-notice", "apache-2.0", "mit-notice"}
    assert licenses.covered([("a", 0, 3), ("b", 1, 1), ("c", 5, 2)]) == 5


def test_token_counts_against_plain_search(spark):
    scores = token_counts.unigram_scores(queries.RANKS)
    import regex

    def best(word):
        top = [(0.0, 0)] + [None] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e - 1, -1, -1):
                if word[s:e] in scores and (top[e] is None or top[s][0] + scores[word[s:e]] > top[e][0]):
                    top[e] = (top[s][0] + scores[word[s:e]], top[s][1] + 1)
        return top[-1]

    want = []
    for i, t, *_ in rows():
        found = regex.findall(P.PATTERN, t or "")
        got = [best(x.encode()) for x in found[:400]]
        if len(found) <= 400:
            want.append((i, len(found), sum(n for _, n in got), round(sum(s for s, _ in got), 2)))
    out = {(r.doc_id, r.n_pretokens, r.n_tokens, round(r.score, 2) + 0.0) for r in token_counts.count(frame(spark), queries.RANKS, P.PATTERN).collect()}
    near = lambda a: {(x[0], x[1], x[2]) for x in a}
    assert near(want) <= near(out)
    assert token_counts.count(empty(spark), queries.RANKS, P.PATTERN).count() == 0


def test_bpe_as_tiktoken(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := enc.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, *_ in rows()]
    assert table(bpe.round_trip(frame(spark), queries.RANKS, P.PATTERN)) == sorted(want, key=repr)
    codec = bpe.codec(queries.RANKS, P.PATTERN)
    for t in ("a" * 300, "abcabcabd" * 30, "é" * 50, " \n \n  x"):
        assert codec.encode(t) == enc.encode_ordinary(t)
    back = bpe.decode(bpe.encode(frame(spark), queries.RANKS, P.PATTERN), queries.RANKS, P.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in rows())


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert [h.find(k) for k in keys] == list(range(5000)) and None not in h.keys
    assert h.find(b"x") == -1 and bpe.PerfectHash([]).find(b"x") == -1


def plain_fp(t):
    w = WORD.findall(low(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least(ids, linked):
    comp = list(range(len(ids)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                comp[find(i)] = find(j)
    by = defaultdict(list)
    for i in range(len(ids)):
        by[find(i)].append(ids[i])
    return [min((x for x in by[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_against_all_pairs(spark):
    rs = rows()
    f = [plain_fp(t) for _, t, *_ in rs]
    want = sorted(((r[0], f"{x:016x}", c) for r, x, c in zip(rs, f, least([r[0] for r in rs], lambda i, j: (f[i] ^ f[j]).bit_count() <= 3), strict=True)), key=repr)
    got = [(r[0], f"{r[1] & (2**64 - 1):016x}", r[2]) for r in simhash.classes(frame(spark)).collect()]
    assert sorted(got, key=repr) == want
    assert simhash.classes(empty(spark)).count() == 0


def test_simhash_links_of_crowded_balls(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = set(centre.tolist())
    for c in centre.tolist():
        for _ in range(60):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    f = sorted(fps)
    want = least(f, lambda i, j: (f[i] ^ f[j]).bit_count() <= 3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(x),) for x in f], "fp long")).collect()
    pairs = {(a & (2**64 - 1), b & (2**64 - 1)) for a, b in got}
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    at = {x: i for i, x in enumerate(f)}
    both = {(at[a], at[b]) for a, b in pairs} | {(at[b], at[a]) for a, b in pairs}
    assert least(f, lambda i, j: (i, j) in both) == want


def test_simhash_bucket_by_neighbours():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 16, 4000).astype(np.uint64) | (np.uint64(1) << rng.integers(16, 20, 4000).astype(np.uint64)))
    many = simhash._bucket(0, 0, fps, 3)
    f = fps.tolist()
    assert all((a ^ b).bit_count() <= 3 for a, b in many)
    few = [x for x in f if x & 0xFFFF < 600]
    sub = simhash._bucket(0, 0, np.array(few, np.uint64), 3)
    at = {x: i for i, x in enumerate(few)}
    both = {(at[a], at[b]) for a, b in sub} | {(at[b], at[a]) for a, b in sub}
    assert least(few, lambda i, j: (i, j) in both) == least(few, lambda i, j: (few[i] ^ few[j]).bit_count() <= 3)


def test_packing(spark):
    tok = Tokenizer.from_file(queries.TOKENIZER)
    want = defaultdict(list)
    for i, t, *_ in rows():
        want[i].append(tok.encode(t or "", add_special_tokens=False).ids + [0])
    for length, windows in ((1024, 32), (64, 2)):
        got = packing.pack(frame(spark), queries.TOKENIZER, length=length, windows=windows).collect()
        seqs, docs = defaultdict(list), defaultdict(list)
        for r in got:
            seqs[r.sequence_id].append((r.offset, r.length))
            docs[r.doc_id].append(r)
        for s in seqs.values():
            at = 0
            for o, n in sorted(s):
                assert o == at and n > 0
                at += n
            assert at <= length
        assert set(docs) == set(want)
        for i, pieces in docs.items():
            if len(want[i]) == 1:
                at = 0
                for r in sorted(pieces, key=lambda r: r.start):
                    ids = want[i][0][at : at + r.length]
                    assert r.start == at and r.doc_tokens == len(want[i][0]) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
                    at += r.length
                assert at == len(want[i][0])
            else:
                assert sum(r.length for r in pieces) == sum(map(len, want[i]))
        short = [sum(n for _, n in s) for s in seqs.values()]
        assert sum(x < length for x in short) <= 1
    assert packing.pack(empty(spark), queries.TOKENIZER).count() == 0


def plain_dedup(rs, k=20):
    first, words = {}, [WORD.findall(t or "") for _, t, *_ in rs]
    order = lambda i: (rs[i][0] is None, rs[i][0] or 0)
    for i, w in enumerate(words):
        for s in range(len(w) - k + 1):
            key, at = tuple(w[s : s + k]), (*order(i), s)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, w in enumerate(words):
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (*order(i), s):
                gone.update(range(s, s + k))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((rs[i][0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(spark, monkeypatch):
    want = plain_dedup(rows())
    assert sum(x[2] for x in want) > 500
    for size in (8 << 20, 3000):
        got = substrings.dedup(frame(spark), out=("n_words", "n_removed", "kept_sha256"), chunk_bytes=size)
        assert table(got) == want
    # Phrases of many chunks, compared in levels; every document is a chunk of its own.
    assert table(substrings.dedup(frame(spark), out=("n_words", "n_removed", "kept_sha256"), chunk_bytes=1, fan=2)) == want
    assert substrings.dedup(empty(spark)).count() == 0


def test_substring_dedup_collects_before_each_pass(spark, monkeypatch):
    """Executors (here the driver's JVM) start each pass without garbage, and the last one too; the driver's own collections are left out."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(common, "release", lambda spark: None)
    seen = [full()]
    chunked, staged = substrings.stage_chunks, substrings.stage
    monkeypatch.setattr(substrings, "stage_chunks", lambda *a: seen.append(full()) or chunked(*a))
    monkeypatch.setattr(substrings, "stage", lambda *a: seen.append(full()) or staged(*a))
    got = substrings.dedup(frame(spark), out=("n_words", "n_removed", "kept_sha256"))
    seen.append(full())
    assert len(seen) == 7 and all(a < b for a, b in zip(seen[:-1], seen[1:], strict=True))
    assert table(got) == plain_dedup(rows())


def test_automata_alone_find_the_places(monkeypatch):
    """A phrase the automata do not report is no candidate, whatever its hash says."""
    passage = " ".join(f"p{i}" for i in range(30))
    sink = pa.BufferOutputStream()
    docs = pa.table({"key": pa.array([1, 2], pa.int64()), "text": [f"a b c {passage} d", f"x {passage} y z"]})
    with pa.ipc.new_stream(sink, docs.schema) as w:
        w.write_table(docs)
    chunk = substrings.Chunk(sink.getvalue().to_pybytes(), 20, 8)
    values, times = np.unique(chunk.phrases[chunk.selected], return_counts=True)
    assert len(chunk.candidates(values[times > 1])) >= 22
    monkeypatch.setattr(substrings.Chunk, "located", lambda self, recurring: np.zeros(len(self.phrases), bool))
    assert not len(chunk.candidates(values[times > 1]))


def test_every_template_as_a_regular_expression():
    """Labels of texts spelled from the templates, some with a word changed, against backtracking search."""
    r = np.random.default_rng(5)

    def spelled(template: str) -> list[str]:
        out, skip = [], 0
        for mark, word in licenses._MARK.findall(template):
            if mark == "beginOptional":
                skip += skip > 0 or r.random() < 0.4
            elif mark == "endOptional":
                skip -= skip > 0
            elif not skip and mark:
                low, high = map(int, mark.split("=")[1].split("-"))
                out += [f"w{i}" for i in range(r.integers(low, high + 1))]
            elif not skip:
                out.append(word)
        return out

    def pattern(template: str) -> re.Pattern:
        out = ""
        for mark, word in licenses._MARK.findall(template):
            low_high = mark.split("=")[1].replace("-", ",") if "=" in mark else ""
            out += {"beginOptional": "(?:", "endOptional": ")?"}.get(mark, f"(?:[^ ]+ ){{{low_high}}}") if mark else re.escape(word) + " "
        return re.compile("(?<= )" + out)

    searches = {k: pattern(t) for k, t in (licenses.BASE | licenses.TEMPLATES).items()}
    auto = licenses.Automaton(licenses.BASE | licenses.TEMPLATES)
    seen = set()
    for _ in range(8):
        for name, template in licenses.TEMPLATES.items():
            words = ["x", *spelled(template), "y"]
            changed = r.random() < 0.5
            if changed:
                words[r.integers(1, len(words) - 1)] = "other"
            line = " " + " ".join(words) + " "
            want = {k for k, p in searches.items() if p.search(line)}
            assert {x for x, _, _ in auto.scan([w.encode() for w in words])} == want
            assert changed or name in want
            seen |= want
    assert seen >= set(licenses.TEMPLATES)


def test_a_license_whose_later_wording_differs():
    auto = licenses.Automaton(licenses.TEMPLATES)
    text = re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", licenses.TEMPLATES["mit"])
    whole = re.sub(r"<<var.*?>>", "anybody", text).encode()
    assert {x for x, _, _ in auto.scan(licenses.words(whole))} == {"mit", "mit-start"}
    assert {x for x, _, _ in auto.scan(licenses.words(whole.replace(b"any claim", b"each claim")))} == {"mit-start"}
