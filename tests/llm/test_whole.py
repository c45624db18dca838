"""What the operators gather and return does not end at a fixed size."""

import time
import zlib

import numpy as np

from tessera.llm import langid, mixing, packing, queries
from tessera.llm.common import stage_chunks


def test_language_sample_ignores_copies_and_keeps_rare_languages(spark):
    """3,000 copies and a language of three rows in 9,003."""
    rare = [("ga", f"tá an cat agus an madra ar an mata {k}") for k in range(3)]
    rows = [("en", "copied words again and again")] * 3000 + [("en" if k % 2 else "fr", f"{'the cat sat on the mat' if k % 2 else 'le chat est sur le tapis'} {k}") for k in range(6000)] + rare
    docs = spark.createDataFrame(rows, "lang string, text string")
    langs, logp = langid.fit(docs, sample=90)
    assert langs == ["en", "fr", "ga"]
    code, _, _ = langid._codes([b"cat sat", b"copied "])
    assert logp[0][code[:5]].mean() > logp[0][code[7:12]].mean() + 1
    again, other = langid.fit(docs.distinct(), sample=90)
    assert again == langs and np.array_equal(logp, other)


def test_slots_grow_with_the_contexts(spark):
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 123, 20_000).astype(np.uint8).tobytes().decode() for _ in range(40)]
    found = []
    for n in (2, 40):
        chunks = stage_chunks(spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string"))
        _, known = mixing.pair_counts(chunks, lambda k: True)
        x = mixing.Bytes([t.encode() for t in texts[:n]])
        want = [len(np.unique(h.astype(np.int64) << 8 | x.b)) for h in x.hashes()]
        assert all(abs(a - b) < 0.1 * b for a, b in zip(known, want, strict=True))
        found.append(max(known))
    assert found[1] > 10 * found[0]
    assert mixing.slots_for(100) == mixing.SLOTS and mixing.slots_for(2 * mixing.SLOTS) == 8 * mixing.SLOTS


def test_packed_ids_spell_the_documents(spark):
    texts = {k: f"some words of text {k} " * (k * 40) for k in range(30)}
    pieces = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), queries.TOKENIZER).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in pieces)
    stop = np.zeros(1, "<u4").tobytes()
    for k, t in texts.items():
        assert b"".join(bytes(r.ids) for r in sorted(pieces, key=lambda r: r.start) if r.doc_id == k) == packing.encoder(queries.TOKENIZER).encode(t) + stop


def test_a_very_long_document_is_packed_in_linear_time():
    """8 M tokens took 29 s when each sequence copied the rest."""
    ids = np.arange(8_000_000, dtype="<u4").tobytes()
    packer = packing.Packer(1024, 4, 0)
    begin = time.perf_counter()
    packer.add(1, 0, ids, 8_000_000)
    assert time.perf_counter() - begin < 5
    out = packer.take()
    assert [r[1] for r in out] == list(range(0, 8_000_000 // 1024 * 1024, 1024)) and b"".join(r[7] for r in out) == ids[: len(out) * 4096]
