"""Near duplicates by way of SimHash; what a large bucket of texts that are near but not alike ships."""

import random

import numpy as np
import pyarrow as pa
from test_near_exact import edited, jaccard
from test_text_operators import least

from tessera.llm import near, simhash
from tessera.llm.common import release_executors


def test_simhash_gives_the_first_candidates(spark, monkeypatch):
    """The stage's links come through op 4's operator: all of its classes, whole."""
    r = random.Random(11)
    texts = []
    for _ in range(30):
        w = [f"w{r.randrange(9000)}" for _ in range(300)]
        texts += [" ".join(w), edited(r, w, 1), edited(r, w, 2), " ".join(w + w[:1])]
    fps = [simhash.fingerprint(t.encode()) for t in texts]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = near._balls(spark.createDataFrame(list(enumerate(signed)), "cid long, fp long")).collect()
    pairs = {(a, b) for a, b in got}
    linked = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3
    both = pairs | {(b, a) for a, b in pairs}
    assert pairs and all(linked(a, b) for a, b in pairs)
    assert least(list(range(120)), lambda i, j: (i, j) in both) == least(list(range(120)), linked)
    called, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *x: called.append(x) or links(*x))
    found = dict(near.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert called and [found[k] for k in range(120)] == [k // 4 * 4 for k in range(120)]


def test_a_crowded_bucket_ships_its_members_and_not_its_pairs(monkeypatch):
    """Rows are at most members times blocks; the links join what brute force joins."""
    r = random.Random(12)
    base = [f"w{r.randrange(9000)}" for _ in range(200)]
    texts = [edited(r, base, r.randrange(2, 9)) for _ in range(150)]
    h = [near.shingles(t.encode()) for t in texts]
    minima = [near.minima(x) for x in h]
    bands = np.stack([near.bands(x) for x in minima])
    met = [(int(v), k) for b in range(near.BANDS) for v in np.unique(bands[:, b]) if (bands[:, b] == v).sum() > 1 for k in np.flatnonzero(bands[:, b] == v).tolist()]
    met = sorted((int(np.uint64(v).view(np.int64)), k) for v, k in met)
    key, at = ([x[i] for x in met] for i in (0, 1))
    sig = [near.signature(minima[k]) for k in at]
    batch = pa.table({"variant": key, "cid": at, "sig": pa.array(sig, pa.binary()), "root": at, "bands": pa.array([bands[k].tobytes() for k in at], pa.binary())})
    want = least(list(range(150)), lambda i, j: jaccard(texts[i], texts[j]) >= 0.8)
    pairs = sum(x.num_rows for x in near._verify(near.FEW)(iter(batch.select(range(4)).to_batches(100))))
    for block in (4096, 16):
        monkeypatch.setattr(near, "BLOCK", block)
        t = pa.Table.from_batches(list(near._wanted(near.FEW)(iter(batch.to_batches(100)))))
        assert t.num_rows <= len(met) * -(-150 // block) and (block < 4096 or t.num_rows < pairs / 4)
        t = t.append_column("text", pa.array([texts[k] for k in t.column("cid").to_pylist()])).sort_by([(c, "ascending") for c in ("variant", "part", "side", "cid")])
        got = {(a, b) for x in near._judge_bucket(near.FEW, 0.8, 5)(iter(t.to_batches(100))) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}
        assert got and all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in got)
        assert least(list(range(150)), lambda i, j: (i, j) in got or (j, i) in got) == want


def test_a_stage_starts_without_the_garbage_of_the_one_before(spark):
    """Executors collect (here the driver's JVM is the executor's; collections asked for at once may be one)."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    release_executors(spark)
    assert full() > before
