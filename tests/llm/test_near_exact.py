"""Near-duplicates by real likeness, against plain Python; rows without ids or with one that others have."""

import random

from test_text_operators import least

import corpus_pipeline
from tessera.llm import near

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b)


def edited(r, words, n):
    w = list(words)
    for k in range(n):
        w[(2 * k + 1) * len(w) // (2 * n)] = f"edit{r.random()}"
    return " ".join(w)


def test_links_at_the_threshold(spark):
    """Pairs at a likeness of 0.82 all link (of 60, 37 were within the bit limit); pairs at 0.71 to 0.76 never."""
    r = random.Random(3)
    rows = []
    for k in range(120):
        w = [f"w{r.randrange(50_000)}" for _ in range(300)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, edited(r, w, 6 if k % 2 else 8 + k % 3))]
    got = dict(near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    said = [jaccard(rows[2 * k][1], rows[2 * k + 1][1]) for k in range(120)]
    assert min(x for x in said if x >= 0.8) < 0.83 and max(x for x in said if x < 0.8) > 0.75
    assert [got[2 * k + 1] == 2 * k for k in range(120)] == [x >= 0.8 for x in said]


def test_components_by_brute_force(spark):
    """Chains and a loose group: pairs that meet in one bucket with a third text between them, too."""
    r = random.Random(5)
    base = [f"w{r.randrange(9000)}" for _ in range(200)]
    rows = [(k, edited(r, base, r.randrange(1, 6))) for k in range(60)]
    w = list(base)
    for k in range(60, 100):
        w[r.randrange(len(w))] = f"step{k}"
        rows.append((k, " ".join(w)))
    got = dict(near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [got[k] for k, _ in rows] == least([k for k, _ in rows], lambda i, j: jaccard(rows[i][1], rows[j][1]) >= 0.8)


def test_a_repeated_line_is_no_likeness(spark):
    r = random.Random(7)
    line = " ".join(f"l{k}" for k in range(10))
    rows = [(k, " ".join([line] * 30 + [f"w{r.randrange(50_000)}" for _ in range(100)])) for k in range(4)]
    assert {a == b for a, b in near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {True}


def test_rows_without_ids_are_told_apart(spark):
    """Different texts with no id or one id all stay; of copies the one of the least id stays, once."""
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(50_000)}" for _ in range(80)) for _ in range(7)]
    ids = [None, None, None, 4, 4, 5, 6]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)]
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame([*rows, (4, texts[6], "en", "s", 1), (None, texts[5], "en", "s", 1)], KINDS)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(x.text for x in got) == sorted(texts)
    assert {x.doc_id for x in got if x.text == texts[6]} == {4} and {x.doc_id for x in got if x.text == texts[5]} == {5}
    docs = spark.createDataFrame([(i, f"{t} {passage}", "en", "s", 1) for i, t, *_ in rows], KINDS)
    got = corpus_pipeline.repeated_passages(spark, docs, "").collect()
    assert sorted(x.text.removesuffix(f" {passage}") for x in got) == sorted(texts) and sum(passage in x.text for x in got) == 1
