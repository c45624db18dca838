"""Language identification by Bayesian fusion of evidence.

posterior(l) ~ prior(l | host) * P(text | l)^t * P(declared | l). The host's prior is
smoothed towards its address suffix's, that towards the whole table's, all from grouped
counts. The text's likelihood is that of hashed byte trigrams; as neighbouring trigrams
are not independent, its exponent t makes n of them count as n * GRAMS / (n + GRAMS).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, binary, lean, stage, tune

BUCKETS = 1 << 14
GRAMS = 200.0
#: Distinct labelled texts that the likelihoods are fitted on, dealt evenly to the languages: those of the smallest hash. Each language has LEAST of them if there are so many.
SAMPLE = 4000
LEAST = 100
#: Rows' worth of the level above in a host's or suffix's prior.
SMOOTHING = 20.0
#: Hosts up to which their priors are broadcast; beyond it they are joined by a shuffle.
BROADCAST_HOSTS = 50_000
ACCEPT = 0.5


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the texts, one after the other, and where each text's begin and end."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    b = np.frombuffer(b"".join(texts).translate(ASCII_LOWER) + b"\0\0", np.uint8).astype(np.uint32)
    code = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(18)
    end = np.cumsum(n)
    return code, end - n, end - np.minimum(n, 2)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (languages, BUCKETS) of all labelled rows, from a sample of their texts.

    The sample is, of each language, the distinct texts with the smallest hashes, however many copies
    they have; only the names and counts by language and bucket come to the driver.
    """
    tune(labelled.sparkSession)
    rows = labelled.select(F.lower(F.trim(F.col(label))).alias("label"), F.col(text).cast("string").alias("text")).where("label <> '' and text <> ''").withColumn("h", F.xxhash64("text"))
    distinct = rows.groupBy("label", "h").agg(F.lit(1).alias("one"))
    langs = sorted(r.label for r in rows.select("label").distinct().collect())
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    each = max(LEAST, sample // len(langs))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    chosen = distinct.withColumn("nth", nth).where(F.col("nth") <= each).select("label", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), binary(b.column(1)), strict=True):
                code, s, e = _codes([t])
                held[lang] = held.get(lang, 0) + np.bincount(code[s[0] : e[0]], minlength=BUCKETS)
        for lang, n in held.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(n[k])], ["label", "bucket", "n"])

    got = rows.join(F.broadcast(chosen), ["label", "h"], "left_semi").dropDuplicates(["label", "h"]).select("label", "text").mapInArrow(run, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), BUCKETS))
    counts[[langs.index(x) for x in got["label"]], got["bucket"].to_numpy(np.int64)] = got["n"]
    return langs, np.log((counts + 0.1) / (counts + 0.1).sum(1, keepdims=True)).astype(np.float32)


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", declared: str | None = None, host: str | None = None, suffix: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and struct `language` (lang, posterior, text_lang, n_grams, accepted), one row for each input row.

    declared, host, suffix: columns with the markup's language, the host and its address
    suffix; a null or absent one is no evidence (a null host has its suffix's prior, a null suffix the
    table's). accepted: the posterior is at least ACCEPT and the text's trigrams are likelier
    in its language than uniform noise. Texts that are null or shorter than a trigram have
    no likelihood; they get the most likely language of the other evidence and are not accepted.
    Ties go to the first language in order of name. The staged pass carries keep's columns
    and one number a language, so texts are read twice only if they are not kept.
    """
    spark = df.sparkSession
    tune(spark)
    langs, logp = model
    if not langs:
        none = F.struct(F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit(0).cast("long").alias("n_grams"), F.lit(False).alias("accepted"))
        return df.select(*keep, none.alias("language"))
    table = spark.sparkContext.broadcast(logp)
    size = len(langs)

    @F.pandas_udf("array<double>")
    def likelihoods(s: pd.Series) -> pd.Series:
        lean()
        code, a, e = _codes([t.encode() for t in s])
        sums = [np.concatenate(([0.0], np.cumsum(p[code], dtype=np.float64))) for p in table.value]
        return pd.Series(list(np.stack([c[e] - c[a] for c in sums] + [(e - a).astype(np.float64)], 1)))

    of = lambda c: F.lit(None).cast("string") if c is None else F.lower(F.trim(F.col(c).cast("string")))
    names = F.array(*map(F.lit, langs))
    primary = F.regexp_extract(of(declared), "^[a-z]+", 0)
    src = df.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"), of(host).alias("host"), of(suffix).alias("suffix"), F.when(F.array_contains(names, primary), primary).alias("declared"))
    seen = src.withColumn("ll", likelihoods(F.coalesce("text", F.lit("")))).drop("text")
    n = F.element_at("ll", -1)
    best = lambda a: F.array_position(a, F.array_max(a)).cast("int")
    ll = F.slice("ll", 1, size)
    seen = seen.withColumns({"n": n, "top": F.when(n > 0, best(ll))})
    seen = stage(seen, "evidence")
    # Counts of the most likely languages by text: by declared language, by suffix and host.
    counted = seen.where("top is not null").groupBy("host", "suffix", "declared", "top").agg(F.count("*").alias("rows"))
    counted = stage(counted, "counts")
    whole, confusion = np.zeros(size), np.ones((size, size))
    for top, r in counted.groupBy("top").agg(F.sum("rows")).collect():
        whole[top - 1] = r
    for d, top, r in counted.where("declared is not null").groupBy("declared", "top").agg(F.sum("rows")).collect():
        confusion[top - 1, langs.index(d)] += r
    base = (whole + 1) / (whole.sum() + size)
    given = np.log(confusion / confusion.sum(1, keepdims=True))

    def by(*keys: str) -> DataFrame:
        """Counts for each language of each group."""
        return counted.groupBy(*keys).agg(F.array(*[F.sum(F.when(F.col("top") == k + 1, F.col("rows")).otherwise(0)).cast("double") for k in range(size)]).alias("counts"))

    def smooth(counts: F.Column, above: F.Column) -> F.Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, above, lambda c, p: (c + SMOOTHING * p) / (total + SMOOTHING))

    prior0 = F.array(*[F.lit(float(p)) for p in base])
    suffixes = by("suffix").where("suffix is not null").select("suffix", smooth(F.col("counts"), prior0).alias("of_suffix"))
    hosts = by("host", "suffix").where("host is not null").join(suffixes, "suffix", "left").select(F.col("host"), F.col("suffix"), smooth(F.col("counts"), F.coalesce("of_suffix", prior0)).alias("of_host"))
    hosts, suffixes = stage(hosts, "hosts"), stage(suffixes, "suffixes")
    small = lambda x: F.broadcast(x) if x.count() <= BROADCAST_HOSTS else x
    a, h, s = seen.alias("a"), small(hosts).alias("h"), small(suffixes).alias("s")
    full = a.join(h, (F.col("a.host") == F.col("h.host")) & F.col("a.suffix").eqNullSafe(F.col("h.suffix")), "left").join(s, F.col("a.suffix") == F.col("s.suffix"), "left")
    prior = F.coalesce(F.col("of_host"), F.col("of_suffix"), prior0)
    temper = F.lit(GRAMS) / (F.col("n") + GRAMS)
    column = lambda j: F.array(*[F.lit(float(given[i, j])) for i in range(size)])
    told = F.coalesce(*[F.when(F.col("declared") == x, column(j)) for j, x in enumerate(langs)], F.array(*[F.lit(0.0)] * size))
    score = F.zip_with(F.zip_with(prior, ll, lambda p, x: F.log(p) + x * temper), told, lambda x, d: x + d)
    full = full.select("row", "ll", "n", "top", score.alias("score")).withColumn("most", F.array_max("score"))
    k = best(F.col("score"))
    post = 1 / F.aggregate("score", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("most")))
    fits = F.coalesce(F.element_at("ll", k) / F.when(F.col("n") > 0, F.col("n")) > -float(np.log(BUCKETS)), F.lit(False))
    out = F.struct(
        F.element_at(names, k).alias("lang"),
        F.round(post, 6).alias("posterior"),
        F.when(F.col("top").isNotNull(), F.element_at(names, F.coalesce("top", F.lit(1)))).alias("text_lang"),
        F.col("n").cast("long").alias("n_grams"),
        ((post >= ACCEPT) & fits).alias("accepted"),
    )
    return full.select("row", out.alias("language")).select("row.*", "language")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, body, declared, host, suffix) of raw web pages: text without markup, the html element's language, the address's host and suffix."""
    body = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"&(#?\w+);", " ")
    host = F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return pages.select("page_id", body.alias("body"), F.nullif(F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", 1), F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract(host, r"\.([A-Za-z]+)$", 1), F.lit("")).alias("suffix"))
