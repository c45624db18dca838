"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, langid, licenses, mixing, packing, simhash, substrings, token_counts, webp

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(_documents(spark, sf_dir)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_documents(spark, sf_dir), RANKS, PATTERN)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.score(_documents(spark, sf_dir), mixing.is_training)
    out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return got.withColumn("held_out", out)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.classes(_documents(spark, sf_dir))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), TOKENIZER).drop("ids")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), RANKS, PATTERN)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_documents(spark, sf_dir), out=("n_words", "n_removed", "kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    got = langid.identify(docs, langid.fit(docs), declared="lang", host="source")
    return got.select("doc_id", "language.*")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all evidence of web pages: markup, address suffix and host."""
    pages = langid.page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    got = langid.identify(pages, langid.fit(_documents(spark, sf_dir)), text="body", declared="declared", host="host", suffix="suffix", keep=("page_id",))
    return got.select("page_id", "language.*")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digest(_documents(spark, sf_dir))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_lm_scores, op4_simhash, op5_packing, op6_bpe, op7_substring_dedup, op8_language_id, op9_media, op10_embedding_dedup, page_languages)
}

#: Words of a document from 1, the places where 20 words follow each other, and for each such sequence its first place.
_REPEATED_WINDOWS = r"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
places as (select doc_id, words, unnest(range(1, len(words) - 18)) as start from texts),
windows as (select doc_id, start, array_to_string(list_slice(words, start, start + 19), ' ') as said from places),
later as (
  select doc_id, start from (select doc_id, start, row_number() over (partition by said order by doc_id, start) as nth from windows)
  where nth > 1
),
gone as (select distinct doc_id, unnest(range(start, start + 20)) as at from later),
spread as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as at from texts),
kept as (
  select s.doc_id, string_agg(s.word, ' ' order by s.at) as said, count(*) as n
  from spread s left join gone g on g.doc_id = s.doc_id and g.at = s.at where g.at is null group by s.doc_id
)
select t.doc_id, cast(len(t.words) as bigint) as n_words, cast(len(t.words) - coalesce(k.n, 0) as bigint) as n_removed,
  sha256(coalesce(k.said, '')) as kept_sha256
from texts t left join kept k on k.doc_id = t.doc_id
"""

_LINKED_VECTORS = """
with recursive usable as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links as (
  select a.vec_id as u, b.vec_id as w from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.98
),
reached as (
  select vec_id as u, vec_id as w from embeddings
  union
  select r.u, l.w from reached r join links l on l.u = r.w
),
classes as (select u, min(w) as component_id from reached group by u),
degrees as (select u, count(*) as n from links group by u)
select e.vec_id, cast(coalesce(d.n, 0) as bigint) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join classes c on c.u = e.vec_id left join degrees d on d.u = e.vec_id
"""

#: The others need hashes, tokenizers, models or files that SQL lacks; tests/llm holds them against plain Python.
ORACLE_SQL: dict[str, str] = {"op7_substring_dedup": _REPEATED_WINDOWS, "op10_embedding_dedup": _LINKED_VECTORS}
