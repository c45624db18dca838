"""Corpus pipeline: language ID, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as
Parquet to the shared folder and gives it to the next. All but the last return the columns of
documents. Write a stage's result before the next one begins: the tables that a stage left in the
shared folder go when the next begins with docs read from other files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, near, packing, queries, substrings
from tessera.llm.common import STAGED, drop_folders, release_executors, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


Step = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[str] = []


def step(of: Step) -> Step:
    """A stage that deletes what the one before staged, unless docs still read it, and starts with executors that hold no garbage of it."""

    @wraps(of)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles()
        if files and not any(left.rsplit("/", 1)[-1] in f for left in _LEFT for f in files):
            drop_folders(spark, [f for f in _LEFT if f in STAGED])
            _LEFT.clear()
        release_executors(spark)
        before = set(STAGED)
        got = of(spark, docs, sf_dir)
        _LEFT.extend(f for f in STAGED if f not in before)
        return got

    return run


@step
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found go on, with that language as lang; the others go."""
    found = langid.identify(docs, langid.fit(docs), declared="lang", host="source", keep=COLUMNS)
    return found.where("language.accepted").withColumn("lang", F.col("language.lang")).select(*COLUMNS)


@step
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one of the least id (no id comes last).

    Groups are of rows, whatever their ids: links of SimHash within 3 bits, as in op 4, and what bands of minima
    find beyond them, both of a likeness of 0.8 or more by shingles of five words.
    """
    rows = near.numbered(docs.select(*COLUMNS))
    found = near.groups(rows, similarity=0.8, shingle=5)
    others = found.where("row <> root")
    shared = stage(others.unionByName(others.select(F.col("root").alias("row"), "root").distinct()), "shared")
    place = rows.select("row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text", "lang", "source", "n_chars"), "row").alias("place"))
    kept = place.join(shared, "row").groupBy("root").agg(F.min("place").alias("place"))
    gone = stage(shared.join(kept.select("root", F.col("place.row").alias("kept")), "root").where("row <> kept").select("row"), "gone")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


@step
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that also start earlier go; texts that lose none stay as they are, texts that lose all go.

    Rows without an id or with one that another row has are told apart by their place in order of id.
    """
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        docs = docs.withColumn("place", F.col("doc_id"))
    else:
        docs = stage(docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text", "lang", "source", "n_chars")).withColumn("place", F.monotonically_increasing_id()), "placed")
    left = substrings.dedup(docs, key="place", out=("n_words", "n_removed", "kept")).withColumnRenamed("place", "of").where("n_removed > 0").select("of", "kept")
    got = docs.join(left, F.col("place") == F.col("of"), "left").where("kept is null or kept <> ''")
    text = F.coalesce("kept", "text")
    return got.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept")).cast("long").alias("n_chars"))


@step
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.TOKENIZER)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]

#: Signatures, automata and tokens are beyond SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, of in STAGES[:-1]:
        docs = stage(of(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
