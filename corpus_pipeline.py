"""A training corpus from ``documents``: one language each, no near copies, no benchmark passages, mixed and sharded.

All stages but the last return the columns they get, whatever their names, extra ones included. Rows with a null in any
column, and whole texts of any length, are treated like others unless a stage says otherwise; an empty table gives an
empty one. Reruns on the same rows agree, up to rows that are equal in all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commweave.llm.common import cut, table, word_count
from commweave.llm.decontam import decontaminate
from commweave.llm.langid import accept
from commweave.llm.mixing import mix
from commweave.llm.sharding import place
from commweave.llm.simhash import deduplicate


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; learned from the rows with a language.

    Null texts, texts without a letter and texts of no clear language go. Repeated rows all stay or all go. Where no row
    has a language, none is found and all go.
    """
    return accept(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id that isn't null.

    Of rows with one id in a group, the one whose text has the smallest hash stays, of rows alike in id and text the one
    with the smallest hash of all columns. Null and empty texts are copies of each other.
    """
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Rows with a null id go by their text; repeated rows all stay or all go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, not at all to three times: repeats are rows of their own.

    A null source is a source. Null texts have no words and follow their source's full passes. Which of several rows alike
    in id and text is taken once more is open.
    """
    mixed = mix(docs, F.col("doc_id"), F.col("source"), word_count(F.col("text")), F.sha2(F.col("text").cast("binary"), 256))
    return mixed.select(F.explode(F.array_repeat(F.struct(*docs.columns), F.col("_repeats"))).alias("_doc")).select("_doc.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot, which replace columns of these names; equal texts share shards where quotas allow.

    Rows alike in id and text share their slots out among themselves. Null texts have no links.
    """
    return place(docs)


STAGES = [("language", language), ("dedup", dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Networks, seeded choices and propagation have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each stage's rows are written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
