"""The operators applied to their whole tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commweave.llm.chat import repair
from commweave.llm.common import crc_mod, cut, table, word_count
from commweave.llm.ctw import score_texts
from commweave.llm.decontam import leaks
from commweave.llm.jpeg import text_features
from commweave.llm.langid import predict, train
from commweave.llm.mixing import mix, source_targets
from commweave.llm.pii import KINDS, listed, spans
from commweave.llm.sharding import shard
from commweave.llm.simhash import near_duplicates
from commweave.llm.sql import OP5_SQL
from commweave.llm.urls import judge


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    net = train(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), net).drop("text")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired and rendered conversations."""
    return repair(table(spark, sf_dir, "conversations"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, by the law of even rows."""
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return judge(table(spark, sf_dir, "pages"))


def op6_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, counts, base_score and score of every document."""
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out")), "held_out")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity, start of every benchmark item found in a document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    text = F.col("text")
    sized = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(text).alias("size"), F.sha2(text.cast("binary"), 256).alias("alike")))
    sizes = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    targets = source_targets(sizes)
    mixed = mix(sized, F.col("doc_id"), F.col("source"), F.col("size"), F.col("alike"), targets)
    of = T.StructType([T.StructField("_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    known = spark.createDataFrame([(s, n, targets[s]) for s, n in sizes.items()], of)
    return mixed.join(known, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_repeats")).alias("taken"), F.col("_repeats").alias("repeats"))


def op9_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sizes, checksums and feature of every document's text, stored as a progressive JPEG and read back."""
    return text_features(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts, base_sha256 and spans of every document."""
    found = spans(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.filter("base", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op1_langid": op1_langid, "op2_chat": op2_chat, "op3_simhash": op3_simhash, "op4_sharding": op4_sharding, "op5_urls": op5_urls, "op6_ctw": op6_ctw, "op7_decontamination": op7_decontamination, "op8_mixing": op8_mixing, "op9_jpeg": op9_jpeg, "op10_pii": op10_pii}
ORACLE_SQL = {"op5_urls": OP5_SQL}
