"""Queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotrace.llm import statements
from biotrace.llm.angular_negatives import hard_negatives
from biotrace.llm.common import ship_package
from biotrace.llm.crf_langid import identify, is_held_out, train
from biotrace.llm.decontaminate import find_contamination
from biotrace.llm.html_extract import extract_pages
from biotrace.llm.iblt_fingerprint import document_fingerprints
from biotrace.llm.minhash_bbit import near_duplicates
from biotrace.llm.multi_index import near_vectors
from biotrace.llm.nnls_packing import pack
from biotrace.llm.pii import personal_data_report
from biotrace.llm.quote_threads import reply_threads
from biotrace.llm.suffix_dedup import remove_repeats
from biotrace.llm.token_shards import materialized_order
from biotrace.llm.va_file import cluster_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_threads(_table(spark, sf_dir, "conversations"))


def op4_minhash_bbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), num=85, den=100)
    return found.withColumnRenamed("id", "doc_id")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(_table(spark, sf_dir, "documents"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(_table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return find_contamination(docs, items)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized_order(_table(spark, sf_dir, "documents"))


def op9_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op11_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_fingerprints(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op12_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(_table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_quote_threads": op3_quote_threads,
    "op4_minhash_bbit": op4_minhash_bbit,
    "op5_personal_data": op5_personal_data,
    "op6_multi_index": op6_multi_index,
    "op7_decontamination": op7_decontamination,
    "op8_token_shards": op8_token_shards,
    "op9_crf_langid": op9_crf_langid,
    "op10_nnls_packing": op10_nnls_packing,
    "op11_iblt_fingerprint": op11_iblt_fingerprint,
    "op12_angular_negatives": op12_angular_negatives,
    "op13_va_file": op13_va_file,
}

SQL: dict[str, str] = statements.SQL
