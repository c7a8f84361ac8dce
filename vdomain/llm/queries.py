"""Queries over the training-data tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, hamming, html, mixing, packing, simhash, substrings, toxicity, vectors, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code().alias("code"))
    return hamming.top_k(codes, codes.where("id % 50 = 0")).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(_read(spark, sf_dir, "conversations"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(_read(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_all(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_packing,
        op3_substring_dedup,
        op4_html_extraction,
        op5_mixing,
        op6_hamming_top_k,
        op7_chat_formatting,
        op8_warc_revisits,
        op9_simhash,
        op10_toxicity,
    )
}

ORACLE_SQL = {"op1_embedding_near_dedup": vectors.ORACLE, "op3_substring_dedup": substrings.ORACLE, "op5_mixing": mixing.ORACLE, "op6_hamming_top_k": hamming.ORACLE, "op7_chat_formatting": chat.ORACLE, "op8_warc_revisits": warc.ORACLE}
