"""A training corpus from raw documents: each stage is one of the operators, and works on all that the one before has kept.

A stage's result is written before the next stage is called, so each stage first drops what its predecessors have left in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vdomain.llm import mixing, packing, simhash, substrings, toxicity
from vdomain.llm.common import Scratch, stage


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network doesn't reject."""
    with stage(docs):
        return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of at least 0.8 similarity in five-word shingles join; fingerprints and bands propose them."""
    with stage(docs):
        return simhash.drop_near_duplicates(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier; a document that has nothing else stays, empty."""
    with stage(docs):
        return substrings.rewritten(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, the last one of a source in part."""
    with stage(docs):
        return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    with stage(docs):
        return packing.pack(docs)


STAGES = [("toxicity", clean), ("simhash near-dedup", distinct), ("substring dedup", unrepeated), ("mixing", mixed), ("packing", packed)]

#: A trained network, fingerprints and a linear program aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES:
        docs = scratch.table(apply(spark, docs, sf_dir), docs)
    return docs
