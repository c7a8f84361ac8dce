"""Profiles and genes: from files that Spark can read, or the built-in genes and profiles built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..kernel.genes import Gene, built_in, parse_genes
from ..kernel.profile import Profile, build, parse_hmm
from ..operators.germline import gene_table

CHAINS = "HKLABGD"
#: Names of the session settings with paths of a HMMER3 profile file and of a gene file.
PROFILES, GENES = "spark.vdomain.profiles", "spark.vdomain.genes"


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def load_genes(spark: SparkSession, path: str | None = None) -> list[Gene]:
    path = path or spark.conf.get(GENES, None)
    return parse_genes(_text(spark, path)) if path else built_in()


def load_profiles(spark: SparkSession, path: str | None = None, genes: list[Gene] | None = None) -> list[Profile]:
    """From a file, or one profile per chain built from genes of all species together."""
    path = path or spark.conf.get(PROFILES, None)
    if path:
        return parse_hmm(_text(spark, path))
    genes = genes or built_in()
    return [build(f"pan_{c}", [g.aligned for g in genes if g.chain == c]) for c in CHAINS if any(g.chain == c for g in genes)]


def export_genes(spark: SparkSession, genes: list[Gene], path: str) -> DataFrame:
    """Genes with their ordinals as Parquet."""
    gene_table(spark, genes).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
