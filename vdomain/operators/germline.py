"""Closest germline genes by DataFrame operations: identity over columns, k-mers, e-values and their ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kernel.genes import Gene
from ..kernel.sw import K, LAMBDA

KMER, TOP = 4, 128
# Groups of residues that count as one letter in k-mers, and all others as a last one.
GROUPS = ("LVIMC", "AGSTP", "FYW", "EDNQ", "KR", "H")
#: A gene table is sent to all executors up to this many rows; larger ones are joined by key.
BROADCAST_GENES = 50_000


def gene_table(spark: SparkSession, genes: list[Gene]) -> DataFrame:
    rows = [(g.segment, g.chain, g.species, g.species_ord, g.name, g.gene_ord, g.aligned) for g in genes]
    df = spark.createDataFrame(rows, "seg string, chain string, species string, species_ord int, gene string, gene_ord int, aligned string").withColumn("ungapped", F.regexp_replace("aligned", "-", ""))
    return F.broadcast(df) if len(rows) <= BROADCAST_GENES else df


def identity(query: str | Column, gene: str | Column) -> Column:
    """Share of the gene's residues that stand in the query at the same column; 0 for a gene without any."""
    q, g = (F.col(x) if isinstance(x, str) else x for x in (query, gene))
    pairs = F.filter(F.arrays_zip(F.split(F.upper(q), "").alias("q"), F.split(g, "").alias("g")), lambda p: (p["g"] != "-") & (p["g"] != ""))
    same = F.size(F.filter(pairs, lambda p: p["q"] == p["g"]))
    return F.when(F.size(pairs) > 0, same / F.size(pairs)).otherwise(0.0)


#: Letters of an aligned row by code, from 1; gaps are 0, and whatever else counts as one letter more.
LETTERS, PLANES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ*", 5


def planes(aligned: str | Column) -> list[Column]:
    """128 columns as ten longs: for each half and each bit of the letters' codes, where that bit is set."""
    s = F.regexp_replace(F.rpad(F.upper(F.col(aligned) if isinstance(aligned, str) else aligned), 128, "-"), "[^A-Z*-]", "?")
    out = []
    for bit in range(PLANES):
        # a translation gives 64 digits a half, which are read as a number in base 2
        digits = F.translate(s, LETTERS + "?-", "".join(str(k >> bit & 1) for k in range(1, len(LETTERS) + 2)) + "0")
        out += [F.conv(F.substring(digits, at, 64), 2, -10).cast("long") for at in (1, 65)]
    return out


def _same_columns(q: str, g: str) -> Column:
    """How many columns of two rows of planes (arrays `q`, `g`) hold the same letter: no bit of their codes differs, and the gene's isn't a gap."""
    count = []
    for half in range(2):
        pairs = [(F.col(q)[2 * b + half], F.col(g)[2 * b + half]) for b in range(PLANES)]
        differs, there = (reduce(Column.bitwiseOR, x) for x in ([a.bitwiseXOR(b) for a, b in pairs], [b for _, b in pairs]))
        count.append(F.bit_count(F.bitwise_not(differs).bitwiseAND(there)))
    return count[0] + count[1]


def best_by_identity(queries: DataFrame, genes: DataFrame, key: str, segment: str, on: list[str]) -> DataFrame:
    """(key, species, gene, identity): the first gene, by species and gene order, of those with the highest identity to `aligned_query`; nothing where it is 0."""
    # both sides become bit masks once per row; a pair is compared by a few operations on longs
    g = genes.where(F.col("seg") == segment).select(*on, *(c for c in ("species", "species_ord", "gene", "gene_ord") if c not in on), F.array(*planes("aligned")).alias("_g"), F.length("ungapped").alias("_n"))
    q = queries.select(key, *on, F.array(*planes("aligned_query")).alias("_q"))
    scored = q.join(g, on).withColumn("identity", F.when(F.col("_n") > 0, _same_columns("_q", "_g") / F.col("_n")).otherwise(0.0))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("identity")).alias("lack"), "species_ord", "gene_ord", "species", "gene")).alias("b"))
    return best.where("b.lack < 0").select(key, F.col("b.species").alias("species"), F.col("b.gene").alias("gene"), (-F.col("b.lack")).alias("identity"))


def best_by_evalue(scored: DataFrame, key: str) -> DataFrame:
    """Of rows (key, evalue, score, species, gene) the lowest e-value, then the higher score, then species and gene by name."""
    best = scored.groupBy(key).agg(F.min(F.struct("evalue", (-F.col("score")).alias("lack"), "species", "gene")).alias("b"))
    return best.select(key, F.col("b.species").alias("species"), F.col("b.gene").alias("gene"), F.col("b.evalue").alias("evalue"), (-F.col("b.lack")).alias("score"))


def missing_species(allowed: list[str], chain_species: str | Column) -> Column:
    """Whether a requested species has no genes for the chain."""
    return F.size(F.array_except(F.array(*map(F.lit, allowed)), F.col(chain_species) if isinstance(chain_species, str) else chain_species)) > 0


def database_length(genes: DataFrame, segment: str, species: list[str]) -> DataFrame:
    """(chain, length): residues of all genes of the species."""
    return genes.where((F.col("seg") == segment) & F.col("species").isin(*species)).groupBy("chain").agg(F.sum(F.length("ungapped")).alias("length"))


def canonical_j_length(genes: DataFrame) -> DataFrame:
    """(chain, length): the longest, over species, of the first J gene without what is missing at its end."""
    return genes.where("seg = 'J' and gene_ord = 0").groupBy("chain").agg(F.max(F.length(F.regexp_replace("aligned", "-+$", ""))).alias("length"))


def kmers(sequence: str | Column, k: int = KMER) -> Column:
    """Distinct k-mers over the reduced alphabet, sorted, as digits."""
    s = F.upper(F.col(sequence) if isinstance(sequence, str) else sequence)
    grouped = "".join(GROUPS)
    s = F.translate(F.regexp_replace(s, f"[^{grouped}]", "?"), grouped + "?", "".join(str(n) * len(g) for n, g in enumerate(GROUPS)) + str(len(GROUPS)))
    starts = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.substring(s, i, F.lit(k)))))


def top_by_kmers(queries: DataFrame, genes: DataFrame, key: str, top: int = TOP) -> DataFrame:
    """(key, gene_index, hits, rank): the genes that share most k-mers with each query, by count, then index; those that share none are left out.

    The index has a row for each k-mer, 7^4 at most, and is sent to all executors; queries are dealt out by key before their k-mers are
    taken apart, whose number their estimated size doesn't show, and stay there.
    """
    index = genes.select("gene_index", F.explode(kmers("ungapped")).alias("kmer")).groupBy("kmer").agg(F.collect_list("gene_index").alias("_genes"))
    dealt = queries.select(key, F.col("sequence")).repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    met = dealt.select(key, F.explode(kmers("sequence")).alias("kmer")).join(F.broadcast(index), "kmer").select(key, F.explode("_genes").alias("gene_index"))
    hits = met.groupBy(key, "gene_index").agg(F.count("*").alias("hits"))
    w = Window.partitionBy(key).orderBy(F.col("hits").desc(), "gene_index")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def evalue(raw: Column, query_length: Column, database: Column) -> Column:
    return query_length.cast("double") * database * F.pow(F.lit(2.0), -raw)


def bit_score(raw: str | Column) -> Column:
    return (F.lit(LAMBDA) * (F.col(raw) if isinstance(raw, str) else raw) - F.log(F.lit(K))) / F.log(F.lit(2.0))
