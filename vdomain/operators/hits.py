"""Operators on hits: thresholds, species, overlap. A sequence's hits are an array, or rows with the sequence's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAINS = ("H", "K", "L", "A", "B", "G", "D")
#: Columns of a hit that the fold carries, after its e-value and its order.
CARRIED = ("hit_id", "bitscore", "query_start", "query_end")


def species_of(hit_id: str | Column) -> Column:
    return F.element_at(F.split(F.col(hit_id) if isinstance(hit_id, str) else hit_id, "_", 2), 1)


def chain_of(hit_id: str | Column) -> Column:
    return F.element_at(F.split(F.col(hit_id) if isinstance(hit_id, str) else hit_id, "_", 2), 2)


def chain_class(chain: str | Column) -> Column:
    c = F.col(chain) if isinstance(chain, str) else chain
    return F.when(c.isin("K", "L"), F.lit("L")).otherwise(c)


def over(threshold: float, score: str = "bitscore") -> Column:
    return F.round(F.col(score), 1) >= threshold


def allowed(chain: str | Column, chains: tuple[str, ...] = CHAINS) -> Column:
    return (F.col(chain) if isinstance(chain, str) else chain).isin(*chains)


def limit_species(hits: DataFrame, key: str, species: list[str], threshold: float) -> DataFrame:
    """Hits over the threshold whose id starts with one of the species, once per such species; all hits of sequences that have none (reverted)."""
    own = F.size(F.filter(F.array(*map(F.lit, species)), lambda s: F.col("hit_id").startswith(s)))
    marked = hits.withColumn("_own", F.when(F.col("bitscore") >= threshold, own).otherwise(0)).withColumn("reverted", F.max("_own").over(Window.partitionBy(key)) == 0)
    return marked.where("reverted or _own > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(F.col("reverted"), 1).otherwise(F.col("_own"))))).drop("_own", "_n")


def without_overlap(hits: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, domains): a sequence's hits over the threshold that overlap none kept before, by e-value and then order, from N to C.

    A sequence has as many hits as it has domains times profiles; they are one array, and the choice is a fold over it.
    """
    ordered = F.array_sort(F.collect_list(F.struct("evalue", "hit_ord", *CARRIED)))
    rows = hits.where(F.col("bitscore") >= threshold).groupBy(key).agg(ordered.alias("hits"))
    empty = F.slice("hits", 1, 0)
    kept = F.aggregate("hits", empty, lambda acc, x: F.when(F.exists(acc, lambda d: (x["query_start"] < d["query_end"]) & (d["query_start"] < x["query_end"])), acc).otherwise(F.concat(acc, F.array(x))))
    order = F.array_sort(F.transform(kept, lambda d: F.struct(d["query_start"].alias("query_start"), d["query_end"].alias("query_end"), d["hit_ord"].alias("hit_ord"), d["hit_id"].alias("hit_id"), d["bitscore"].alias("bitscore"), d["evalue"].alias("evalue"))))
    return rows.select(key, order.alias("domains"))


def first_domain(domains: str = "domains") -> Column:
    return F.try_element_at(F.col(domains), F.lit(1))


def states(columns: str, query_start: str, hit_start: str) -> Column:
    """States of a hit from its columns (m, i, d) as an array of (id, typ, si), by SQL functions; the kernel's is faster, this is its cross-check."""
    before = lambda k: F.substring(F.col(columns), F.lit(1), k - 1)
    count = lambda k, kinds: F.length(F.regexp_replace(before(k), f"[^{kinds}]", ""))
    at = lambda k: F.substring(F.col(columns), k, F.lit(1))
    return F.transform(
        F.when(F.length(columns) > 0, F.sequence(F.lit(1), F.length(columns))).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct((F.col(hit_start) + 1 + count(k, "md")).cast("int").alias("id"), at(k).alias("typ"), F.when(at(k) != "d", (F.col(query_start) + count(k, "mi")).cast("int")).alias("si")),
    )


def extended(query_start: str, query_end: str, hit_start: str, hit_end: str, length: str | Column, model_length: str | Column, first: Column, alone: Column) -> dict[str, Column]:
    """Bounds of a hit, extended at the ends where little of the model is missing: at the start of a sequence's first hit, as far as the sequence goes (where the
    model misses more than the sequence has, only by the difference), and at the end of an only one."""
    qs, qe, hs, he = map(F.col, (query_start, query_end, hit_start, hit_end))
    length, model = (F.col(x) if isinstance(x, str) else x for x in (length, model_length))
    more = F.when(first & (hs > 0) & (hs < 5), F.when(hs <= qs, hs).otherwise(F.least(qs, hs - qs))).otherwise(0)
    tail = F.when(alone & (qe < length) & (he > 123) & (he < model), F.least(model - he, length - qe)).otherwise(0)
    return {query_start: qs - more, query_end: qe + tail, hit_start: hs - more, hit_end: he + tail}
