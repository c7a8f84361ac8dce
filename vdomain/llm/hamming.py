"""Exact top-k search over 64-bit codes by incremental multi-index hashing, with SQL functions only.

A code is cut into segments about as wide as the index is large, each an index key. A query first looks up keys near its own in every
segment; rings of larger radius follow for the queries that still need them, in as many segments as they need. Once the m
segments have been searched to radii r1..rm, every code at a distance up to (r1+1)+..+(rm+1)-1 has been met, so a query is done
when its kth verified distance is no more than that. Candidates farther than the kth so far never leave the join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

BITS = 64
#: Radius up to which all segments are searched at the start.
AT_ONCE = 1
#: Keys of a ring that a segment is asked for, at most; queries that need a larger ring go on with four segments of 16 bits, whose rings are all smaller.
MOST_MASKS, FALLBACK = 30_000, [(0, 16), (16, 16), (32, 16), (48, 16)]


def sign_code(vector: str = "embedding") -> Column:
    """A bit for each of the first 64 components: 1 if it is positive. Null for a null vector; missing and null components are 0."""
    return F.when(F.col(vector).isNotNull(), F.expr(f"aggregate(sequence(0, 63), 0L, (a, i) -> a | if(coalesce(get({vector}, i), 0) > 0, shiftleft(1L, i), 0L))"))


def segments_of(n: int) -> list[tuple[int, int]]:
    """Shift and width of each segment, about as wide as log2 of the number of codes, so that a key holds about one code."""
    m = max(3, min(8, round(BITS / math.log2(n + 2))))
    cuts = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def masks(spark: SparkSession, width: int, least: int, most: int) -> DataFrame:
    """Values `mask` of `width` bits with `least` to `most` of them set: a table, as a plan that lists them would take the driver's memory."""
    return spark.range(1 << width).where(F.bit_count("id").between(least, most)).select(F.col("id").alias("mask"))


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """codes (id, code) and queries (id, code) to (query_id, rank, id, distance): the k nearest codes of each query by distance, then id.

    A query that is itself among the codes is found like any other. Null codes are neither searched nor found; null ids
    come last among equals. Fewer than k codes: all of them. Rows with one code share its place in the index.
    """
    spark = codes.sparkSession
    scratch = Scratch(spark, "hamming")
    by_code = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    # only a code's k smallest ids can be among anyone's k nearest; the limit is applied before rows are shuffled
    few = codes.where("code is not null").select("id", "code").withColumn("nth", F.row_number().over(by_code)).where(F.col("nth") <= k)
    held = scratch.table(few.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("ids")))
    wanted = queries.where("code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    state = scratch.table(wanted.select("q").distinct().select("q", F.lit(BITS).alias("bound")))
    best: DataFrame | None = None
    done: DataFrame | None = None
    usual = segments_of(held.count())
    for segments in [usual] if len(usual) >= len(FALLBACK) else [usual, FALLBACK]:
        m, widest = len(segments), max(w for _, w in segments)
        key = lambda code, s: F.shiftrightunsigned(F.col(code), segments[s][0]).bitwiseAND(F.lit((1 << segments[s][1]) - 1))  # noqa: B023, E731
        index = scratch.table(held.select("code", F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), key("code", s).alias("key")) for s in range(m)))).alias("x")).select("code", "x.seg", "x.key"))
        for r in range(AT_ONCE, widest + 1):
            lo = 0 if r == AT_ONCE else r
            if math.comb(widest, r) > MOST_MASKS:
                break
            # with all segments searched to r - 1 and the first t to r, all codes up to m * r + t - 1 have been met: a query searches as many as its kth distance asks for
            state = state.withColumn("t", F.greatest(F.lit(1), F.least(F.lit(m), F.col("bound") - m * r + 1)) if lo else F.lit(m))
            segs = state.repartition(partitions(spark), "q").select("q", "bound", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("seg"))
            own = lambda of: reduce(lambda rest, s: F.when(F.col("seg") == s, of(s)).otherwise(rest), range(m - 1), of(m - 1))
            ring = F.broadcast(masks(spark, widest, lo, r))
            asked = segs.withColumn("key", own(lambda s: key("q", s))).join(ring, F.col("mask") < own(lambda s: F.lit(1 << segments[s][1]))).select("q", "bound", "seg", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))  # noqa: B023
            distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
            # few queries ask for very many keys, which their estimated size doesn't show: no side of these joins goes through the driver
            met = asked.hint("merge").join(index, ["seg", "key"]).where(distance <= F.col("bound")).select("q", "code", distance.alias("distance")).distinct()
            rows = met.hint("merge").join(held, "code").select("q", "distance", F.explode("ids").alias("x")).select("q", "distance", F.col("x.id").alias("id"))
            if best is not None:
                rows = rows.union(best.select("q", "distance", "id")).distinct()
            order = Window.partitionBy("q").orderBy("distance", F.col("id").asc_nulls_last())
            new = scratch.table(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
            kth = new.groupBy("q").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
            after = scratch.table(state.select("q", "t").join(kth, "q", "left").select("q", F.when(F.col("n") >= k, F.col("far")).otherwise(BITS).cast("int").alias("bound"), (m * r + F.col("t") - 1).alias("covered")))
            found = F.lit(r == widest) | (F.col("bound") <= F.col("covered"))
            finished = scratch.table(new.join(after.where(found), "q", "left_semi"))
            done = finished if done is None else done.union(finished)
            state = scratch.table(after.where(~found).select("q", "bound"), after)
            best = new
            if r == widest or state.isEmpty():
                return wanted.join(done, "q").select("query_id", "rank", "id", "distance")
    raise AssertionError("the last segments are searched to their whole width")


ORACLE = """
WITH e AS (SELECT vec_id, CAST(array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN coalesce(embedding[i], 0) > 0 THEN '1' ELSE '0' END), '') AS BIT) AS code
  FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(bit_count(xor(q.code, e.code)) AS INTEGER) AS distance FROM e q, e WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
