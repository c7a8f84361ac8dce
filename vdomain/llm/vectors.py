"""Embedding near-duplicates: a robust-pruned flat graph on overlapping cluster shards.

Vectors of one direction (to 12 digits) are one node. Centroids are fitted on a bounded sample; each node is a member of its two
nearest shards, where a pruned graph is built, and the adjacency lists of a node from both are united. Each
node then searches its `probes` nearest shards from their medoids, and everything in range that it meets is
expanded in turn. What is found is verified in double precision. Links are only counted, and a task gives
a spanning forest of what it has found, so that a large group of copies never becomes a table of pairs. An audit
holds the links of sampled nodes, some with links and some of all, against brute force; it widens the search where recall is
too low, and an error ends the job where that doesn't help.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flatgraph
from .common import Scratch, grouped, partitions, pieces, signed, union_pairs
from .components import connected_components

log = logging.getLogger(__name__)

#: Nodes that a shard should have, the most shards, and rows and bytes of the sample that centroids are fitted on.
SHARD, MOST_SHARDS, SAMPLE, SAMPLE_BYTES = 1200, 65_536, 200_000, 64 << 20
#: Rows of the sample for each centroid.
PER_CENTROID = 16
#: Shards that a node is a member of; shards that it searches, beam and degree: at first, and where the audit finds too little.
MEMBER = 2
SEARCHES = ((5, 32, flatgraph.DEGREE), (15, 64, 32), (45, 128, 48))
#: Members and queries that one task holds; larger shards are dealt out in blocks of each.
MEMBERS, QUERIES = 3000, 12_000
#: Nodes that the audit holds against brute force: of those with links, of all, and of all again where those have few links.
AUDIT, MORE, FEW = 256, 2048, 20
#: Recall below which the search is widened, and below which the job ends.
RECALL, LEAST = 0.97, 0.9


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of float64 from equally long binaries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def valid(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vec): the direction as float64 bytes; null for vectors that are null, empty, zero, or hold a null or a component that isn't finite."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4096):
            lists = b.column("v")
            there, size = lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy()
            flat, first = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            out: list[bytes | None] = [None] * len(lists)
            for n in np.unique(size[there]):
                rows = np.flatnonzero(there & (size == n))
                unit = np.round(_unit(flat[first[rows][:, None] + np.arange(n)]), 12) + 0.0
                for k, u in zip(rows, unit):
                    out[k] = u.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "vec"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.when(good, v).alias("v")).mapInArrow(run, "id long, vec binary")


def _fitted(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def centroids(sample: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """k centroids; many are fitted in two steps, each part of the sample getting its share."""
    rng, x = np.random.default_rng(seed), sample.astype(np.float32)
    if k <= 512:
        return _fitted(x, k, rng)
    top = _fitted(x, round(math.sqrt(k)), rng)
    own = (x @ top.T).argmax(axis=1)
    parts = [x[own == j] for j in range(len(top))]
    return np.concatenate([_fitted(p, max(1, min(len(p), round(k * len(p) / len(x)))), rng) for p in parts if len(p)])


def _dealt(nodes: DataFrame, c: np.ndarray, probes: int) -> DataFrame:
    """Each node once per shard that it searches: (key, n, vec, shard, member, home, probed)."""
    p = min(probes, len(c))
    own = nodes.sparkSession.sparkContext.broadcast(c)  # at most MOST_SHARDS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4096):
            sim = _unit(_matrix(b.column("vec"))).astype(np.float32) @ own.value.T
            near = np.argpartition(-sim, p - 1, axis=1)[:, :p]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1).astype(np.int32)
            probed = pa.array([r.tobytes() for r in near], pa.binary())
            for k in range(p):
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), b.column("vec"), pa.array(near[:, k]), pa.array(np.full(len(near), k < MEMBER)), pa.array(near[:, 0]), probed], ["key", "n", "vec", "shard", "member", "home", "probed"])

    return nodes.select("key", "n", "vec").mapInArrow(run, "key long, n long, vec binary, shard int, member boolean, home int, probed binary")


def _graphs(members: DataFrame, degree: int) -> DataFrame:
    """Members by block to (key, near): keys of the neighbours in the block's graph; for a member that follows another, -1 less that one's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, "shard", "i"):
            keys = t.column("key").to_numpy()
            order = np.argsort(keys)
            keys, x = keys[order], _unit(_matrix(t.column("vec"))[order]).astype(np.float32)
            adj, leader = flatgraph.build(x, degree)
            near = [keys[a[a >= 0]].tobytes() if f < 0 else (-1 - keys[[f]]).tobytes() for a, f in zip(adj, leader)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(near, pa.binary())], ["key", "near"])

    n = partitions(members.sparkSession)
    return members.select("shard", "i", "key", "vec").repartition(n, "shard", "i").sortWithinPartitions("shard", "i").mapInArrow(run, "key long, near binary")


def _marks(keys: np.ndarray) -> np.ndarray:
    """A hash of each key, of which sets of keys are told apart by the exclusive or."""
    h = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _searched(rows: DataFrame, threshold: float, beam: int) -> DataFrame:
    """Blocks of members (with united lists) and queries to (key, links, mark, other): links of a key, counted, with a mark of their set (other = key); and links that span what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, *_), t in grouped(batches, "shard", "i", "j"):
            is_member = t.column("is_member").to_numpy()
            mem, que = t.filter(pa.array(is_member)), t.filter(pa.array(~is_member))
            if not mem.num_rows or not que.num_rows:
                continue
            keys = mem.column("key").to_numpy()
            order = np.argsort(keys)
            keys, mem = keys[order], mem.take(pa.array(order))
            x = _unit(_matrix(mem.column("vec")))
            x32 = x.astype(np.float32)
            weight, home = mem.column("n").to_numpy(), mem.column("home").to_numpy()
            lists = [np.frombuffer(b"".join(v or []), np.int64) for v in mem.column("near").to_pylist()]
            follows = [v < 0 for v in lists]
            lists = [np.where(f, -1 - v, v) for f, v in zip(follows, lists)]
            at = [np.searchsorted(keys, v) for v in lists]
            there = [(a < len(keys)) & (keys[np.minimum(a, len(keys) - 1)] == v) for a, v in zip(at, lists)]
            # whom a member follows in this block; in both of its shards it may follow one, of which at least this block's is here
            leader = np.array([next(iter(a[t & f]), -1) for a, t, f in zip(at, there, follows)], np.int64)
            at = [np.unique(a[t]) for a, t in zip(at, there)]
            adj = np.full((len(keys), max(1, max(map(len, at)))), -1, np.int32)
            for k, a in enumerate(at):
                adj[k, : len(a)] = a
            starts = flatgraph.medoids(x32)
            qkeys = que.column("key").to_numpy()
            q = _unit(_matrix(que.column("vec")))
            probed = np.frombuffer(b"".join(que.column("probed").to_pylist()), np.int32).reshape(len(qkeys), -1)
            values, node = np.unique(np.concatenate((keys, qkeys)), return_inverse=True)
            parent, links, mark = np.arange(len(values)), np.zeros(len(qkeys), np.int64), np.zeros(len(qkeys), np.uint64)
            for lo in range(0, len(qkeys), 256):
                own = q[lo : lo + 256]
                _, _, found = flatgraph.search(x32, adj, starts, own.astype(np.float32), beam, threshold - 1e-4 - flatgraph.TIED)
                if not len(found):
                    continue
                a, b = flatgraph.followed(found, leader).T
                good = np.concatenate([np.einsum("nd,nd->n", own[a[s : s + 65536]], x[b[s : s + 65536]]) >= threshold for s in range(0, len(a), 65536)])
                a, b = a[good], b[good]
                other = keys[b] != qkeys[lo + a]
                a, b = a[other], b[other]
                # a member found in both of its shards counts at its first, or at its second if the query doesn't search the first
                counts = (home[b] == shard) | ~(probed[lo + a] == home[b][:, None]).any(axis=1)
                links += np.bincount(lo + a[counts], weight[b[counts]], len(qkeys)).astype(np.int64)
                np.bitwise_xor.at(mark, lo + a[counts], _marks(keys[b[counts]]))
                union_pairs(parent, node[len(keys) + lo + a], node[b])
            linked = np.flatnonzero(parent != np.arange(len(values)))
            some = np.flatnonzero(links)
            none = np.zeros(len(linked), np.int64)
            columns = [(qkeys[some], values[linked]), (links[some], none), (signed(mark[some]), none), (qkeys[some], values[parent[linked]])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["key", "links", "mark", "other"])

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "shard", "i", "j").sortWithinPartitions("shard", "i", "j").mapInArrow(run, "key long, links long, mark long, other long")


def _blocks(dealt: DataFrame) -> DataFrame:
    """With the numbers of blocks of members and of queries of each shard."""
    size = dealt.groupBy("shard").agg(F.sum(F.col("member").cast("long")).alias("m"), F.count("*").alias("q"))
    size = size.select("shard", F.greatest(F.lit(1), F.ceil(F.col("m") / MEMBERS)).cast("int").alias("mb"), F.greatest(F.lit(1), F.ceil(F.col("q") / QUERIES)).cast("int").alias("qb"))
    return dealt.join(size, "shard").withColumn("i", F.pmod(F.xxhash64("key"), F.col("mb")).cast("int")).withColumn("j", F.pmod(F.xxhash64("key", F.lit(1)), F.col("qb")).cast("int"))


def _linked(nodes: DataFrame, threshold: float, count: int, size: int, search: tuple[int, int, int], scratch: Scratch) -> DataFrame:
    """Nodes of one dimension to (key, links, mark, other)."""
    probes, beam, degree = search
    k = int(min(MOST_SHARDS, max(1, -(-count // SHARD))))
    rows = min(max(20_000, PER_CENTROID * k), SAMPLE, SAMPLE_BYTES // size)
    sample = _unit(np.stack([np.frombuffer(r.vec, np.float64) for r in nodes.orderBy(F.xxhash64("key")).limit(rows).select("vec").toLocalIterator()]))  # SAMPLE rows and SAMPLE_BYTES at most
    dealt = scratch.table(_blocks(_dealt(nodes, centroids(sample, min(k, len(sample))), probes)))
    graphs = scratch.table(_graphs(dealt.where("member"), degree))
    united = graphs.groupBy("key").agg(F.collect_list("near").alias("near"))  # at most MEMBER lists
    mem = dealt.where("member").join(united, "key").select("shard", "i", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("j"), F.lit(True).alias("is_member"), "key", "n", "vec", "home", "near", F.lit(None).cast("binary").alias("probed"))
    que = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), "j", F.lit(False).alias("is_member"), "key", "n", "vec", "home", F.lit(None).cast("array<binary>").alias("near"), "probed")
    found = _searched(mem.union(que), threshold, beam)
    # one row per key with links, beside the spanning links
    counted = found.groupBy("key", "other").agg(F.sum("links").alias("links"), F.expr("bit_xor(mark)").alias("mark"))
    return scratch.table(counted.select("key", "links", "mark", "other"), dealt, graphs)


def _truth(nodes: DataFrame, picked: list, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the picked nodes, counted, and marks of their sets, by brute force against all nodes."""
    keys = np.array([r.key for r in picked])
    q = _unit(np.stack([np.frombuffer(r.vec, np.float64) for r in picked]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mark = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint64)
        for b in pieces(batches, 2048):
            own = b.column("key").to_numpy()
            i, j = np.nonzero((_unit(_matrix(b.column("vec"))) @ q.T >= threshold) & (own[:, None] != keys))
            np.add.at(total, j, b.column("n").to_numpy()[i])
            np.bitwise_xor.at(mark, j, _marks(own[i]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(total), pa.array(signed(mark))], ["k", "links", "mark"])

    rows = nodes.select("key", "n", "vec").mapInArrow(run, "k long, links long, mark long").groupBy("k").agg(F.sum("links").alias("links"), F.expr("bit_xor(mark)").alias("mark")).collect()  # a row per picked node
    total, mark = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for r in rows:
        total[r.k], mark[r.k] = r.links, r.mark
    return total, mark


def audit(nodes: DataFrame, found: DataFrame, threshold: float) -> tuple[float | None, int]:
    """Mean share of their links that were found, over sampled nodes with links, and the number of those; None if none has any.

    Nodes count alike, whatever their number of links; one whose links are as many as there are but not the same counts as having none.
    """
    counted = found.where(F.col("key") == F.col("other")).select("key", "links", "mark")
    by_hash = lambda df, n, seed: df.orderBy(F.xxhash64("key", F.lit(seed))).limit(n)
    with_links = by_hash(counted.select("key"), AUDIT, 3)
    shares: list[float] = []
    for sample in (nodes.join(F.broadcast(with_links), "key"), by_hash(nodes, AUDIT, 2), by_hash(nodes, MORE, 4)):
        picked = sample.select("key", "vec").collect()  # AUDIT or MORE rows
        if not picked:
            continue
        there, marks = _truth(nodes, picked, threshold)
        got = {r.key: r for r in counted.where(F.col("key").isin([r.key for r in picked])).collect()}
        own = []
        for r, n, m in zip(picked, there.tolist(), marks.tolist()):
            if n:
                g = got.get(r.key)
                own.append(0.0 if g is None or (g.links == n) != (g.mark == m) else min(g.links, n) / n)
        shares += own
        if len(own) >= FEW and len(shares) > len(own):
            break  # enough of all nodes have links
    return (float(np.mean(shares)) if shares else None), len(shares)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per row of `df`: id, n_links (other rows whose vectors have at least this cosine), component_id, kept.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, and vectors of
    different lengths don't link. Repeated ids are rows of their own; a component is named by its smallest id, which is null
    only if all are. An empty table gives no rows. The audit's figures are logged; a recall below LEAST after the widest search raises.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = scratch.table(valid(df, id_col, vector).withColumn("k1", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))).withColumn("k2", F.xxhash64(F.lit(1), "vec")))
    distinct = rows.where("vec is not null").groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.min("id").alias("first_id"), F.count("*").alias("n"))
    nodes = scratch.table(distinct.withColumn("key", F.monotonically_increasing_id()))
    found: DataFrame | None = None
    for r in sorted(nodes.groupBy(F.length("vec").alias("bytes")).count().collect()):  # one row per length of vectors
        own = nodes.where(F.length("vec") == r.bytes)
        for search in SEARCHES:
            part = _linked(own, threshold, r["count"], r.bytes, search, scratch)
            recall, seen = audit(own, part, threshold)
            log.info("vectors of %d components: recall %s over %d audited nodes with links, %d shards searched, beam %d, degree %d", r.bytes // 8, recall, seen, *search)
            if recall is None or recall >= RECALL:
                break
        else:
            if recall < LEAST:
                raise RuntimeError(f"recall {recall:.3f} over {seen} audited nodes after the widest search")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "key long, links long, mark long, other long")
    roots = scratch.table(connected_components(found.where("key <> other").select(F.col("key").alias("a"), F.col("other").alias("b")), scratch))
    links = found.where("key = other").select("key", "links")
    named = nodes.select("key", "k1", "k2", "first_id", "n").join(links, "key", "left").join(roots, nodes.key == roots.node, "left").withColumn("root", F.coalesce("root", "key"))
    named = scratch.table(named.select("k1", "k2", "first_id", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links")))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_key = named.join(lowest, "root").select("k1", "k2", "n_links", "component_id")
    out = rows.where("k1 is not null").select("id", "k1", "k2").join(of_key, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = rows.where("k1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.9 * a.size * b.size),
r AS (SELECT a AS node, b AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT node, min(other) AS low FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id, vec_id <= coalesce(c.low, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
