"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a product of two codes on each half of the fingerprint: the perfect binary Golay code of
length 23 (covering radius 3) on its first 23 bits, and all words (covering radius 0) on its last 9, which makes 2^21 anchors a half.
Two fingerprints that differ in at most `distance` bits differ in at most distance // 2 bits of one of the halves. So each
fingerprint has a home anchor in each half, within the covering radius, and is replicated to every anchor within the covering
radius plus that threshold; of any two linked fingerprints one meets the other at its home anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import Scratch, partitions, pieces, signed, texts_of, union_pairs, whole_groups
from .components import connected_components

BITS, RADIUS, GENERATOR = 23, 3, 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1
#: Bits of a half, and those that the Golay code leaves.
HALF, PLAIN = 32, 9
#: Rows of one anchor that one task compares; a larger anchor is dealt out in blocks of homes times blocks of replicas.
BLOCK = 8192
#: Pairs that are compared at once.
AT_ONCE = 4_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles, repeats included; a bit is 1 if it is set in over half of the hashes."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter([h(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text: str = "text", column: str = "fp", shingle: int = 3) -> DataFrame:
    """`docs` and a long with its text's fingerprint (null text: 0)."""
    schema = f"{docs.select('*', F.lit(0).cast('long').alias(column))._jdf.schema().toDDL()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in texts_of(b.column(text))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(signed(fps))], [*b.schema.names, column])

    return docs.mapInArrow(run, schema)


def coset_patterns(within: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight at most `within`, lightest first: (first index by syndrome, patterns)."""
    patterns = np.array([sum(1 << b for b in bits) for w in range(within + 1) for bits in combinations(range(BITS), w)], np.uint32)
    s = syndrome(patterns)
    order = np.argsort(s, kind="stable")
    return np.searchsorted(s[order], np.arange((1 << 11) + 1)), patterns[order]


def syndrome(values: np.ndarray) -> np.ndarray:
    """Remainder of each value's polynomial on division by the generator."""
    r = values.astype(np.uint32).copy()
    for bit in range(BITS - 1, 10, -1):
        r ^= np.where((r >> np.uint32(bit)) & np.uint32(1), np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    return r


def covering(threshold: int) -> list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """What an anchor may differ in from a fingerprint's half, by number of plain bits: their patterns, and cosets of what that leaves to the code."""
    return [(np.array([sum(1 << b for b in bits) for bits in combinations(range(PLAIN), j)], np.uint64), coset_patterns(RADIUS + threshold - j)) for j in range(min(threshold, PLAIN) + 1)]


def anchors_of(fps: np.ndarray, cover: list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By half and number of plain bits: index of the fingerprint, anchor, and whether that is its home."""
    for half in range(2):
        v = (fps >> np.uint64(HALF * half)) & np.uint64((1 << HALF) - 1)
        coded, plain = (v & np.uint64((1 << BITS) - 1)).astype(np.uint32), v >> np.uint64(BITS)
        s = syndrome(coded)
        for j, (flips, (first, patterns)) in enumerate(cover):
            n = first[s + 1] - first[s]
            which = np.repeat(np.arange(len(v)), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            words = (coded[which] ^ patterns[first[s][which] + nth]).astype(np.uint64)
            for f in flips:
                anchor = words | ((plain[which] ^ f) << np.uint64(BITS)) | np.uint64(half << HALF)
                yield which, anchor.astype(np.int64), (nth == 0) & (j == 0)


def near(fps: np.ndarray, home: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes and others of the groups that begin at `starts`: (fingerprint, smaller linked one or root)."""
    values, at = np.unique(fps, return_inverse=True)
    parent = np.arange(len(values))
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    h = np.flatnonzero(home)
    size = (starts[1:] - starts[:-1])[group[h]]
    upto = np.cumsum(size)
    lo = 0
    while lo < len(h):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, "right")))
        n = size[lo:hi]
        a = np.repeat(h[lo:hi], n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[group[h[lo:hi]]], n)
        ok = np.bitwise_count(fps[a] ^ fps[b]) <= distance
        union_pairs(parent, at[a[ok]], at[b[ok]])
        lo = hi
    linked = np.flatnonzero(parent != np.arange(len(values)))
    return values[linked], values[parent[linked]]


def links(distinct: DataFrame, scratch: Scratch, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp long) to edges (a, b) that join all that differ in at most `distance` bits, as spanning forests."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = covering(distance // 2)
        for b in pieces(batches, 4096):
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            parts = list(anchors_of(fps, cover))
            which, anchor, home = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(signed(fps[which])), pa.array(home)], ["anchor", "fp", "home"])

    rows = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    # only anchors that are too large for one task; Spark sends them to all tasks if they are few, else joins by anchor
    large = scratch.table(rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > block))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    as_home = F.transform(numbers(F.col("blocks")), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("is_home")))
    as_other = F.transform(numbers(F.col("blocks")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("is_home")))
    dealt = (
        rows.join(large, "anchor", "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        # a home row meets every block of replicas, a replica every block of homes
        .select("anchor", "fp", F.explode(F.when(F.col("home"), F.concat(as_home, as_other)).otherwise(as_other)).alias("t"))
        .select("anchor", "fp", "t.i", "t.j", "t.is_home")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, "anchor", "i", "j"):
            a, b = near(t.column("fp").to_numpy().view(np.uint64), t.column("is_home").to_numpy(), starts, distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b))], ["a", "b"])

    return dealt.repartition(partitions(distinct.sparkSession), "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = 3, shingle: int = 3) -> DataFrame:
    """One row per row of `docs`: id, fp long, component_id (smallest id that links reach).

    Null and wordless texts have fingerprint zero and link like any other. Repeated ids are rows of
    their own; a null id takes part in links but never names a component of rows that have ids. Other
    columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", "fp", shingle).select("id", "fp"))
    distinct = scratch.table(rows.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = scratch.table(connected_components(links(distinct, scratch, distance), scratch))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = scratch.table(named.join(lowest, "root").select("fp", "component_id"))
    scratch.only(rows, of_fp)
    return rows.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def similar_groups(rows: DataFrame, texts: DataFrame, similarity: float, distance: int, scratch: Scratch) -> DataFrame:
    """Rows of similar.sketched() to nodes (node, k1, k2, first: struct of no_id, id, rid) with root, one for each group that links join.

    Texts of the same words are one node. Links are fingerprints within `distance` bits and min-hash bands, both held against the texts:
    first what the fingerprints join and each node's least and greatest likely partner; then what a band holds that these links have left apart is
    gathered by groups that likely pairs hold together, and compared group by group.
    """
    distinct = rows.groupBy("k1", "k2").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("first"), *(F.first(c).alias(c) for c in ("n", "bands", "sig", "fp")))
    nodes = scratch.table(distinct.withColumn("node", F.monotonically_increasing_id()))
    texts, places = texts.select("rid", "text"), nodes.select("node", F.col("first.rid").alias("rid"))
    # nodes with one fingerprint are joined through the least of them, fingerprints through those
    fps = scratch.table(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("least")))
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    equal = nodes.where("n > 0").join(fps, "fp").select(*ordered("node", "least"))
    near_ = links(fps, scratch, distance).join(fps.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(*ordered("x", "y"))
    members = similar.banded(nodes, scratch)
    first = similar.verified(equal.union(near_).union(similar.leads(members, similarity)).where("a < b").distinct(), texts, places, similarity, scratch)
    roots = scratch.table(connected_components(first, scratch))
    maybe = scratch.table(connected_components(similar.suspects(members, roots, similarity), scratch))
    found = similar.joined(maybe.select("node", F.col("root").alias("group")), roots, nodes, texts, places, similarity, scratch)
    if not found.isEmpty():
        roots = scratch.table(connected_components(first.union(found), scratch))
    return nodes.select("node", "k1", "k2", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = similar.SIMILARITY, distance: int = 3) -> DataFrame:
    """One row per row of `docs`: id, root long (of its group), component_id (the group's smallest id).

    Null and wordless texts are one group. A null id takes part in links but names no group of rows that have ids. Repeated ids are rows of their
    own, in groups of their own. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash-groups")
    texts = scratch.table(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text).alias("text")))
    rows = scratch.table(similar.sketched(texts))
    nodes = scratch.table(similar_groups(rows, texts, similarity, distance, scratch))
    lowest = nodes.groupBy("root").agg(F.min("first.id").alias("component_id"))
    of_node = scratch.table(nodes.join(lowest, "root").select("k1", "k2", "root", "component_id"))
    scratch.only(rows, of_node)
    return rows.select("id", "k1", "k2").join(of_node, ["k1", "k2"]).select(F.col("id").alias(id_col), "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = similar.SIMILARITY, distance: int = 3) -> DataFrame:
    """`docs` with one row of each group: the one with the smallest id (null ids last; of equal ids, the one that is read first).

    Groups are those of near_duplicate_groups(), so rows that share an id, or have none, stay if their texts differ. Columns of any
    name and type are kept as they are.
    """
    scratch = Scratch(docs.sparkSession, "simhash-drop")
    names = docs.columns
    held = scratch.table(docs.select(*(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(names)), F.monotonically_increasing_id().alias("rid")))
    texts = held.select("rid", F.col(f"_c{names.index(id_col)}").alias("id"), F.col(f"_c{names.index(text)}").alias("text"))
    rows = scratch.table(similar.sketched(texts))
    kept = similar_groups(rows, texts, similarity, distance, scratch).groupBy("root").agg(F.min("first").alias("f")).select("f.rid")
    # the lesser table: what goes
    gone = scratch.table(rows.select("rid").join(scratch.table(kept), "rid", "left_anti"))
    scratch.only(held, gone)
    return held.join(gone, "rid", "left_anti").select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(names)))
