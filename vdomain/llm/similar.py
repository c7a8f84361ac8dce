"""Exact similarity of documents, for the near-duplicates that fingerprints within a few bits leave in.

Texts are compared by the Jaccard similarity of their sets of five-word shingles. 200 min-hashes in 40 bands of 5 leave out a pair at
the threshold of 0.8 with probability 1.3e-7, and one of higher similarity less often. Two bits of each min-hash estimate the
similarity of what a band brings together, and leave out a pair at the threshold with about 3e-7. What is left is compared by
its shingles.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, partitions, pieces, signed, texts_of, union_pairs, whole_groups

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: Bytes of a signature, two bits a min-hash in whole 64-bit words.
SIGNATURE = -(-HASHES // 32) * 8
#: Standard deviations of the estimate at the threshold that a pair may lack.
DEVIATIONS = 5
#: Rows of a band that are compared at once with as many others; larger bands are dealt out in blocks.
BLOCK = 1024
#: Nodes of a group, and their shingles, that are compared in one task with as many others; larger groups are dealt out in blocks, with copies of their texts.
GATHERED, SHINGLES = 16_384, 5_000_000
#: Pairs with one document that a task verifies, about.
VERIFIED = 256
#: Shingles that a task remembers while it verifies pairs.
REMEMBERED = 4_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SALT = np.random.default_rng(23).integers(0, 1 << 64, (2, HASHES), np.uint64)
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_LOW_BITS = np.uint64(0x5555555555555555)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of five consecutive words; of all words where there are fewer."""
    h = hashes.of(words)
    k = min(SHINGLE, len(h))
    if not k:
        return h
    s = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        s = (s ^ h[j : j + len(s)]) * _FACTORS[j]
        s ^= s >> np.uint64(29)
    return np.unique(s)


def least_hashes(s: np.ndarray) -> np.ndarray:
    """The 200 min-hashes of a set of shingles."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 256):
        np.minimum(least, ((s[lo : lo + 256, None] ^ _SALT[0]) * (_SALT[1] | np.uint64(1))).min(axis=0), out=least)
    return least


def majority(s: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(s), 65536):
        ones += np.unpackbits(s[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(s), bitorder="little").tobytes(), "little")


def signatures(least: np.ndarray) -> np.ndarray:
    """Two bits of each min-hash (rows of 200), 32 to a word."""
    two = np.zeros((len(least), SIGNATURE * 4), np.uint64)
    two[:, :HASHES] = (least >> np.uint64(40)) & np.uint64(3)
    return (two.reshape(len(least), -1, 32) << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the min-hashes of two signatures differ in their two bits."""
    d = x ^ y
    return np.bitwise_count((d | (d >> np.uint64(1))) & _LOW_BITS).sum(axis=-1, dtype=np.int64)


def most_differing(similarity: float) -> float:
    p = 0.75 * (1 - similarity)
    return HASHES * (p + DEVIATIONS * (p * (1 - p) / HASHES) ** 0.5)


def sketched(texts: DataFrame) -> DataFrame:
    """(rid, id, text) to rid, id, k1 and k2 (128 bits of the text's words), n shingles, bands (40 hashes), sig, fp (SimHash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in pieces(batches):
            size = b.num_rows
            key, n, least, fp = np.zeros((size, 2), np.uint64), np.zeros(size, np.int32), np.zeros((size, HASHES), np.uint64), np.zeros(size, np.uint64)
            for k, t in enumerate(texts_of(b.column("text"))):
                w = words_of(t)
                key[k] = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(w)), np.uint64)
                s = shingles(w, hashes)
                n[k], least[k], fp[k] = len(s), least_hashes(s), majority(s)
            bands = np.zeros((size, BANDS), np.uint64)
            for r in range(ROWS):
                bands = (bands ^ least[:, r::ROWS]) * _FACTORS[r]
                bands ^= bands >> np.uint64(31)
            sig = signatures(least)
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("id"), pa.array(signed(key[:, 0])), pa.array(signed(key[:, 1])), pa.array(n), pa.array([x.tobytes() for x in bands], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(signed(fp))],
                ["rid", "id", "k1", "k2", "n", "bands", "sig", "fp"])

    kind = texts.select("rid", "id", *(F.lit(0).cast("long").alias(x) for x in ("k1", "k2")), F.lit(0).cast("int").alias("n"), F.lit(b"").alias("bands"), F.lit(b"").alias("sig"), F.lit(0).cast("long").alias("fp"))
    return texts.mapInArrow(run, kind._jdf.schema().toDDL())


def banded(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes (node, n, sig, bands) to (band, members, node, n, sig) for bands that more than one node is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(BANDS, dtype=np.uint64)
        for b in pieces(batches, 4096):
            # the band's number is mixed in, so that equal hashes of two bands stay apart
            h = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.uint64).reshape(b.num_rows, BANDS) * np.uint64(0x9E3779B97F4A7C15) + number
            yield pa.RecordBatch.from_arrays([pa.array(signed(h.ravel())), pa.array(np.repeat(b.column("node").to_numpy(), BANDS))], ["band", "node"])

    bands = nodes.where("n > 0").select("node", "bands").mapInArrow(run, "band long, node long")
    shared = scratch.table(bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"))
    members = bands.join(shared, "band")
    return scratch.table(members.join(nodes.select("node", "n", "sig"), "node"))


def _signature_rows(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(t.num_rows, -1)


def leads(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): for each node the least and the greatest node that shares a block of a band with it and that it may be similar to."""
    n = partitions(members.sparkSession)
    dealt = members.withColumn("i", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK)).cast("int")).select("band", "i", "node", "n", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = most_differing(similarity)
        for t, starts in whole_groups(batches, "band", "i", rows=50_000):
            node, size, sig = t.column("node").to_numpy(), t.column("n").to_numpy(), _signature_rows(t)
            long = np.diff(starts)
            for lead in (np.repeat(starts[:-1], long), np.repeat(starts[1:] - 1, long)):
                ok = (node != node[lead]) & (np.minimum(size, size[lead]) >= similarity * np.maximum(size, size[lead])) & (differing(sig, sig[lead]) <= most)
                yield pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(node[lead][ok])], ["node", "lead"])

    found = dealt.repartition(n, "band", "i").sortWithinPartitions("band", "i", "node").mapInArrow(run, "node long, lead long")
    own = found.groupBy("node").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi"))
    return own.select(F.explode(F.array(F.struct(F.least("node", "lo").alias("a"), F.greatest("node", "lo").alias("b")), F.struct(F.least("node", "hi").alias("a"), F.greatest("node", "hi").alias("b")))).alias("p")).select("p.a", "p.b").distinct()


def suspects(members: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a forest that holds together the nodes of one band that may be similar and that (node, root) hasn't joined yet. Bands of one root give nothing."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    dealt = _dealt(rooted.join(mixed, "band").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")), "band", "node", "root", "n", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = most_differing(similarity)
        for t, starts in whole_groups(batches, "band", "i", "j", rows=20_000):
            node, root, size, left = (t.column(c).to_numpy() for c in ("node", "root", "n", "left"))
            sig, same = _signature_rows(t), t.column("i").to_numpy() == t.column("j").to_numpy()
            forest = np.arange(t.num_rows)
            for lo, hi in zip(starts, starts[1:]):
                x = np.arange(lo, hi)
                p, q = (x, x) if same[lo] else (x[left[lo:hi]], x[~left[lo:hi]])
                own = np.arange(hi - lo)
                for at in range(0, len(p), 256):
                    k = p[at : at + 256]
                    small, large = np.minimum(size[k][:, None], size[q]), np.maximum(size[k][:, None], size[q])
                    a, b = np.nonzero((root[k][:, None] != root[q]) & (small >= similarity * large) & (own[k - lo][:, None] != own[q - lo]))
                    ok = differing(sig[k[a]], sig[q[b]]) <= most
                    union_pairs(own, k[a[ok]] - lo, q[b[ok]] - lo)
                forest[lo:hi] = own + lo
            held = np.flatnonzero(forest != np.arange(t.num_rows))
            if len(held):
                yield pa.RecordBatch.from_arrays([pa.array(node[held]), pa.array(node[forest[held]])], ["a", "b"])

    n = partitions(members.sparkSession)
    return dealt.repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _dealt(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of a key with `blocks`, and a copy for each pair of blocks (i, j) that their own block is in; left: it is the first."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # block p meets block q for p <= q: a row goes to every pair that its block is in
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j")))
    return rows.withColumn("own", own).select(key, F.explode(pair).alias("p"), "own", *columns).select(key, "p.i", "p.j", (F.col("own") == F.col("p.i")).alias("left"), *columns)


def joined(groups: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, places: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): a forest of the pairs within groups (node, group) that are similar by their shingles, and that (node, root) hasn't joined yet.

    A group is dealt out in blocks, and each pair of blocks is compared in one task, with its texts: rows out are fewer than rows in.
    """
    # few columns of those asked for, so that Spark may send them to the texts rather than deal out all texts
    asked = scratch.table(groups.join(places, "node").select("node", "rid"))
    known = groups.join(nodes.select("node", "n", "sig"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = scratch.table(texts.join(asked, "rid").select("node", "text").join(known, "node").select("node", "group", "root", "n", "sig", "text"))
    blocks = own.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / GATHERED, F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    dealt = _dealt(own.join(blocks, "group"), "group", "node", "root", "n", "sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, hashes = most_differing(similarity), WordHashes()
        for t, starts in whole_groups(batches, "group", "i", "j", rows=1):
            node, root, size, left = (t.column(c).to_numpy() for c in ("node", "root", "n", "left"))
            sig, same, text = _signature_rows(t), t.column("i").to_numpy() == t.column("j").to_numpy(), t.column("text").combine_chunks()
            for lo, hi in zip(starts.tolist(), starts[1:].tolist()):
                words = texts_of(text.slice(lo, hi - lo))
                sets: list[np.ndarray | None] = [None] * (hi - lo)
                ids, label = np.unique(root[lo:hi], return_inverse=True)
                parent = np.arange(len(ids))
                x = np.arange(hi - lo)
                p, q = (x, x) if same[lo] else (x[left[lo:hi]], x[~left[lo:hi]])
                found: list[tuple[int, int]] = []

                def of(k: int) -> np.ndarray:
                    if sets[k] is None:  # noqa: B023
                        sets[k] = shingles(words_of(words[k]), hashes)  # noqa: B023
                    return sets[k]  # noqa: B023

                n, s = size[lo:hi], sig[lo:hi]
                for k in p.tolist():
                    few = q[(parent[label[q]] != parent[label[k]]) & (np.minimum(n[q], n[k]) >= similarity * np.maximum(n[q], n[k]))]
                    far = differing(s[few], s[k])
                    few = few[far <= most][np.argsort(far[far <= most], kind="stable")]
                    for at in range(0, len(few), 64):
                        part = few[at : at + 64]
                        part = part[parent[label[part]] != parent[label[k]]]
                        if not len(part):
                            continue
                        mine, others = of(k), [of(z) for z in part.tolist()]
                        sizes = np.array([len(z) for z in others])
                        every = np.concatenate(others)
                        place = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
                        common = np.add.reduceat(mine[place] == every, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
                        for z in part[common >= similarity * (len(mine) + sizes - common) - 1e-9].tolist():
                            if parent[label[z]] != parent[label[k]]:
                                found.append((k, z))
                                union_pairs(parent, label[[k]], label[[z]])
                if found:
                    a, b = node[lo:hi][np.array(found).T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    n = partitions(texts.sparkSession)
    return scratch.table(dealt.repartition(n, "group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(run, "a long, b long"))


def verified(pairs: DataFrame, texts: DataFrame, places: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Those pairs (a, b) of nodes whose shingles have at least that Jaccard similarity. texts: rid, text; places: node, rid of a row with its text."""
    pairs = scratch.table(pairs)
    asked = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(places, "node"))
    own = scratch.table(texts.join(asked, "rid").select("node", "text"))
    # a node with many pairs is dealt out with copies of its text
    salts = F.ceil(F.col("pairs") / VERIFIED).cast("int")
    many = pairs.groupBy("a").agg(F.count("*").alias("pairs"))
    salted = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int")).drop("pairs")
    firsts = own.select(F.col("node").alias("a"), F.col("text").alias("ta")).join(many, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("pairs")
    both = salted.join(own.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(firsts, ["a", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), OrderedDict(), 0

        def of(key: int, text: bytes) -> np.ndarray:
            nonlocal size
            if key not in held:
                held[key] = shingles(words_of(text), hashes)
                size += len(held[key])
                while size > REMEMBERED and len(held) > 2:
                    size -= len(held.popitem(last=False)[1])
            return held[key]

        for b in pieces(batches):
            ok = []
            for p, q, s, t in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), texts_of(b.column("ta")), texts_of(b.column("tb"))):
                x, y = of(p, s), of(q, t)
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(same >= similarity * (len(x) + len(y) - same) - 1e-9)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return scratch.table(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))
