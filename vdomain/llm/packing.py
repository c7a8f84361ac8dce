"""Packing token sequences: cutting stock by column generation.

A document's ids are cut into full sequences and a rest. Rests are counted by length class; a linear
program chooses how often each pattern of classes that fits a sequence is used. Its columns come from a
knapsack dynamic program over the dual prices. Uses are rounded down, what is left over goes into patterns filled
largest class first, and the nth document of a class takes the class's nth place in the patterns. Only the
histogram of at most `length / width` classes reaches the driver, whatever the corpus.
"""

from __future__ import annotations

import base64
import warnings
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pieces, texts_of

LENGTH, WIDTH, END = 2048, 16, 1
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as the tokenizer gives them, as little-endian unsigned 32-bit bytes.

    The tokenizer itself takes 15 microseconds for each new word, which the same vocabulary's ranks do in 3. So where a single space between two
    characters that aren't white space begins a new token, and ranks merge as the tokenizer does, a text is cut there, and each piece is
    merged once and remembered. Both are tried out against the tokenizer, on PROBES at the start and on the first TRIED texts; if they don't hold,
    and for texts with other spacing or a special token's string, the tokenizer encodes the whole text.
    """

    MOST, TRIED = 400_000, 16
    PROBES = ("a b", "The quick brown fox, it's 12 o'clock (or 3.50 $)!", "don't I'll we'VE x' y", "é ñ ß 漢字 かな 🙂 🙂🙂 zł", "a1 2b 33c d_e f-g #h @i", "http://x.y/z?a=b c:d \\n", "A B C . , ; : ! ? ' \" 's 're", "word's 's word ' s", "ÅÄÖ ijk LMN 0 00 000 0000", "x\ny z\tw", "e\u0301 \u00a0 \u200d \ufeffq")

    def __init__(self, tokenizer: str | None = None, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer or tokenizer_path(TOKENIZER))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.spaced = regex.compile(r"(?:^|\s) | (?:\s|$)")
        self.known: dict[str, bytes] = {}
        self.merge = self._merge(ranks or (None if tokenizer else tokenizer_path(RANKS)))
        self.tried = 0
        self.fast = self.merge is not None and all(self._fast(p) == self._whole(p) for p in self.PROBES if not self._odd(p))

    @staticmethod
    def _merge(path: str | None) -> Callable[[str], list[int]] | None:
        if path is None:
            return None
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=of, special_tokens={}).encode_ordinary

    def _odd(self, text: str) -> bool:
        return bool(self.spaced.search(text)) or any(s in text for s in self.special)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _fast(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if len(self.known) > self.MOST:
            self.known.clear()
        # the first piece has no space before it
        for w in set(rest).difference(self.known):
            self.known[w] = np.array(self.merge(" " + w), "<u4").tobytes()
        return b"".join(chain((np.array(self.merge(first), "<u4").tobytes(),), map(self.known.__getitem__, rest)))

    def __call__(self, text: str) -> bytes:
        if not self.fast or self._odd(text):
            return self._whole(text)
        ids = self._fast(text)
        if self.tried < self.TRIED:
            self.tried += 1
            if ids != self._whole(text):
                self.fast = False
                return self._whole(text)
        return ids


def cut(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, tokenizer: str | None = None) -> DataFrame:
    """Pieces of each document: doc_id, start, length, ids_crc32, doc_tokens, class (of its length), part and nth (place in its class within the task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(tokenizer)
        part = TaskContext.get().partitionId()
        count = np.zeros(length // width + 2, np.int64)
        end = np.array([END], "<u4").tobytes()
        for b in pieces(batches):
            out: list[tuple] = []
            for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text"))):
                ids = encode(t.decode()) + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    own = ids[4 * start : 4 * (start + length)]
                    k = -(-len(own) // 4 // width)
                    out.append((i, start, len(own) // 4, zlib.crc32(own), n, k, part, int(count[k])))
                    count[k] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "nth"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, nth long")


# --- cutting stock on the driver: sizes 1..capacity, numbers of pieces --------------------------------


def best_pattern(price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes (index + 1) with the highest total price that fits, by dynamic programming over capacities."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(price > 1e-12)
    for c in range(1, capacity + 1):
        fit = useful[useful < c]
        value[c], last[c] = value[c - 1], -1
        if len(fit):
            v = value[c - 1 - fit] + price[fit]
            k = int(v.argmax())
            if v[k] > value[c] + 1e-12:
                value[c], last[c] = v[k], fit[k]
    pattern, c = np.zeros(len(price), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= last[c] + 1
    return float(value[capacity]), pattern


def columns(counts: np.ndarray, capacity: int, most_rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: patterns (rows) and how often each is used, possibly a fraction, for the linear program's optimum.

    The basis starts with one pattern per size that occurs; each round prices sizes by the basis, asks for the
    best pattern, and lets it replace the one that reaches zero first.
    """
    sizes = np.flatnonzero(counts)
    m = len(sizes)
    basis = np.diag((capacity // (sizes + 1)).astype(float))  # column j: pattern j
    need = counts[sizes].astype(float)
    for _ in range(most_rounds):
        dual = np.linalg.solve(basis.T, np.ones(m))
        price = np.zeros(capacity)
        price[sizes] = dual
        worth, pattern = best_pattern(price, capacity)
        if worth <= 1 + 1e-7:
            break
        use, change = np.linalg.solve(basis, need), np.linalg.solve(basis, pattern[sizes].astype(float))
        use = np.maximum(use, 0)
        ratio = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern[sizes]
    else:
        warnings.warn(f"the linear program hasn't settled in {most_rounds} rounds: the packing is whole, but may take more sequences", stacklevel=2)
    use = np.maximum(np.linalg.solve(basis, need), 0)
    patterns = np.zeros((m, capacity), np.int64)
    patterns[:, sizes] = np.rint(basis.T).astype(np.int64)
    return patterns, use


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole uses of patterns which hold exactly `counts` pieces of each size 1..capacity."""
    left = counts.astype(np.int64).copy()
    used: dict[bytes, int] = {}
    if left.any():
        patterns, use = columns(left, capacity)
        for p, u in zip(patterns, np.floor(use + 1e-6).astype(np.int64)):
            u = min(int(u), int((left[p > 0] // p[p > 0]).min()))
            if u > 0:
                used[p.tobytes()] = used.get(p.tobytes(), 0) + u
                left -= u * p
    while left.any():  # a few pieces per pattern are left, whatever the counts were
        p, room = np.zeros(capacity, np.int64), capacity
        while room and (fit := np.flatnonzero(left[:room] > p[:room])).size:
            k = int(fit[-1])
            n = min(int(left[k] - p[k]), room // (k + 1))
            p[k] += n
            room -= n * (k + 1)
        u = int((left[p > 0] // p[p > 0]).min())
        used[p.tobytes()] = used.get(p.tobytes(), 0) + u
        left -= u * p
    keys = sorted(used)
    return np.array([np.frombuffer(k, np.int64) for k in keys]).reshape(-1, capacity), np.array([used[k] for k in keys], np.int64)


def places(patterns: np.ndarray, uses: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(class, first, after, first sequence, pieces of the class in one sequence) for each class of each pattern.

    Pieces `first` to `after` of the class, by rank, go to the pattern's sequences in turn. At most classes
    times patterns rows, and patterns are at most twice the classes or so.
    """
    out, next_rank, base = [], np.zeros(patterns.shape[1], np.int64), 0
    for p, u in zip(patterns, uses.tolist()):
        for k in np.flatnonzero(p).tolist():
            n = int(p[k]) * u
            out.append((k + 1, int(next_rank[k]), int(next_rank[k]) + n, base, int(p[k])))
            next_rank[k] += n
        base += u
    return out


def pack(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Each row of `docs` is a document, repeated and null ids too. Null or empty text is the end id alone. An empty table gives no
    rows. A sequence's pieces lie one after the other, the larger class first.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cuts = scratch.table(cut(docs, length, width, tokenizer))
    by_part = scratch.table(cuts.groupBy("class", "part").agg(F.count("*").alias("n")))
    counts = np.zeros(length // width, np.int64)
    for r in by_part.groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most length / width rows
        counts[r["class"] - 1] = r.n
    patterns, uses = plan(counts, length // width)
    rows = places(patterns, uses) or [(0, 0, 0, 0, 1)]
    table = spark.createDataFrame(rows, "p_class int, first long, after long, base long, each long")
    ahead = by_part.select("class", "part", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ranked = cuts.join(ahead, ["class", "part"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    # ranges of one class, sorted: each piece finds its own by the last range that begins at or before its rank
    ranges = table.groupBy("p_class").agg(F.array_sort(F.collect_list(F.struct("first", "base", "each"))).alias("ranges"))
    found = ranked.join(F.broadcast(ranges), F.col("class") == F.col("p_class"))
    lo = F.element_at(F.filter("ranges", lambda x: x["first"] <= F.col("rank")), -1)
    placed = found.withColumn("r", lo).withColumn("sequence_id", F.col("r.base") + F.floor((F.col("rank") - F.col("r.first")) / F.col("r.each")).cast("long"))
    w = Window.partitionBy("sequence_id").orderBy(F.col("class").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"))
