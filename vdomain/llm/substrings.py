"""Substring dedup: words inside a window that also starts earlier in the corpus are removed.

Level-wise doubling. Level one asks which runs of half a window's length stand at more than one place; of the halves
in a window only the one with the least hash is asked for, which the window's words alone decide, so a window can only repeat if that one
does. Windows whose half repeats are extended to their whole length, twice the half's, and asked for in turn; those that repeat are
extended to twice that length where both halves repeat, and so on until no candidates survive. What is removed is settled
at the window's own length; longer levels tell how long the repeats are.

Each level is one exchange. A map task, which is a part of the corpus, numbers its distinct runs and sends each once, with
a mark if it stands at two places there, so a run that a third of all documents hold goes to its reducer once from each part;
the answers go back to the part, whose documents have kept their runs' numbers. Runs are told apart by 128 bits of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, partitions, pieces, texts_of

#: Bases of the two polynomials over words' hashes that make a run's 128 bits.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Runs that a task gathers into one part.
PART_RUNS = 4_000_000
_WORD = np.dtype("<i8")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def doubled(first: np.ndarray, second: np.ndarray, words: int, base: int) -> np.ndarray:
    """Hash of runs made of two, of which the second has `words` words."""
    return first * np.uint64(pow(base, words, 1 << 64)) + second


def run_hashes(words: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of each run of n word hashes, by doubling."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if n == 1:
        return words
    half, m = run_hashes(words, n // 2, base), len(words) - n + 1
    h = doubled(half[:m], half[n // 2 : n // 2 + m], n // 2, base)
    return h if n % 2 == 0 else doubled(h, words[n - 1 : n - 1 + m], 1, base)


def least_halves(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a document the position of its least half, and the hashes of all halves."""
    halves = _mix(run_hashes(words, window // 2))
    if len(words) < window:
        return np.zeros(0, np.int64), halves
    least = np.lib.stride_tricks.sliding_window_view(halves, window - window // 2 + 1)
    return least.argmin(axis=1) + np.arange(len(least)), halves


def content_key(words: list[bytes]) -> tuple[int, int]:
    """128 bits of a text's words, as two signed longs; they also order documents of one id."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), _WORD).tolist())


def kept_sha256(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def packed(*columns: np.ndarray) -> bytes:
    """8-byte columns of one length, one after the other."""
    return b"".join(np.ascontiguousarray(c).astype(c.dtype if c.dtype.itemsize == 8 else np.int64, copy=False).tobytes() for c in columns)


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    n = len(blob) // 8 // columns
    return [np.frombuffer(blob, _WORD, n, 8 * n * k) for k in range(columns)]


# --- one level: runs by part, and what comes back ------------------------------------------------------

#: Rows of a level: documents with their runs (blob: twice the number, and one more at the part's earliest place; place; h1; h2), and each distinct run of the part with that place.
#: Level one, which only filters, has neither hashes in its blobs nor h2 and places in its rows; it alone has c1, as copies of a text are still apart there.
LEVEL = "part long, doc long, c1 long, blob binary, h1 long, h2 long, number long, twice boolean, at long"
_KINDS = {"part": pa.int64(), "doc": pa.int64(), "c1": pa.int64(), "blob": pa.binary(), "h1": pa.int64(), "h2": pa.int64(), "number": pa.int64(), "twice": pa.bool_(), "at": pa.int64()}


class Part:
    """Gathers documents with the runs that are asked for, up to PART_RUNS of them, then gives them out as rows of LEVEL."""

    def __init__(self, filters: bool = False) -> None:
        from pyspark import TaskContext

        self.filters = filters
        self.base, self.nth = TaskContext.get().partitionId() << 24, 0
        self.docs: list[tuple] = []
        self.runs = 0

    def add(self, doc: int, c1: int | None, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(at):
            self.docs.append((doc, c1, at.astype(np.int64), h1.view(np.int64), h2.view(np.int64)))
            self.runs += len(at)
        if self.runs >= PART_RUNS:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        part, self.nth = self.base + self.nth, self.nth + 1
        doc = np.array([d[0] for d in self.docs])
        size = np.array([len(d[2]) for d in self.docs])
        of = np.repeat(np.arange(len(size)), size)
        at, h1, h2 = (np.concatenate([d[k] for d in self.docs]) for k in (2, 3, 4))
        order = np.lexsort((at, doc[of], h2, h1))  # of equal runs the first is the earliest
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        flagged = number * 2
        flagged[first] += 1
        twice = np.bincount(number, minlength=len(first)) > 1
        cuts = np.cumsum(size)
        kept = (flagged, at) if self.filters else (flagged, at, h1, h2)
        blobs = [packed(*(c[b - n : b] for c in kept)) for b, n in zip(cuts, size)]
        yield _batch(part=np.full(len(size), part), doc=doc, blob=blobs)
        c1 = pa.array([d[1] for d in self.docs], pa.int64()).take(pa.array(of[first]))
        for lo in range(0, len(first), 100_000):
            s = slice(lo, lo + 100_000)
            n = len(first[s])
            own = {"part": np.full(n, part), "h1": h1[first[s]], "number": np.arange(lo, lo + n), "twice": twice[s]}
            yield _batch(**own, c1=c1[s]) if self.filters else _batch(**own, doc=doc[of[first[s]]], h2=h2[first[s]], at=at[first[s]])
        self.docs, self.runs = [], 0


def _batch(**columns) -> pa.RecordBatch:
    n = len(columns["part"])
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns and not isinstance(columns[k], pa.Array) else columns.get(k, pa.nulls(n, t)) for k, t in _KINDS.items()], list(_KINDS))


def _answered(level: DataFrame, scratch: Scratch, each: Callable[[int, np.ndarray, list[np.ndarray]], tuple], schema: str, earliest: bool = False, filters: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that `each` makes of a level's documents with repeated runs, from the document, marks and the blob's columns. Marks: 1 for a run that repeats, 2 if its part has its earliest place (asked for with `earliest`).

    Also the table of answers, which they read. It is written first, so that the shuffle files of the runs are gone when documents are dealt out.
    """
    run = Window.partitionBy("h1") if filters else Window.partitionBy("h1", "h2")
    place = F.struct("doc", "at")
    wins = F.min(place).over(run) == place if earliest else F.lit(False)
    elsewhere = F.min("c1").over(run) < F.max("c1").over(run) if filters else F.count("*").over(run) > 1
    asked = level.where("blob is null").select("part", "number", wins.alias("wins"), (F.max("twice").over(run) | elsewhere).alias("repeats"))
    answers = scratch.table(asked.where("repeats").select("part", "number", "wins"))
    back = answers.select("part", "number", "wins", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("binary").alias("blob"))
    docs = level.where("blob is not null").select("part", F.lit(None).cast("long").alias("number"), F.lit(None).cast("boolean").alias("wins"), "doc", "blob")
    names = [f.split()[0] for f in schema.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, answers, marks = None, [], None
        for b in pieces(batches, 50_000):
            out, parts = [], b.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
            for lo, hi in zip(cuts, cuts[1:]):
                if parts[lo] != part:
                    part, answers, marks = parts[lo], [], None
                own = b.slice(lo, hi - lo)
                n = own.column("doc").null_count  # answers come before documents
                if n:
                    answers.append((own.column("number").slice(0, n).to_numpy(zero_copy_only=False).astype(np.int64), own.column("wins").slice(0, n).to_numpy(zero_copy_only=False).astype(np.int8)))
                    marks = None
                if n == own.num_rows:
                    continue
                if marks is None:
                    marks = np.zeros(max((int(a.max()) for a, _ in answers), default=-1) + 2, np.int8)
                    for a, w in answers:
                        marks[a] = 1 + w
                for doc, blob in zip(own.column("doc").slice(n).to_pylist(), own.column("blob").slice(n).to_pylist()):
                    columns = unpacked(blob, 2 if filters else 4)
                    mark = marks[np.minimum(columns[0] >> 1, len(marks) - 1)]
                    if mark.any():
                        out.append(each(doc, mark, columns))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int64()) for c in map(list, zip(*out))], names)

    n = partitions(level.sparkSession)
    return back.unionByName(docs).repartition(n, "part").sortWithinPartitions("part", F.col("doc").isNotNull(), "doc").mapInArrow(made, schema), answers


def _alive(doc: int, mark: np.ndarray, columns: list[np.ndarray]) -> tuple:
    return doc, np.sort(columns[1][mark > 0]).tobytes()


def _settled(doc: int, mark: np.ndarray, columns: list[np.ndarray]) -> tuple:
    """Repeated runs (place, h1, h2), and the places of those that go: all but the earliest of each."""
    flagged, at, h1, h2 = columns
    keep = mark > 0
    return doc, packed(at[keep], h1[keep], h2[keep]), at[keep & ~((mark == 2) & (flagged % 2 == 1))].tobytes()


# --- the operator -------------------------------------------------------------------------------------


def _survey(texts: DataFrame, window: int) -> DataFrame:
    """(rid, id, text) to a row per document with its key, number of words and digest, beside the rows of level one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = WordHashes(), Part(filters=True)
        seen: set[tuple[int, int]] = set()
        for b in pieces(batches):
            rows = []
            for rid, i, t in zip(b.column("rid").to_pylist(), b.column("id").to_pylist(), texts_of(b.column("text"))):
                w = t.split()
                c = content_key(w)
                rows.append((rid, i, *c, len(w), kept_sha256(w)))
                if len(w) < window:
                    continue
                at, halves = least_halves(words.of(w), window)
                at = np.unique(at)
                if c in seen:  # a copy in this part: its own repeats are known, and it has nothing of its own to send
                    continue
                seen.add(c)
                yield from map(_with_rows, part.add(rid, c[0], at, halves[at], halves[at]))
                if not part.docs:
                    seen.clear()
            yield _rows_only(rows)
        yield from map(_with_rows, part.rows())

    return texts.mapInArrow(run, f"{LEVEL}, rid long, id long, c2 long, n_words long, sha string")


_SURVEY = {**_KINDS, "rid": pa.int64(), "id": pa.int64(), "c2": pa.int64(), "n_words": pa.int64(), "sha": pa.string()}


def _with_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(b.num_rows, _SURVEY[k]) for k in _SURVEY if k not in _KINDS)], list(_SURVEY))


def _rows_only(rows: list[tuple]) -> pa.RecordBatch:
    own = dict(zip(("rid", "id", "c1", "c2", "n_words", "sha"), zip(*rows)))
    return pa.RecordBatch.from_arrays([pa.array(own[k], t) if k in own else pa.nulls(len(rows), t) for k, t in _SURVEY.items()], list(_SURVEY))


def _extended(texts: DataFrame, window: int) -> DataFrame:
    """(doc, text, alive: places of halves) to the level of windows whose least half is one of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = WordHashes(), Part()
        for b in pieces(batches):
            for doc, t, alive in zip(b.column("doc").to_pylist(), texts_of(b.column("text")), b.column("alive").to_pylist()):
                w = words.of(t.split())
                at, _ = least_halves(w, window)
                found = np.flatnonzero(np.isin(at, np.frombuffer(alive, _WORD)))
                if len(found):
                    yield from part.add(doc, None, found, run_hashes(w, window)[found], run_hashes(_mix(w), window, BASES[1])[found])
        yield from part.rows()

    return texts.select("doc", "text", "alive").mapInArrow(run, LEVEL)


def _twice_as_long(survivors: DataFrame, words: int) -> DataFrame:
    """(doc, places of repeated runs of so many words with their hashes) to the level of runs of twice the words, both of whose halves repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Part()
        for b in pieces(batches):
            for doc, blob in zip(b.column("doc").to_pylist(), b.column("runs").to_pylist()):
                at, h1, h2 = unpacked(blob, 3)
                order = np.argsort(at)
                at, h1, h2 = at[order], h1[order].view(np.uint64), h2[order].view(np.uint64)
                second = np.minimum(np.searchsorted(at, at + words), len(at) - 1)
                ok = np.flatnonzero(at[second] == at + words)
                second = second[ok]
                yield from part.add(doc, None, at[ok], doubled(h1[ok], h1[second], words, BASES[0]), doubled(h2[ok], h2[second], words, BASES[1]))
        yield from part.rows()

    return survivors.select("doc", "runs").mapInArrow(run, LEVEL)


def cover(n_words: int, places: bytes, window: int) -> np.ndarray:
    """Whether each word lies in a removed window."""
    steps = np.zeros(n_words + 1, np.int64)
    at = np.frombuffer(places, _WORD)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return np.cumsum(steps)[:n_words] > 0


def _longest(settled: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(doc, longest): words of the longest of the runs of window, twice the window, and so on that repeat in a document; levels go on until no candidates survive."""
    found, words, survivors = settled.where("length(runs) > 0").select("doc", F.lit(window).cast("long").alias("longest")), window, settled
    while True:
        level = scratch.table(_twice_as_long(survivors, words))
        words *= 2
        runs, answers = _answered(level, scratch, _settled, "doc long, runs binary, gone binary")
        survivors = scratch.table(runs, level, answers)
        if survivors.isEmpty():
            return found.groupBy("doc").agg(F.max("longest").alias("longest"))
        found = found.union(survivors.select("doc", F.lit(words).cast("long")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, columns: list[str] | None = None, prefix: str = "", longest: bool = False) -> DataFrame:
    """`columns` of `docs` (all) with n_words, n_removed and kept_sha256 (long, long, string) and kept_text: the words that stay, joined by one space.

    The new names may have a prefix; columns of `docs` with the same names give way to them. With `longest` also longest_repeat: words of the longest run of
    window, 2 * window, 4 * window... words in the document that stands at another place too, 0 if there is none.

    A document is its id and its words: of rows with equal id and words each gets the same result, and of rows with equal id and other words the
    one whose content_key() is smaller counts as earlier. Null ids come last. Null and wordless texts have no words; texts shorter than a window lose
    none. kept_text is null where no word goes (the text stays as it is). An empty table gives no rows.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    names = [c for c in (docs.columns if columns is None else columns)]
    extra = {f"{prefix}n_words": pa.int64(), f"{prefix}n_removed": pa.int64(), f"{prefix}kept_sha256": pa.string(), f"{prefix}kept_text": pa.string()}
    if longest:
        extra[f"{prefix}longest_repeat"] = pa.int64()
    names = [n for n in names if n not in extra]
    # inside, columns go by number: no name of theirs can clash
    inside = [*dict.fromkeys([*names, id_col, text])]
    at_id, at_text = f"_c{inside.index(id_col)}", f"_c{inside.index(text)}"
    held = scratch.table(docs.select(*(F.col(f"`{n}`").alias(f"_c{j}") for j, n in enumerate(inside)), F.monotonically_increasing_id().alias("rid")))
    texts = held.select("rid", F.col(at_id).cast("long").alias("id"), F.col(at_text).alias("text"))

    survey = scratch.table(_survey(texts, window))
    rows = scratch.table(survey.where("sha is not null").select("rid", F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("idz"), "c1", "c2", "n_words", "sha"))
    # exact copies: all but the first lose every word, if they hold a window at all
    ids = F.struct("no_id", "idz")
    first = rows.groupBy("c1", "c2").agg(F.min(F.struct("no_id", "idz", "rid")).alias("f"), (F.min(ids) != F.max(ids)).alias("copied")).select("c1", "c2", "f.no_id", "f.idz", F.col("f.rid").alias("first_rid"), "copied")
    halves, answers = _answered(survey.where("sha is null").select(*_KINDS), scratch, _alive, "doc long, alive binary", filters=True)
    asked = halves.withColumnRenamed("doc", "rid").join(rows.select("rid", "c1", "c2"), "rid").join(first, ["c1", "c2"]).groupBy("no_id", "idz", "c1", "c2").agg(F.first("first_rid").alias("rid"), F.first("alive").alias("alive"))
    # documents are numbered in their order: by id, then by their words
    asked = scratch.table(asked.orderBy("no_id", "idz", "c1", "c2").select("rid", "alive", F.monotonically_increasing_id().alias("doc")), survey, answers)
    level = scratch.table(_extended(texts.join(asked, "rid"), window))
    runs, answers = _answered(level, scratch, _settled, "doc long, runs binary, gone binary", earliest=True)
    settled = scratch.table(runs, level, answers)
    found = settled.select("doc", F.col("gone").alias("_gone"))
    if longest:
        found = found.join(scratch.table(_longest(settled, window, scratch)), "doc", "left")
    else:
        found = found.withColumn("longest", F.lit(None).cast("long"))
    found = found.join(asked.select("doc", F.col("rid").alias("first_rid")), "doc").drop("doc")
    state = rows.join(first, ["c1", "c2", "no_id", "idz"], "left").withColumn("copy", F.col("first_rid").isNull()).withColumn("first_rid", F.coalesce("first_rid", -1 - F.col("rid")))
    state = scratch.table(state.join(found, "first_rid", "left").select("rid", F.col("n_words").alias("_n"), F.col("sha").alias("_sha"), F.col("copy").alias("_copy"), F.coalesce("copied", F.lit(True)).alias("_copied"), "_gone", F.col("longest").alias("_longest")))
    scratch.only(held, state)
    none = kept_sha256([])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            cols: list[list] = [[], [], [], [], []]
            for t, n, sha, copy, copied, gone, length in zip(texts_of(b.column(at_text)), *(b.column(c).to_pylist() for c in ("_n", "_sha", "_copy", "_copied", "_gone", "_longest"))):
                if copied and n >= window:
                    length = window << ((n // window).bit_length() - 1)
                if copy and n >= window:
                    out = (n, n, none, "")
                elif gone:
                    w = t.split()
                    w = [x for x, g in zip(w, cover(n, gone, window).tolist()) if not g]
                    out = (n, n - len(w), kept_sha256(w), b" ".join(w).decode())
                else:
                    out = (n, 0, sha, None)
                for c, x in zip(cols, (*out, length or 0)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([*(b.column(f"_c{inside.index(x)}") for x in names), *(pa.array(c, kind) for c, kind in zip(cols, extra.values()))], [*names, *extra])

    kinds = [F.lit(None).cast("string" if "kept_" in k else "long").alias(k) for k in extra]
    schema = docs.select(*(F.col(f"`{n}`") for n in names), *kinds)._jdf.schema().toDDL()
    return held.join(state, "rid").drop("rid").mapInArrow(finish, schema)


def digests(docs: DataFrame, window: int = 20) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text"), window=window, columns=["doc_id"], longest=True).select("doc_id", "n_words", "n_removed", "kept_sha256", "longest_repeat")


def rewritten(docs: DataFrame, window: int = 20) -> DataFrame:
    """`docs` with what repeats taken out of text, and n_chars to match where a column of that name is there."""
    mark = "_repeat_"
    while any(c.startswith(mark) for c in docs.columns):
        mark = "_" + mark
    out = remove_repeats(docs, window=window, prefix=mark)
    kept = F.col(f"{mark}kept_text")
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(kept.isNull(), F.col("n_chars")).otherwise(F.length(kept).cast("long")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).select(*(F.col(f"`{c}`") for c in docs.columns))


#: Levels that the SQL has: up to 20 * 2^13 words.
_LEVELS = [20 << k for k in range(14)]
_LEVEL_SQL = "".join(
    f"""
q{n} AS (SELECT a.doc_id, a.pos, dense_rank() OVER (ORDER BY a.id, b.id) AS id, count(*) OVER (PARTITION BY a.id, b.id) AS c FROM r{n // 2} a JOIN r{n // 2} b ON b.doc_id = a.doc_id AND b.pos = a.pos + {n // 2}),
r{n} AS (SELECT doc_id, pos, id FROM q{n} WHERE c > 1),"""
    for n in _LEVELS[1:]
)
ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM d WHERE len(w) >= 20),
y AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 19], ' ') AS run FROM x),
z AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1 AS gone, dense_rank() OVER (ORDER BY run) AS id, count(*) OVER (PARTITION BY run) AS c FROM y),
r20 AS (SELECT doc_id, pos, id FROM z WHERE c > 1),{_LEVEL_SQL}
u AS (SELECT doc_id, max(n) AS n FROM ({" UNION ALL ".join(f"SELECT doc_id, {n} AS n FROM r{n}" for n in _LEVELS)}) GROUP BY doc_id),
e AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS p FROM z WHERE gone),
v AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT v.doc_id, count(*) AS n_kept, string_agg(v.word, ' ' ORDER BY v.p) AS kept FROM v ANTI JOIN e ON e.doc_id = v.doc_id AND e.p = v.p GROUP BY v.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(u.n, 0) AS BIGINT) AS longest_repeat
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id
"""
