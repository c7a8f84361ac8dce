"""What the training-data operators share: shared storage, batch sizes, words and group streams."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the bytes 0x20 and 0x09-0x0D, which is also what bytes.split() takes.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Seconds that writing a table may take for its shuffle files to be left to the next collection of garbage.
PROMPT = 2.0

_dirs: dict[str, str] = {}
_open: list["Scratch"] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset and all run on one machine, as in tests, a local one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _dirs.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="vdomain-"))
    return base.rstrip("/")


def trim(spark: SparkSession) -> None:
    """Gives back to the system what the C heaps of the driver's JVM and of its Python hold free, which adds up to some 200 MB over many plans. Results and
    options are as before. Only glibc does it, and the JVM from 17.0.9 on; elsewhere nothing happens."""
    with suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)
    sc = spark.sparkContext
    jvm = sc._jvm
    with suppress(Py4JError, PySparkException):
        # by reflection: the server's own class isn't public
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = sc._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


class Scratch:
    """Tables of one operator call, written to the shared folder.

    Writing a table cuts the lineage: a lost executor costs one stage, not the job, and the rows are
    stable across retries. Tables that later ones replace are dropped at once. The others serve the
    operator's lazy result, and go with drop(), or at the next stage() of a pipeline, once that is written, else when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        fs, path = self._at(self.base)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _open.append(self)

    def _at(self, path: str) -> tuple:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def table(self, df: DataFrame, *replaces: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        start = time.monotonic()
        df.write.option("compression", "zstd").parquet(path)
        if time.monotonic() - start > PROMPT:
            self._collect_garbage()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        for old in replaces:
            if hasattr(old, "_scratch_path"):
                fs, p = self._at(old._scratch_path)
                fs.delete(p, True)
        return out

    def _collect_garbage(self) -> None:
        """Spark deletes shuffle files of what is written by now once the driver's JVM has collected the plans; the last plan is let go when its events are through."""
        for pause in (0.3, 0.0):
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(pause)
        trim(self.spark)

    def only(self, *needed: DataFrame) -> None:
        """Drops all tables but these, which are what a lazy result reads."""
        keep = {df._scratch_path for df in needed}
        for n in range(1, self.n + 1):
            if f"{self.base}/{n}" not in keep:
                fs, p = self._at(f"{self.base}/{n}")
                fs.delete(p, True)

    def drop(self) -> None:
        fs, p = self._at(self.base)
        fs.delete(p, True)
        if self in _open:
            _open.remove(self)


_stages: list[Scratch] = []


@contextmanager
def stage(docs: DataFrame) -> Iterator[None]:
    """Around a pipeline's stage, whose predecessors' results are written by now: first drops the scratch tables and the memory that they have left, but for tables that `docs` reads."""
    read = docs.inputFiles() if _stages else []
    for s in [s for s in _stages if not any(f"/{s.base.rsplit('/', 1)[1]}/" in f for f in read)]:
        s.drop()
        _stages.remove(s)
    trim(docs.sparkSession)
    before = list(_open)
    yield
    _stages.extend(s for s in _open if s not in before)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, without a copy: Spark bounds a batch in bytes (64 MB by default), this bounds what a task derives from it at once."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of each word, remembered up to `most` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with the same key, from batches sorted by it; one group is in memory at a time."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(new), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            k = tuple(c[lo] for c in cols)
            if k != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = k
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str, rows: int = 200_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about `rows` rows that hold whole groups, and where each group starts (with the end), from batches sorted by the keys."""
    held: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        new[1:] = False
        for k in keys:
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= rows:
            held = held.combine_chunks()
            at = starts(held)
            if at[-1]:
                yield held.slice(0, at[-1]), at
                held = held.slice(at[-1])
    if held is not None:
        held = held.combine_chunks()
        yield held, np.append(starts(held), held.num_rows)


def union_pairs(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] in `parent`, in which each node points to a root that points to itself."""
    while len(a):
        a, b = parent[a], parent[b]
        differ = a != b
        a, b = a[differ], b[differ]
        if not len(a):
            return
        hi, lo = np.maximum(a, b), np.minimum(a, b)
        np.minimum.at(parent, hi, lo)
        while True:  # every node to its root again
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def digest(df: DataFrame, *columns: str) -> tuple:
    """A count and an order-free checksum of rows, to see whether an iteration has changed anything."""
    return tuple(df.agg(F.count("*"), F.coalesce(F.expr(f"bit_xor(xxhash64({', '.join(columns)}))"), F.lit(0))).first())
