"""FASTA: a batch reader that splits files at record starts, and a data source for spark.read.format("fasta")."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "seq_id string, sequence string"
BAD = "This FASTA file has text before its first header"


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file, a folder or a pattern of them exists where Spark would look for it."""
    sc = spark.sparkContext
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(p))
    except Exception:  # noqa: BLE001  what isn't a path at all, as Java sees it
        return False


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(seq_id, sequence) of FASTA files: id is the header's first word, lines are trimmed and joined, letters stay as they are.

    Files are split at record starts by Spark's text reader, so one large file is read by many tasks. Records without an id have an empty one;
    blank records are left out. Text before a file's first header can't be told from a record here: the data source below refuses it.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    lines = F.split(F.regexp_replace(F.col("value"), "^>", ""), "\r\n|\r|\n")
    named = F.element_at(F.split(F.trim(F.element_at(lines, 1)), "[ \\t]+"), 1)
    rest = F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), "")
    return raw.where("trim(value) not in ('', '>')").select(named.alias("seq_id"), rest.alias("sequence"))


def records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """The records of one file's lines; text before the first header is an error."""
    name: str | None = None
    parts: list[str] = []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts)
            name, parts = (line[1:].split() or [""])[0], []
        elif line and name is None:
            raise ValueError(BAD)
        else:
            parts.append(line)
    if name is not None:
        yield name, "".join(parts)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        path = self.path.removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path))
        return [_File(f) for f in files if os.path.isfile(f)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        with open(partition.path) as f:
            yield from records(f)


class FastaDataSource(DataSource):
    """spark.dataSource.register(FastaDataSource); spark.read.format("fasta").load(path): strict, a task per file, for file systems that are mounted."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("path", ""))
