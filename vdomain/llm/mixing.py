"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with SQL functions only.

A source's target is its weight's share of all words, capped at `most_epochs` times the source and
shared out again. Complete epochs come first; for the fractional epoch that is left, each document
draws an exponential key, scaled by its quality weight, and the documents with the smallest keys are
taken until the source's budget is full, the last one in part. Keys are dealt into narrow ranges, so
the running sum inside a source never puts a source into one task: ranges are summed first, and rows are
only sorted inside their range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
#: Ranges that a source's keys are dealt into.
RANGES = 4096
WORDS, SPACE = "[^\\x20\\x09-\\x0D]+", "[\\x20\\x09-\\x0D]"


def n_words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORDS)), F.lit(0)).cast("long")


def quality(size: Column, text: str = "text") -> Column:
    """1, 2 or 3: a point each for 20 words or more and for words of 3 to 10 characters on average."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.lit(1) + (size >= 20).cast("int") + F.coalesce(mean.between(3.0, 10.0).cast("int"), F.lit(0))


def uniform(doc_id: str = "doc_id", seed: str = "mix") -> Column:
    """In (0, 1), from a digest of the id, so that reruns and other engines draw the same."""
    n = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")
    return (n.cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): water-filling, in closed form.

    Sources are ordered by how soon the level w * t reaches their cap; the level is that of the first
    source which stays below its cap. One row per source is ordered here, not the documents.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    s = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    rank = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("w").over(after))
    level = F.col("left").cast("double") / F.col("open").cast("double")
    s = s.withColumn("level", F.when(level * F.col("w") <= F.col("cap"), level))
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("level") * F.col("w") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _taken(rows: DataFrame, quality_of: Column, weights: tuple[int, ...], most: int, ranges: int, scratch: Scratch) -> DataFrame:
    """(rid, doc_id, source, text) to rid, doc_id, source, size, source_size, target, taken. Rows that share a draw are in order of id, size, text and rid."""
    rows = scratch.table(
        rows.select("rid", "doc_id", "source", F.xxhash64("text").alias("text_key"), n_words().alias("size"), quality_of.cast("double").alias("q"))
        .withColumn("key", -F.log(uniform()) / F.col("q"))
        .withColumn("range", F.floor(F.exp(-F.col("key")) * -ranges).cast("int"))
        .drop("q")
    )
    by_range = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    by_source = targets(by_range.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    ahead = by_range.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    t = by_source.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("budget", (F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")).cast("long"))
    a, b = ahead.alias("a"), t.alias("t")
    offsets = a.join(b, F.col("a.source").eqNullSafe(F.col("t.source"))).select(F.col("a.source").alias("o_source"), F.col("range").alias("o_range"), "ahead", "source_size", "target", "epochs", "budget")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "text_key", "rid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = rows.withColumn("inside", inside).join(offsets, rows.source.eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    room = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("budget") - F.col("ahead") - F.col("inside")))
    return joined.select("rid", "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + room).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, ranges: int = RANGES, quality_of: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: a row per row of `docs`. quality_of: the weight of a document, greater than 0; quality() unless told otherwise.

    Null text has no words, so none are taken. A null source is a source of its own, after the others.
    Repeated ids share a draw, and are told apart by size and text; rows equal in all that are taken alike or
    in the order in which they come, which makes the same rows. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", "text").withColumn("rid", F.monotonically_increasing_id())
    return _taken(rows, quality(n_words()) if quality_of is None else quality_of, weights, most, ranges, Scratch(docs.sparkSession, "mixing")).drop("rid")


def first_words(text: str, n: str | Column) -> Column:
    """The text up to the end of its nth word, as it stands."""
    c = F.col(text)
    # pieces begin where a word does; white space before the first word is a piece of its own
    parts = F.split(c, f"(?<={SPACE})(?={WORDS[:-1]})")
    own = F.slice(parts, F.lit(1), (n + F.when(c.rlike(f"^{SPACE}"), 1).otherwise(0)).cast("int"))
    return F.regexp_replace(F.array_join(own, ""), f"{SPACE}+$", "")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, ranges: int = RANGES) -> DataFrame:
    """The mix as rows of `docs`: each document once per whole time that it is taken, and once more with its first words if in part.

    A part ends with its last word, and is otherwise as it stands in the text; n_chars follows the text. Rows are told apart by place, so
    those with one id, or none, count each for itself. Other columns may have any name and type. Documents without words aren't taken.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    names = docs.columns
    held = scratch.table(docs.select(*(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(names)), F.monotonically_increasing_id().alias("rid")))
    at = {c: f"_c{k}" for k, c in enumerate(names)}
    rows = held.select("rid", *(F.col(at[c]).alias(c) for c in ("doc_id", "source", "text")))
    taken = _taken(rows, quality(n_words()), weights, most, ranges, scratch).where("taken > 0").select("rid", "size", "taken")
    taken = scratch.table(taken)
    scratch.only(held, taken)
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    parts = F.concat(F.array_repeat(F.col("size"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    j = held.join(taken, "rid").withColumn("n", F.explode(parts))
    part, cut = F.col("n") < F.col("size"), first_words(at["text"], F.col("n"))
    j = j.withColumn(at["text"], F.when(part, cut).otherwise(F.col(at["text"])))
    if "n_chars" in at:
        j = j.withColumn(at["n_chars"], F.when(part, F.length(at["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"])))
    return j.select(*(F.col(at[c]).alias(c) for c in names))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0)
    / CAST(1 + CAST(size >= 20 AS INT) + coalesce(CAST(length(text) / greatest(size, 1) BETWEEN 3.0 AND 10.0 AS INT), 0) AS DOUBLE) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER r1, 0) AS DOUBLE) / CAST(sum(w) OVER r2 AS DOUBLE) AS lv FROM w
  WINDOW r1 AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         r2 AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT (SELECT lv FROM l WHERE lv * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1) AS level),
t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR level * w > cap THEN CAST(cap AS DOUBLE) ELSE level * w END AS target FROM l, v),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
x AS (
  SELECT doc_id, size, source_size, target, epochs, CAST(floor(target) AS BIGINT) - epochs * source_size AS budget,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - ahead)) AS BIGINT) AS taken FROM x
"""
