"""Numbering steps that SQL functions express: the symmetric loop, and gaps where numbers are skipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _code(n: Column) -> Column:
    """Insertion code of the nth insertion, from 0."""
    letter = F.char(F.lit(65) + n % 26)
    return F.when(n < 26, letter).otherwise(F.concat(letter, letter))


def symmetric_loop(letters: str | Column, first: int, last: int) -> Column:
    """Numbers of a loop filled from both ends, as an array of (num, ins, aa): a closed form of the imgt rule."""
    s = F.col(letters) if isinstance(letters, str) else letters
    n, size = F.length(s), last - first + 1
    held = F.least(n, F.lit(size))
    right = F.floor(held / 2).cast("int")
    left = (held - right).cast("int")
    extra = F.greatest(n - size, F.lit(0))
    ins_l, ins_r = F.floor(extra / 2).cast("int"), (extra - F.floor(extra / 2)).cast("int")
    gaps = F.lit(size) - held
    total = n + gaps

    def slot(k: Column) -> Column:  # k from 0
        a, b = left, left + ins_l
        c = b + gaps
        d = c + ins_r
        num = F.when(k < a, first + k).when(k < b, first + left - 1).when(k < c, first + left + (k - b)).when(k < d, last - right + 1).otherwise(last - right + 1 + (k - d))
        ins = F.when((k >= a) & (k < b), _code(k - a)).when((k >= c) & (k < d), _code(d - 1 - k)).otherwise(" ")
        aa = F.when((k >= b) & (k < c), "-").otherwise(F.substring(s, F.when(k < b, k).otherwise(k - gaps) + 1, F.lit(1)))
        return F.struct(num.cast("int").alias("num"), ins.alias("ins"), aa.alias("aa"))

    return F.transform(F.sequence(F.lit(0), total - 1), slot)


def fill_gaps(residues: str | Column) -> Column:
    """An array of (num, ins, aa) with a gap at each number that is skipped, the first ones included."""
    r = F.col(residues) if isinstance(residues, str) else residues
    gap = lambda p: F.struct(p.cast("int").alias("num"), F.lit(" ").alias("ins"), F.lit("-").alias("aa"))

    def with_gaps(x: Column, k: Column) -> Column:
        before = F.when(k == 0, F.lit(0)).otherwise(F.get(r, k - 1)["num"])
        skipped = F.when(x["num"] > before + 1, F.transform(F.sequence(before + 1, x["num"] - 1), gap)).otherwise(F.array().cast("array<struct<num:int,ins:string,aa:string>>"))
        return F.concat(skipped, F.array(F.struct(x["num"].cast("int").alias("num"), x["ins"].alias("ins"), x["aa"].alias("aa"))))

    return F.flatten(F.transform(r, with_gaps))
