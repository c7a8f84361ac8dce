"""Operators on sequences: validation, length gate, running an operator once per distinct sequence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
LONGEST = 10_000


def validation_error(sequence: str | Column) -> Column:
    """Null for a sequence of residues that isn't too long, else what is wrong with it. A null sequence has no error."""
    s = F.col(sequence) if isinstance(sequence, str) else sequence
    odd = F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.upper(s), f"[{RESIDUES}]", ""), ""), lambda c: c != "")))
    return F.when(F.length(s) >= LONGEST, F.lit("Sequence too long.")).when(F.size(odd) > 0, F.concat(F.lit("Unknown amino acid letter found in sequence: "), F.array_join(odd, ", ")))


def long_enough(sequence: str, least: int = 70) -> Column:
    return F.length(sequence) >= least


def once_per_sequence(df: DataFrame, operator: Callable[[DataFrame], DataFrame], sequence: str = "sequence") -> DataFrame:
    """Applies `operator` to the distinct sequences (one column) and joins what it adds back to every row; null sequences get nulls."""
    done = operator(df.where(F.col(sequence).isNotNull()).select(sequence).distinct())
    return df.join(done, sequence, "left")


def is_contiguous(residues: str, sequence: str) -> Column:
    """Whether numbers don't fall and the residues, gaps left out, stand in the sequence one after the other. No residues pass."""
    r = F.col(residues)
    pairs = F.arrays_zip(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))).alias("a"), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))).alias("b"))
    rising = F.forall(pairs, lambda p: p["a"]["num"] <= p["b"]["num"])
    letters = F.array_join(F.transform(F.filter(r, lambda x: x["aa"] != "-"), lambda x: x["aa"]), "")
    return rising & (F.instr(F.regexp_replace(F.col(sequence), "-", ""), letters) > 0) | (F.size(r) == 0)
