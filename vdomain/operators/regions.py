"""Which framework and loop regions a span of imgt columns covers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regions of the imgt scheme.
REGIONS = {"fr1": (1, 26), "cdr1": (27, 38), "fr2": (39, 55), "cdr2": (56, 65), "fr3": (66, 104), "cdr3": (105, 117), "fr4": (118, 128)}


def status(region: str, lo: Column, hi: Column) -> Column:
    a, b = REGIONS[region]
    return F.when(lo.isNull() | hi.isNull() | (hi < a) | (lo > b), F.lit("absent")).when((lo <= a) & (hi >= b), F.lit("complete")).otherwise(F.lit("partial"))


def annotate(lo: str | Column, hi: str | Column) -> dict[str, Column]:
    lo, hi = (F.col(x) if isinstance(x, str) else x for x in (lo, hi))
    return {r: status(r, lo, hi) for r in REGIONS}


def as_map(lo: str | Column, hi: str | Column) -> Column:
    return F.create_map(*[x for r, c in annotate(lo, hi).items() for x in (F.lit(r), c)])


def covered(states: str | Column) -> Column:
    """(lo, hi): first and last match state that has a residue; nulls if none has."""
    s = F.col(states) if isinstance(states, str) else states
    ids = F.transform(F.filter(s, lambda x: (x["typ"] == "m") & x["si"].isNotNull()), lambda x: x["id"])
    return F.struct(F.array_min(ids).alias("lo"), F.array_max(ids).alias("hi"))
