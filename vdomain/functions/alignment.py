"""Local alignment as Arrow functions of two string columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..kernel.sw import align


def _aligned(query: pa.Array, target: pa.Array, identity: bool) -> list:
    """What align() gives for each row, null where either is null."""
    q, t = query.to_pylist(), target.to_pylist()
    good = [k for k, (a, b) in enumerate(zip(q, t)) if a is not None and b is not None]
    found = align([q[k] for k in good], [t[k] for k in good], identity)[int(identity)]
    out: list = [None] * len(q)
    for k, x in zip(good, found.tolist()):
        out[k] = x
    return out


@F.arrow_udf(LongType())
def sw_score(query: pa.Array, target: pa.Array) -> pa.Array:
    """Score of the best local alignment; null if either is null."""
    return pa.array(_aligned(query, target, False), pa.int64())


@F.arrow_udf(DoubleType())
def sw_identity(query: pa.Array, target: pa.Array) -> pa.Array:
    """Matches over columns of the best local alignment; null if either is null."""
    return pa.array(_aligned(query, target, True), pa.float64())
