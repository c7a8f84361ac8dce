"""Annotation of streams of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.engine import AnnotateOptions, annotate


def annotate_stream(stream: DataFrame, options: AnnotateOptions = AnnotateOptions(), time: str | None = None, delay: str = "1 hour", **resources) -> DataFrame:
    """As annotate(), row by row, with all columns of the stream. With an event-time column a sequence that comes again within `delay` is left out."""
    if time:
        stream = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sequence"])
    return annotate(stream, options, distinct=False, **resources)
