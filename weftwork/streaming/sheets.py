"""Streams of sheets: each inserted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket


def inserted_once(sheets: DataFrame, key: str = "sheet", time: str | None = None, late: str = "1 hour") -> DataFrame:
    """A stream (or table) with each sheet of `key` once and its style bucket. With an event time,
    a sheet is remembered for `late` after it was last seen, so that the state is bounded."""
    if time:
        once = sheets.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    else:
        once = sheets.dropDuplicates([key])
    return once.withColumn("bucket", bucket(F.col(key)))
