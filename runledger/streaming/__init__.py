"""Streams of records: running loop totals with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, stamp: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by kind in tumbling windows; rows later than the watermark are left out, and state behind it goes."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
