"""Hourly rain from an unbounded source of half-hour granules.

The method itself works on complete files. Resampling uses time windows, so the same
operator runs on a stream once late data is bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.resample import resample_time


def hourly_mean_stream(granules: DataFrame, col: str, late: str = "2 hours") -> DataFrame:
    """Hourly means of a stream ``time, y, x, <col>``; hours older than ``late`` are closed."""
    return resample_time(granules.withWatermark("time", late), col, "1 hour", "avg")


def write_hours(hours: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed hours to a parquet table, exactly once; stops when the input is used up."""
    return (
        hours.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
