"""Time resampling of gridded reports; works on batch and streaming tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample_time(
    df: DataFrame, col: str, width: str, agg: str, by: tuple[str, ...] = ("y", "x")
) -> DataFrame:
    """Aggregate ``col`` in windows of ``width`` with ``avg`` or ``sum``."""
    reduced = {"avg": F.avg, "sum": F.sum}[agg](col).alias(col)
    return (
        df.groupBy(F.window("time", width).alias("_w"), *by)
        .agg(reduced)
        .select(F.col("_w.start").alias("time"), *by, col)
    )


def hourly_rain(half_hours: DataFrame, col: str = "pr", dt_hours: int = 1) -> DataFrame:
    """Half-hour rates to hourly means, then sums over ``dt_hours``."""
    hourly = resample_time(half_hours, col, "1 hour", "avg")
    return hourly if dt_hours == 1 else resample_time(hourly, col, f"{dt_hours} hours", "sum")


def hour_range(df: DataFrame) -> tuple[int, int] | None:
    """Epoch seconds of the first and last hour with a report; None without any."""
    hour = F.unix_timestamp(F.date_trunc("hour", "time"))
    first, last = df.agg(F.min(hour), F.max(hour)).first()
    return None if first is None else (first, last)


def rain_sums(
    half_hours: DataFrame,
    col: str = "pr",
    dt_hours: int = 1,
    hours: tuple[int, int] | None = None,
    whole: bool = True,
) -> DataFrame:
    """Half-hour rates to hourly means, then sums over ``dt_hours``, counted from the first hour.

    ``hours`` gives the first and last hour of the series in epoch seconds; without it they
    are found in the data (one more read of the time column). A last window which the series
    does not fill has no comparable sum and is left out, unless ``whole`` is false.
    """
    hourly = resample_time(half_hours, col, "1 hour", "avg")
    hours = hours or hour_range(half_hours)
    if dt_hours == 1 or hours is None:
        return hourly
    width = dt_hours * 3600
    window = F.window("time", f"{width} seconds", startTime=f"{hours[0] % width} seconds")
    sums = hourly.groupBy(window.alias("_w"), "y", "x").agg(F.sum(col).alias(col))
    if whole:
        sums = sums.where(F.unix_timestamp("_w.end") <= hours[1] + 3600)
    return sums.select(F.col("_w.start").alias("time"), "y", "x", col)


def median_substep(
    df: DataFrame, col: str, width: str = "1 hour", by: tuple[str, ...] = ("y", "x")
) -> DataFrame:
    """Exact median of the sub-steps of each window, missing values left out."""
    return (
        df.groupBy(F.window("time", width).alias("_w"), *by)
        .agg(F.median(col).alias(col))
        .select(F.col("_w.start").alias("time"), *by, col)
    )
