"""Tables behind the usual plots, and views with older column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def storm_accumulation(cells: DataFrame, storm_id: str = "storm_id") -> DataFrame:
    """Rain that fell from storms at each grid point."""
    inside = cells.where(F.col(storm_id).isNotNull())
    return inside.groupBy("run_id", "y", "x").agg(F.sum("pr").alias("storm_pr"))


def storm_summary(steps: DataFrame) -> DataFrame:
    """Largest size, total volume, peak and life of each object."""
    return steps.groupBy("run_id", "object_id").agg(
        F.max("size_m2").alias("max_size_m2"),
        F.sum("tot").alias("volume"),
        F.max("max").alias("peak"),
        F.min("t").alias("t_min"),
        F.max("t").alias("t_max"),
    )


def storm_series(steps: DataFrame) -> DataFrame:
    """Size (km2), speed and peak of each object over time."""
    return steps.select(
        "run_id", "object_id", "t", (F.col("size_m2") / 1e6).alias("size_km2"), "speed_km",
        F.col("max").alias("peak"), "lat", "lon",
    )


def nested_view(steps: DataFrame) -> DataFrame:
    """One row per object with its steps as an array in time order."""
    cols = [c for c in steps.columns if c not in ("run_id", "object_id", "kind")]
    step = F.struct("t", *[c for c in cols if c != "t"])
    return steps.groupBy("run_id", "object_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))


def legacy_view(steps: DataFrame) -> DataFrame:
    """Step statistics under their older names; the track is longitude first."""
    return steps.select(
        "run_id",
        "object_id",
        F.struct("cy", "cx").alias("rgrMassCent"),
        F.col("speed_km").alias("rgrObjSpeed"),
        F.col("tot").alias("rgrPR_Vol"),
        F.col("min").alias("rgrPR_Min"),
        F.col("max").alias("rgrPR_Max"),
        F.col("mean").alias("rgrPR_Mean"),
        F.col("size_m2").alias("rgrSize"),
        F.col("t").alias("TimeAct"),
        F.struct(F.col("lon").alias("track_lon"), F.col("lat").alias("track_lat")).alias("rgrMassCentLatLon"),
    )
