"""Interpolation between grids with a table of weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_weights(src_grid: DataFrame, points: DataFrame) -> DataFrame:
    """Barycentric weights of three corners on a regular source mesh.

    ``points`` has ``target_id, lat, lon``. Each mesh square is split along one fixed
    diagonal. Points outside the mesh get no row. The mesh is described by one row of
    its corner and steps; source cells are named ``y * nx + x``.
    """
    mesh = src_grid.agg(
        F.min("lat").alias("lat0"),
        F.min("lon").alias("lon0"),
        F.max("lat").alias("lat1"),
        F.max("lon").alias("lon1"),
        F.max("y").alias("ly"),
        F.max("x").alias("lx"),
        F.min_by("lat", "y").alias("first_lat"),
    ).first()
    ly, lx = mesh["ly"], mesh["lx"]
    dlat = (mesh["lat1"] - mesh["lat0"]) / ly
    dlon = (mesh["lon1"] - mesh["lon0"]) / lx
    south_first = mesh["first_lat"] == mesh["lat0"]
    north = (F.col("lat") - mesh["lat0"]) / dlat
    fy = north if south_first else F.lit(ly) - north
    fx = (F.col("lon") - mesh["lon0"]) / dlon
    df = points.withColumns({"_fy": fy, "_fx": fx}).where(
        (F.col("_fy") >= 0) & (F.col("_fy") <= ly) & (F.col("_fx") >= 0) & (F.col("_fx") <= lx)
    )
    df = df.withColumns(
        {
            "_iy": F.least(F.floor("_fy"), F.lit(ly - 1)).cast("long"),
            "_ix": F.least(F.floor("_fx"), F.lit(lx - 1)).cast("long"),
        }
    ).withColumns({"_ry": F.col("_fy") - F.col("_iy"), "_rx": F.col("_fx") - F.col("_ix")})
    ry, rx = F.col("_ry"), F.col("_rx")
    lower = rx + ry <= 1

    def corner(dy, dx, weight):
        cell = (F.col("_iy") + dy) * (lx + 1) + F.col("_ix") + dx
        return F.struct(cell.alias("source_id"), weight.alias("weight"))

    corners = F.array(
        F.when(lower, corner(0, 0, 1 - rx - ry)).otherwise(corner(1, 1, rx + ry - 1)),
        F.when(lower, corner(0, 1, rx)).otherwise(corner(0, 1, 1 - ry)),
        F.when(lower, corner(1, 0, ry)).otherwise(corner(1, 0, 1 - rx)),
    )
    return df.select("target_id", F.explode(corners).alias("c")).select("target_id", "c.*")


def regrid(values: DataFrame, weights: DataFrame, col: str = "value") -> DataFrame:
    """Weighted sum of source values per target and step; a missing corner gives NULL."""
    return (
        values.join(weights, "source_id")
        .groupBy("run_id", "t", "target_id")
        .agg(F.sum(F.col(col) * F.col("weight")).alias("_sum"), F.count(col).alias("_n"))
        .select("run_id", "t", "target_id", F.when(F.col("_n") == 3, F.col("_sum")).alias(col))
    )
