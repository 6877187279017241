"""Grid geometry: spacing and area per grid point, and joining it to cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import cosine_distance_m, haversine_m
from ..session import stage

# Fixed value: circumference used for regular grids (m).
EARTH_CIRCUMFERENCE_M = 40075000.0

# A grid of up to this many points (at most 64 bytes each) is broadcast.
MAX_BROADCAST_POINTS = 1_000_000


def grid_keys(grid: DataFrame) -> list[str]:
    """Join keys of a grid; a grid with ``run_id`` differs from run to run."""
    return [c for c in ("run_id", "y", "x") if c in grid.columns]


def grid_metrics(grid: DataFrame, method: str = "haversine") -> DataFrame:
    """Distance to the left and upper neighbour and their product as cell area.

    The first column takes dx from the second and the first row takes dy from the
    second. ``method="cosine"`` uses the law of cosines and copies along both axes.
    Windows hold one grid row or column, never more.
    """
    run = [c for c in ("run_id",) if c in grid.columns]
    along_x = Window.partitionBy(*run, "y").orderBy("x")
    along_y = Window.partitionBy(*run, "x").orderBy("y")
    dist = haversine_m if method == "haversine" else cosine_distance_m

    def from_previous(w) -> Column:
        return dist(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))

    df = grid.withColumn("dx_m", from_previous(along_x))
    df = df.withColumn("dx_m", F.coalesce("dx_m", F.lead("dx_m").over(along_x)))
    if method == "cosine":
        dy_edge = F.when(F.lag("x").over(along_x).isNull(), F.lead("dy_m").over(along_x))
        dx_edge = F.when(F.lag("y").over(along_y).isNull(), F.lead("dx_m").over(along_y))
        df = df.withColumn("dy_m", from_previous(along_y))
        df = df.withColumn("dy_m", F.coalesce(dy_edge, "dy_m"))
        df = df.withColumn("dx_m", F.coalesce(dx_edge, "dx_m"))
    else:
        df = df.withColumn("dy_m", from_previous(along_y))
    df = df.withColumn("dy_m", F.coalesce("dy_m", F.lead("dy_m").over(along_y)))
    return df.withColumn("area_m2", F.greatest(F.col("dx_m") * F.col("dy_m"), F.lit(0.0)))


def regular_grid_metrics(grid: DataFrame) -> DataFrame:
    """Spacing of a regular latitude-longitude mesh from its latitude step."""
    keyed = grid.withColumn("_grid", F.col("run_id") if "run_id" in grid.columns else F.lit(0))
    ends = keyed.groupBy("_grid").agg(
        F.min_by("lat", F.struct("y", "x")).alias("_lat0"),
        F.min_by("lat", F.struct(F.col("y") == F.lit(0), "y", "x")).alias("_lat1"),
    )
    df = keyed.join(ends, "_grid").drop("_grid")
    step = F.abs(F.col("_lat1") - F.col("_lat0"))
    df = df.withColumn("dy_m", F.lit(EARTH_CIRCUMFERENCE_M) / (F.lit(360.0) / step))
    df = df.withColumn("dx_m", F.col("dy_m") * F.cos(F.radians("lat")))
    return df.withColumn("area_m2", F.greatest(F.col("dx_m") * F.col("dy_m"), F.lit(0.0))).drop(
        "_lat0", "_lat1"
    )


def mean_spacing(metrics: DataFrame) -> DataFrame:
    """Mean of all dx and dy, one row per grid."""
    run = [c for c in ("run_id",) if c in metrics.columns]
    return metrics.groupBy(*run).agg(((F.avg("dx_m") + F.avg("dy_m")) / 2).alias("spacing_m"))


@dataclass(frozen=True)
class Grid:
    """A measured grid: its table, size, spacing and whether it closes on itself.

    If the grid differs from run to run, ``runs`` holds ``run_id, ny, nx, closes, spacing_m``
    of each, and the numbers are the largest size and the mean spacing of all.
    """

    df: DataFrame
    keys: list[str]
    points: int
    spacing_m: float
    ny: int
    nx: int
    closes: bool
    runs: DataFrame | None = None

    @property
    def wrap_nx(self) -> int | DataFrame | None:
        """Columns of a grid which closes on itself; a table ``run_id, wrap_nx`` if runs differ."""
        if not self.closes:
            return None
        return self.nx if self.runs is None else self.runs.where("closes").select("run_id", F.col("nx").alias("wrap_nx"))

    def attach(self, cells: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
        """Add grid columns to cells; broadcast only below ``MAX_BROADCAST_POINTS``."""
        side = self.df.select(*self.keys, *cols)
        if self.points <= MAX_BROADCAST_POINTS:
            side = F.broadcast(side)
        return cells.join(side, self.keys, how)

    def attach_spacing(self, df: DataFrame) -> DataFrame:
        if self.runs is not None:
            return df.join(self.runs.select("run_id", "spacing_m"), "run_id")
        return df.withColumn("spacing_m", F.lit(self.spacing_m))


def measure_grid(grid: DataFrame, regular: bool = False) -> Grid:
    """Compute metrics once, store them, and read off size, spacing and seam, run by run."""
    metrics = stage(regular_grid_metrics(grid) if regular else grid_metrics(grid), "grid")
    first = F.struct("y", "x")
    last = F.struct(-F.col("y"), "x")
    per_run = "run_id" in metrics.columns
    measured = metrics.groupBy(*(["run_id"] if per_run else [])).agg(
        F.count(F.lit(1)).alias("points"),
        ((F.avg("dx_m") + F.avg("dy_m")) / 2).alias("spacing_m"),
        (F.max("y") + 1).cast("int").alias("ny"),
        (F.max("x") + 1).cast("int").alias("nx"),
        ((F.min_by("lon", first) < -176) & (F.max_by("lon", last) > 176)).alias("closes"),
    )
    runs = stage(measured, "grid-runs") if per_run else None
    row = (measured if runs is None else runs).agg(
        F.sum("points").alias("points"),
        (F.sum(F.col("spacing_m") * F.col("points")) / F.sum("points")).alias("spacing"),
        F.max("ny").alias("ny"),
        F.max("nx").alias("nx"),
        F.max("closes").alias("closes"),
    ).first()
    return Grid(metrics, grid_keys(metrics), row["points"], row["spacing"], row["ny"], row["nx"], row["closes"], runs)
