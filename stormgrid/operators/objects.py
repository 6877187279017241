"""Measuring, filtering and numbering labelled objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import key_step
from .components import Labels, numbered_pieces, restore_nulls, spread_nulls
from .grid import Grid
from .joins import join_pieces


def _cell_aggs(value: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_cells"),
        F.sum("area_m2").alias("size_m2"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum(value).alias("tot"),
        F.count(value).alias("_n_values"),
        F.sum("y").alias("_sum_y"),
        F.sum("x").alias("_sum_x"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
    ]


def _merge_aggs() -> list[Column]:
    add = ["n_cells", "size_m2", "tot", "_n_values", "_sum_y", "_sum_x"]
    low, high = ["min", "y_min", "x_min"], ["max", "y_max", "x_max"]
    return (
        [F.sum(c).alias(c) for c in add]
        + [F.min(c).alias(c) for c in low]
        + [F.max(c).alias(c) for c in high]
    )


def _finish_steps(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        (F.col("tot") / F.col("_n_values")).alias("mean"),
        (F.col("_sum_y") / F.col("n_cells")).alias("cy"),
        (F.col("_sum_x") / F.col("n_cells")).alias("cx"),
    )


def step_table(cells: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row per group and step with area, value statistics, extent and centroid."""
    return _finish_steps(cells.groupBy(*by, "t").agg(*_cell_aggs(value)))


def labelled_steps(labels: Labels, values: dict[str, str]) -> DataFrame:
    """Object steps of several kinds: ``kind, run_id, object_key, t, ...``.

    Cells are reduced to tile pieces before any join; only those small rows meet the
    piece-to-object links and are reduced again.
    """
    merged = []
    for kind, value in values.items():
        part = f"{kind}_part"
        pieces = (
            labels.cells.where(F.col(part).isNotNull())
            .groupBy("run_id", F.col(part).alias("part"), "t")
            .agg(*_cell_aggs(value))
        )
        whole = labels.objects_of(pieces, kind).groupBy("run_id", "object_key", "t").agg(*_merge_aggs())
        merged.append(_finish_steps(whole).select(F.lit(kind).alias("kind"), "*"))
    return reduce(DataFrame.unionByName, merged)


def object_area(labels: DataFrame, key: str = "object_key") -> DataFrame:
    """Area of each object in each step it exists."""
    return labels.groupBy("run_id", key, "t").agg(F.sum("area_m2").alias("area_m2"))


def object_bounds(steps: DataFrame, key: str = "object_key") -> DataFrame:
    """Bounding box, lifetime and cell count per object, from its step rows."""
    return steps.groupBy("run_id", key).agg(
        F.min("t").alias("t_min"),
        F.max("t").alias("t_max"),
        F.min("y_min").alias("y_min"),
        F.max("y_max").alias("y_max"),
        F.min("x_min").alias("x_min"),
        F.max("x_max").alias("x_max"),
        F.sum("n_cells").alias("n_cells"),
        F.count(F.lit(1)).alias("n_steps"),
    )


def sustained(steps: DataFrame, ok: Column, w: int, by: list[str]) -> DataFrame:
    """Groups for which ``ok`` holds in ``w`` consecutive steps.

    Every good step votes for the ``w`` runs it may belong to; a run with ``w`` votes
    is complete. A missing step breaks a run, and a group is spread over its runs, so
    even an object of endless life is never in one task.
    """
    good = steps.where(ok).select(*by, "t")
    if w > 1:
        start = F.explode(F.sequence(F.col("t") - (w - 1), F.col("t")))
        good = good.select(*by, start.alias("t")).groupBy(*by, "t").count().where(F.col("count") == w)
    return good.select(*by).distinct()


def filter_sustained(
    steps: DataFrame, min_area_km2: float, min_steps: int, by: tuple[str, ...] = ("run_id", "object_key")
) -> DataFrame:
    """Objects which are large enough in enough consecutive steps."""
    return sustained(steps, F.col("size_m2") >= min_area_km2 * 1000**2, min_steps, list(by))


def filter_lifetime(bounds: DataFrame, min_steps: int) -> DataFrame:
    """Objects whose first and last step span at least ``min_steps``."""
    return bounds.where(F.col("t_max") - F.col("t_min") + 1 >= min_steps)


def filter_area(areas: DataFrame, min_area_km2: float) -> DataFrame:
    """Object steps of at least the given area."""
    return areas.where(F.col("area_m2") >= min_area_km2 * 1000**2)


def dense_ids(objects: DataFrame, key: str = "object_key", by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Number objects 1..N per group in key order.

    Objects are ranked among those which start in the same step, and shifted by the
    count of earlier ones. No window holds more than one step's objects or one row per
    step, so a group with very many objects is spread.
    """
    by = list(by)
    first = objects.select(*by, key, key_step(F.col(key)).alias("_t0")).distinct()
    earlier = (
        Window.partitionBy(*by).orderBy("_t0").rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = (
        first.groupBy(*by, "_t0")
        .count()
        .select(*by, "_t0", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_shift"))
    )
    rank = F.row_number().over(Window.partitionBy(*by, "_t0").orderBy(key))
    return (
        first.withColumn("_rank", rank)
        .join(shift, [*by, "_t0"])
        .select(*by, key, (F.col("_shift") + F.col("_rank")).cast("long").alias("object_id"))
    )


def object_speed(steps: DataFrame, by: tuple[str, ...] = ("run_id", "object_id")) -> DataFrame:
    """Centroid displacement from the step before, in km per step.

    The first step of an object, and any step after a gap, has no speed. ``steps``
    carries ``spacing_m``, and one row per object and step.
    """
    series = Window.partitionBy(*by).orderBy("t")
    dy, dx = F.col("cy") - F.lag("cy").over(series), F.col("cx") - F.lag("cx").over(series)
    speed = F.sqrt(dy * dy + dx * dx) * (F.col("spacing_m") / 1000.0)
    return steps.withColumn("speed_km", F.when(F.lag("t").over(series) == F.col("t") - 1, speed))


def centroid_cells(steps: DataFrame, by: tuple[str, ...] = ("run_id", "object_id")) -> DataFrame:
    """Grid cell nearest to each centroid.

    Rounding is half-to-even on the index inside the object's bounding box, so the box
    corner decides ties.
    """
    whole = Window.partitionBy(*by)
    near = lambda c, low: (F.rint(F.col(c) - low) + low).cast("int")
    return steps.withColumns(
        {f"track_{a}": near(f"c{a}", F.min(f"{a}_min").over(whole)) for a in ("y", "x")}
    )


def object_stats(steps: DataFrame, grid: Grid, min_steps: int = 1, by: tuple[str, ...] = ("run_id", "object_id")) -> DataFrame:
    """Track position and speed for the step rows of objects with enough steps."""
    by = tuple(by)
    if min_steps > 1:
        life = steps.groupBy(*by).agg(F.countDistinct("t").alias("_n"))
        steps = steps.join(life.where(F.col("_n") >= min_steps).drop("_n"), list(by), "left_semi")
    df = object_speed(grid.attach_spacing(centroid_cells(steps, by)), by)
    points = Grid(
        grid.df.withColumnsRenamed({"y": "track_y", "x": "track_x"}),
        [k if k == "run_id" else f"track_{k}" for k in grid.keys],
        grid.points, grid.spacing_m, grid.ny, grid.nx, grid.closes, grid.runs,
    )
    return points.attach(df, ["lat", "lon"], "left").drop("track_y", "track_x", "spacing_m")


def number_cells(
    labels: Labels, ids: dict[str, DataFrame], cells: DataFrame | None = None
) -> DataFrame:
    """Attach object numbers to cells: ``<kind>_id`` (NULL for dropped objects).

    ``ids[kind]`` has ``run_id, object_key, object_id``. The join to cells runs on tile
    pieces, whose size is bounded, never on objects.
    """
    df = labels.cells if cells is None else cells
    for kind, table in ids.items():
        part = f"{kind}_part"
        named = table.select("run_id", "object_key", F.col("object_id").alias(f"{kind}_id"))
        numbered = numbered_pieces(labels, kind, named)
        df = restore_nulls(join_pieces(spread_nulls(df, part), numbered, ["run_id", part], "left"), part)
    return df


def validate_steps(steps: DataFrame) -> int:
    """Number of step rows without a centroid or track position (0 is right)."""
    bad = F.col("cy").isNull() | F.col("cx").isNull() | F.col("lat").isNull() | F.col("lon").isNull()
    return steps.agg(F.count_if(bad).alias("bad")).first()["bad"]


def count_parts(parts: DataFrame) -> DataFrame:
    """Mean number of slice parts per step of each object's lifetime, and its first part."""
    return parts.groupBy("run_id", "object_key").agg(
        (F.count(F.lit(1)) / (F.max("t") - F.min("t") + 1)).alias("mean_parts"),
        F.min("part").alias("first_part"),
    )
