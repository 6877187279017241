"""One query per operator, on tables which grow with the driver's data."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (
    AllObjectsConfig,
    CloudConfig,
    CycloneConfig,
    FrontConfig,
    MoistureConfig,
    PressureConfig,
    RainConfig,
    StormConfig,
    TrackConfig,
)
from ..functions import (
    brightness_temperature,
    cell_id,
    coriolis,
    cosine_distance_m,
    great_circle_km,
    haversine_km,
    haversine_m,
    ivt,
    normalize_lon,
    null_if_negative,
    roll_x,
    vapor_transport,
)
from ..operators.breakup import breakup_objects
from ..operators.components import Tile, label_components, label_masks
from ..operators.geometry import is_land, object_extent, points_in_polygons
from ..operators.grid import grid_metrics, measure_grid, mean_spacing, regular_grid_metrics
from ..operators.objects import (
    dense_ids,
    filter_lifetime,
    filter_sustained,
    labelled_steps,
    object_area,
    object_bounds,
    object_speed,
)
from ..operators.overlap import bbox_min, overlap_pairs, partner_area
from ..operators.regrid import grid_weights, regrid
from ..operators.resample import hourly_rain, median_substep, rain_sums
from ..operators.smoothing import gaussian_smooth, gradients, local_minima, uniform_smooth
from ..plans import kinds as K
from ..plans.report import legacy_view, storm_accumulation, storm_series, storm_summary
from ..plans.storms import classify_storms, cloud_objects, precipitation_objects, track_storms
from ..session import stage, stage_dir
from ..sources.fields import align_fields, crop, nearest, scan_variable, stack_variables, time_axis, with_step_index
from ..sources.sinks import Chunks, read_chunks, write_chunks
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CELL = ["run_id", "t", "y", "x"]
SIZE = {"y": I.NY, "x": I.NX}
# thresholds at which the small synthetic storms show every behaviour
RAIN = RainConfig(5.0, 3.0, 500.0)
CLOUD = CloudConfig(241.0, 5.0, 1000.0)
LOWS = PressureConfig(low_anomaly=-4.0, low_min_time_h=5.0, high_anomaly=1.0, high_min_time_h=5.0)
WET = MoistureConfig(112.0, 2.0, 200.0, 660.0, 3.0, 20.0, 20.0, 1.3)
FRONTS = FrontConfig(threshold=3.0, min_area_km2=60.0)
TROPICAL = CycloneConfig(
    min_steps=5, min_warm_steps=2, min_deep_steps=3, max_pressure=1008.0, max_genesis_lat=35.0, min_core_t=285.0
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _grid(spark):
    return measure_grid(I.base_grid(spark))


def _area_cells(spark, sf):
    return _grid(spark).attach(I.storm_cells(spark, sf), ["area_m2"])


def _rain(spark, sf):
    """Labelled rain cells with area."""
    return label_components(_area_cells(spark, sf).where(F.col("pr") >= 5))


def _rain_steps(spark, sf):
    labels = label_masks(_area_cells(spark, sf), {"pr": F.col("pr") >= 5})
    return stage(labelled_steps(labels, {"pr": "pr"}).drop("kind"), "steps")


# ------------------------------------------------------------------- column functions


@query
def brightness_temperature_olr(spark, sf):
    df = I.storm_cells(spark, sf).withColumn("olr", F.lit(80.0) + F.col("pr"))
    return rounded(df.select(*CELL, brightness_temperature(F.col("olr")).alias("bt_k")), bt_k=6)


@query
def haversine(spark, sf):
    df = I.run_grids(spark, sf)
    a = (F.col("lat"), F.col("lon"))
    b = (F.col("lat") + 3.0, F.col("lon") + 7.0)
    df = df.select(
        "run_id",
        "y",
        "x",
        haversine_m(*a, *b).alias("hav_m"),
        haversine_km(a[1], a[0], b[1], b[0]).alias("hav_km"),
        great_circle_km(a[1], a[0], b[1], b[0]).alias("arc_km"),
        cosine_distance_m(*a, *b).alias("cos_m"),
    )
    return rounded(df, hav_m=2, hav_km=5, arc_km=5, cos_m=2)


@query
def grid_columns(spark, sf):
    """Index and longitude arithmetic."""
    return I.run_grids(spark, sf).select(
        "run_id",
        "y",
        "x",
        F.round(normalize_lon(F.col("lon") + 360), 6).alias("lon180"),
        roll_x(F.col("x"), 7, I.NX).cast("long").alias("rolled"),
        cell_id(F.lit(3), F.col("y"), F.col("x"), I.NY, I.NX).alias("cell"),
        F.round(coriolis(F.col("lat")) * 1e6, 6).alias("coriolis_e6"),
    )


@query
def grid_metrics_haversine(spark, sf):
    df = grid_metrics(I.run_grids(spark, sf)).select("run_id", "y", "x", "dx_m", "dy_m", "area_m2")
    return rounded(df, dx_m=3, dy_m=3, area_m2=0)


@query
def grid_metrics_cosine(spark, sf):
    df = grid_metrics(I.run_grids(spark, sf), "cosine").select("run_id", "y", "x", "dx_m", "dy_m")
    return rounded(df, dx_m=1, dy_m=1)


@query
def grid_metrics_regular(spark, sf):
    df = regular_grid_metrics(I.run_grids(spark, sf))
    df = df.select("run_id", "y", "x", "dx_m", "dy_m", "area_m2")
    return rounded(df, dx_m=3, dy_m=3, area_m2=0)


@query
def grid_mean_spacing(spark, sf):
    return rounded(mean_spacing(grid_metrics(I.run_grids(spark, sf))), spacing_m=3)


@query
def vapor_transport_field(spark, sf):
    df = I.dense_fields(spark, sf).select(
        *CELL, vapor_transport(F.col("u"), F.col("v"), F.col("q")).alias("vap")
    )
    return rounded(df, vap=6)


@query
def ivt_field(spark, sf):
    df = I.dense_fields(spark, sf).select(*CELL, ivt(F.col("ivte"), F.col("ivtn")).alias("ivt"))
    return rounded(df, ivt=6)


# ------------------------------------------------------------- sources and predicates


@query
def threshold_mask(spark, sf):
    cells = I.storm_cells(spark, sf).where((F.col("pr") >= 5) | (F.col("bt") <= 241))
    return cells.select(*CELL, (F.col("pr") >= 5).alias("rain"), (F.col("bt") <= 241).alias("cloud"))


@query
def crop_region(spark, sf):
    cells = crop(I.storm_cells(spark, sf), I.base_grid(spark), (21.2, -98.7, 20.3, -99.6))
    return cells.select(*CELL)


@query
def step_index(spark, sf):
    df = I.gauge_30min(spark, sf).withColumn("run_id", (F.col("y") % 3).cast("long"))
    return with_step_index(df).groupBy("run_id", "t").agg(F.count(F.lit(1)).alias("n"))


@query
def time_axis_hours(spark, sf):
    df = I.gauge_30min(spark, sf).withColumn("run_id", (F.col("y") % 3).cast("long"))
    return time_axis(df).select("run_id", "t", F.unix_timestamp("time").alias("epoch"))


@query
def aligned_fields(spark, sf):
    cells = I.storm_cells(spark, sf)
    rain = cells.where("pr >= 5").select(*CELL, "pr")
    cloud = cells.where("bt <= 241").select(*CELL, "bt")
    return rounded(align_fields(rain, cloud), pr=6, bt=6)


@query
def stacked_variables(spark, sf):
    cells = I.storm_cells(spark, sf)
    fields = {v: cells.where(f"{v} > 10").select(*CELL, F.col(v).alias("value")) for v in ("pr", "bt")}
    return rounded(stack_variables(fields), pr=6, bt=6)


@query
def reanalysis_scan(spark, sf):
    """Temperature at the level nearest to 860 and surface pressure, every sixth hour of three days."""
    src = I.reanalysis_files(spark, sf)
    days = F.dayofmonth("time").isin(3, 4, 9) & (F.hour("time") % 6 == 0)
    times = src.where(days).select("time").distinct()
    air = scan_variable(src, "T", times, 860.0, (0, 9, 1, 6)).withColumn("variable", F.lit("T"))
    found = air.unionByName(scan_variable(src, "SLP", times).withColumn("variable", F.lit("SLP")))
    return found.select("variable", F.unix_timestamp("time").alias("epoch"), "y", "x", "value")


@query
def nearest_prices(spark, sf):
    """Order totals per hundred beside the nearest retail price."""
    axis = I.table(spark, sf, "part").selectExpr("CAST(p_retailprice AS DOUBLE) AS price")
    wants = I.table(spark, sf, "orders").selectExpr("CAST(o_totalprice AS DOUBLE) / 100 AS want")
    return nearest(axis, wants, "price")


# ------------------------------------------------------------------------- components


@query
def label_components_space_time(spark, sf):
    mask = I.storm_cells(spark, sf).where("pr >= 5").select(*CELL)
    return label_components(mask).select(*CELL, "object_key")


@query
def slice_components(spark, sf):
    mask = I.storm_cells(spark, sf).where("bt <= 241").select(*CELL)
    return label_components(mask, "slice").select(*CELL, "object_key")


@query
def dateline_merge(spark, sf):
    """Storms rolled by half the grid, so that many lie across the seam."""
    mask = I.storm_cells(spark, sf).where("pr >= 5")
    mask = mask.select("run_id", "t", "y", F.pmod(F.col("x") + 20, F.lit(I.NX)).cast("int").alias("x"))
    return label_components(mask, wrap_nx=I.NX).select(*CELL, "object_key")


@query
def mixed_grid_seams(spark, sf):
    """The same storms on global and regional grids in one job: only global runs have a seam."""
    grid = measure_grid(I.mixed_grids(spark, sf))
    mask = I.storm_cells(spark, sf).where("pr >= 5")
    mask = mask.select("run_id", "t", "y", F.pmod(F.col("x") + 20, F.lit(I.NX)).cast("int").alias("x"))
    return label_components(mask, wrap_nx=grid.wrap_nx).select(*CELL, "object_key")


@query
def dense_object_ids(spark, sf):
    return dense_ids(_rain_steps(spark, sf))


# --------------------------------------------------------------------------- objects


@query
def object_area_steps(spark, sf):
    df = object_area(_rain(spark, sf)).withColumn("km2", F.col("area_m2") / 1e6).drop("area_m2")
    return rounded(df, km2=3)


@query
def object_bounds_rain(spark, sf):
    return object_bounds(_rain_steps(spark, sf))


@query
def sustained_rain(spark, sf):
    return filter_sustained(_rain_steps(spark, sf), 500, 3)


@query
def lifetime_rain(spark, sf):
    return filter_lifetime(object_bounds(_rain_steps(spark, sf)), 8).select("run_id", "object_key", "t_min", "t_max")


@query
def object_speed_rain(spark, sf):
    steps = _rain_steps(spark, sf).withColumn("spacing_m", F.lit(4000.0))
    df = object_speed(steps, ("run_id", "object_key")).select("run_id", "object_key", "t", "speed_km")
    return rounded(df, speed_km=6)


def _stats(df):
    df = df.select(
        "run_id", "object_id", "t", "n_cells", (F.col("size_m2") / 1e6).alias("km2"),
        F.col("min").alias("lowest"), F.col("max").alias("highest"), F.col("mean").alias("average"),
        "tot", "cy", "cx", "lat", "lon", "speed_km",
    )
    digits = dict.fromkeys(["lowest", "highest", "average", "cy", "cx", "lat", "lon", "speed_km"], 5)
    return rounded(df, km2=3, tot=4, **digits)


@query
def precipitation_object_stats(spark, sf):
    return _stats(precipitation_objects(I.storm_cells(spark, sf), _grid(spark), RAIN))


@query
def cloud_object_stats(spark, sf):
    return _stats(cloud_objects(I.storm_cells(spark, sf), _grid(spark), CLOUD))


@query
def breakup_clouds(spark, sf):
    """Strong rain objects split into tracks; most storms of a run meet others."""
    rain = label_components(I.storm_cells(spark, sf).where("pr >= 5").select(*CELL)).drop("part")
    return breakup_objects(rain, 2, avg_parts=1.2).select(*CELL, "object_id")


# ---------------------------------------------------------------------------- storms


def _numbered(spark, sf):
    return track_storms(I.storm_cells(spark, sf), _grid(spark), TrackConfig(rain=RAIN, cloud=CLOUD))


@query
def overlapping_pairs(spark, sf):
    cells = I.storm_cells(spark, sf).select(*CELL, "pr", "bt")
    labels = label_masks(cells, {"pr": F.col("pr") >= 5, "bt": F.col("bt") <= 241}).keyed_cells()
    return overlap_pairs(labels, labels, "pr_key", "bt_key")


@query
def partner_cloud_area(spark, sf):
    labels = label_masks(_area_cells(spark, sf), {"pr": F.col("pr") >= 5, "bt": F.col("bt") <= 241})
    steps = stage(labelled_steps(labels, {"pr": "pr", "bt": "bt"}), "steps")
    cells = labels.keyed_cells()
    pairs = overlap_pairs(cells, cells, "pr_key", "bt_key")
    own = {k: steps.where(F.col("kind") == k).withColumnRenamed("object_key", f"{k}_key") for k in ("pr", "bt")}
    df = partner_area(pairs, object_bounds(own["pr"], "pr_key"), own["bt"], "pr_key", "bt_key")
    return rounded(df.withColumn("km2", F.col("partner_m2") / 1e6).drop("partner_m2"), km2=3)


@query
def box_minimum(spark, sf):
    steps = _rain_steps(spark, sf)
    cold = I.storm_cells(spark, sf).where("bt <= 241")
    return rounded(bbox_min(steps, object_bounds(steps), cold, "object_key", "bt"), bt_min=6)


@query
def rain_box_temperature(spark, sf):
    """Strong rain stands in for cyclones: temperature on the rain cells in its box."""
    cells = I.storm_cells(spark, sf)
    cores = label_components(cells.where("pr >= 20").select(*CELL)).withColumnRenamed("object_key", "object_id")
    df = K.rain_temperature(cores, cells.where("pr >= 5"))
    return rounded(df.withColumnRenamed("object_id", "object_key"), rain_bt=6)


@query
def classify_storm_steps(spark, sf):
    v = _numbered(spark, sf).verdicts
    v = v.select(
        "run_id", "pr_id", "t", "rain_km2", "cloud_km2", "pr_max", "bt_min", "lifetime_peak", "ok"
    )
    return rounded(v, rain_km2=3, cloud_km2=3, pr_max=6, bt_min=6, lifetime_peak=6)


@query
def classify_storms_compat(spark, sf):
    cells = _numbered(spark, sf).cells
    return classify_storms(cells, cells, StormConfig(compat_overlap=True))[1]


@query
def track_storms_objects(spark, sf):
    return _numbered(spark, sf).storms


@query
def storm_statistics(spark, sf):
    return _stats(_numbered(spark, sf).stats("storm"))


@query
def storm_statistics_smoothed(spark, sf):
    """Storms of sparse cells whose masks are taken from smoothed rain and temperature."""
    rain, cloud = RainConfig(4.0, 3.0, 500.0, 1.0), CloudConfig(241.0, 5.0, 1000.0, 1.0)
    cells = I.storm_cells(spark, sf).where("pr >= 1.5")
    cells = cells.withColumn("bt", F.when(F.pmod(F.col("x") + F.col("y"), F.lit(13)) > 0, F.col("bt")))
    return _stats(track_storms(cells, _grid(spark), TrackConfig(rain=rain, cloud=cloud)).stats("storm"))


@query
def storm_summaries(spark, sf):
    df = storm_summary(_numbered(spark, sf).stats("storm")).withColumn("km2", F.col("max_size_m2") / 1e6)
    return rounded(df.drop("max_size_m2"), km2=3, volume=3, peak=6)


@query
def storm_time_series(spark, sf):
    df = storm_series(_numbered(spark, sf).stats("storm"))
    return rounded(df, size_km2=3, speed_km=5, peak=5, lat=5, lon=5)


@query
def storm_rain_accumulation(spark, sf):
    return rounded(storm_accumulation(_numbered(spark, sf).cells), storm_pr=4)


@query
def legacy_names(spark, sf):
    df = legacy_view(_numbered(spark, sf).stats("pr"))
    df = df.select(
        "run_id", "object_id", "TimeAct", "rgrPR_Max", "rgrPR_Vol",
        F.col("rgrMassCentLatLon.track_lon").alias("track_lon"),
    )
    return rounded(df, rgrPR_Max=5, rgrPR_Vol=4, track_lon=5)


# ------------------------------------------------------------------- fields and filters


@query
def uniform_smooth_fields(spark, sf):
    """Space-time boxcar with missing cells: one wide, one even and leaning."""
    df = I.dense_fields(spark, sf).withColumn("gap", F.when((F.col("x") + F.col("t")) % 11 > 0, F.col("tk")))
    filters = {"u_box": ("u", {"t": 5, "y": 4, "x": 3}), "gap_box": ("gap", {"y": 6, "x": 7})}
    df = uniform_smooth(df.select(*CELL, "u", "gap"), filters, SIZE | {"t": I.NT})
    return rounded(df.select(*CELL, "u_box", "gap_box"), u_box=5, gap_box=5)


@query
def gaussian_smooth_field(spark, sf):
    df = I.dense_fields(spark, sf).select(*CELL, "pr")
    df = gaussian_smooth(df, "pr", {"y": 1.0, "x": 1.0}, SIZE)
    return rounded(df.select(*CELL, "pr_smooth"), pr_smooth=5)


@query
def gradient_fields(spark, sf):
    df = I.dense_fields(spark, sf).select(*CELL, "u", "tk")
    slopes = {"du_dy": ("u", "y"), "dtk_dx": ("tk", "x"), "dtk_dt": ("tk", "t")}
    df = gradients(df, slopes, SIZE | {"t": I.NT}, keep=[])
    return df.select(*CELL, "du_dy", "dtk_dx", "dtk_dt")


@query
def local_minima_bt(spark, sf):
    df = local_minima(I.dense_fields(spark, sf).select(*CELL, "bt", "slp"), "bt", lengths=SIZE, keep=[])
    return df.where("is_minimum").select(*CELL)


@query
def frontal_diagnostic_field(spark, sf):
    g = measure_grid(I.base_grid(spark), regular=True)
    df = K.frontal_diagnostic(I.dense_fields(spark, sf).select(*CELL, "u", "v", "tk"), g, keep=[])
    return rounded(df.select(*CELL, "front", "t_gradient"), front=4, t_gradient=6)


@query
def pressure_anomaly_field(spark, sf):
    g = measure_grid(I.base_grid(spark), regular=True)
    df = K.pressure_anomaly(I.dense_fields(spark, sf).select(*CELL, "slp"), g, keep=[])
    return rounded(df.select(*CELL, "anomaly"), anomaly=3)


@query
def hourly_rain_gauges(spark, sf):
    half = I.gauge_30min(spark, sf).groupBy("time", "y", "x").agg(F.avg("value").alias("pr"))
    df = hourly_rain(half, "pr", 3)
    return rounded(df.select(F.unix_timestamp("time").alias("epoch"), "y", "x", "pr"), pr=4)


@query
def rain_sums_from_first_step(spark, sf):
    """Whole five-hour sums, counted from the first hour of the series."""
    half = I.gauge_30min(spark, sf).groupBy("time", "y", "x").agg(F.avg("value").alias("pr"))
    df = rain_sums(half, "pr", 5)
    return rounded(df.select(F.unix_timestamp("time").alias("epoch"), "y", "x", "pr"), pr=4)


@query
def chunked_cells(spark, sf):
    """Storm cells written in chunks and batches, a broken part finished, and read back."""
    cells = stage(I.storm_cells(spark, sf), "cells")
    path, chunks = f"{stage_dir(spark)}/stormgrid/chunks-{uuid.uuid4().hex}", Chunks(steps=12, side=16, batch_cells=1 << 20)
    write_chunks(cells.where("t < 30"), path, chunks)
    write_chunks(cells, path, chunks)
    return rounded(read_chunks(spark, path).select("run_id", *[F.col(c).cast("long").alias(c) for c in "tyx"], "pr"), pr=6)


@query
def median_brightness(spark, sf):
    df = I.gauge_30min(spark, sf).withColumn("bt", null_if_negative(F.col("value") - 2))
    df = median_substep(df, "bt")
    return rounded(df.select(F.unix_timestamp("time").alias("epoch"), "y", "x", "bt"), bt=4)


@query
def regrid_midpoints(spark, sf):
    """Storm rain interpolated to points between the grid points."""
    mid = I.base_grid(spark).selectExpr(
        f"CAST(y * {I.NX} + x AS BIGINT) AS target_id",
        "lat + 0.03D - 0.02D * (y % 2) AS lat",
        "lon + 0.02D AS lon",
    )
    weights = grid_weights(I.base_grid(spark), mid)
    values = I.dense_fields(spark, sf).select(
        "run_id", "t", (F.col("y") * I.NX + F.col("x")).cast("long").alias("source_id"), F.col("tk").alias("value")
    )
    return rounded(regrid(values, weights), value=5)


# ------------------------------------------------------------------------- geometry


@query
def polygon_points(spark, sf):
    """Storm centres of all runs against a triangle and a square with a hole."""
    return points_in_polygons(_centres(spark, sf), _outlines(spark), 0.25)


def _outlines(spark):
    ring = [(20.1, -99.9, 20.9, -99.1), (20.3, -99.7, 20.7, -99.3)]
    rows = []
    for lat0, lon0, lat1, lon1 in ring:
        p = [(lon0, lat0), (lon1, lat0), (lon1, lat1), (lon0, lat1)]
        rows += [(1, *p[i], *p[(i + 1) % 4]) for i in range(4)]
    tri = [(-99.0, 20.2), (-98.45, 20.8), (-98.9, 21.5)]
    rows += [(2, *tri[i], *tri[(i + 1) % 3]) for i in range(3)]
    return spark.createDataFrame(rows, "poly_id long, x1 double, y1 double, x2 double, y2 double")


def _centres(spark, sf):
    return I.table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS point_id",
        "-100 + 0.04D * (4 + (s_suppkey * 104729) % 32) + 0.003D AS lon",
        "20 + 0.04D * (4 + (s_suppkey * 15485863) % 32) + 0.003D AS lat",
    )


@query
def land_flags(spark, sf):
    return is_land(_centres(spark, sf), _outlines(spark), 0.25).select("point_id", "land")


@query
def object_extent_boxes(spark, sf):
    """Area (square degrees) of the smallest rectangle around each rain object step."""
    cells = _grid(spark).attach(_rain(spark, sf), ["lat", "lon"])
    df = object_extent(cells.withColumnRenamed("object_key", "object_id"))

    def side(i, j):
        return F.hypot(F.col(f"lon{i}") - F.col(f"lon{j}"), F.col(f"lat{i}") - F.col(f"lat{j}"))

    df = df.select(
        "run_id", F.col("object_id").alias("object_key"), F.col("t").cast("long").alias("t"),
        (side(0, 1) * side(1, 2)).alias("box_deg2"),
    )
    return rounded(df, box_deg2=7)


# ------------------------------------------------------------------------- kinds


def _fields(spark, sf):
    """Moisture flux and column transport; they are read once, so they are not written."""
    return K.with_transport(I.dense_fields(spark, sf)).select(*CELL, "vap", "ivt")


def _kind(found: K.KindResult) -> DataFrame:
    df = found.steps.select(
        "run_id", "object_id", "t", "n_cells", F.col("max").alias("highest"),
        F.col("mean").alias("average"), "cy", "cx",
    )
    return rounded(df, highest=4, average=4, cy=5, cx=5)


@query
def moisture_stream_objects(spark, sf):
    return _kind(K.moisture_streams(_fields(spark, sf), _grid(spark), WET))


@query
def ivt_transport_objects(spark, sf):
    return _kind(K.ivt_objects(_fields(spark, sf), _grid(spark), WET))


@query
def atmospheric_river_cells(spark, sf):
    g, df = _grid(spark), _fields(spark, sf)
    found = K.detect_kinds(df, g, {"ms": K.moisture_spec(WET, 1.0), "ivt": K.ivt_spec(WET, 1.0)})
    return K.atmospheric_rivers(found.of("ivt"), found.of("ms"), g, WET).select(*CELL, "object_id")


def _lows(spark, sf):
    """Pressure and its anomaly; they are read once, so they are not written."""
    g = measure_grid(I.base_grid(spark), regular=True)
    slp = I.dense_fields(spark, sf).select(*CELL, "slp")
    return g, K.pressure_anomaly(slp, g, LOWS, nt=I.NT, keep=["slp_hpa"])


@query
def cyclone_objects(spark, sf):
    g, fields = _lows(spark, sf)
    return _kind(K.pressure_systems(fields, g, LOWS, sign=-1))


@query
def anticyclone_objects(spark, sf):
    g, fields = _lows(spark, sf)
    return _kind(K.pressure_systems(fields, g, LOWS, sign=1))


@query
def front_zones(spark, sf):
    g = measure_grid(I.base_grid(spark), regular=True)
    df = K.frontal_diagnostic(I.dense_fields(spark, sf).select(*CELL, "u", "v", "tk"), g, keep=[])
    return K.front_objects(df, g, FRONTS).select(*CELL, "front_key")


def _low_cells(spark, sf):
    """Rain objects stand in for cyclones: they are lows of the synthetic pressure.

    Their cells carry pressure and temperature through the labelling, so they do not meet the
    fields again, and both stay where the fields are made.
    """
    fields = I.dense_fields(spark, sf).withColumn("slp_hpa", F.col("slp") / 100)
    rain = fields.where("pr >= 5").select("run_id", *[F.col(c).cast("long").alias(c) for c in "tyx"], "slp_hpa", "tk")
    rain = label_components(rain, tile=Tile().on(I.NY, I.NX)).drop("part")
    return rain.withColumnRenamed("object_key", "object_id"), fields.select(*CELL, "slp_hpa", "tk")


@query
def low_centres(spark, sf):
    cells, _ = _low_cells(spark, sf)
    df = K.low_centre(cells).withColumnRenamed("object_id", "object_key")
    return rounded(df, low=5)


@query
def warm_core_excess(spark, sf):
    cells, fields = _low_cells(spark, sf)
    df = K.warm_cores(cells, fields, tasks=I.run_tasks(spark, sf)).withColumnRenamed("object_id", "object_key")
    df = df.select("run_id", "object_key", "t", "tk_near", "tk_mean", "excess_smooth")
    return rounded(df, tk_near=5, tk_mean=5, excess_smooth=5)


@query
def track_pieces(spark, sf):
    """Unbroken pieces of rain tracks at steps of strong rain."""
    strong = _rain_steps(spark, sf).where("max >= 20")
    df = K.track_islands(strong, ("run_id", "object_key"))
    return df.select("run_id", "object_key", "t", F.col("island").cast("long").alias("island"))


@query
def tropical_cyclone_tracks(spark, sf):
    cells, fields = _low_cells(spark, sf)
    g = measure_grid(I.base_grid(spark), regular=True)
    _, tracks = K.tropical_cyclones(cells, fields, g, _outlines(spark), TROPICAL, tasks=I.run_tasks(spark, sf))
    return rounded(tracks, lat=5, lon=5)


@query
def identify_all_storm_statistics(spark, sf):
    """Statistics of the storm cells which the whole chain finds where no river lies."""
    cfg = AllObjectsConfig(
        rain=RAIN, cloud=CLOUD, storm=StormConfig(), moisture=WET, pressure=LOWS, front=FRONTS, cyclone=TROPICAL,
        river_exclusion_lat=20.0,
    )
    steps = K.identify_all(I.dense_fields(spark, sf), _grid(spark), cfg, nt=I.NT).storm_steps
    return _stats(steps.withColumn("t", F.col("t").cast("long")))


@query
def identify_all_objects(spark, sf):
    """Object and step counts of every kind in one run of the whole chain."""
    g = measure_grid(I.base_grid(spark), regular=True)
    cfg = AllObjectsConfig(
        rain=RAIN, cloud=CloudConfig(241.0, 5.0, 1000.0, breakup=True), storm=StormConfig(500, 5, None, 225, 1000, 4),
        moisture=WET, pressure=LOWS, front=FRONTS, cyclone=TROPICAL,
    )
    r = K.identify_all(I.dense_fields(spark, sf), g, cfg, _outlines(spark), I.NT)

    def size(kind, df, obj):
        return df.groupBy("run_id").agg(
            F.lit(kind).alias("kind"), F.countDistinct(obj).alias("objects"), F.count(F.lit(1)).alias("rows")
        ).select("kind", "run_id", "objects", "rows")

    out = r.kinds.steps.groupBy("kind", "run_id").agg(
        F.countDistinct("object_id").alias("objects"), F.count(F.lit(1)).alias("rows")
    )
    for kind, df, obj in [
        ("river", r.rivers, "object_id"), ("front", r.fronts, "front_key"),
        ("storm", r.storms, "storm_id"), ("tc", r.cyclone_tracks, "tc_id"),
    ]:
        out = out.unionByName(size(kind, df, obj))
    return out
