"""Reading gridded fields kept as parquet cell tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import brightness_temperature, null_if_negative
from ..functions.geodesy import normalize_lon, roll_x
from ..operators.joins import MAX_BROADCAST_ROWS, join_cells, join_per_run
from ..operators.regrid import regrid
from ..operators.resample import hour_range, median_substep, rain_sums
from ..schema import nan_to_null
from ..session import stage

# Wanted days up to this number become a predicate; more are joined.
MAX_DATES = 4096
# Ranges into which the values of a nearest join are cut.
RANGES = 1024

# Variable, archive stem, name inside the files, and whether it has levels.
VARIABLES = [
    ("V", "v.ll025uv", "V", True),
    ("U", "u.ll025uv", "U", True),
    ("T", "t.ll025sc", "T", True),
    ("ZG", "z.ll025sc", "Z", True),
    ("Q", "q.ll025sc", "Q", True),
    ("SLP", "msl.ll025sc", "MSL", False),
    ("IVTE", "viwve.ll025sc", "VIWVE", False),
    ("IVTN", "viwvn.ll025sc", "VIWVN", False),
]


def read_runs(spark: SparkSession, path: str, rain: str = "RAIN", olr: str = "OLR") -> DataFrame:
    """Rain and long-wave files of many runs, paired by the run in their names.

    Files are named ``<anything>_RAIN_YYYY-MM...`` with a sibling ``OLR``; the run number
    is YYYYMM. One scan per field reads all files; there is no loop over runs.
    """

    def field(name: str, col: str) -> DataFrame:
        files = spark.read.parquet(f"{path}/*_{name}_20*")
        run = F.regexp_extract(F.col("_metadata.file_path"), rf"_{name}_(20\d\d)-(\d\d)", 0)
        df = files.withColumn("run_id", F.regexp_replace(run, r"\D", "").cast("long"))
        return df.select("run_id", "time", "y", "x", F.col(name).cast("double").alias(col))

    return load_cells(field(rain, "pr"), field(olr, "olr"))


def load_cells(rain: DataFrame, olr: DataFrame, dt_hours: float = 1.0) -> DataFrame:
    """Aligned cells with rain and brightness temperature; one missing field stays NULL."""
    rain, olr = nan_to_null(rain, "pr"), nan_to_null(olr, "olr")
    df = rain.join(olr, ["run_id", "time", "y", "x"], "full")
    df = df.withColumn("bt", brightness_temperature(F.col("olr"))).drop("olr")
    return with_step_index(df, dt_hours)


def align_fields(*fields: DataFrame) -> DataFrame:
    """Join fields with different variables on their cells; no field is collected for a broadcast."""
    return reduce(lambda a, b: join_cells(a, b, ["run_id", "t", "y", "x"]), fields)


def stack_variables(fields: dict[str, DataFrame]) -> DataFrame:
    """Fields ``run_id, t, y, x, value`` side by side, one column per variable."""
    rows = [f.select("run_id", "t", "y", "x", F.lit(v).alias("variable"), "value") for v, f in fields.items()]
    long = reduce(DataFrame.unionByName, rows)
    return long.groupBy("run_id", "t", "y", "x").pivot("variable", list(fields)).agg(F.first("value"))


def with_step_index(df: DataFrame, dt_hours: float = 1.0) -> DataFrame:
    """Step number since the first time stamp of each run."""
    start = df.groupBy("run_id").agg(F.min("time").alias("_start"))
    df = join_per_run(df, start, "time")
    seconds = F.unix_timestamp("time") - F.unix_timestamp("_start")
    step = F.floor(seconds / (3600 * dt_hours)).cast("int")
    return df.withColumn("t", step).drop("_start")


def time_axis(df: DataFrame, dt_hours: int = 1) -> DataFrame:
    """Every step from the first to the last time stamp of each run."""
    span = df.groupBy("run_id").agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    times = F.sequence("lo", "hi", F.make_interval(hours=F.lit(dt_hours)))
    return span.select("run_id", F.posexplode(times).alias("t", "time"))


def nearest(df: DataFrame, ref: DataFrame, on: str) -> DataFrame:
    """For each different ``want`` of ``ref`` the nearest value of ``on`` in ``df``; low on ties.

    Both sides are cut into ranges of values. Within a range the values below and above a
    wanted one are found in order; the ends of the ranges before and after it, one row per
    range, stand in where its own range has none. Neither side comes to the driver. NULLs
    are left out; without any value the answer is NULL.
    """
    axis = df.select(F.col(on).alias("_value")).where("_value IS NOT NULL").distinct()
    wants = ref.select("want").where("want IS NOT NULL").distinct()
    at = F.col("want").cast("double").alias("_at")
    rows = axis.select(F.col("_value").cast("double").alias("_at"), "_value").unionByName(
        wants.select(at, "want"), allowMissingColumns=True
    )
    rows = stage(rows, "axes")
    ends = rows.agg(F.min("_at").alias("low"), F.max("_at").alias("high")).first()
    width = (ends.high - ends.low) / RANGES if ends.low is not None and ends.high > ends.low else 1.0
    rows = rows.withColumn("_range", F.floor((F.col("_at") - F.lit(ends.low)) / width))
    spans = rows.groupBy("_range").agg(F.min("_value").alias("_first"), F.max("_value").alias("_last"))
    order = Window.orderBy("_range")  # one row per range
    spans = spans.select(
        "_range",
        F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    # frames which grow row by row, from below and from above: one which shrinks is summed anew for every row
    below, above = (Window.partitionBy("_range").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in ("_at", F.desc("_at")))
    rows = rows.join(F.broadcast(spans), "_range")
    rows = rows.withColumns({"_low": F.max("_value").over(below), "_high": F.min("_value").over(above)})
    low, high = F.coalesce("_low", "_before"), F.coalesce("_high", "_after")
    far = high.isNull() | (F.col("_at") - low <= high - F.col("_at"))
    return rows.where("want IS NOT NULL").select("want", F.when(far, low).otherwise(high).alias("nearest"))


def _nearest_index(axis: str, coord: str, value: float) -> Column:
    return F.min_by(axis, F.struct(F.abs(F.col(coord) - value), F.col(axis)))


def region_box(grid: DataFrame, region: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """Index box (y0, y1, x0, x1), ends included, of a north, east, south, west region."""
    north, east, south, west = region
    row = grid.agg(
        _nearest_index("y", "lat", north).alias("yn"),
        _nearest_index("y", "lat", south).alias("ys"),
        _nearest_index("x", "lon", east).alias("xe"),
        _nearest_index("x", "lon", west).alias("xw"),
    ).first()
    return min(row["yn"], row["ys"]), max(row["yn"], row["ys"]), row["xw"], row["xe"]


def crop(df: DataFrame, grid: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """Rows inside a region. The box is four numbers, so the filter reaches the scan."""
    y0, y1, x0, x1 = region_box(grid, region)
    return df.where(F.col("y").between(y0, y1) & F.col("x").between(x0, x1))


def apply_mask(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells inside the analysis region (``mask`` true)."""
    return cells.join(grid.where("mask").select("y", "x"), ["y", "x"], "left_semi")


def select_times(df: DataFrame, times: DataFrame) -> DataFrame:
    """Rows whose time stamp is in the wanted set."""
    return df.join(times.select("time").distinct(), "time", "left_semi")


def make_grid(lats: DataFrame, lons: DataFrame, region: tuple[float, float, float, float] | None = None) -> DataFrame:
    """2-D mesh of two axes ``(y, lat)`` and ``(x, lon)``.

    Longitudes go to -180..180. If the region spans the zero meridian, the longitude
    axis is rolled so that it is contiguous there. The mesh is built by expanding every
    latitude with the (short, one-dimensional) longitude axis.
    """
    lons = lons.withColumn("lon", normalize_lon(F.col("lon")))
    if region is not None and region[1] > 0 and region[3] < 0:
        row = lons.agg(F.count_if(F.col("lon") < 0).alias("n"), F.count(F.lit(1)).alias("nx")).first()
        lons = lons.withColumn("x", roll_x(F.col("x"), row["n"], row["nx"]).cast("int"))
    axis = lons.agg(F.to_json(F.sort_array(F.collect_list(F.struct("x", "lon"))))).first()[0]
    points = F.from_json(F.lit(axis), "array<struct<x int, lon double>>")
    grid = lats.select("y", "lat", F.explode(points).alias("p")).select("y", "p.x", "lat", "p.lon")
    return grid if region is None else crop(grid, grid, region)


def on_dates(dates: list[tuple]) -> Column:
    """Predicate on the partition columns ``year, month, day``, one term per month."""
    months: dict[tuple, list] = {}
    for year, month, day in dates:
        months.setdefault((year, month), []).append(day)
    terms = [(F.col("year") == y) & (F.col("month") == m) & F.col("day").isin(days) for (y, m), days in sorted(months.items())]
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def prune_dates(src: DataFrame, times: DataFrame) -> tuple[DataFrame, Column | None]:
    """Rows of the days which hold a wanted time stamp, and the predicate of the first such day.

    Up to ``MAX_DATES`` days become a predicate on the partitions, so other files are not
    even listed; beyond that the days are joined, and Spark prunes partitions while it runs.
    """
    if not {"year", "month", "day"} <= set(src.columns):
        return src, None
    parts = [f(F.col("time")).alias(n) for f, n in ((F.year, "year"), (F.month, "month"), (F.dayofmonth, "day"))]
    dates = stage(times.where("time IS NOT NULL").select(*parts).distinct(), "dates")
    days = dates.count()
    if days <= MAX_DATES:
        found = sorted((r.year, r.month, r.day) for r in dates.collect())
        return src.where(on_dates(found)), on_dates(found[:1])
    first = dates.agg(F.min(F.struct("year", "month", "day")).alias("d")).first().d
    # any comparison on the small side makes Spark prune by it, if that side is broadcast
    wanted = dates.where("year > 0")
    wanted = F.broadcast(wanted) if days <= MAX_BROADCAST_ROWS else wanted
    return src.join(wanted, ["year", "month", "day"], "left_semi"), on_dates([tuple(first)])


def scan_variable(
    src: DataFrame,
    var: str,
    times: DataFrame,
    level: float | None = None,
    box: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """One reanalysis variable at the nearest level, wanted times and region.

    ``src`` has ``name, year, month, day, time, level, y, x, value`` (surface variables
    have a NULL level), partitioned by name and date. Only the files of the variable on
    wanted days are read, and the axis of levels is taken from the first of these days.
    """
    stem = {v: (name, has_levels) for v, _, name, has_levels in VARIABLES}
    name, has_levels = stem[var]
    own = src.where(F.col("name") == name)
    df, first_day = prune_dates(own, times)
    if box is not None:
        df = df.where(F.col("y").between(*box[:2]) & F.col("x").between(*box[2:]))
    if has_levels:
        nearest_level = F.min_by("level", F.struct(F.abs(F.col("level") - level), "level"))
        pick = None if first_day is None else own.where(first_day).agg(nearest_level).first()[0]
        if pick is None:  # no such day, or a source without dates
            pick = df.agg(nearest_level).first()[0]
        df = df.where(F.col("level") == F.lit(pick))
    return select_times(df, times).select("time", "y", "x", "value")


def scan_halfhourly(
    df: DataFrame,
    box: tuple[int, int, int, int] | None = None,
    dt_hours: int = 1,
    hours: tuple[int, int] | None = None,
) -> DataFrame:
    """Half-hour rain granules to sums per ``dt_hours`` from the first step on.

    ``df`` has ``time, y, x, pr``; ``hours`` are the ends of the whole series, see ``rain_sums``.
    """
    if hours is None and dt_hours > 1:
        hours = hour_range(df)  # of the archive, not of the region
    if box is not None:
        df = df.where(F.col("y").between(*box[:2]) & F.col("x").between(*box[2:]))
    return rain_sums(df, "pr", dt_hours, hours)


def granule_stamps(time: Column) -> Column:
    """Start and end stamp which name a half-hour granule."""
    end = time + F.expr("INTERVAL 29 MINUTES 59 SECONDS")
    return F.concat(
        F.date_format(time, "yyyyMMdd"), F.lit("-S"), F.date_format(time, "HHmmss"),
        F.lit("-E"), F.date_format(end, "HHmmss"),
    )


def scan_brightness(df: DataFrame, weights: DataFrame, nx: int) -> DataFrame:
    """Sub-hourly infrared temperatures: fill to missing, median, regrid, fill again.

    ``df`` has ``run_id, time, y, x, bt``; ``weights`` come from ``grid_weights`` on its
    mesh of ``nx`` columns. Targets outside the mesh have no weights and no rows.
    """
    clean = df.withColumn("bt", null_if_negative(F.col("bt")))
    hourly = median_substep(clean, "bt", by=("run_id", "y", "x"))
    source = (F.col("y").cast("long") * nx + F.col("x")).alias("source_id")
    values = hourly.select("run_id", F.col("time").alias("t"), source, "bt")
    mapped = regrid(values, weights, "bt").withColumnRenamed("t", "time")
    return mapped.withColumn("bt", null_if_negative(F.col("bt")))
