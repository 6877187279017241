"""Writing labelled cells, statistics, tracks and weights."""

from __future__ import annotations

import dataclasses
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid
from ..operators.joins import MAX_BROADCAST_PIECES
from ..operators.regrid import grid_weights
from ..operators.smoothing import densify
from ..session import stage

# Units and long names of output columns.
META = {
    "lat": {"units": "degrees_north", "long_name": "latitude"},
    "lon": {"units": "degrees_east", "long_name": "longitude"},
    "pr": {"units": "mm", "long_name": "precipitation per time step", "coordinates": "lon lat"},
    "bt": {"units": "K", "long_name": "brightness temperature", "coordinates": "lon lat"},
    "size_m2": {"units": "m2", "long_name": "object area"},
    "speed_km": {"units": "km per time step", "long_name": "centroid displacement"},
}


def with_meta(df: DataFrame, cfg=None) -> DataFrame:
    """Attach units and names as column metadata, and thresholds as columns."""
    for col in df.columns:
        if col in META:
            df = df.withMetadata(col, META[col])
    if cfg is not None:
        df = df.withColumns({f"cfg_{k}": F.lit(v) for k, v in flat_config(cfg).items()})
    return df


def flat_config(cfg) -> dict:
    """Thresholds of a configuration as ``group_name: value``."""
    out = {}
    for f in dataclasses.fields(cfg):
        value = getattr(cfg, f.name)
        if dataclasses.is_dataclass(value):
            out |= {f"{f.name}_{k}": v for k, v in flat_config(value).items()}
        else:
            out[f.name] = value
    return out


def setup_string(cfg) -> str:
    """All thresholds in one name, for output folders."""
    return "_".join(f"{k}-{v}" for k, v in flat_config(cfg).items())


def write_objects(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Labelled cells, one folder per run.

    Rows are spread by run and step, so that a large run is written by many tasks.
    """
    spread = cells.repartition("run_id", F.floor(F.col("t") / 24))
    (
        spread.sortWithinPartitions("run_id", "t", "y", "x")
        .write.mode(mode)
        .partitionBy("run_id")
        .option("compression", "zstd")
        .parquet(path)
    )


CHUNK = ["run_id", "day", "ty", "tx"]
MANIFEST = "run_id long, day long, ty long, tx long, n long, pack string, at long, steps int, side int"
# Bounds of batches which the driver holds; one step of the order of chunks.
MAX_BATCHES = 1000
# Chunks of less than this share of a batch lie with others in one file of about that share.
FILES_PER_BATCH = 64


@dataclass(frozen=True)
class Chunks:
    """Steps and cells per side of a chunk, and cells per batch of chunks (one Spark job)."""

    steps: int = 24
    side: int = 512
    batch_cells: int = 20_000_000_000

    def place(self, cells: DataFrame) -> DataFrame:
        cut = {"day": ("t", self.steps), "ty": ("y", self.side), "tx": ("x", self.side)}
        return cells.withColumns({c: F.floor(F.col(axis) / size).cast("long") for c, (axis, size) in cut.items()})


def write_chunks(cells: DataFrame, path: str, chunks: Chunks = Chunks()) -> int:
    """Labelled cells in chunks of (run, day, tile); a second call goes on where a first one ended.

    A chunk of at least a ``FILES_PER_BATCH``-th of ``batch_cells`` is one task and one file; smaller
    ones share files of about that size (packs), since a file costs more than its few cells. Batches of chunks
    are written one after the other; a chunk is listed under ``path/done`` with its pack after its batch was
    written. Chunks last listed with the same number of cells are left out the next time, others
    replace what a broken run left. What is not listed last is never read. Results with other numbers of the
    same cells belong under a new path. Batches are ranges of runs and days; if there are several, the cells of
    open chunks are laid out in that order first, so that they are read about once. Returns the number of chunks written.
    """
    spark = cells.sparkSession
    done = f"{path}/done"
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(done)
    listed = spark.read.schema(MANIFEST).parquet(done)
    if not listed.where((F.col("steps") != chunks.steps) | (F.col("side") != chunks.side)).isEmpty():
        raise ValueError(f"{path} holds chunks of another size")
    placed = chunks.place(cells)
    counted = placed.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("n"))
    # the list grows while it is read, so the open chunks are a table of their own
    open_ = stage(counted.join(_last_listed(listed).select(*CHUNK, "n"), [*CHUNK, "n"], "left_anti"), "open-chunks")
    total = open_.agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("cells")).first()
    if not total.chunks:
        return 0
    batches = _batches(open_, min(MAX_BATCHES, math.ceil(total.cells / chunks.batch_cells)))
    share, call = chunks.batch_cells // FILES_PER_BATCH, uuid.uuid4().hex
    small = open_.select(*CHUNK, (F.col("n") < share).alias("_small"))
    todo = placed.join(F.broadcast(small) if total.chunks <= MAX_BROADCAST_PIECES else small, CHUNK)
    if len(batches) > 1:
        todo = _laid_out(todo, len(batches))
    for i, inside in enumerate(batches):
        wanted = open_.where(inside).withColumn("_small", F.col("n") < share)
        found = wanted.agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.when(F.col("_small"), F.col("n"))).alias("small")).first()
        if found.chunks:
            pack = _pack(f"s-{call}-{i}-", math.ceil((found.small or 0) / max(share, 1)))
            _write_batch(todo.where(inside).withColumn("pack", pack).drop("_small"), path)
            size = [F.lit(chunks.steps).alias("steps"), F.lit(chunks.side).alias("side")]
            at = F.unix_micros(F.current_timestamp()).alias("at")
            wanted.select(*CHUNK, "n", pack.alias("pack"), at, *size).coalesce(1).write.mode("append").parquet(done)
    return total.chunks


def _pack(prefix: str, n: int) -> Column:
    """Folder of a chunk: its own, which a later write replaces, or one of ``n`` new ones for small chunks."""
    shared = F.concat(F.lit(prefix), F.pmod(F.xxhash64(*CHUNK), F.lit(max(n, 1))).cast("string"))
    return F.when(F.col("_small"), shared).otherwise(F.concat_ws("-", F.lit("c"), *CHUNK))


def _last_listed(done: DataFrame) -> DataFrame:
    """Each listed chunk with the size and pack of its last writing."""
    last = done.groupBy(*CHUNK).agg(F.max_by(F.struct("n", "pack"), "at").alias("_last"))
    return last.select(*CHUNK, "_last.n", "_last.pack")


def _batches(open_: DataFrame, n: int) -> list[Column]:
    """Conditions on run and day which cut the open chunks into at most ``n`` parts of like size."""
    at = F.col("run_id") * (1 << 24) + F.col("day")
    cuts = open_.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts))
    out = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True)
        if low is not None:  # the bare column lets a scan skip other runs
            inside = inside & (F.col("run_id") >= low >> 24) & (at > low)
        if high is not None:
            inside = inside & (F.col("run_id") <= high >> 24) & (at <= high)
        out.append(inside)
    return out


def _laid_out(cells: DataFrame, batches: int) -> DataFrame:
    """Cells as a table ordered by run and day: a batch skips the files and row groups of others."""
    tasks = max(batches, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stage(cells.repartitionByRange(tasks, "run_id", "day").sortWithinPartitions("run_id", "day"), "laid-out")


def _write_batch(cells: DataFrame, path: str) -> None:
    (
        cells.repartition("pack")
        .sortWithinPartitions("pack", *CHUNK, "t", "y", "x")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("pack")
        .parquet(f"{path}/cells")
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all finished chunks."""
    done = stage(_last_listed(spark.read.schema(MANIFEST).parquet(f"{path}/done")).select(*CHUNK, "pack"), "listed")
    done = F.broadcast(done) if done.count() <= MAX_BROADCAST_PIECES else done
    cells = spark.read.parquet(f"{path}/cells")
    return cells.join(done, [*CHUNK, "pack"], "left_semi").drop("day", "ty", "tx", "pack")


def dense_view(cells: DataFrame, grid: Grid) -> DataFrame:
    """Labelled cells with a row for each grid point and step; background has id 0."""
    ids = {c: 0 for c in cells.columns if c.endswith("_id") and c != "run_id"}
    return grid.attach(densify(cells, grid, ids), ["lat", "lon"])


def write_stats(steps: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Object statistics by kind and run, one file for each month of hourly steps."""
    spread = steps.repartition("kind", "run_id", F.floor(F.col("t") / 720))
    spread.write.mode(mode).partitionBy("kind", "run_id").option("compression", "zstd").parquet(path)


def write_tracks(tracks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tropical-cyclone tracks."""
    tracks.write.mode(mode).option("compression", "zstd").parquet(path)


def weights_table(spark: SparkSession, path: str, src_grid: DataFrame, points: DataFrame) -> DataFrame:
    """Regridding weights, computed once and kept under ``path``."""
    grid_weights(src_grid, points).write.mode("ignore").parquet(path)
    return spark.read.parquet(path)
