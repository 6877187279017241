import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stormgrid.catalog import inputs as I
from stormgrid.config import TrackConfig
from stormgrid.operators.grid import measure_grid
from stormgrid.operators.regrid import grid_weights, regrid
from stormgrid.operators.resample import rain_sums
from stormgrid.plans.storms import track_storms
from stormgrid.schema import nan_to_null, require, validate_inputs
from stormgrid.session import stage_dir
from stormgrid.sources import fields as S
from stormgrid.sources import sinks as W
from stormgrid.streaming.resample import hourly_mean_stream, write_hours

T0 = dt.datetime(2016, 7, 1)


def hours(n, step=60):
    return [T0 + dt.timedelta(minutes=step * k) for k in range(n)]


def test_runs_are_paired_by_name(spark, tmp_path):
    for month in ("07", "08"):
        for name, base in [("RAIN", 1.0), ("OLR", 200.0)]:
            rows = [(t, 0, x, base + x) for t in hours(3) for x in range(2)]
            df = spark.createDataFrame(rows, f"time timestamp, y int, x int, {name} float")
            df.write.parquet(f"{tmp_path}/model_01H_{name}_2016-{month}.parquet")
    cells = S.read_runs(spark, str(tmp_path))
    assert {r.run_id for r in cells.select("run_id").distinct().collect()} == {201607, 201608}
    r = cells.where("run_id = 201608 AND t = 2 AND x = 1").first()
    assert (r.pr, r.time) == (2.0, T0 + dt.timedelta(hours=2))
    assert r.bt == pytest.approx((201.0 / 5.6704e-8) ** 0.25)


def test_missing_field_stays_null(spark):
    rain = spark.createDataFrame([(1, T0, 0, 0, float("nan")), (1, T0, 0, 1, 2.0)], "run_id long, time timestamp, y int, x int, pr double")
    olr = spark.createDataFrame([(1, T0, 0, 0, 100.0)], "run_id long, time timestamp, y int, x int, olr double")
    got = {r.x: (r.pr, r.bt is None) for r in S.load_cells(rain, olr).collect()}
    assert got == {0: (None, False), 1: (2.0, True)}


def test_step_index_and_axis(spark):
    df = spark.createDataFrame([(1, T0), (1, T0 + dt.timedelta(hours=6)), (2, T0)], "run_id long, time timestamp")
    assert sorted(r.t for r in S.with_step_index(df, 3).collect()) == [0, 0, 2]
    assert S.time_axis(df, 3).where("run_id = 1").count() == 3


def test_mesh_rolls_over_the_zero_meridian(spark):
    lats = spark.createDataFrame([(i, 90.0 - 30 * i) for i in range(7)], "y int, lat double")
    lons = spark.createDataFrame([(i, 45.0 * i) for i in range(8)], "x int, lon double")
    grid = S.make_grid(lats, lons, (60.0, 90.0, 0.0, -90.0))
    got = [r.lon for r in grid.where("y = 2").orderBy("x").collect()]
    assert got == [-90.0, -45.0, 0.0, 45.0, 90.0]
    assert sorted(r.lat for r in grid.select("lat").distinct().collect()) == [0.0, 30.0, 60.0]
    assert S.make_grid(lats, lons).count() == 56


def test_crop_filters_reach_the_scan(spark, tmp_path):
    grid = spark.createDataFrame([(y, x, 1.0 * y, 1.0 * x) for y in range(9) for x in range(9)], "y int, x int, lat double, lon double")
    grid.write.parquet(f"{tmp_path}/g")
    got = S.crop(spark.read.parquet(f"{tmp_path}/g"), grid, (6.2, 5.1, 2.8, 1.6))
    assert got.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first() == (3, 6, 2, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(y), IsNotNull(x), GreaterThanOrEqual(y,3)" in plan


def test_reanalysis_variable_at_nearest_level(spark):
    rows = [("T", t, lev, 0, 0, lev + k) for k, t in enumerate(hours(3)) for lev in (500.0, 825.0, 850.0)]
    rows += [("MSL", t, None, 0, 0, 1.0) for t in hours(3)]
    src = spark.createDataFrame(rows, "name string, time timestamp, level double, y int, x int, value double")
    times = spark.createDataFrame([(T0,), (T0 + dt.timedelta(hours=2),)], "time timestamp")
    got = S.scan_variable(src, "T", times, 860.0, (0, 0, 0, 0))
    assert sorted(r.value for r in got.collect()) == [850.0, 852.0]
    assert S.scan_variable(src, "SLP", times).count() == 2
    wants = spark.createDataFrame([(840.0,), (100.0,)], "want double")
    assert {r.want: r.nearest for r in S.nearest(src.where("level IS NOT NULL"), wants, "level").collect()} == {840.0: 850.0, 100.0: 500.0}


@pytest.mark.parametrize("most", [S.MAX_DATES, 0])
def test_only_files_of_wanted_days_are_read(spark, tmp_path, monkeypatch, most):
    """Files of other days and variables are not parquet at all, so reading one would fail."""
    monkeypatch.setattr(S, "MAX_DATES", most)
    rows = [
        (n, 2016, 7, d, dt.datetime(2016, 7, d, h), lev, 0, 0, 100.0 * d + h)
        for n in ("T", "Q") for d in (1, 2, 3) for h in (0, 6) for lev in (500.0, 850.0)
    ]
    kind = "name string, year int, month int, day int, time timestamp, level double, y int, x int, value double"
    df = spark.createDataFrame(rows, kind)
    df.write.partitionBy("name", "year", "month", "day").parquet(f"{tmp_path}/a")
    for part in (tmp_path / "a").glob("name=*/year=2016/month=7/day=*"):
        if not (part.match("name=T/*/*/day=1") or part.match("name=T/*/*/day=3")):
            for file in part.glob("*.parquet"):
                file.write_bytes(b"not parquet")
            for file in part.glob(".*.crc"):
                file.unlink()
    src = spark.read.schema(df.schema).parquet(f"{tmp_path}/a")
    times = spark.createDataFrame([(dt.datetime(2016, 7, 1, 6),), (dt.datetime(2016, 7, 3),), (None,)], "time timestamp")
    got = S.scan_variable(src, "T", times, 800.0)
    assert sorted(r.value for r in got.collect()) == [106.0, 300.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("PartitionFilters: [(name#" if most else "dynamicpruning") in plan or "PartitionFilters: [isnotnull(name" in plan
    assert most or "dynamicpruning" in plan
    nothing = S.scan_variable(src, "T", times.where("time IS NULL"), 800.0)
    assert nothing.count() == 0


@pytest.mark.parametrize("ranges", [1, 3, 1024])
def test_nearest_of_any_axis(spark, monkeypatch, ranges):
    monkeypatch.setattr(S, "RANGES", ranges)
    draw = random.Random(2)
    axis = [draw.randint(-50, 50) / 2 for _ in range(25)]
    wants = [draw.randint(-140, 140) / 4 for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in [*axis, *axis[:3], None]], "v double")
    ref = spark.createDataFrame([(w,) for w in [*wants, None]], "want double")
    got = {r.want: r.nearest for r in S.nearest(df, ref, "v").collect()}
    assert got == {w: min(axis, key=lambda v: (abs(v - w), v)) for w in wants}
    assert {r.nearest for r in S.nearest(df.limit(0), ref, "v").collect()} == {None}
    assert S.nearest(df, ref.limit(0), "v").count() == 0


def test_half_hours_to_sums(spark):
    rows = [(t, 0, 0, float(k)) for k, t in enumerate(hours(8, 30))]
    df = spark.createDataFrame(rows, "time timestamp, y int, x int, pr double")
    assert [r.pr for r in S.scan_halfhourly(df).orderBy("time").collect()] == [0.5, 2.5, 4.5, 6.5]
    assert [r.pr for r in S.scan_halfhourly(df, None, 2).orderBy("time").collect()] == [3.0, 11.0]
    late = df.where("pr >= 2")  # the series starts at one o'clock, its third hour fills no window
    assert [(r.time.hour, r.pr) for r in S.scan_halfhourly(late, None, 2).orderBy("time").collect()] == [(1, 7.0)]
    kept = rain_sums(late, "pr", 2, whole=False).orderBy("time").collect()
    assert [(r.time.hour, r.pr) for r in kept] == [(1, 7.0), (3, 6.5)]
    assert S.scan_halfhourly(df.limit(0), None, 2).count() == 0
    stamp = df.where("pr = 1").select(S.granule_stamps(F.col("time")).alias("s")).first().s
    assert stamp == "20160701-S003000-E005959"


def test_brightness_scan_regrids_and_drops_fill(spark):
    mesh = spark.createDataFrame([(y, x, 1.0 * y, 1.0 * x) for y in range(3) for x in range(3)], "y int, x int, lat double, lon double")
    target = spark.createDataFrame([(1, 0.25, 0.25), (2, 1.75, 1.5), (3, 5.0, 5.0)], "target_id long, lat double, lon double")
    weights = grid_weights(mesh, target)
    assert {r.target_id: r.s for r in weights.groupBy("target_id").agg(F.sum("weight").alias("s")).collect()} == {1: 1.0, 2: 1.0}
    rows = [(7, t, y, x, (-9.0 if (y, x) == (2, 2) else 200.0 + 10 * y + x)) for t in hours(2, 30) for y in range(3) for x in range(3)]
    df = spark.createDataFrame(rows, "run_id long, time timestamp, y int, x int, bt double")
    got = {r.target_id: r.bt for r in S.scan_brightness(df, weights, 3).collect()}
    assert got == {1: pytest.approx(202.75), 2: None}


def test_regrid_reproduces_a_plane_for_descending_latitudes(spark):
    mesh = spark.createDataFrame([(y, x, 4.0 - y, 1.0 * x) for y in range(5) for x in range(6)], "y int, x int, lat double, lon double")
    pts = [(i, 0.37 * i % 4, 0.61 * i % 5) for i in range(30)]
    target = spark.createDataFrame(pts, "target_id long, lat double, lon double")
    values = mesh.selectExpr("0L run_id", "0 t", "y * 6 + x AS source_id", "2 * lat - 3 * lon AS value")
    got = {r.target_id: r.value for r in regrid(values, grid_weights(mesh, target)).collect()}
    assert got == {i: pytest.approx(2 * a - 3 * o, abs=1e-9) for i, a, o in pts}


def test_input_checks(spark):
    a = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 0, 1)], "run_id long, t int, y int, x int")
    validate_inputs(a, a)
    with pytest.raises(ValueError, match="1 cells only in the first"):
        validate_inputs(a, a.where("x = 0"))
    with pytest.raises(ValueError, match="missing"):
        require(a, "pr")
    assert nan_to_null(spark.createDataFrame([(float("nan"),)], "v double"), "v").first().v is None


def test_mask_times_and_stack(spark):
    cells = spark.createDataFrame([(0, 0, 0, x, 1.0 * x) for x in range(3)], "run_id long, t int, y int, x int, value double")
    grid = spark.createDataFrame([(0, x, x != 1) for x in range(3)], "y int, x int, mask boolean")
    assert sorted(r.x for r in S.apply_mask(cells, grid).collect()) == [0, 2]
    wide = S.stack_variables({"a": cells, "b": cells.where("x > 0")})
    assert [(r.a, r.b) for r in wide.orderBy("x").collect()] == [(0.0, None), (1.0, 1.0), (2.0, 2.0)]


def test_sinks_round_trip(spark, sf_dir, tmp_path):
    grid = measure_grid(I.base_grid(spark))
    r = track_storms(I.storm_cells(spark, sf_dir), grid)
    cells = r.cells.select("run_id", "t", "y", "x", "pr", "bt", "pr_id", "bt_id", "storm_id")
    W.write_objects(cells, f"{tmp_path}/cells")
    W.write_stats(r.steps, f"{tmp_path}/steps")
    back = spark.read.parquet(f"{tmp_path}/cells")
    assert back.count() == cells.count()
    assert back.where("storm_id IS NOT NULL").count() == cells.where("storm_id IS NOT NULL").count()
    kinds = {x.kind for x in spark.read.parquet(f"{tmp_path}/steps").select("kind").distinct().collect()}
    assert kinds == {"pr", "bt", "storm"}
    dense = W.dense_view(back.where("t BETWEEN 10 AND 12"), grid)
    assert dense.count() == 3 * 1600 and dense.where("storm_id IS NULL").count() == 0
    meta = W.with_meta(r.steps, TrackConfig())
    assert meta.schema["size_m2"].metadata["units"] == "m2" and meta.first().cfg_rain_threshold == 5.0
    assert "rain_threshold-5.0" in W.setup_string(TrackConfig())
    tracks = spark.createDataFrame([(0, 1, 0, 1.0, 2.0, 1)], "run_id long, tc_id long, t int, lat double, lon double, island long")
    W.write_tracks(tracks, f"{tmp_path}/tracks")
    assert spark.read.parquet(f"{tmp_path}/tracks").count() == 1


def test_a_broken_write_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    rows = [(r, t, y, x, 100 * r + t) for r in (0, 3) for t in (0, 1, 5, 9) for y in (0, 7) for x in (0, 1, 9)]
    cells = spark.createDataFrame(rows, "run_id long, t int, y int, x int, storm_id int")
    chunks, path, write = W.Chunks(steps=4, side=8, batch_cells=10), f"{tmp_path}/cells", W._write_batch
    calls = []

    def broken(batch, to):
        write(batch, to)
        calls.append(1)
        if len(calls) == 2:  # written, but not yet listed
            raise RuntimeError("lost")

    monkeypatch.setattr(W, "_write_batch", broken)
    with pytest.raises(RuntimeError, match="lost"):
        W.write_chunks(cells, path, chunks)
    monkeypatch.setattr(W, "_write_batch", write)
    listed = spark.read.parquet(f"{path}/done").count()
    n = W.read_chunks(spark, path).count()
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "cells/cells").rglob("*.parquet")}
    assert 0 < listed < 12 and 0 < n < len(rows) and len(files) > listed
    assert W.write_chunks(cells, path, chunks) == 12 - listed
    got = W.read_chunks(spark, path).select(*cells.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    now = {f: f.stat().st_mtime_ns for f in (tmp_path / "cells/cells").rglob("*.parquet")}
    assert len(now) == 12  # one file a chunk
    assert sum(now.get(f) == t for f, t in files.items()) == listed
    assert W.write_chunks(cells, path, chunks) == 0
    # a run which grew: only its new chunk is written
    more = cells.unionByName(spark.createDataFrame([(3, 30, 0, 0, 1)], cells.schema))
    assert W.write_chunks(more, path, chunks) == 1 and W.read_chunks(spark, path).count() == len(rows) + 1
    with pytest.raises(ValueError, match="another size"):
        W.write_chunks(cells, path)
    assert W.write_chunks(cells.limit(0), f"{tmp_path}/none") == 0


def test_small_chunks_share_files(spark, tmp_path, monkeypatch):
    """Every chunk of a few cells was a file of its own, which costs some hundred times more than the cells."""
    cells = spark.range(6000).selectExpr("id % 40 AS run_id", "CAST(id % 48 AS INT) AS t", "0 AS y", "CAST(id % 7 AS INT) AS x", "id AS n")
    chunks, path, write = W.Chunks(steps=12, side=8, batch_cells=64_000), f"{tmp_path}/cells", W._write_batch
    early = cells.where("t < 30 AND run_id < 30")

    def broken(batch, to):
        write(batch, to)
        raise RuntimeError("lost")

    monkeypatch.setattr(W, "_write_batch", broken)
    with pytest.raises(RuntimeError, match="lost"):
        W.write_chunks(early, path, chunks)
    assert W.read_chunks(spark, path).count() == 0
    monkeypatch.setattr(W, "_write_batch", write)
    n = W.write_chunks(early, path, chunks)
    assert len(list((tmp_path / "cells/cells").rglob("*.parquet"))) < n / 4
    assert sorted(W.read_chunks(spark, path).select(*cells.columns).collect()) == sorted(early.collect())
    # chunks which grew are read once, in their last state; a chunk may also shrink again
    assert 0 < W.write_chunks(cells, path, chunks) < cells.selectExpr("run_id", "t div 12").distinct().count()
    assert sorted(W.read_chunks(spark, path).select(*cells.columns).collect()) == sorted(cells.collect())
    assert W.write_chunks(cells, path, chunks) == 0 and W.write_chunks(early.where("t >= 24"), path, chunks) > 0
    assert W.read_chunks(spark, path).where("t BETWEEN 30 AND 35 AND run_id < 30 AND run_id % 8 < 6").count() == 0


def test_weights_are_kept(spark, tmp_path):
    mesh = spark.createDataFrame([(y, x, 1.0 * y, 1.0 * x) for y in range(2) for x in range(2)], "y int, x int, lat double, lon double")
    one = spark.createDataFrame([(1, 0.5, 0.25)], "target_id long, lat double, lon double")
    first = W.weights_table(spark, f"{tmp_path}/w", mesh, one).collect()
    again = W.weights_table(spark, f"{tmp_path}/w", mesh, one.where("false")).collect()
    assert sorted(first) == sorted(again) and len(first) == 3


def test_stream_gives_the_batch_means(spark, sf_dir, tmp_path):
    half = I.gauge_30min(spark, sf_dir).groupBy("time", "y", "x").agg(F.avg("value").alias("pr"))
    half.orderBy("time").write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(half.schema).parquet(f"{tmp_path}/in")
    q = write_hours(hourly_mean_stream(src, "pr"), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = {(r.time, r.y, r.x): r.pr for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.time, r.y, r.x): r.pr for r in S.scan_halfhourly(half).collect()}
    assert got and all(v == pytest.approx(want[k]) for k, v in got.items())
    open_hours = {k for k in want if k not in got}
    assert all(k[0] > max(want)[0] - dt.timedelta(hours=4) for k in open_hours)


def test_stage_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert stage_dir(spark) == (named or stage_dir(spark)).rstrip("/")


def test_nearest_sums_no_shrinking_frames(spark):
    """A frame from a row to the end of its range is summed anew for every row: quadratic in a dense range."""
    axis = spark.range(50).selectExpr("CAST(id AS DOUBLE) AS price")
    found = S.nearest(axis, spark.range(3000).selectExpr("id / 70 AS want"), "price")
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rangeframe, unboundedpreceding$(), currentrow$()" in plan
    assert "rangeframe, currentrow$(), unboundedfollowing$()" not in plan
    for r in found.collect():
        assert abs(r.nearest - r.want) == min(abs(p - r.want) for p in range(50))


def test_a_batch_reads_its_own_cells(spark, tmp_path, monkeypatch):
    """Each batch read the whole table of cells, which is not laid out by run."""
    cells = spark.range(4000).selectExpr("id % 40 AS run_id", "CAST(id % 48 AS INT) AS t", "0 AS y", "0 AS x", "id AS storm_id")
    read, write = [], W._write_batch

    def watched(batch, to):
        read.append("laid-out" in " ".join(batch.inputFiles()))
        write(batch, to)

    monkeypatch.setattr(W, "_write_batch", watched)
    chunks = W.Chunks(steps=48, side=8, batch_cells=1000)
    assert W.write_chunks(cells, f"{tmp_path}/cells", chunks) == 40
    assert len(read) > 1 and all(read)
    got = W.read_chunks(spark, f"{tmp_path}/cells").select(*cells.columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, cells.collect()))
