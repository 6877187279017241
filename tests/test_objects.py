import pytest
from pyspark.sql import functions as F

from stormgrid.operators.grid import measure_grid
from stormgrid.operators.objects import (
    centroid_cells,
    dense_ids,
    filter_lifetime,
    filter_sustained,
    object_area,
    object_bounds,
    object_speed,
    object_stats,
    step_table,
    sustained,
    validate_steps,
)


def box(obj, t, y, x):
    return [(0, obj, tt, yy, xx, 1.0, float(tt + yy + xx)) for tt in range(*t) for yy in range(*y) for xx in range(*x)]


@pytest.fixture(scope="module")
def cube(spark):
    rows = box(1, (2, 5), (4, 9), (5, 8)) + box(2, (6, 8), (4, 8), (5, 7))
    return spark.createDataFrame(
        rows, "run_id long, object_key long, t int, y int, x int, area_m2 double, v double"
    )


def test_golden_areas(cube):
    got = {}
    for r in object_area(cube).orderBy("t").collect():
        got.setdefault(r.object_key, []).append(r.area_m2)
    assert got == {1: [15.0, 15.0, 15.0], 2: [8.0, 8.0]}


def test_golden_small_and_short_removed(spark, cube):
    areas = {1: [6e7, 6e7, 6e7], 2: [2.4e7, 3.2e7, 3.2e7]}
    rows = [(0, o, t, a) for o, s in areas.items() for t, a in enumerate(s)]
    steps = spark.createDataFrame(rows, "run_id long, object_key long, t int, size_m2 double")
    kept = filter_sustained(steps, 30, 3)
    ids = dense_ids(kept)
    cells = cube.join(ids, ["run_id", "object_key"])
    assert [tuple(r) for r in cells.groupBy("object_id").count().collect()] == [(1, 45)]


@pytest.mark.parametrize(
    "series, want", [([1, 1, 1, 0], True), ([1, 1, 0, 1], False), ([1, 1], False), ([0, 1, 1, 1], True)]
)
def test_runs(spark, series, want):
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate(series)], "k int, t int, v int")
    assert (sustained(df, F.col("v") == 1, 3, ["k"]).count() == 1) is want


def test_gap_breaks_a_run(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 3)], "k int, t int")
    assert sustained(df, F.lit(True), 3, ["k"]).count() == 0
    assert sustained(df, F.lit(True), 1, ["k"]).count() == 1


def test_dense_ids_follow_key_order(spark):
    keys = [5, (3 << 40) + 2, (3 << 40) + 1, 1 << 40, 9]
    df = spark.createDataFrame([(r, k) for r in (1, 2) for k in keys], "run_id long, object_key long")
    got = {(r.run_id, r.object_key): r.object_id for r in dense_ids(df).collect()}
    assert got == {(r, k): i + 1 for r in (1, 2) for i, k in enumerate(sorted(keys))}


def test_bounds_and_lifetime(cube):
    b = {r.object_key: r for r in object_bounds(step_table(cube, ["run_id", "object_key"], "v")).collect()}
    assert (b[1].t_min, b[1].t_max, b[1].y_min, b[1].y_max, b[1].x_min, b[1].x_max) == (2, 4, 4, 8, 5, 7)
    assert (b[1].n_cells, b[1].n_steps) == (45, 3)
    kept = filter_lifetime(object_bounds(step_table(cube, ["run_id", "object_key"], "v")), 3)
    assert [r.object_key for r in kept.collect()] == [1]


def test_speed_only_between_neighbouring_steps(spark):
    rows = [(0, 1, 0, 0.0, 0.0), (0, 1, 1, 3.0, 4.0), (0, 1, 3, 3.0, 5.0)]
    steps = spark.createDataFrame(rows, "run_id long, object_id long, t int, cy double, cx double")
    got = {r.t: r.speed_km for r in object_speed(steps.withColumn("spacing_m", F.lit(2000.0))).collect()}
    assert got == {0: None, 1: 10.0, 3: None}


@pytest.mark.parametrize("y_min, want", [(2, 2), (3, 3), (4, 4)])
def test_centroid_ties_round_inside_the_box(spark, y_min, want):
    row = [(0, 1, 0, y_min + 0.5, 0.0, y_min, 0)]
    steps = spark.createDataFrame(row, "run_id long, object_id long, t int, cy double, cx double, y_min int, x_min int")
    assert centroid_cells(steps).first().track_y == want


def test_statistics_skip_missing_values(spark):
    grid = measure_grid(
        spark.createDataFrame(
            [(y, x, 10.0 + y, 20.0 + x) for y in range(4) for x in range(4)], "y int, x int, lat double, lon double"
        )
    )
    rows = [(0, 1, 0, 1, 1, 4.0), (0, 1, 0, 1, 2, None), (0, 1, 0, 1, 3, 8.0), (0, 1, 1, 2, 2, 1.0)]
    cells = spark.createDataFrame(rows, "run_id long, object_id long, t int, y int, x int, v double")
    steps = step_table(grid.attach(cells, ["area_m2"]), ["run_id", "object_id"], "v")
    got = {r.t: r for r in object_stats(steps, grid).collect()}
    assert (got[0].min, got[0].max, got[0].mean, got[0].tot, got[0].n_cells) == (4.0, 8.0, 6.0, 12.0, 3)
    assert (got[0].lat, got[0].lon) == (11.0, 22.0)
    assert got[1].speed_km == pytest.approx(grid.spacing_m / 1000)
    assert validate_steps(object_stats(steps, grid)) == 0
    assert object_stats(steps, grid, min_steps=3).count() == 0


def test_speed_reads_the_steps_once(spark):
    rows = [(1, 1, t, float(t * t), 0.0, 1000.0) for t in (0, 1, 2, 4)]
    steps = spark.createDataFrame(rows, "run_id long, object_id long, t int, cy double, cx double, spacing_m double")
    found = object_speed(steps)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.t: r.speed_km for r in found.collect()} == {0: None, 1: 1.0, 2: 3.0, 4: None}
