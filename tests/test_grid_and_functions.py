import math

import pytest
from pyspark.sql import functions as F

from stormgrid import functions as S
from stormgrid.operators.grid import grid_metrics, measure_grid, mean_spacing, regular_grid_metrics


@pytest.fixture(scope="module")
def corner_grid(spark):
    rows = [(0, 0, 39.0, 1.0), (0, 1, 40.0, 2.0), (1, 0, 39.1, 1.1), (1, 1, 40.1, 2.1)]
    return spark.createDataFrame(rows, "y int, x int, lat double, lon double")


def test_golden_cell_area(corner_grid):
    area = {(r.y, r.x): r.area_m2 for r in grid_metrics(corner_grid).collect()}
    assert area[0, 1] == pytest.approx(1966730866.401264, rel=1e-12)
    assert area[0, 0] == pytest.approx(area[0, 1], rel=1e-2)


def test_first_row_and_column_are_copied(corner_grid):
    m = {(r.y, r.x): r for r in grid_metrics(corner_grid).collect()}
    assert m[0, 0].dx_m == m[0, 1].dx_m and m[1, 0].dx_m == m[1, 1].dx_m
    assert m[0, 0].dy_m == m[1, 0].dy_m and m[0, 1].dy_m == m[1, 1].dy_m
    c = {(r.y, r.x): r for r in grid_metrics(corner_grid, "cosine").collect()}
    assert len({r.dx_m for r in c.values()}) == 1 and len({r.dy_m for r in c.values()}) == 1


def test_mean_spacing_and_seam(spark, corner_grid):
    m = grid_metrics(corner_grid).collect()
    want = sum(r.dx_m + r.dy_m for r in m) / 8
    assert mean_spacing(grid_metrics(corner_grid)).first()[0] == pytest.approx(want)
    g = measure_grid(corner_grid)
    assert (g.points, g.ny, g.nx, g.closes, g.wrap_nx) == (4, 2, 2, False, None)
    globe = spark.createDataFrame(
        [(y, x, 10.0 + y, -178.0 + 3.6 * x) for y in range(2) for x in range(100)],
        "y int, x int, lat double, lon double",
    )
    assert measure_grid(globe).wrap_nx == 100


def test_regular_metrics_with_latitude_descending(spark):
    g = spark.createDataFrame(
        [(y, x, 40.0 - y, 5.0 + x) for y in range(3) for x in range(3)], "y int, x int, lat double, lon double"
    )
    r = {(r.y, r.x): r for r in regular_grid_metrics(g).collect()}
    assert r[0, 0].dy_m == pytest.approx(40075000 / 360)
    assert r[2, 1].dx_m == pytest.approx(40075000 / 360 * math.cos(math.radians(38)))


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_distances_agree(spark):
    a, b = (F.lit(10.0), F.lit(20.0)), (F.lit(-3.0), F.lit(55.0))
    m = one(spark, S.haversine_m(*a, *b))
    assert one(spark, S.haversine_km(a[1], a[0], b[1], b[0])) == pytest.approx(m / 1000)
    assert one(spark, S.cosine_distance_m(*a, *b)) == pytest.approx(m)
    assert one(spark, S.great_circle_km(a[1], a[0], b[1], b[0])) == pytest.approx(m / 6371 * 6.373)
    assert one(spark, S.cosine_distance_m(*a, *a)) == pytest.approx(0.0, abs=0.2)
    assert one(spark, S.cosine_distance_m(F.lit(None).cast("double"), a[1], *b)) is None


def test_column_helpers(spark):
    assert one(spark, S.brightness_temperature(F.lit(5.6704e-8 * 250.0**4))) == pytest.approx(250.0)
    assert one(spark, S.normalize_lon(F.lit(190.0))) == -170.0
    assert one(spark, S.roll_x(F.lit(3), -5, 10)) == 8
    assert one(spark, S.cell_id(F.lit(2), F.lit(3), F.lit(4), 10, 20)) == 464
    assert one(spark, S.key_step(S.cell_key(F.lit(7), F.lit(3), F.lit(4)))) == 7
    assert one(spark, S.null_if_negative(F.lit(-1.0))) is None
    assert one(spark, S.coriolis(F.lit(90.0))) == pytest.approx(2 * 7.2921159e-5)
    assert one(spark, S.vapor_transport(F.lit(3.0), F.lit(4.0), F.lit(2.0))) == 10.0
    assert one(spark, S.ivt(F.lit(3.0), F.lit(-4.0))) == 5.0
