import math
import random

import numpy as np
import pytest
from brute import boxcar, gaussian
from pyspark.sql import functions as F

from stormgrid.operators import stencil
from stormgrid.operators.grid import measure_grid
from stormgrid.operators.smoothing import (
    densify,
    gaussian_smooth,
    gradient,
    gradients,
    local_minima,
    smooth_series,
    uniform_smooth,
)

NX = 7


@pytest.fixture(scope="module")
def values():
    rng = random.Random(1)
    return [[round(rng.uniform(0, 9), 2) if rng.random() > 0.15 else None for _ in range(NX)] for _ in range(3)]


@pytest.fixture(scope="module")
def rows(spark, values):
    data = [(0, 0, y, x, v) for y, row in enumerate(values) for x, v in enumerate(row)]
    return spark.createDataFrame(data, "run_id long, t int, y int, x int, v double")


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 13, 14, 15, 28, 33, 75])
def test_boxcar_of_any_width(rows, values, size):
    got = uniform_smooth(rows, {"s": ("v", {"x": size})}, {"y": 3, "x": NX})
    for r in got.collect():
        total, n = boxcar(values[r.y], size)[r.x]
        assert r.s == (pytest.approx(total / n, abs=1e-9) if n else None)


def test_two_axes_and_two_filters_at_once(rows, values):
    got = uniform_smooth(rows, {"a": ("v", {"x": 3, "y": 2}), "b": ("v", {"y": 5})}, {"y": 3, "x": NX})
    cols = list(zip(*values))
    by_x = [boxcar(r, 3) for r in values]
    for r in got.collect():
        total, n = boxcar(cols[r.x], 5)[r.y]
        assert r.b == pytest.approx(total / n)
        rows_of = [(r.y - 1) if r.y else 0, r.y]
        assert r.a == pytest.approx(
            sum(by_x[y][r.x][0] for y in rows_of) / sum(by_x[y][r.x][1] for y in rows_of)
        )


def test_time_axis_length_differs_between_runs(spark):
    series = {1: [1.0, 5.0, 2.0], 2: [4.0, 0.0, 8.0, 8.0, 1.0, 3.0]}
    df = spark.createDataFrame(
        [(r, t, 0, 0, v) for r, s in series.items() for t, v in enumerate(s)],
        "run_id long, t int, y int, x int, v double",
    )
    got = uniform_smooth(df, {"s": ("v", {"t": 9})}, {"y": 1, "x": 1})
    for r in got.collect():
        assert r.s == pytest.approx(boxcar(series[r.run_id], 9)[r.t][0] / 9)


@pytest.mark.parametrize("sigma, truncate", [(0.7, 4.0), (1.5, 4.0), (1.0, 10.0)])
def test_gaussian(rows, values, sigma, truncate):
    full = rows.withColumn("v", F.coalesce("v", F.lit(1.0)))
    got = gaussian_smooth(full, "v", {"x": sigma}, {"x": NX, "y": 3}, truncate)
    for r in got.collect():
        want = gaussian([1.0 if v is None else v for v in values[r.y]], sigma, truncate)[r.x]
        assert r.v_smooth == pytest.approx(want)
    assert gaussian_smooth(full, "v", {"x": 0}, {"x": NX}).where("v_smooth <> v").count() == 0


def test_series(spark):
    data = {1: [0.0, 4.0, 1.0], 2: [2.0], 3: [1.0, 2.0, 3.0, 9.0, 9.0, 0.0]}
    df = spark.createDataFrame(
        [(0, o, t + 5, v) for o, s in data.items() for t, v in enumerate(s)],
        "run_id long, object_id long, t int, v double",
    )
    for r in smooth_series(df, "v", 1.0, ["run_id", "object_id"], "s").collect():
        assert r.s == pytest.approx(gaussian(data[r.object_id], 1.0)[r.t - 5])


def test_gradient_edges(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, x, float(v)) for x, v in enumerate([1, 4, 9, 16])], "run_id long, t int, y int, x int, v double"
    )
    assert [r.dv_dx for r in gradient(df, "v", "x").orderBy("x").collect()] == [3.0, 4.0, 6.0, 7.0]


def test_local_minima_and_background(spark):
    field = [[5, 5, 5, 0, 0], [5, 1, 5, 0, 0], [5, 5, 5, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]]
    df = spark.createDataFrame(
        [(0, 0, y, x, float(v)) for y, r in enumerate(field) for x, v in enumerate(r)],
        "run_id long, t int, y int, x int, v double",
    )
    got = {(r.y, r.x) for r in local_minima(df, "v").where("is_minimum").collect()}
    want = set()
    for y in range(5):
        for x in range(5):
            near = [field[j][i] for j in range(max(y - 1, 0), min(y + 2, 5)) for i in range(max(x - 1, 0), min(x + 2, 5))]
            if (field[y][x] == min(near)) != all(v == 0 for v in near):
                want.add((y, x))
    assert got == want


def test_densify_adds_missing_cells(spark):
    grid = measure_grid(
        spark.createDataFrame(
            [(y, x, 1.0 * y, 1.0 * x) for y in range(3) for x in range(4)], "y int, x int, lat double, lon double"
        )
    )
    df = spark.createDataFrame([(1, 2, 0, 0, 5.0), (1, 4, 2, 3, 6.0)], "run_id long, t int, y int, x int, pr double")
    got = densify(df, grid, {"pr": 0.0})
    assert (got.count(), got.agg(F.sum("pr")).first()[0]) == (36, 11.0)


# ------------------------------------------------------------- tiles and sparse fields


def sparse_rows(spark, seed, shape, share):
    """Random cells of a run: some absent, some NULL; and the same as a dense array."""
    rng = random.Random(seed)
    nt, ny, nx = shape
    field = np.full(shape, np.nan)
    rows = []
    for t in range(nt):
        for y in range(ny):
            for x in range(nx):
                if rng.random() < share:
                    v = None if rng.random() < 0.1 else rng.uniform(-5, 9)
                    rows.append((1, t, y, x, v, "k"))
                    field[t, y, x] = np.nan if v is None else v
    return spark.createDataFrame(rows, "run_id long, t int, y int, x int, v double, note string"), field


def mirrored_sum(field, axis, offsets, weights):
    n = field.shape[axis]
    total = 0.0
    for k, w in zip(offsets, weights, strict=True):
        at = (np.arange(n) + k) % (2 * n)
        total = total + w * np.take(field, np.where(at < n, at, 2 * n - 1 - at), axis=axis)
    return total


def by_hand(field, sizes):
    total, n = np.nan_to_num(field), (~np.isnan(field)).astype(float)
    for axis, size in enumerate(sizes):
        offsets = range(-(size // 2), size - size // 2)
        total, n = (mirrored_sum(f, axis, offsets, [1.0] * size) for f in (total, n))
    return np.where(n > 0, total / np.where(n > 0, n, 1), np.nan)


@pytest.mark.parametrize("limit", [stencil.MAX_CELLS, 1])
@pytest.mark.parametrize("size", [stencil.TileSize(), stencil.TileSize(2, 3, 4), stencil.TileSize(5, 4, 3)])
def test_sparse_boxes_on_any_tiles(spark, monkeypatch, size, limit):
    """Tiles smaller than the grid, halos longer than a tile, and axes filtered one by one."""
    monkeypatch.setattr(stencil, "MAX_CELLS", limit)
    monkeypatch.setattr(stencil, "FULL_TILE", 1)
    monkeypatch.setattr(stencil.passes, "__defaults__", (size,))
    df, field = sparse_rows(spark, 4, (9, 10, 11), 0.4)
    got = uniform_smooth(df, {"a": ("v", {"t": 5, "y": 4, "x": 7}), "b": ("v", {"x": 30})}, {"y": 10, "x": 11}).collect()
    assert len(got) == df.count() and {r.note for r in got} == {"k"}
    a, b = by_hand(field, (5, 4, 7)), by_hand(field, (1, 1, 30))
    for r in got:
        for have, want in ((r.a, a[r.t, r.y, r.x]), (r.b, b[r.t, r.y, r.x])):
            assert have == (None if np.isnan(want) else pytest.approx(want, abs=1e-9))


def test_wide_box_without_cancellation(spark):
    """A huge and an infinite value stay in the frames which hold them."""
    values = [1e300, float("inf")] + [0.25] * 400
    df = spark.createDataFrame([(0, 0, 0, x, v) for x, v in enumerate(values)], "run_id long, t int, y int, x int, v double")
    got = {r.x: r.s for r in uniform_smooth(df, {"s": ("v", {"x": 21})}, {"y": 1, "x": len(values)}).collect()}
    assert all(got[x] == 0.25 for x in range(12, 402)) and got[5] == float("inf")


@pytest.mark.parametrize("missing", ["null", "skip", 0.0])
def test_sparse_gaussian(spark, missing):
    df, field = sparse_rows(spark, 9, (3, 12, 13), 0.3 if missing == 0.0 else 0.95)
    got = gaussian_smooth(df, "v", {"y": 0.6, "x": 0.6}, {"y": 12, "x": 13}, missing=missing)
    r = int(4 * 0.6 + 0.5)
    weights = [math.exp(-0.5 * (k / 0.6) ** 2) for k in range(-r, r + 1)]
    weights = [w / sum(weights) for w in weights]
    total, n = np.nan_to_num(field), (~np.isnan(field)).astype(float)
    for axis in (1, 2):
        total, n = (mirrored_sum(f, axis, range(-r, r + 1), weights) for f in (total, n))
    if missing == "null":
        want = np.where(n > 1 - 1e-9, total, np.nan)
    else:
        want = total if missing == 0.0 else np.where(np.isnan(field), np.nan, total / np.where(n > 0, n, 1))
    rows = got.collect()
    for row in rows:
        w = want[row.t, row.y, row.x]
        assert row.v_smooth == (None if np.isnan(w) else pytest.approx(w, abs=1e-9))
    places = {(row.t, row.y, row.x) for row in rows}
    held = {(row.t, row.y, row.x) for row in df.collect()}
    if missing == 0.0:  # every cell which the kernel reaches has a row now
        assert places == held | set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True))
    else:
        assert places == held


def test_isolated_cells_keep_their_value(spark):
    """Six sparse cells and sigma 1: none becomes NULL."""
    df = spark.createDataFrame([(0, 0, 5 * i, 3, 8.0) for i in range(6)], "run_id long, t int, y int, x int, v double")
    got = gaussian_smooth(df, "v", {"y": 1.0, "x": 1.0}, {"y": 40, "x": 40}, missing="skip").collect()
    assert [r.v_smooth for r in got] == [pytest.approx(8.0)] * 6


def test_gradient_does_not_read_over_a_gap(spark):
    values = [1.0, 4.0, None, 16.0, 25.0, 36.0]
    df = spark.createDataFrame(
        [(0, 0, 0, x, v) for x, v in enumerate(values) if x != 4], "run_id long, t int, y int, x int, v double"
    )
    got = {r.x: r.dv_dx for r in gradient(df, "v", "x", lengths={"x": 6}).collect()}
    assert got == {0: 3.0, 1: None, 2: 6.0, 3: None, 5: None}


def test_run_lengths_differ(spark):
    """Without given lengths each run has its own ends."""
    rows = [(r, t, 0, x, float(x * x + t)) for r, n in ((1, 3), (2, 70)) for x in range(n) for t in range(r)]
    df = spark.createDataFrame(rows, "run_id long, t int, y int, x int, v double")
    got = {(r.run_id, r.t, r.x): (r.a, r.b) for r in gradients(df, {"a": ("v", "x"), "b": ("v", "t")}).collect()}
    assert got[1, 0, 2] == (3.0, None) and got[2, 1, 69] == (137.0, 1.0) and got[2, 0, 2] == (4.0, 1.0)


def test_plans_have_no_window_and_one_shuffle(spark, rows):
    lengths = {"t": 1, "y": 3, "x": NX}
    for df in (
        uniform_smooth(rows, {"s": ("v", {"t": 5, "y": 3, "x": 9})}, lengths),
        gaussian_smooth(rows, "v", {"y": 1.0, "x": 1.0}, lengths),
        gradients(rows, {"a": ("v", "x"), "b": ("v", "y")}, lengths),
        local_minima(rows, "v", lengths=lengths),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_cells_outside_the_grid_are_an_error(spark):
    df = spark.createDataFrame([(0, 0, 0, 9, 1.0)], "run_id long, t int, y int, x int, v double")
    with pytest.raises(Exception, match="outside its grid"):
        uniform_smooth(df, {"s": ("v", {"x": 3})}, {"y": 1, "x": 5}).collect()
