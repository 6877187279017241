"""What grows with the cells must not be shuffled twice, collected, or sent to every task."""

import re

from pyspark.sql import functions as F
from stormgrid.catalog import inputs as I
from stormgrid.catalog import queries as Q
from stormgrid.catalog.queries import CELL, SIZE
from stormgrid.config import CloudConfig, RainConfig
from stormgrid.operators.breakup import part_overlaps
from stormgrid.operators.grid import measure_grid
from stormgrid.operators.joins import cells_at
from stormgrid.operators.overlap import bbox_min, overlap_pairs
from stormgrid.operators import stencil
from stormgrid.operators.smoothing import gaussian_smooth, gradients, local_minima
from stormgrid.plans import kinds
from stormgrid.plans.kinds import FRONT_SLOPES, cells_around, neighbourhood_mean, pressure_anomaly
from stormgrid.plans.storms import smooth_fields
from stormgrid.session import stage


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"(?:Broadcast)?Exchange [^,\]]+", text)


def test_cells_are_opened_after_their_runs_were_dealt(spark, sf_dir):
    """The only shuffles are those of suppliers and runs, below the rows which open them."""
    for make in (I.storm_cells, I.dense_fields):
        text = plan(make(spark, sf_dir))
        assert exchanges(text[: text.rindex("Generate")]) == [], text


def test_a_filter_shuffles_no_cell_of_runs_which_lie_together(spark, sf_dir):
    df = gaussian_smooth(I.dense_fields(spark, sf_dir).select(*CELL, "pr"), "pr", {"y": 1.0, "x": 1.0}, SIZE)
    text = plan(df)
    assert exchanges(text[: text.rindex("Generate")]) == [], text


def test_boxes_and_cells_meet_without_a_broadcast_of_either(spark, sf_dir):
    """The cells are opened from a few suppliers, so their size is guessed a thousand times too small."""
    cells = I.storm_cells(spark, sf_dir)
    steps = cells.where("pr >= 20").selectExpr("run_id", "0 AS object_key", "t", "y AS y_min", "y AS y_max", "x AS x_min", "x AS x_max")
    text = plan(bbox_min(steps, steps, cells.where("bt <= 241"), "object_key", "bt"))
    assert len(re.findall("SortMergeJoin", text)) >= 2, text
    assert not re.search(r"BroadcastHashJoin \[(_level|run_id)#\w+, (run_id|t)#\w+, (t|_by)#", text), text


def test_staged_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    same = spark.range(1 << 20).selectExpr("id % 2 AS k", "1 AS v")
    a, b = stage(same, "a"), stage(same, "b")
    assert "SortMergeJoin" in plan(a.join(b, "k"))
    assert "BroadcastHashJoin" in plan(a.join(F.broadcast(b), "k"))


def test_fields_are_aligned_without_a_broadcast_of_either(spark, sf_dir):
    """Both fields are opened from a few suppliers; one of them was collected in the driver."""
    text = plan(Q.aligned_fields(spark, sf_dir))
    assert "SortMergeJoin" in text and "BroadcastExchange" not in text, text


def test_cells_around_centres_are_found_where_they_lie(spark, sf_dir):
    """A join with the centres shuffled the whole dense fields, three times in a query."""
    fields, tasks = I.dense_fields(spark, sf_dir).select(*CELL, "tk"), I.run_tasks(spark, sf_dir)
    rows = [(0, 5, 3, 0, 0), (0, 6, 3, 39, 39), (0, 7, 3, 39, 38), (0, 8, 99, 1, 1)]
    points = spark.createDataFrame(rows, "run_id long, object_id long, t long, y long, x long")
    text = plan(cells_at(fields, points, CELL, tasks))
    assert exchanges(text[: text.rindex("Generate")]) == [] and "Union" in text, text
    assert {(r.t, r.y, r.x) for r in cells_at(fields, points, CELL, tasks).collect()} == {(3, 0, 0), (3, 39, 39), (3, 39, 38)}
    joined = sorted(neighbourhood_mean(points, fields, "tk").collect())
    assert sorted(neighbourhood_mean(points, fields, "tk", tasks=tasks).collect()) == joined and len(joined) == 4


def test_lows_carry_their_fields_through_the_labelling(spark, sf_dir):
    cells, fields = Q._low_cells(spark, sf_dir)
    assert {"slp_hpa", "tk"} <= set(cells.columns) and "Generate" in plan(fields)
    same = cells.join(fields.withColumnsRenamed({"slp_hpa": "p", "tk": "k"}), CELL, "left").where("p <=> slp_hpa AND k <=> tk")
    assert same.count() == cells.count() == I.storm_cells(spark, sf_dir).where("pr >= 5").count()


def test_parts_of_one_object_overlap_from_step_to_step_only(spark):
    """``t, x, part``: part 1 goes on as 2 and 3; equal cells of another object or after a gap do not count."""
    rows = [(0, 0, 1, 7), (0, 1, 1, 7), (0, 2, 1, 7), (1, 0, 2, 7), (1, 1, 2, 7), (1, 2, 3, 7), (1, 3, 3, 7), (3, 0, 4, 7), (2, 0, 5, 8)]
    cells = spark.createDataFrame([(9, t, 0, x, p, o) for t, x, p, o in rows], "run_id long, t long, y long, x long, part long, object_key long")
    found = {(r.a, r.b): r.n_shared for r in part_overlaps(cells).collect()}
    assert found == {(1, 2): 2, (1, 3): 1}
    assert len(re.findall("Exchange hashpartitioning", plan(part_overlaps(cells)))) == 2


def test_front_diagnostic_moves_only_what_it_needs(spark, sf_dir):
    from stormgrid.operators.grid import measure_grid
    from stormgrid.plans.kinds import frontal_diagnostic

    cells, grid = I.dense_fields(spark, sf_dir), measure_grid(I.base_grid(spark), regular=True)
    slim, whole = frontal_diagnostic(cells, grid, keep=[]), frontal_diagnostic(cells, grid)
    assert set(slim.columns) == {*CELL, "front", "t_gradient"} and set(cells.columns) < set(whole.columns)
    assert slim.exceptAll(whole.select(slim.columns)).count() == 0


def test_slopes_and_means_share_one_pass(spark, sf_dir, monkeypatch):
    """Slopes and pressure were filtered apart, and all dense fields were shuffled to meet again."""
    g = measure_grid(I.base_grid(spark), regular=True)
    df = I.dense_fields(spark, sf_dir).where("t < 4").select(*CELL, "u", "v", "tk", "slp")
    both = pressure_anomaly(df, g, nt=4, keep=["tk"], slopes=FRONT_SLOPES)
    text = plan(both)
    assert exchanges(text[: text.rindex("Generate")]) == [], text
    apart = gradients(df, FRONT_SLOPES, g, ["tk"]).join(pressure_anomaly(df.select(*CELL, "slp"), g, nt=4, keep=[]), CELL)
    assert both.exceptAll(apart.select(both.columns)).count() == 0 and both.count() == df.count()
    monkeypatch.setattr(stencil, "MAX_CELLS", 1000)  # several passes
    wide = pressure_anomaly(df, g, nt=4, keep=["tk"], slopes=FRONT_SLOPES)
    whole = wide.withColumn("anomaly", F.round("anomaly", 6)).exceptAll(both.select(wide.columns).withColumn("anomaly", F.round("anomaly", 6)))
    assert "Join" in plan(wide) and whole.count() == 0 and wide.count() == df.count()


def test_steps_too_short_for_a_river_get_no_rectangle(spark, monkeypatch):
    """Rectangles of all the small bodies were a large part of the time of rivers."""
    grid = measure_grid(I.base_grid(spark))
    at = [(1, 0, y, x) for y in (3, 4) for x in range(12)] + [(2, 0, y, x) for y in (9, 10) for x in (3, 4, 5)] + [(1, 1, 0, 0)]
    cells = spark.createDataFrame([(0, o, t, y, x, 1.0, 1.0) for o, t, y, x in at], "run_id long, object_id long, t int, y int, x int, value double, area_m2 double")
    steps = kinds.object_stats(kinds.step_table(cells, ["run_id", "object_id"], "value"), grid)
    measured, extent = [], kinds.object_extent
    monkeypatch.setattr(kinds, "object_extent", lambda df: measured.append(df.select("object_id", "t").distinct().count()) or extent(df))
    found = [tuple(r)[:3] for r in kinds.river_steps(cells, steps, grid, Q.WET).collect()]
    assert found == [(0, 1, 0)] and measured == [1]
    assert len(kinds.river_steps(cells, steps, grid, Q.WET, compat=True).collect()) == 2 and measured == [1, 3]


def test_only_cells_in_the_boxes_of_a_step_meet_them(spark):
    cells = spark.range(2 * 100).selectExpr("0L AS run_id", "CAST(id div 100 AS INT) AS t", "CAST(id div 10 % 10 AS INT) AS y", "CAST(id % 10 AS INT) AS x")
    given = spark.createDataFrame([(0, 1, 2, 3), (0, 1, 4, 9)], "run_id long, t int, y int, x int")
    found = {(r.t, r.y, r.x) for r in cells_around(cells, given, False).collect()}
    assert found == {(1, y, x) for y in range(1, 6) for x in range(2, 10)}
    assert cells_around(cells, given, True).count() == 5 * 10


def test_pressure_moves_only_what_is_used(spark, sf_dir):
    """The anomaly is taken inside the tile, and the dense fields of cyclones are not written."""
    g, df = Q._lows(spark, sf_dir)
    text = plan(df)
    filtered = next(line for line in text.splitlines() if "FlatMapGroupsInArrow" in line)
    assert "_fine" not in filtered and "_coarse" not in filtered and not re.search(r"\bslp#", filtered), filtered
    assert "Generate" in text  # the cells are opened in the same job
    lows = I.dense_fields(spark, sf_dir).where("(x + y + t) % 5 > 0 AND t < 12").select(*CELL, "slp", "u")
    whole, some = (pressure_anomaly(lows, g, Q.LOWS, nt=I.NT, keep=k) for k in (None, []))
    assert whole.columns == [*CELL, "slp", "u", "slp_hpa", "anomaly"] and some.columns == [*CELL, "anomaly"]
    both = whole.select(*CELL, "anomaly").exceptAll(some).unionAll(some.exceptAll(whole.select(*CELL, "anomaly")))
    assert both.count() == 0 and some.where("anomaly IS NOT NULL").count() == lows.count() > 0


def test_minima_move_only_what_is_used(spark, sf_dir):
    df = local_minima(I.dense_fields(spark, sf_dir).select(*CELL, "bt", "slp"), "bt", lengths=SIZE, keep=[])
    filtered = next(line for line in plan(df).splitlines() if "FlatMapGroupsInArrow" in line)
    assert df.columns == [*CELL, "is_minimum"] and not re.search(r"\bslp#", filtered), filtered


def test_rain_and_temperature_are_smoothed_in_one_pass(spark, sf_dir):
    """Rows which only smoothed rain reaches have no temperature, as after one filter at a time."""
    cells = I.storm_cells(spark, sf_dir).where("pr >= 1.5")
    cells = cells.withColumn("bt", F.when((F.col("x") + F.col("y")) % 13 > 0, F.col("bt")))
    grid = measure_grid(I.base_grid(spark))
    got = smooth_fields(cells, grid, RainConfig(smooth_sigma=1.0), CloudConfig(smooth_sigma=2.0))
    text = plan(got)
    assert text.count("FlatMapGroupsInArrow") == 1 and exchanges(text[: text.rindex("Generate")]) == [], text
    want = gaussian_smooth(cells, "bt", {"y": 2.0, "x": 2.0}, grid, missing="skip")
    want = gaussian_smooth(want, "pr", {"y": 1.0, "x": 1.0}, grid, missing=0.0)
    want = want.withColumn("pr", F.coalesce("pr", F.lit(0.0))).select(got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.where("bt_smooth IS NULL AND pr_smooth > 0").count() > 0


def test_overlaps_in_one_table_join_no_cells(spark):
    rows = [(0, 0, 0, 1, 5), (0, 0, 1, 1, 5), (0, 1, 1, 1, 6), (1, 0, 0, 2, None), (1, 0, 1, None, 6)]
    cells = spark.createDataFrame([(3, t, y, x, a, b) for t, y, x, a, b in rows], "run_id long, t int, y int, x int, pr_id long, bt_id long")
    found = overlap_pairs(cells, cells, "pr_id", "bt_id")
    assert "Join" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(3, 1, 5, 2), (3, 1, 6, 1)]
    apart = overlap_pairs(cells, cells.select("*"), "pr_id", "bt_id")
    assert sorted(map(tuple, apart.collect())) == [(3, 1, 5, 2), (3, 1, 6, 1)]
