from stormgrid.operators.breakup import breakup_objects
from stormgrid.operators.components import Tile


def tracks(spark, bodies, min_steps=1, tile=Tile(), avg_parts=1.2):
    """``bodies``: (t, x_from, x_to) on one row, all one object."""
    rows = [(0, t, 0, x, 7) for t, a, b in bodies for x in range(a, b + 1)]
    df = spark.createDataFrame(rows, "run_id long, t int, y int, x int, object_key long")
    got = breakup_objects(df, min_steps, avg_parts, tile=tile)
    return {(r.t, r.x): r.object_id for r in got.collect()}


def test_split_keeps_the_number_on_the_largest(spark):
    got = tracks(spark, [(0, 0, 9), (1, 0, 5), (1, 7, 9), (2, 0, 5), (2, 7, 9)])
    assert got[0, 0] == got[1, 0] == got[2, 0] == 1
    assert got[1, 7] == got[2, 7] == 2


def test_equal_halves_go_to_the_lowest(spark):
    got = tracks(spark, [(0, 0, 8), (1, 0, 3), (1, 5, 8)])
    assert (got[1, 0], got[1, 5]) == (1, 2)


def test_merge_goes_on_with_the_largest_predecessor(spark):
    got = tracks(spark, [(0, 0, 2), (0, 4, 9), (1, 0, 2), (1, 4, 9), (2, 0, 9)])
    assert got[2, 0] == got[1, 4] == got[0, 4] == 2
    assert got[0, 0] == got[1, 0] == 1


def test_split_then_merge(spark):
    got = tracks(spark, [(0, 0, 9), (1, 0, 2), (1, 4, 9), (2, 0, 2), (2, 4, 9), (3, 0, 9)])
    assert got[0, 0] == got[1, 4] == got[2, 4] == got[3, 0]
    assert got[1, 0] == got[2, 0] != got[0, 0]


def test_appear_and_vanish(spark):
    got = tracks(spark, [(0, 0, 3), (1, 0, 3), (1, 6, 8), (2, 6, 8)], avg_parts=1.0)
    assert len({got[0, 0], got[1, 0]}) == 1 and got[1, 6] == got[2, 6] != got[0, 0]


def test_short_tracks_are_dropped_and_numbers_stay_dense(spark):
    got = tracks(spark, [(0, 0, 9), (1, 0, 5), (1, 7, 9), (2, 0, 5)], min_steps=2)
    assert set(got.values()) == {1} and (1, 7) not in got


def test_few_parts_stay_whole(spark):
    got = tracks(spark, [(0, 0, 9), (1, 0, 5), (1, 7, 9), (2, 0, 5)], avg_parts=1.5)
    assert set(got.values()) == {1} and len(got) == 25


def test_same_tracks_for_any_tile(spark):
    bodies = [(0, 0, 9), (1, 0, 2), (1, 4, 9), (2, 0, 2), (2, 4, 9), (3, 0, 9), (4, 1, 3), (4, 6, 9)]
    assert tracks(spark, bodies) == tracks(spark, bodies, tile=Tile(1, 1, 2))
