import random

import pytest
from brute import flood_fill, key
from pyspark.sql import functions as F

from stormgrid.operators import components as C
from stormgrid.operators import joins
from stormgrid.operators.components import Mask, Tile, label_components, label_masks

SMALL = Tile(2, 3, 3)


def random_cells(seed, share, shape=(5, 8, 9), runs=2):
    rng = random.Random(seed)
    return {
        (r, t, y, x)
        for r in range(runs)
        for t in range(shape[0])
        for y in range(shape[1])
        for x in range(shape[2])
        if rng.random() < share
    }


def frame(spark, cells, extra=None):
    rows = [(*c, *([extra[c]] if extra else [])) for c in sorted(cells)]
    return spark.createDataFrame(rows, "run_id long, t int, y int, x int" + (", g long" if extra else ""))


def labelled(df):
    return {(r.run_id, r.t, r.y, r.x): r.object_key for r in df.collect()}


@pytest.mark.parametrize("share", [0.12, 0.3])
@pytest.mark.parametrize("connectivity", ["space_time", "slice"])
@pytest.mark.parametrize("wrap", [None, 9])
def test_equals_flood_fill(spark, share, connectivity, wrap):
    cells = random_cells(hash((share, connectivity)) % 1000, share)
    got = labelled(label_components(frame(spark, cells), connectivity, wrap_nx=wrap, tile=SMALL))
    assert got == flood_fill(cells, connectivity == "slice", wrap)


def test_same_result_for_any_tile_and_partitioning(spark):
    cells = random_cells(7, 0.2)
    want = flood_fill(cells)
    assert labelled(label_components(frame(spark, cells), tile=Tile(64, 64, 64))) == want
    assert labelled(label_components(frame(spark, cells).repartition(7, "x"), tile=Tile(1, 1, 1))) == want


def test_only_equal_groups_join(spark):
    cells = random_cells(3, 0.6, runs=1)
    group = {c: (c[2] * 7 + c[3] // 2) % 3 for c in cells}
    got = labelled(label_components(frame(spark, cells, group), "slice", within="g", tile=SMALL))
    assert got == flood_fill(cells, True, within=group)


def test_two_masks_in_one_pass(spark):
    cells = random_cells(11, 0.5, runs=1)
    df = frame(spark, cells).withColumn("v", (F.col("x") * 5 + F.col("y") * 3 + F.col("t")) % 7)
    labels = label_masks(df, {"a": F.col("v") >= 3, "b": Mask(F.col("v") <= 4, slice_only=True)}, tile=SMALL)
    rows = labels.keyed_cells().collect()
    v = lambda c: (c[3] * 5 + c[2] * 3 + c[1]) % 7
    a = flood_fill({c for c in cells if v(c) >= 3})
    b = flood_fill({c for c in cells if v(c) <= 4}, True)
    assert {(r.run_id, r.t, r.y, r.x): r.a_key for r in rows if r.a_key is not None} == a
    assert {(r.run_id, r.t, r.y, r.x): r.b_key for r in rows if r.b_key is not None} == b
    assert all(r.a_part is None or r.a_part >= 0 for r in rows)


def test_corner_contact_in_time_and_null_mask(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, 0, 9.0), (0, 1, 1, 1, 9.0), (0, 2, 3, 3, 9.0), (0, 0, 5, 5, None)],
        "run_id long, t int, y int, x int, v double",
    )
    rows = label_masks(df, {"m": F.col("v") > 1}, tile=Tile(1, 1, 1)).keyed_cells().collect()
    assert {(r.t, r.y, r.x): r.m_key for r in rows} == {(0, 0, 0): 0, (1, 1, 1): 0, (2, 3, 3): key(2, 3, 3)}


def test_empty_mask(spark):
    df = spark.createDataFrame([(0, 0, 0, 0)], "run_id long, t int, y int, x int")
    assert label_components(df.where("x > 5")).count() == 0


def test_object_that_fills_everything(spark):
    cells = {(0, t, y, x) for t in range(4) for y in range(6) for x in range(6)}
    assert set(labelled(label_components(frame(spark, cells), tile=SMALL)).values()) == {0}


def test_hot_hub_is_salted_and_still_right(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_ROWS_PER_KEY", 3)
    star = [(1, 0, i, 5) for i in range(6, 40)]
    chain = [(1, 0, i + 1, i) for i in range(100, 130)] + [(1, 0, 101, 6)]
    edges = spark.createDataFrame(star + chain, "run_id long, kind int, u long, v long")
    got = {r.u: r.v for r in C.reduce_to_stars(edges, ["run_id", "kind"]).collect()}
    assert got == {i: 5 for i in [*range(6, 40), *range(100, 131)]}


def test_long_chain_needs_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_ROUNDS", 14)
    edges = spark.range(1, 3000).selectExpr("0L AS run_id", "id AS u", "id - 1 AS v")
    stars = C.reduce_to_stars(edges, ["run_id"])
    assert stars.where("v = 0").count() == 2999


def test_chains_end_at_their_first_node(spark):
    """A long chain, a branching one and one link alone, as the star rounds would reduce them."""
    rng = random.Random(5)
    links = [(1, n, n - 1) for n in range(1, 40)] + [(2, n, rng.randrange(n)) for n in range(1, 60)] + [(3, 9, 4)]
    df = spark.createDataFrame(links, "run_id long, u long, v long")
    got = {(r.run_id, r.u): r.v for r in C.chase_links(df, ["run_id"]).collect()}
    assert got == {(run, u): {1: 0, 2: 0, 3: 4}[run] for run, u, _ in links}
    assert C.chase_links(df.where("run_id > 3"), ["run_id"]) is None


def test_tiles_on_a_small_grid_hold_more_steps(spark):
    """One tile holds 48 steps of 40 x 40 cells, so no object needs a link."""
    tile = Tile().on(40, 40)
    assert tile.t >= 48 and tile.t * tile.y * tile.x <= 32 * 64 * 64
    assert Tile().on(5000, 64) == Tile()
    cells = [(1, t, 5, 7) for t in range(48)]
    df = frame(spark, cells)
    assert label_masks(df, {"m": F.lit(True)}, tile=tile).links is None
    assert labelled(label_components(df, tile=tile)) == labelled(label_components(df))


def test_pieces_are_numbered_through_their_objects(spark):
    cells = [(1, t, y, 3) for t in range(9) for y in range(7)] + [(2, 0, 0, 0), (2, 8, 8, 8)]
    labels = label_masks(frame(spark, cells), {"m": F.lit(True)}, tile=SMALL)
    keys = labels.keyed_cells().select("run_id", F.col("m_key").alias("object_key")).distinct()
    ids = keys.withColumn("object_id", F.col("object_key") * 10 + F.col("run_id"))
    want = {(r.run_id, r.m_part): r.m_key * 10 + r.run_id for r in labels.keyed_cells().collect()}
    found = C.numbered_pieces(labels, "m", ids).collect()
    got = {(r.run_id, r.m_part): r.object_id for r in found}
    assert len(found) == len(got) and want.items() <= got.items()


def test_only_heavy_keys_are_copied(spark, monkeypatch):
    rows = [(1, i) for i in range(50)] + [(2, 1), (3, 2)]
    big = spark.createDataFrame(rows, "k long, part long")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k long, name string")
    want = sorted([(1, i, "a") for i in range(50)] + [(2, 1, "b")])
    light = joins.salted_join(big, table, ["k"], "part")
    assert "Generate" not in light._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(joins, "MAX_ROWS_PER_KEY", 10)
    heavy = joins.salted_join(big, table, ["k"], "part")
    for df in (light, heavy):
        assert sorted(map(tuple, df.select("k", "part", "name").collect())) == want
    left = joins.salted_join(big, table, ["k"], "part", "left").collect()
    assert sorted((r.k, r.part) for r in left) == sorted(rows)
