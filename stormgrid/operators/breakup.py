"""Splitting objects that consist of several bodies into separate tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import KEY_BITS, cell_key
from ..session import stage
from .components import Mask, Tile, chase_links, label_masks
from .joins import join_pieces, salted_join
from .objects import count_parts, dense_ids


def part_overlaps(cells: DataFrame, part: str = "part") -> DataFrame:
    """Cells which two parts of one object share from one step to the next: ``a`` then ``b``.

    A cell stands at its own step and, as the part before, at the next one; most of these
    pairs meet before the shuffle, which a join of the cells with themselves would do twice.
    """
    here = cell_key(F.col("t"), F.col("y"), F.col("x"))
    nobody = F.lit(None).cast("long")
    seen = F.array(
        F.struct(here.alias("cell"), nobody.alias("a"), F.col(part).alias("b")),
        F.struct((here + (1 << (2 * KEY_BITS))).alias("cell"), F.col(part).alias("a"), nobody.alias("b")),
    )
    return (
        cells.select("run_id", "object_key", F.explode(seen).alias("_s"))
        .select("run_id", "object_key", "_s.*")
        .groupBy("run_id", "object_key", "cell")
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL")
        .groupBy("run_id", "a", "b")
        .agg(F.count(F.lit(1)).alias("n_shared"))
    )


def largest_link(overlaps: DataFrame, sizes: DataFrame, side: str) -> DataFrame:
    """Largest partner on ``side`` ("a" before, "b" after) for every part on the other side.

    Equal sizes go to the lowest part. Also counts the partners.
    """
    other = "b" if side == "a" else "a"
    size = sizes.select("run_id", F.col("part").alias(side), F.col("n_cells").alias("_size"))
    rank = F.struct(F.col("_size"), -F.col(side))
    return (
        overlaps.join(size, ["run_id", side])
        .groupBy("run_id", other)
        .agg(F.max_by(side, rank).alias("best"), F.count(F.lit(1)).alias("n"))
    )


def track_links(overlaps: DataFrame, sizes: DataFrame) -> DataFrame:
    """At most one link per part to the step before: ``u`` (later) to ``v`` (earlier).

    A part with several predecessors goes on with the largest. A part with one goes on
    with it only as its largest successor; the other successors begin new tracks.
    """
    before = largest_link(overlaps, sizes, "a").select("run_id", F.col("b").alias("u"), F.col("best").alias("v"), "n")
    after = largest_link(overlaps, sizes, "b").select("run_id", F.col("a").alias("v"), F.col("best").alias("heir"))
    return (
        before.join(after, ["run_id", "v"])
        .where((F.col("n") > 1) | (F.col("heir") == F.col("u")))
        .select("run_id", "u", "v")
    )


def breakup_objects(
    cells: DataFrame,
    min_steps: int | Column,
    avg_parts: float = 1.5,
    wrap_nx: int | DataFrame | None = None,
    tile: Tile = Tile(),
) -> DataFrame:
    """Renumber objects after splitting those with more than ``avg_parts`` bodies per step.

    ``cells`` has ``run_id, t, y, x, object_key``. Bodies are slice components; they are
    chained over time by ``track_links`` as one graph problem, not step by step. Tracks
    shorter than ``min_steps`` (a number, or a column over ``run_id``) are dropped. The
    result has ``object_id`` instead of ``object_key``.
    """
    body = Mask(F.lit(True), slice_only=True, within="object_key")
    labels = label_masks(cells, {"body": body}, wrap_nx, tile)
    pieces = labels.cells.groupBy("run_id", "object_key", "t", "body_part").agg(
        F.count(F.lit(1)).alias("n_cells")
    )
    pieces = stage(labels.objects_of(pieces, "body", "body_part", "part"), "bodies")
    bodies = pieces
    if labels.links is not None:
        bodies = pieces.groupBy("run_id", "object_key", "t", "part").agg(F.sum("n_cells").alias("n_cells"))
    gate = count_parts(bodies).withColumn("_split", F.col("mean_parts") > avg_parts).drop("mean_parts")
    gated = stage(salted_join(pieces, gate, ["run_id", "object_key"], "body_part"), "gated")
    split = gated.where("_split")

    # the overlaps of all objects, cut to the split ones, cost less than to find the cells of those
    shared = part_overlaps(labels.cells, "body_part")
    shared = shared.join(split.select("run_id", F.col("body_part").alias("a")), ["run_id", "a"], "left_semi")
    for side in ("a", "b") if labels.links is not None else ():  # else each piece is a body
        named = pieces.select("run_id", F.col("body_part").alias(side), F.col("part").alias(f"_{side}"))
        shared = shared.join(named, ["run_id", side]).drop(side).withColumnRenamed(f"_{side}", side)
    shared = stage(shared.groupBy("run_id", "a", "b").agg(F.sum("n_shared").alias("n_shared")), "overlaps")
    roots = chase_links(track_links(shared, bodies), ["run_id"])

    split = split.withColumn("track_key", F.col("part"))
    if roots is not None:
        root = roots.select("run_id", F.col("u").alias("part"), F.col("v").alias("_root"))
        split = split.join(root, ["run_id", "part"], "left")
        split = split.withColumn("track_key", F.coalesce("_root", "part"))
    whole = gated.where("NOT _split").withColumn("track_key", F.col("first_part"))
    cols = ["run_id", "t", "body_part", "track_key"]
    tracks = stage(whole.select(*cols).unionByName(split.select(*cols)), "tracks")
    life = tracks.groupBy("run_id", "track_key").agg((F.max("t") - F.min("t") + 1).alias("_life"))
    ids = dense_ids(life.where(F.col("_life") >= min_steps), "track_key")
    final = salted_join(tracks, ids, ["run_id", "track_key"], "body_part")
    final = final.select("run_id", "body_part", "object_id")
    return join_pieces(labels.cells, final, ["run_id", "body_part"]).drop("body_part", "object_key")
