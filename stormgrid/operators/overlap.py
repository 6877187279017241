"""Relating objects of two kinds: who lies over whom, how large, how cold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Labels
from .joins import join_cells

# Sides of the square blocks in which boxes meet cells.
SIDES = (16, 64, 256)


def overlap_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Distinct pairs of objects which share a cell, with the number of shared cells.

    If ``a`` is ``b``, one row per cell, both numbers are in one row and no cells are joined.
    """
    cell = ["run_id", "t", "y", "x"]
    if a is b:
        both = a.where(F.col(a_id).isNotNull() & F.col(b_id).isNotNull())
    else:
        left = a.where(F.col(a_id).isNotNull()).select(*cell, a_id)
        right = b.where(F.col(b_id).isNotNull()).select(*cell, b_id)
        both = join_cells(left, right, cell)
    return both.groupBy("run_id", a_id, b_id).agg(F.count(F.lit(1)).alias("n_shared"))


def labelled_overlaps(labels: Labels, a: str, b: str) -> DataFrame:
    """Overlaps of two kinds which were labelled together.

    Both pieces of a cell are in one row, so no join of cells is needed; piece pairs
    are counted first and then summed up to object pairs ``a_key, b_key``.
    """
    pa, pb = f"{a}_part", f"{b}_part"
    pairs = (
        labels.cells.where(F.col(pa).isNotNull() & F.col(pb).isNotNull())
        .groupBy("run_id", pa, pb)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = labels.objects_of(pairs, a, pa, f"{a}_key")
    pairs = labels.objects_of(pairs, b, pb, f"{b}_key")
    return pairs.groupBy("run_id", f"{a}_key", f"{b}_key").agg(F.sum("n").alias("n_shared"))


def effective_pairs(pairs: DataFrame, bounds: DataFrame, a_id: str, b_id: str, compat: bool) -> DataFrame:
    """Pairs used for classification.

    In compat mode an object which is wholly covered loses its lowest partner, as in
    earlier releases of the method which took that partner for the background.
    """
    if not compat:
        return pairs
    covered = pairs.groupBy("run_id", a_id).agg(
        F.sum("n_shared").alias("_n"), F.min(b_id).alias("_lowest")
    )
    lost = covered.join(bounds.select("run_id", a_id, "n_cells"), ["run_id", a_id]).where(
        F.col("_n") == F.col("n_cells")
    )
    return pairs.join(
        lost.select("run_id", a_id, F.col("_lowest").alias(b_id)), ["run_id", a_id, b_id], "left_anti"
    )


def partner_area(
    pairs: DataFrame, objects: DataFrame, partner_steps: DataFrame, a_id: str, b_id: str
) -> DataFrame:
    """Total area of all partners in each step of an object's lifetime.

    Pairs are opened over the steps which both lives share, so the join on
    ``(partner, step)`` is as large as its result and has no hot key. ``pairs`` and
    ``objects`` carry the keys ``a_id`` and ``b_id``.
    """
    b_life = partner_steps.groupBy("run_id", b_id).agg(F.min("t").alias("_b0"), F.max("t").alias("_b1"))
    life = objects.select("run_id", a_id, F.col("t_min").alias("_a0"), F.col("t_max").alias("_a1"))
    shared = (
        pairs.select("run_id", a_id, b_id)
        .join(life, ["run_id", a_id])
        .join(b_life, ["run_id", b_id])
        .withColumn("_lo", F.greatest("_a0", "_b0"))
        .withColumn("_hi", F.least("_a1", "_b1"))
        .where(F.col("_lo") <= F.col("_hi"))
        .select("run_id", a_id, b_id, F.explode(F.sequence("_lo", "_hi")).alias("t"))
    )
    return (
        shared.join(partner_steps.select("run_id", b_id, "t", "size_m2"), ["run_id", b_id, "t"])
        .groupBy("run_id", a_id, "t")
        .agg(F.sum("size_m2").alias("partner_m2"))
    )


def _span(lo: Column, hi: Column) -> Column:
    """The numbers ``lo`` to ``hi``; none if ``lo > hi``."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def _touched(axis: str) -> tuple[Column, Column]:
    """First and last smallest block which a box meets on an axis."""
    return F.floor(F.col(f"{axis}_min") / SIDES[0]), F.floor(F.col(f"{axis}_max") / SIDES[0])


def _inner(axis: str, side: int) -> tuple[Column, Column]:
    """First and last block of a side which lies wholly in the box on an axis."""
    return F.ceil(F.col(f"{axis}_min") / side), F.floor((F.col(f"{axis}_max") + 1) / side) - 1


def box_blocks(boxes: DataFrame) -> DataFrame:
    """Boxes cut into blocks ``_level, _by, _bx``, each cell of a box in exactly one of them.

    Blocks of level 0 and more (sides 16, 64, 256) lie wholly inside the box and in no larger
    block which does; those of level -1 have the smallest side and hold the rest of the box.
    A level is a ring, as long as the rim of the box in blocks of its side, and only the
    largest blocks fill an area.
    """
    levels = []
    for level in range(-1, len(SIDES)):
        side = SIDES[max(level, 0)]
        y, x = (_touched("y"), _touched("x")) if level < 0 else (_inner("y", side), _inner("x", side))
        columns = _span(*x)
        if level < len(SIDES) - 1:
            larger = SIDES[level + 1]
            (y0, y1), (x0, x1) = _inner("y", larger), _inner("x", larger)
            k = larger // side
            # blocks of this side which the larger ones cover
            hole = F.col("_by").between(y0 * k, y1 * k + k - 1) & (x0 <= x1)
            columns = F.when(hole, F.concat(_span(x[0], x0 * k - 1), _span(x1 * k + k, x[1]))).otherwise(columns)
        rows = boxes.withColumn("_by", F.explode(_span(*y))).withColumn("_bx", F.explode(columns))
        levels.append(rows.withColumn("_level", F.lit(level)))
    return reduce(DataFrame.unionAll, levels)


def bbox_reduce(
    steps: DataFrame, bounds: DataFrame, cells: DataFrame, a_id: str, cols: dict[str, tuple[str, str]]
) -> DataFrame:
    """Reduce the given cells inside each object's box, per step.

    ``cols`` maps a new column to ``(how, column)`` with ``min``, ``sum`` or ``count``. The box
    of an object covers its whole life. Its blocks meet a pyramid of reduced blocks, only its
    rim meets single cells. Steps without any cell in their box have no row.
    """
    first = {"min": F.min, "sum": F.sum, "count": F.count}
    again = {"min": F.min, "sum": F.sum, "count": F.sum}
    box = steps.select("run_id", a_id, "t").join(
        bounds.select("run_id", a_id, "y_min", "y_max", "x_min", "x_max"), ["run_id", a_id]
    )
    blocks = box_blocks(box)
    smallest = [F.floor(F.col(c) / SIDES[0]).alias(f"_b{c}") for c in ("y", "x")]
    used = sorted({c for _, c in cols.values()})
    placed = cells.select("run_id", "t", *smallest, "y", "x", *[F.col(c).alias(f"_v_{c}") for c in used])
    at = ["run_id", "t", "_by", "_bx"]
    low = placed.groupBy(*at).agg(*[first[how](f"_v_{c}").alias(out) for out, (how, c) in cols.items()])
    up = [
        F.struct(F.lit(i).alias("_level"), *[F.floor(F.col(c) / (s // SIDES[0])).alias(c) for c in ("_by", "_bx")])
        for i, s in enumerate(SIDES)
    ]
    pyramid = low.withColumn("_up", F.explode(F.array(*up))).drop("_by", "_bx").select("run_id", "t", "_up.*", *cols)
    merged = [again[how](out).alias(out) for out, (how, _) in cols.items()]
    pyramid = pyramid.groupBy("_level", *at).agg(*merged)
    whole = join_cells(blocks.where("_level >= 0"), pyramid, ["_level", *at]).select("run_id", a_id, "t", *cols)
    rim = join_cells(blocks.where("_level < 0"), placed, at).where(
        F.col("y").between(F.col("y_min"), F.col("y_max"))
        & F.col("x").between(F.col("x_min"), F.col("x_max"))
    )
    rim = rim.groupBy("run_id", a_id, "t").agg(*[first[how](f"_v_{c}").alias(out) for out, (how, c) in cols.items()])
    return whole.unionByName(rim).groupBy("run_id", a_id, "t").agg(*merged)


def bbox_min(
    steps: DataFrame, bounds: DataFrame, cells: DataFrame, a_id: str, col: str
) -> DataFrame:
    """Minimum of ``col`` over the given cells inside each object's box, per step."""
    return bbox_reduce(steps, bounds, cells, a_id, {f"{col}_min": ("min", col)})


def bbox_mean(
    steps: DataFrame, bounds: DataFrame, cells: DataFrame, a_id: str, col: str, out: str
) -> DataFrame:
    """Mean of ``col`` over the given cells inside each object's box, per step, NULLs left out."""
    sums = bbox_reduce(steps, bounds, cells, a_id, {"_sum": ("sum", col), "_n": ("count", col)})
    return sums.select("run_id", a_id, "t", (F.col("_sum") / F.nullif(F.col("_n"), F.lit(0))).alias(out))


def exclude_overlapping(
    steps: DataFrame,
    bounds: DataFrame,
    other: DataFrame,
    a_id: str,
    min_abs_lat: float = 25.0,
    signed: bool = False,
) -> DataFrame:
    """Drop object steps whose box contains a cell of another kind poleward of a latitude.

    ``other`` has ``run_id, t, y, x, lat``. ``signed`` looks at the northern side only.
    """
    lat = F.col("lat") if signed else F.abs("lat")
    poleward = other.where(lat >= min_abs_lat).withColumn("_one", F.lit(1))
    hit = bbox_min(steps, bounds, poleward, a_id, "_one")
    return steps.join(hit.select("run_id", a_id, "t"), ["run_id", a_id, "t"], "left_anti")
