"""Filters along the axes of fields, dense or sparse.

Neighbours are neighbouring positions, found on tiles with a halo (``stencil``); a missing
row is a missing value. Edges are mirrored: a b c | c b a. Only the series of single
objects are filtered by windows, over one object's steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import Grid
from .joins import join_cells, join_per_run
from .stencil import AXES, Tile, TileSize, apply_stencil, passes, sliding_sum


def densify(cells: DataFrame, grid: Grid, fill: dict[str, float] | None = None) -> DataFrame:
    """Add a row for each grid point and step of a run that has none."""
    span = cells.groupBy("run_id").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    steps = span.select("run_id", F.explode(F.sequence("_t0", "_t1")).alias("t"))
    # spread a long run over many tasks before its steps are opened to cells
    steps = steps.repartition("run_id", "t")
    row = F.explode(F.sequence(F.lit(0), F.lit(grid.ny - 1)))
    col = F.explode(F.sequence(F.lit(0), F.lit(grid.nx - 1)))
    spine = steps.withColumn("y", row).withColumn("x", col)
    # cells are never fewer than a fraction of the spine: no broadcast of either side
    dense = spine.hint("shuffle_hash").join(cells, ["run_id", *AXES], "left")
    return dense.fillna(fill) if fill else dense


@dataclass(frozen=True)
class _Axis:
    """Length of an axis: one number, or a column with a known least value."""

    name: str
    n: Column
    least: int


Lengths = dict[str, int] | Grid


def _with_lengths(df: DataFrame, names: list[str], lengths: Lengths) -> tuple[DataFrame, dict[str, int | Column]]:
    """Lengths of some axes: given, known of the grid (perhaps run by run), or found per run."""
    found: dict[str, int | Column] = {}
    if isinstance(lengths, Grid):
        known = [a for a in names if a != "t"]
        if lengths.runs is None:
            found = {"y": lengths.ny, "x": lengths.nx}
        elif known:
            df = join_per_run(df, lengths.runs.select("run_id", *(F.col(f"n{a}").alias(f"_n_{a}") for a in known)))
            found = {a: F.col(f"_n_{a}") for a in known}
    else:
        found = {a: lengths[a] for a in AXES if a in lengths}
    missing = [a for a in names if a not in found]
    if missing:
        spans = df.groupBy("run_id").agg(*((F.max(a) + 1).cast("int").alias(f"_n_{a}") for a in missing))
        df = join_per_run(df, spans)
        found |= {a: F.col(f"_n_{a}") for a in missing}
    return df, found


def _mirrored(
    df: DataFrame, axis: _Axis, before: int, after: int, by: list[str]
) -> DataFrame:
    """Repeat rows at their mirror positions up to ``before`` / ``after`` beyond the edges.

    Positions go to ``_<axis>``. A row of index i shows up at i and at 2n - 1 - i, both
    shifted by any number of periods of 2n; only rows near an edge are repeated.
    """
    i, n = F.col(axis.name), axis.n
    turns = -(-max(before, after, 1) // (2 * axis.least))
    images = [i + n * (2 * k) for k in range(-turns, turns + 1)]
    images += [n * (2 * k) - 1 - i for k in range(-turns + 1, turns + 2)]
    if before <= axis.least and after <= axis.least:
        images = [i, -1 - i, n * 2 - 1 - i]
    seen = F.array(*[F.when((p >= -before) & (p < n + after), p).cast("long") for p in images])
    near_edge = (i < before) | (i >= n - after)
    # gather the lines first, so that only real rows are shuffled
    df = df.repartition(*by)
    position = F.explode(F.when(near_edge, seen).otherwise(F.array(i.cast("long"))))
    return df.withColumn(f"_{axis.name}", position).where(F.col(f"_{axis.name}").isNotNull())


Line = Callable[[Tile, np.ndarray, str, str], np.ndarray]
Finish = Callable[[np.ndarray, np.ndarray, np.ndarray, str], tuple[np.ndarray, np.ndarray]]


def _full_weight(tile: Tile, axes: list[str], line: Line, out: str) -> np.ndarray:
    """Filtered weights where no cell is missing; along an axis not filtered yet they are equal, so one stands for all."""
    weight = np.ones((1, 1, 1))
    for k, axis in enumerate(AXES):
        if axis in axes:
            weight = line(tile, np.repeat(weight, tile.shape[k], axis=k), axis, out)
    return weight


def _separable(
    df: DataFrame,
    filters: dict[str, tuple[str, dict[str, int]]],
    lengths: Lengths,
    line: Line,
    finish: Finish,
    fill: dict[str, float] | None = None,
    columns: list[str] | None = None,
    keep: list[str] | None = None,
    differences: dict[str, tuple[str, str]] | None = None,
    slopes: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Filter sums of values and of their weights along the axes of each filter.

    ``filters`` maps an output to its column and its reach per axis; ``line`` filters one
    axis of a tile. ``finish`` makes the result from both sums and from where the cell
    itself has a value. ``fill`` tells for at most one output what stands for missing values of
    cells with and without rows; cells without a row get one where that output is not 0.
    ``keep`` names the columns to return beside the outputs (all by default); no others are moved.
    ``differences`` maps an output to two filters: only their differences are returned then.
    ``slopes``, see ``gradients``, are taken beside them if all axes are filtered together.
    """
    fill, slopes = fill or {}, slopes or {}
    if len(fill) > 1:
        raise ValueError("cells without a row can follow one output only")
    names = [a for a in ("x", "y", "t") if any(a in axes for _, axes in filters.values()) or any(a == b for _, b in slopes.values())]
    reach = {a: max(axes.get(a, 0) for _, axes in filters.values()) for a in names}
    reach |= {a: max(reach[a], 1) for _, a in slopes.values()}
    keep = df.columns if keep is None else ["run_id", *AXES, *keep]
    sloped = [c for c, _ in slopes.values()]
    df = df.select(*dict.fromkeys([*keep, *(c for c, _ in filters.values()), *(columns or []), *sloped]))
    df, sizes = _with_lengths(df, names, lengths)
    steps = passes(names, reach, sizes) or [([], TileSize())]
    if slopes and len(steps) > 1:  # wide filters move their own columns only, and meet the slopes once
        own = list(dict.fromkeys([*(c for c, _ in filters.values()), *(columns or [])]))
        alone = _separable(df.select("run_id", *AXES, *own), filters, lengths, line, finish, fill, columns, [], differences)
        return join_cells(gradients(df, slopes, lengths, keep[4:]), alone, ["run_id", *AXES], "left")
    rowed = ["_row"] if len(steps) > 1 else []
    for i, (axes, size) in enumerate(steps):
        first, final = i == 0, i == len(steps) - 1

        def work(tile: Tile, axes: list = axes, first: bool = first, final: bool = final) -> dict:
            made, seen = {}, False
            for out, (col, own) in filters.items():
                value, have = tile.field(col)
                centre = tile.cut(have, *AXES)
                if first:
                    total = np.where(have, value, fill[out]) if out in fill else value
                    weight = None if out in fill or have.all() else have.astype(float)
                else:
                    total, weight = tile.field(f"_s_{out}")[0], tile.field(f"_w_{out}")[0]
                full = weight is None
                for axis in AXES:
                    if axis in axes and axis in own:
                        total = line(tile, total, axis, out)
                        weight = weight if full else line(tile, weight, axis, out)
                    else:
                        total = tile.cut(total, axis)
                        weight = weight if full else tile.cut(weight, axis)
                if full:
                    weight = np.broadcast_to(_full_weight(tile, [a for a in axes if a in own], line, out), total.shape)
                if final:
                    made[out] = finish(total, weight, centre, out)
                else:
                    made |= {f"_s_{out}": (total, weight > 0), f"_w_{out}": (weight, weight > 0)}
                    seen = seen | (weight > 0)
            if not final:
                return made | {"_seen": (seen * 1.0, seen)}
            if differences:
                both = {o: (made[a], made[b]) for o, (a, b) in differences.items()}
                made = {o: (v - w, k & m) for o, ((v, k), (w, m)) in both.items()}
            return made | _slopes(tile, slopes)

        inputs = [c for c, _ in filters.values()] + (columns or []) + ([] if first else [f"_{p}_{o}" for o in filters for p in "sw"]) + sloped
        if final:
            made, emit = dict.fromkeys([*(differences or filters), *slopes], "double"), next(iter(fill), None)
        else:
            made, emit = {f"_{p}_{o}": "double" for o in filters for p in "sw"} | {"_seen": "double"}, "_seen"
        if first and not final:
            df = df.withColumn("_row", F.lit(True))
        near = {a: reach[a] for a in axes}
        df = apply_stencil(df, near, sizes, list(dict.fromkeys(inputs)), made, work, size, emit, [*keep, *rowed] if final else None)
        if not final:  # rows which only carry sums need the length of their run too
            spans = [c for c in df.columns if c.startswith("_n_")] + (columns or [])
            if spans:
                known = df.where("_row").groupBy("run_id").agg(*(F.first(c).alias(c) for c in spans))
                df = join_per_run(df.drop(*spans), known)
    if len(steps) > 1 and not fill:
        df = df.where("_row")
    return df.select(*keep, *(differences or filters), *slopes)


class RunSize(NamedTuple):
    """A size which differs from run to run: its column, and the largest value."""

    column: str
    most: int


Sizes = dict[str, int | RunSize]


def _box_line(sizes: dict[str, Sizes]) -> Line:
    """Sums over boxes. Any 2n neighbours of a mirrored axis hold each cell twice, so a longer
    box is some totals of the axis and the sum over the rest of the box."""

    def line(tile: Tile, field: np.ndarray, axis: str, out: str) -> np.ndarray:
        k = AXES.index(axis)
        n, size = tile.lengths[k], sizes[out][axis]
        if isinstance(size, RunSize):
            size = max(tile.first(size.column), 1)
        turns, rest = divmod(size, 2 * n)
        before = (size // 2) % (2 * n)
        total = 0.0
        if rest:
            total = sliding_sum(tile.around(field, axis, before, rest - 1 - before), k, rest)
        if turns:
            total = total + field.sum(axis=k, keepdims=True) * (2 * turns) * np.ones(tile.inside(axis, 0).shape)
        return total

    return line


def uniform_smooth(
    df: DataFrame,
    filters: dict[str, tuple[str, Sizes]],
    lengths: Lengths,
    keep: list[str] | None = None,
    differences: dict[str, tuple[str, str]] | None = None,
    slopes: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Boxcar means: ``filters`` maps an output name to ``(column, {axis: size})``.

    NULLs and absent rows are left out of the mean, because sums and counts are filtered
    apart and divided once at the end. An even size leans to the left; size 1 or less leaves
    the axis alone. ``lengths`` gives ``y`` and ``x`` or the grid; the number of steps may
    differ between runs and is found here. All filters share one shuffle while a tile with
    its halo is small. ``keep`` names the columns to return beside the means (all by default).
    With ``differences``, which maps an output to two of the filters, the first less the second
    is returned instead of the means. ``slopes``, see ``gradients``, are added, in the same shuffle
    while a tile is small.
    """
    sizes = {
        o: {a: n for a, n in axes.items() if (n.most if isinstance(n, RunSize) else n) > 1} for o, (_, axes) in filters.items()
    }
    fixed = {a: n for a, n in lengths.items()} if isinstance(lengths, dict) else {}
    if isinstance(lengths, Grid):
        fixed = {"y": lengths.ny, "x": lengths.nx}  # the largest of all runs: reach is never more

    def reach(axis: str, size: int | RunSize) -> int:
        size = size.most if isinstance(size, RunSize) else size
        return min(size // 2, fixed[axis]) if axis in fixed else size // 2

    near = {o: (c, {a: reach(a, n) for a, n in sizes[o].items()}) for o, (c, _) in filters.items()}
    columns = sorted({n.column for axes in sizes.values() for n in axes.values() if isinstance(n, RunSize)})

    def finish(total: np.ndarray, weight: np.ndarray, centre: np.ndarray, _: str) -> tuple[np.ndarray, np.ndarray]:
        known = weight > 0
        return np.divide(total, weight, out=np.zeros(total.shape), where=known), known

    return _separable(df, near, lengths, _box_line(sizes), finish, columns=columns, keep=keep, differences=differences, slopes=slopes)


def gaussian_weights(sigma: float, truncate: float) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(w)
    return [v / total for v in w]


def _gaussian_pass(df: DataFrame, col: str, axis: _Axis, weights: list[float], by: list[str]) -> DataFrame:
    r = len(weights) // 2
    df = _mirrored(df, axis, r, r, by)
    at = F.col(f"_{axis.name}")
    w = Window.partitionBy(*by).orderBy(at)
    # lag(-k) reads k rows ahead, so every tap is an O(1) offset in one window
    taps = [F.lag(col, -k).over(w) * weights[k + r] for k in range(-r, r + 1)]
    df = df.withColumn(col, reduce(lambda a, b: a + b, taps))
    return df.where((at >= 0) & (at < axis.n)).drop(f"_{axis.name}")


def smooth_series(
    df: DataFrame, col: str, sigma: float, by: list[str], out: str, truncate: float = 4.0
) -> DataFrame:
    """Gaussian filter over the steps of each series, for example one object's life."""
    life = df.groupBy(*by).agg(F.min("t").alias("_t0"), (F.max("t") - F.min("t") + 1).alias("_n"))
    df = df.join(life, by).withColumn("i", F.col("t") - F.col("_t0")).withColumn(out, F.col(col))
    df = _gaussian_pass(df, out, _Axis("i", F.col("_n"), 1), gaussian_weights(sigma, truncate), by)
    return df.drop("_t0", "_n", "i")


def gaussian_smooth(
    df: DataFrame,
    col: str,
    sigmas: dict[str, float],
    lengths: Lengths,
    truncate: float = 4.0,
    out: str | None = None,
    missing: str | float = "null",
) -> DataFrame:
    """Gaussian filter; sigma 0 leaves an axis alone.

    ``missing`` says what an absent row or NULL under the kernel means: ``"null"`` gives
    NULL, ``"skip"`` leaves it out and scales the other weights up (a missing cell itself
    stays NULL), and a number stands for it, so that cells without a row get one where the
    result is not 0.
    """
    return gaussian_smooths(df, {out or f"{col}_smooth": (col, sigmas, missing)}, lengths, truncate)


def gaussian_smooths(
    df: DataFrame,
    filters: dict[str, tuple[str, dict[str, float], str | float]],
    lengths: Lengths,
    truncate: float = 4.0,
) -> DataFrame:
    """Several Gaussian filters which share one shuffle while a tile with its halo is small.

    ``filters`` maps an output to its column, ``sigmas`` and ``missing``, see ``gaussian_smooth``;
    at most one ``missing`` is a number.
    """
    weights = {o: {a: gaussian_weights(s, truncate) for a, s in sigmas.items() if s > 0} for o, (_, sigmas, _) in filters.items()}
    near = {o: (c, {a: len(w) // 2 for a, w in weights[o].items()}) for o, (c, _, _) in filters.items()}
    missing = {o: m for o, (_, _, m) in filters.items()}
    fill = {o: m for o, m in missing.items() if isinstance(m, (int, float))}

    def line(tile: Tile, field: np.ndarray, axis: str, out: str) -> np.ndarray:
        k, r = AXES.index(axis), near[out][1][axis]
        wide = tile.around(field, axis, r, r)
        n = wide.shape[k] - 2 * r
        total = np.zeros(())
        for step, w in enumerate(weights[out][axis]):
            total = total + w * np.take(wide, np.arange(step, step + n), axis=k)
        return total

    def finish(total: np.ndarray, weight: np.ndarray, centre: np.ndarray, out: str) -> tuple[np.ndarray, np.ndarray]:
        if out in fill:
            return total, np.ones(total.shape, bool)
        known = centre & (weight > 0) if missing[out] == "skip" else weight > 1 - 1e-9
        return np.divide(total, weight, out=np.zeros(total.shape), where=known), known

    return _separable(df, near, lengths, line, finish, fill)


def _slopes(tile: Tile, slopes: dict[str, tuple[str, str]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Central differences inside a tile."""
    made = {}
    for out, (col, axis) in slopes.items():
        value, have = tile.field(col)
        others = [a for a in AXES if a != axis]
        k = AXES.index(axis)
        wide, there = tile.around(tile.cut(value, *others), axis, 1, 1), tile.around(tile.cut(have, *others), axis, 1, 1)
        n = wide.shape[k] - 2
        before, after = np.take(wide, np.arange(n), k), np.take(wide, np.arange(2, n + 2), k)
        # beyond an edge the mirror shows the cell itself, so the difference is one-sided
        span = tile.inside(axis, -1).astype(int) + tile.inside(axis, 1)
        known = np.take(there, np.arange(n), k) & np.take(there, np.arange(2, n + 2), k) & (span > 0)
        made[out] = (after - before) / np.maximum(span, 1), known
    return made


def gradients(
    df: DataFrame, slopes: dict[str, tuple[str, str]], lengths: Lengths | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Central differences with unit spacing, one-sided at the ends of the axis.

    ``slopes`` maps an output to ``(column, axis)``. Neighbours are neighbouring positions:
    where one is missing, the slope is NULL. Axes of one cell have no slope. All slopes
    share one shuffle; axis lengths which are not given are found per run. ``keep`` names
    the columns to return beside the slopes (all by default).
    """
    names = [a for a in AXES if any(a == axis for _, axis in slopes.values())]
    keep = df.columns if keep is None else ["run_id", *AXES, *keep]
    df, sizes = _with_lengths(df, names, lengths or {})
    near = dict.fromkeys(names, 1)
    inputs = list(dict.fromkeys(c for c, _ in slopes.values()))
    df = apply_stencil(df, near, sizes, inputs, dict.fromkeys(slopes, "double"), lambda tile: _slopes(tile, slopes), keep=keep)
    return df.select(*keep, *slopes)


def gradient(df: DataFrame, col: str, axis: str, out: str | None = None, lengths: Lengths | None = None) -> DataFrame:
    """One slope, see ``gradients``."""
    return gradients(df, {out or f"d{col}_d{axis}": (col, axis)}, lengths)


def local_minima(
    df: DataFrame, col: str, out: str = "is_minimum", lengths: Lengths | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Cells equal to the minimum of their 3 x 3 neighbourhood in a step.

    A zero cell among zeros only is background, not a trough. Missing neighbours do not
    count; a missing cell has no answer. ``keep`` names the columns to return beside the
    answer (all by default); no others are moved.
    """
    keep = df.columns if keep is None else ["run_id", *AXES, *keep]
    df, sizes = _with_lengths(df, ["y", "x"], lengths or {})

    def work(tile: Tile) -> dict:
        value, have = tile.field(col)
        low, high = np.where(have, value, np.inf), np.where(have, np.abs(value), 0.0)
        here, known = tile.cut(value, *AXES), tile.cut(have, *AXES)
        for axis in AXES:
            if axis == "t":
                low, high = tile.cut(low, axis), tile.cut(high, axis)
                continue
            k = AXES.index(axis)
            low, high = tile.around(low, axis, 1, 1), tile.around(high, axis, 1, 1)
            n = low.shape[k] - 2
            low = np.minimum.reduce([np.take(low, np.arange(i, i + n), k) for i in range(3)])
            high = np.maximum.reduce([np.take(high, np.arange(i, i + n), k) for i in range(3)])
        return {out: ((here == low) != (high == 0), known)}

    df = apply_stencil(df, {"y": 1, "x": 1}, sizes, [col], {out: "boolean"}, work, keep=keep)
    return df.select(*keep, out)
