"""Functions of a cell's neighbourhood, computed on tiles with a halo.

Cells are dealt out by fixed (t, y, x) tiles. A cell also goes to the tiles whose cells see
it within the ``reach`` of the filter, so one shuffle is enough for all axes, and a group
never holds more than one tile with its halo: no run, step or grid line is a group. A tile
is at least as long as the reach, so a cell is copied to three tiles an axis at most, and
not at all on an axis which fits into one tile. Inside a tile the cells stand at their
positions in dense arrays; a missing row or NULL is a missing value there, never the next row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geodesy import KEY_BITS, cell_key

AXES = ("t", "y", "x")
# Cells of a tile with its halo which one task holds at a time.
MAX_CELLS = 1 << 21
# Cells of a tile on a grid with few rows and columns; its tiles hold more steps instead.
FULL_TILE = 1 << 17


@dataclass(frozen=True)
class TileSize:
    """Cells per tile and axis, without the halo."""

    t: int = 16
    y: int = 64
    x: int = 64

    def grown(self, reach: dict[str, int], lengths: dict[str, int | Column]) -> TileSize:
        """Tiles not shorter than the reach, and no longer than the axis."""
        sizes = {}
        for a in AXES:
            size, n = max(getattr(self, a), reach.get(a, 0)), lengths.get(a)
            sizes[a] = min(size, n) if isinstance(n, int) and n > 0 else size
        if reach.get("t", 0):
            sizes["t"] = max(sizes["t"], FULL_TILE // (sizes["y"] * sizes["x"]))
            if isinstance(lengths.get("t"), int):
                sizes["t"] = min(sizes["t"], lengths["t"])
        return TileSize(**sizes)

    def cells(self, reach: dict[str, int], lengths: dict[str, int | Column]) -> int:
        """Cells of one tile with its halo."""
        total = 1
        for a in AXES:
            size, n = getattr(self, a) + 2 * reach.get(a, 0), lengths.get(a)
            total *= min(size, n) if isinstance(n, int) and n > 0 else size
        return total


def mirror(at: np.ndarray, n: int) -> np.ndarray:
    """Positions on an axis of length ``n`` which is mirrored at its ends: a b c | c b a."""
    at = at % (2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


class Tile:
    """Dense arrays of one tile. Arrays start at ``low``; ``home`` are the positions to compute."""

    def __init__(self, low: list[int], shape: list[int], lengths: list[int], home: list[tuple[int, int]], flat: np.ndarray, columns: dict):
        self.low, self.shape, self.lengths, self.home = low, tuple(shape), lengths, home
        self._flat, self._columns = flat, columns

    def field(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where missing) and which are there."""
        column = self._columns[name]
        known = column.is_valid().to_numpy(zero_copy_only=False)
        values, have = np.zeros(np.prod(self.shape)), np.zeros(np.prod(self.shape), bool)
        values[self._flat[known]] = column.drop_null().to_numpy(zero_copy_only=False)
        have[self._flat[known]] = True
        return values.reshape(self.shape), have.reshape(self.shape)

    def first(self, name: str) -> int:
        """A number which is the same in the whole run."""
        return self._columns[name][0].as_py()

    def around(self, field: np.ndarray, axis: str, before: int, after: int) -> np.ndarray:
        """The home positions of one axis with so many neighbours on either side, mirrored at the edges."""
        k = AXES.index(axis)
        first, last = self.home[k]
        at = mirror(np.arange(first - before, last + after), self.lengths[k]) - self.low[k]
        return np.take(field, at, axis=k)

    def inside(self, axis: str, step: int) -> np.ndarray:
        """Whether the neighbour ``step`` away on an axis is on the grid, shaped to multiply a home array."""
        k = AXES.index(axis)
        at = np.arange(*self.home[k]) + step
        shape = [1, 1, 1]
        shape[k] = -1
        return ((at >= 0) & (at < self.lengths[k])).reshape(shape)

    def cut(self, field: np.ndarray, *axes: str) -> np.ndarray:
        """Only the home positions of some axes."""
        for axis in axes:
            k = AXES.index(axis)
            first, last = self.home[k]
            field = np.take(field, np.arange(first, last) - self.low[k], axis=k)
        return field


Kernel = Callable[[Tile], dict[str, tuple[np.ndarray, np.ndarray]]]


def apply_stencil(
    df: DataFrame,
    reach: dict[str, int],
    lengths: dict[str, int | Column],
    inputs: list[str],
    outputs: dict[str, str],
    kernel: Kernel,
    size: TileSize = TileSize(),
    emit: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the ``outputs`` (name: type) which ``kernel`` computes for the home cells of each tile.

    The kernel returns per output the values and which of them are known, both of the shape
    of the home tile. ``lengths`` holds a number per axis, or a column where it differs from
    run to run; an axis without reach needs none. With ``emit``, cells which have no row
    but a known, non-zero value of that output get one (other columns NULL).

    ``keep`` names the other columns to return (all of them by default); only home rows carry
    them. Rows with an index outside the grid raise an error. Equal cells get equal values.
    """
    size = size.grown(reach, lengths)
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("run_id", *AXES, *outputs)]
    spread, home, cell, inside = df, F.lit(True), F.lit(0), F.lit(True)
    sizes, reaches, varying = {}, {}, []
    for a in AXES:
        b, r, n = getattr(size, a), reach.get(a, 0), lengths.get(a)
        own = F.floor(F.col(a) / b).cast("int")
        limit = n if isinstance(n, Column) else F.lit(n)
        inside = inside & (F.col(a) >= 0) & (F.lit(True) if n is None else F.col(a) < limit)
        if isinstance(n, int) and n <= b:
            r, tile, own = 0, F.lit(0), F.lit(0)
        elif r:
            low = F.greatest(F.ceil((F.col(a) - r - b + 1) / b).cast("int"), F.lit(0))
            high = F.least(F.floor((F.col(a) + r) / b), F.floor((limit - 1) / b)).cast("int")
            tile = F.explode(F.sequence(low, F.greatest(high, low)))
        else:
            tile = own
        spread = spread.withColumn(f"_tile_{a}", tile)
        sizes[a], reaches[a] = b, r
        if isinstance(n, Column):
            varying.append(a)
            spread = spread.withColumn(f"_len_{a}", n.cast("int"))
        home = home & (F.col(f"_tile_{a}") == own)
        # one number for the place in the tile and its halo: each column is copied to Python cell by cell
        cell = cell * (b + 2 * r) + (F.col(a) - F.col(f"_tile_{a}") * b + r)
    carried = [F.when(home, F.col(c)).alias(c) if c not in inputs else F.col(c) for c in keep]
    others = [F.col(c) for c in inputs if c not in keep]
    spread = spread.select(
        "run_id",
        cell_key(*(F.col(f"_tile_{a}") for a in AXES)).alias("_tile"),
        F.when(inside, cell.cast("int")).alias("_cell"),
        *carried,
        *others,
        *(f"_len_{a}" for a in varying),
    )
    kinds = {f.name: f.dataType for f in df.schema}
    made_types = {o: T._parse_datatype_string(t) for o, t in outputs.items()}
    schema = T.StructType([T.StructField("run_id", kinds["run_id"]), T.StructField("_at", T.LongType())])
    schema = T.StructType([*schema, *(T.StructField(c, kinds[c]) for c in keep), *(T.StructField(o, t) for o, t in made_types.items())])
    arrow = to_arrow_schema(schema)
    fixed = {a: n for a, n in lengths.items() if isinstance(n, int)}

    def compute(key, table):
        mask = (1 << KEY_BITS) - 1
        run, packed = key[0].as_py(), key[1].as_py()
        tiles = dict(zip(AXES, (packed >> (2 * KEY_BITS), packed >> KEY_BITS & mask, packed & mask), strict=True))
        if table.column("_cell").null_count:
            raise ValueError(f"run {run} has cells outside its grid")
        spans = [sizes[a] + 2 * reaches[a] for a in AXES]
        at = np.unravel_index(table.column("_cell").to_numpy(), spans)
        low, shape, extent, homes = [], [], [], []
        for k, a in enumerate(AXES):
            begin = tiles[a] * sizes[a] - reaches[a]
            n = table.column(f"_len_{a}")[0].as_py() if a in varying else fixed.get(a, begin + int(at[k].max()) + 1)
            first, last = tiles[a] * sizes[a], min((tiles[a] + 1) * sizes[a], n)
            extent.append(n)
            homes.append((first, last))
            low.append(max(first - reaches[a], 0))
            shape.append(min(last + reaches[a], n) - low[k])
            at[k][...] += begin  # positions on the grid
        flat = np.ravel_multi_index([p - q for p, q in zip(at, low, strict=True)], shape)
        columns = {c: table.column(c).combine_chunks() for c in inputs}
        found = kernel(Tile(low, shape, extent, homes, flat, columns))
        here = np.ones(len(flat), bool)
        for p, (first, last) in zip(at, homes, strict=True):
            here &= (p >= first) & (p < last)
        here = np.flatnonzero(here)
        spans = [last - first for first, last in homes]
        place = np.ravel_multi_index([p[here] - first for p, (first, _) in zip(at, homes, strict=True)], spans)
        whole = len(here) == len(flat)
        rows = table if whole else table.take(pa.array(here))

        def keys(index) -> pa.Array:
            t, y, x = index
            return pa.array((t.astype(np.int64) << (2 * KEY_BITS)) + (y.astype(np.int64) << KEY_BITS) + x)

        made = {o: _column(v, k, place, arrow.field(o).type) for o, (v, k) in found.items()}
        made["_at"] = keys([p[here] for p in at])
        out = pa.table([made[f.name] if f.name in made else rows.column(f.name).cast(f.type) for f in arrow], schema=arrow)
        if emit is None:
            return out
        value, known = found[emit]
        fresh = (np.broadcast_to(known, spans) & (np.broadcast_to(value, spans) != 0)).ravel()
        fresh[place] = False
        new = np.flatnonzero(fresh)
        index = [p + first for p, (first, _) in zip(np.unravel_index(new, spans), homes, strict=True)]
        more = {o: _column(v, k, new, arrow.field(o).type) for o, (v, k) in found.items()}
        more |= {"_at": keys(index), "run_id": pa.array([run] * len(new), arrow.field("run_id").type)}
        return pa.concat_tables([out, pa.table([more.get(f.name, pa.nulls(len(new), f.type)) for f in arrow], schema=arrow)])

    done = spread.groupBy("run_id", "_tile").applyInArrow(compute, schema)
    index = {
        "t": F.shiftright("_at", 2 * KEY_BITS),
        "y": F.shiftright("_at", KEY_BITS).bitwiseAND(F.lit((1 << KEY_BITS) - 1)),
        "x": F.col("_at").bitwiseAND(F.lit((1 << KEY_BITS) - 1)),
    }
    return done.select("run_id", *(index[a].cast(kinds[a]).alias(a) for a in AXES), *keep, *outputs)


def _column(values: np.ndarray, known: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values.reshape(-1)[at], kind, mask=~known.reshape(-1)[at])


def passes(
    axes: list[str], reach: dict[str, int], lengths: dict[str, int | Column], size: TileSize = TileSize()
) -> list[tuple[list[str], TileSize]]:
    """Axes which are filtered together, and the tiles for them.

    All at once if a tile with its halo stays small; else axis by axis, on tiles which are
    long in that axis and narrow in the others.
    """
    grown = size.grown(reach, lengths)
    if grown.cells(reach, lengths) <= MAX_CELLS:
        return [(axes, size)]
    narrow = TileSize(8, 16, 16)
    return [([a], TileSize(**{b: getattr(size if a == b else narrow, b) for b in AXES})) for a in axes]


def sliding_sum(field: np.ndarray, axis: int, width: int) -> np.ndarray:
    """Sums of ``width`` neighbours along an axis, as many as fit.

    The axis is cut into stretches of ``width``; each frame is the rest of one stretch and
    the beginning of the next, so nothing is ever subtracted: rounding does not grow with
    the length of the axis, and an infinite value stays in its own frames.
    """
    field = np.moveaxis(field, axis, -1)
    n = field.shape[-1]
    frames = n - width + 1
    pad = -n % width
    blocks = np.concatenate([field, np.zeros((*field.shape[:-1], pad))], axis=-1) if pad else field
    blocks = blocks.reshape(*field.shape[:-1], -1, width)
    ahead = np.cumsum(blocks, axis=-1).reshape(*field.shape[:-1], -1)
    behind = np.cumsum(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(*field.shape[:-1], -1)
    out = behind[..., :frames] + np.where(np.arange(frames) % width == 0, 0.0, ahead[..., width - 1 : n])
    return np.moveaxis(out, -1, axis)
