"""Connected components of mask cells in space and time.

Two steps keep every task bounded, whatever the size of an object:

1. Cells are grouped by fixed (t, y, x) tiles, each with a one-cell border from the
   next tile on every axis, and labelled inside the tile. A group never holds more
   than one tile. The label of a tile piece is the key of its first cell.
2. Border cells occur in several tiles; each links the pieces which claim it. The
   links form a graph of pieces, thousands of times smaller than the cells, which is
   reduced to stars with alternating large-star and small-star joins (Kiveris et al.,
   "Connected Components in MapReduce and Beyond", SoCC 2014).

An object is named by the key of its first cell in (t, y, x) order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geodesy import KEY_BITS, cell_key
from ..session import stage
from .joins import MAX_ROWS_PER_KEY, join_per_run, salted_join

MAX_ROUNDS = 60


@dataclass(frozen=True)
class Tile:
    """Cells per tile and axis; t*y*x bounds the rows of one labelling group."""

    t: int = 32
    y: int = 64
    x: int = 64

    def on(self, ny: int, nx: int) -> Tile:
        """Tiles of as many cells on a grid with few rows and columns: they hold more steps instead.

        Objects which lie in one tile need no links, so fewer of them have any.
        """
        y, x = max(min(self.y, ny), 1), max(min(self.x, nx), 1)
        return Tile(max(self.t, self.t * self.y * self.x // (y * x)), y, x)


@dataclass(frozen=True)
class Mask:
    """Cells to join into objects.

    ``slice_only`` joins inside one time step (8 neighbours) instead of space and time
    (26 neighbours). With ``within``, only cells with an equal value there are joined.
    """

    cond: Column
    slice_only: bool = False
    within: str | None = None


@dataclass(frozen=True)
class Labels:
    """Labelled cells.

    ``cells`` has one ``<kind>_part`` column per mask: the tile piece of each cell.
    ``links`` maps the pieces of multi-tile objects to their object key; pieces which
    are missing there are whole objects. ``None`` means that no piece is linked.
    """

    cells: DataFrame
    links: DataFrame | None
    kinds: list[str]

    def objects_of(self, pieces: DataFrame, kind: str, part: str = "part", out: str = "object_key") -> DataFrame:
        """Add the object key to a table of pieces (non-null ``part``)."""
        if self.links is None:
            return pieces.withColumn(out, F.col(part))
        root = self.links.where(F.col("kind") == self.kinds.index(kind)).select(
            "run_id", F.col("u").alias(part), F.col("v").alias("_root")
        )
        return (
            pieces.join(root, ["run_id", part], "left")
            .withColumn(out, F.coalesce("_root", part))
            .drop("_root")
        )

    def keyed_cells(self) -> DataFrame:
        """Cells with a ``<kind>_key`` object column for every mask."""
        df = self.cells
        for kind in self.kinds:
            df = spread_nulls(df, f"{kind}_part")
            df = self.objects_of(df, kind, f"{kind}_part", f"{kind}_key")
            df = restore_nulls(df, f"{kind}_part", f"{kind}_key")
        return df


def numbered_pieces(labels: Labels, kind: str, ids: DataFrame) -> DataFrame:
    """The table ``run_id, object_key, ...`` of objects, as ``run_id, <kind>_part, ...`` of their pieces.

    An object is named after one of its pieces, so only the others are looked up, by the links.
    """
    part = f"{kind}_part"
    first = ids.withColumnRenamed("object_key", part)
    if labels.links is None:
        return first
    root = labels.links.where(F.col("kind") == labels.kinds.index(kind)).select(
        "run_id", F.col("u").alias(part), F.col("v").alias("object_key")
    )
    others = salted_join(root, ids, ["run_id", "object_key"], part).drop("object_key")
    return first.unionByName(others)


def spread_nulls(df: DataFrame, part: str) -> DataFrame:
    """Give cells without a piece distinct negative keys, so no join key is hot."""
    return df.withColumn(part, F.coalesce(part, -1 - cell_key(F.col("t"), F.col("y"), F.col("x"))))


def restore_nulls(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.when(F.col(c) >= 0, F.col(c)))
    return df


# --------------------------------------------------------------------------- tiles


def _owners(axis: str, size: int, border: bool) -> Column:
    """Tiles which see a cell on one axis: its own and, at a low face, the one before."""
    own = F.floor(F.col(axis) / size).cast("int")
    if not border:
        return F.array(own)
    at_face = (F.col(axis) % size == 0) & (F.col(axis) > 0)
    return F.when(at_face, F.array(own, own - 1)).otherwise(F.array(own))


def _low_face(tile: Tile, in_time: bool) -> Column:
    axes = [("y", tile.y), ("x", tile.x)] + ([("t", tile.t)] if in_time else [])
    return reduce(lambda a, b: a | b, [(F.col(c) % n == 0) & (F.col(c) > 0) for c, n in axes])


def _merge_min(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable node for each of ``n`` nodes joined by edges a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root


def _tile_pieces(code: np.ndarray, slice_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """First run of each cell's piece (-1 outside the mask), and where runs start.

    ``code`` is a dense (t, y, x) block; cells join if their non-zero codes are equal.
    Rows are cut into runs along x, and runs of neighbouring rows are merged where
    they overlap or touch at a corner.
    """
    start = code > 0
    start[..., 1:] &= code[..., 1:] != code[..., :-1]
    run = np.cumsum(start.ravel()).reshape(code.shape) - 1
    left, right = [], []
    for dt, dy in [(0, 1)] if slice_only else [(0, 1), (1, -1), (1, 0), (1, 1)]:
        t0, t1 = slice(0, code.shape[0] - dt), slice(dt, None)
        y0 = slice(1, None) if dy < 0 else slice(0, code.shape[1] - dy)
        y1 = slice(0, code.shape[1] - 1) if dy < 0 else slice(dy, None)
        a, b = code[t0, y0], code[t1, y1]
        ra, rb = run[t0, y0], run[t1, y1]
        meet = (a > 0) & (a == b) & (start[t0, y0] | start[t1, y1])
        a_l, a_r, b_l, b_r = a[..., :-1], a[..., 1:], b[..., :-1], b[..., 1:]
        up = (a_l > 0) & (a_l == b_r) & (a_r != a_l) & (b_l != a_l)
        down = (a_r > 0) & (a_r == b_l) & (a_l != a_r) & (b_r != a_r)
        left += [ra[meet], ra[..., :-1][up], ra[..., 1:][down]]
        right += [rb[meet], rb[..., 1:][up], rb[..., :-1][down]]
    root = _merge_min(int(start.sum()), np.concatenate(left), np.concatenate(right))
    return np.where(code > 0, root[run] if len(root) else -1, -1), start


def _tile_labeller(spec: list[tuple[str, bool, str | None]], tile: Tile, out: pa.Schema):
    """Arrow group function: add ``<kind>_part`` and ``home`` to the cells of one tile."""

    def label(key, table):
        packed, low = key[0].as_py(), (1 << KEY_BITS) - 1
        t, y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("t", "y", "x"))
        rel = (
            t - (packed >> (2 * KEY_BITS)) * tile.t,
            y - (packed >> KEY_BITS & low) * tile.y,
            x - (packed & low) * tile.x,
        )
        home = (rel[0] < tile.t) & (rel[1] < tile.y) & (rel[2] < tile.x)
        keys = (t << (2 * KEY_BITS)) + (y << KEY_BITS) + x
        shape = (int(rel[0].max()) + 1, int(rel[1].max()) + 1, int(rel[2].max()) + 1)
        flat = np.ravel_multi_index(rel, shape)
        key_at = np.zeros(np.prod(shape), dtype=np.int64)
        key_at[flat] = keys
        made = {"home": pa.array(home)}
        for kind, slice_only, within in spec:
            inside = table.column(f"_in_{kind}").to_numpy(zero_copy_only=False)
            code = np.zeros(len(key_at), dtype=np.int32)
            if within is None:
                code[flat[inside]] = 1
            else:
                group = table.column(within).to_numpy()[inside]
                code[flat[inside]] = np.unique(group, return_inverse=True)[1] + 1
            piece, start = _tile_pieces(code.reshape(shape), slice_only)
            first_key = key_at[start.ravel()]
            found = piece.ravel()[flat]
            values = first_key[np.maximum(found, 0)] if len(first_key) else keys
            made[f"{kind}_part"] = pa.array(values, mask=found < 0)
        cols = [made[f.name] if f.name in made else table.column(f.name) for f in out]
        return pa.table(cols, schema=out)

    return label


def label_masks(
    cells: DataFrame,
    masks: dict[str, Mask | Column],
    wrap_nx: int | DataFrame | None = None,
    tile: Tile = Tile(),
) -> Labels:
    """Label several masks of one cell table in a single shuffle.

    ``cells`` has ``run_id, t, y, x`` with non-negative indices; cells outside every
    mask are dropped. With ``wrap_nx`` the last column touches the first one of the
    same row and step; a table ``run_id, wrap_nx`` tells it for the runs which have a seam.
    """
    masks = {k: m if isinstance(m, Mask) else Mask(m) for k, m in masks.items()}
    kinds = list(masks)
    in_time = any(not m.slice_only for m in masks.values())
    flags = {k: F.coalesce(m.cond, F.lit(False)) for k, m in masks.items()}
    df = cells.where(reduce(lambda a, b: a | b, flags.values()))
    df = df.select(*cells.columns, *[f.alias(f"_in_{k}") for k, f in flags.items()])
    for axis, size, border in [("t", tile.t, in_time), ("y", tile.y, True), ("x", tile.x, True)]:
        df = df.withColumn(f"_tile_{axis}", F.explode(_owners(axis, size, border)))
    # one packed number sorts much faster than three
    packed = cell_key(*[F.col(f"_tile_{axis}") for axis in ("t", "y", "x")])
    df = df.withColumn("_tile", packed).drop("_tile_t", "_tile_y", "_tile_x")

    kept = [f for f in df.schema if not f.name.startswith("_")]
    schema = T.StructType(
        kept
        + [T.StructField("home", T.BooleanType())]
        + [T.StructField(f"{k}_part", T.LongType()) for k in kinds]
    )
    arrow = to_arrow_schema(T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
    labeller = _tile_labeller([(k, m.slice_only, m.within) for k, m in masks.items()], tile, arrow)
    pieces = stage(
        df.groupBy("_tile", "run_id").applyInArrow(labeller, schema), "pieces"
    )
    edges = stage(_piece_links(pieces, masks, wrap_nx, tile, in_time), "links")
    home = pieces.where("home").drop("home")
    return Labels(home, reduce_to_stars(edges, ["run_id", "kind"]), kinds)


def _piece_links(
    pieces: DataFrame, masks: dict[str, Mask], wrap_nx: int | DataFrame | None, tile: Tile, in_time: bool
) -> DataFrame:
    """Pairs of pieces which claim the same border cell (or touch across the seam)."""
    named = F.array(
        *[
            F.struct(
                F.lit(i).alias("kind"),
                F.col(f"{k}_part").alias("part"),
                (F.col(m.within) if m.within else F.lit(0)).cast("long").alias("group"),
            )
            for i, (k, m) in enumerate(masks.items())
        ]
    )
    key = cell_key(F.col("t"), F.col("y"), F.col("x"))
    face = _low_face(tile, in_time)
    claims = pieces.where(face).select("run_id", key.alias("cell"), F.explode(named).alias("p"))
    if wrap_nx is not None:
        one_size = isinstance(wrap_nx, int)
        end = (F.lit(wrap_nx) if one_size else F.col("wrap_nx")) - 1
        last = cell_key(F.col("t"), F.col("y"), end)
        seam = pieces if one_size else join_per_run(pieces, wrap_nx)
        seam = seam.where((F.col("x") == 0) | (F.col("x") == end))
        claims = claims.unionByName(
            seam.select("run_id", last.alias("cell"), F.explode(named).alias("p"))
        )
    claims = claims.select("run_id", "cell", "p.*").where(F.col("part").isNotNull())
    # at most eight tiles (and two seam sides) claim a cell, so the set stays tiny
    shared = claims.groupBy("run_id", "kind", "cell", "group").agg(
        F.min("part").alias("v"), F.collect_set("part").alias("parts")
    )
    return (
        shared.where(F.size("parts") > 1)
        .select("run_id", "kind", F.explode("parts").alias("u"), "v")
        .where(F.col("u") > F.col("v"))
        .distinct()
    )


# --------------------------------------------------------------------------- stars


def _keyed_join(big: DataFrame, small: DataFrame, keys: list[str], total: int, salt_by: str) -> DataFrame:
    """Join ``big`` to one row per key of ``small`` (which carries the key's count ``n``).

    A key with more than ``MAX_ROWS_PER_KEY`` rows is cut into salted sub-keys. With
    ``total`` rows there are at most ``total / limit`` such keys, and the limit grows
    with the total, so the broadcast list of hot keys has at most 1000 rows.
    """
    if total <= MAX_ROWS_PER_KEY:
        return big.join(small.drop("n"), keys)
    limit = max(MAX_ROWS_PER_KEY, total // 1000)
    salts = F.ceil(F.col("n") / limit).cast("int")
    hot = F.broadcast(small.where(F.col("n") > limit).select(*keys, salts.alias("_salts")))
    salt = F.pmod(F.xxhash64(salt_by), F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")
    salted = big.join(hot, keys, "left").withColumn("_salt", salt)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return salted.drop("_salts").join(copies, [*keys, "_salt"]).drop("_salt")


def _star_round(edges: DataFrame, by: list[str], total: int) -> DataFrame:
    """One large-star and one small-star step on edges u > v."""
    both = edges.select(*by, F.col("v").alias("a"), F.col("u").alias("b")).unionAll(
        edges.select(*by, F.col("u").alias("a"), F.col("v").alias("b"))
    )
    low = both.groupBy(*by, "a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    low = low.select(*by, F.col("a").alias("v"), F.least("a", "m").alias("m"), "n")
    large = (
        _keyed_join(edges, low, [*by, "v"], 2 * total, "u")
        .select(*by, "u", F.col("m").alias("v"))
        .distinct()
    )
    low = large.groupBy(*by, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _keyed_join(large, low, [*by, "u"], 2 * total, "v")
    return (
        moved.where(F.col("v") > F.col("m"))
        .select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        .unionAll(low.select(*by, "u", F.col("m").alias("v")))
        .distinct()
    )


def _star_state(edges: DataFrame, by: list[str]) -> tuple[int, bool]:
    """Edge count, and whether all edges already point straight at a root."""
    ends = edges.select(*by, F.col("u").alias("a"), F.lit(1).alias("up")).unionAll(
        edges.select(*by, F.col("v").alias("a"), F.lit(0).alias("up"))
    )
    node = ends.groupBy(*by, "a").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
    loose = (F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("n") > 1))
    row = node.agg(F.sum("n").alias("ends"), F.max(loose).alias("loose")).first()
    return (row["ends"] or 0) // 2, not row["loose"]


def reduce_to_stars(edges: DataFrame, by: list[str]) -> DataFrame | None:
    """Edges (u, v), u > v, rewritten until every node points at its smallest one.

    Each round is a written table, so a lost executor costs one round at most.
    """
    total, done = _star_state(edges, by)
    rounds = 0
    while not done:
        if rounds == MAX_ROUNDS:
            raise RuntimeError(f"components not stable after {MAX_ROUNDS} rounds")
        edges = stage(_star_round(edges, by, total), "stars")
        total, done = _star_state(edges, by)
        rounds += 1
    return edges if total else None


def chase_links(links: DataFrame, by: list[str]) -> DataFrame | None:
    """Links ``u, v`` to an earlier node, at most one per ``u``, rewritten to the first node of each chain.

    Every round doubles the reach of the open links, so a chain of n nodes takes log2(n) rounds.
    A link whose end is first leaves the join, so no first node collects the rows of its chain.
    """
    links = stage(links.select(*by, "u", "v", F.lit(False).alias("done")), "chains")
    if links.isEmpty():
        return None
    rounds, open_ = 0, True
    while open_:
        if rounds == MAX_ROUNDS:
            raise RuntimeError(f"chains not ended after {MAX_ROUNDS} rounds")
        ahead = links.select(*by, F.col("u").alias("v"), F.col("v").alias("_v"), F.col("done").alias("_done"))
        moved = links.where("NOT done").hint("merge").join(ahead.hint("merge"), [*by, "v"], "left")
        moved = moved.select(*by, "u", F.coalesce("_v", "v").alias("v"), F.coalesce("_done", F.lit(True)).alias("done"))
        links = stage(links.where("done").unionByName(moved), "chains")
        open_ = not links.where("NOT done").isEmpty()
        rounds += 1
    return links.drop("done")


def label_components(
    mask: DataFrame,
    connectivity: str = "space_time",
    wrap_nx: int | DataFrame | None = None,
    within: str | None = None,
    tile: Tile = Tile(),
) -> DataFrame:
    """All rows of ``mask`` with the ``object_key`` and tile ``part`` of their component."""
    m = Mask(F.lit(True), connectivity == "slice", within)
    cells = label_masks(mask, {"object": m}, wrap_nx, tile).keyed_cells()
    return cells.withColumnRenamed("object_part", "part")
