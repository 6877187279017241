"""Joins whose key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

# A table of up to this many rows (a key and a few numbers) is broadcast.
MAX_BROADCAST_ROWS = 1_000_000
# Pieces are broadcast up to this many rows: about 30 MB in the driver and each executor.
MAX_BROADCAST_PIECES = 250_000
# No join key may bring more rows than this into one task; heavier keys are salted.
MAX_ROWS_PER_KEY = 200_000
SALTS = 32


def salted_join(big: DataFrame, table: DataFrame, keys: list[str], salt_by: str, how: str = "inner") -> DataFrame:
    """Join many rows per key to one row per key; only keys with very many rows are cut into ``SALTS`` sub-keys.

    ``salt_by`` differs between the rows of a key, such as the tile piece of an object. ``big`` is
    read twice. Copies of all keys would be many times larger than a table of small objects.
    """
    heavy = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MAX_ROWS_PER_KEY)
    heavy = stage(heavy.select(*keys, F.lit(SALTS).alias("_salts")), "heavy-keys")
    if heavy.isEmpty():
        return join_cells(big, table, keys, how)
    heavy = F.broadcast(heavy)  # at most one in MAX_ROWS_PER_KEY rows
    salt = F.pmod(F.xxhash64(salt_by), F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")
    salted = big.join(heavy, keys, "left").withColumn("_salt", salt).drop("_salts")
    copies = table.join(heavy, keys, "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return join_cells(salted, copies.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def join_cells(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join two tables which both grow with the cells.

    Spark guesses their size from the files below them, which may be a thousand times smaller
    (opened rows, repeated values), and would collect one side in the driver to broadcast it.
    """
    return left.join(right.hint("merge"), on, how)


def cells_at(cells: DataFrame, wanted: DataFrame, on: list[str], tasks: int) -> DataFrame:
    """The rows of ``cells``, one per key, whose key ``wanted`` names once or more.

    ``cells`` are dealt by ``run_id`` into ``tasks`` tasks, as grids opened run by run are. The
    keys are dealt alike and grouped with the cells where these lie, so only keys are shuffled;
    a join would shuffle the cells too, since it wants them dealt by the whole key.
    """
    others = [c for c in cells.columns if c not in on]
    kinds = {f.name: f.dataType for f in cells.schema}
    keys = wanted.select(*[F.col(c).cast(kinds[c]).alias(c) for c in on], F.lit(True).alias("_wanted"))
    both = cells.withColumn("_here", F.lit(True)).unionByName(keys.repartition(tasks, "run_id"), allowMissingColumns=True)
    found = both.groupBy(*on).agg(*[F.max(c).alias(c) for c in (*others, "_here", "_wanted")])
    return found.where("_here AND _wanted").select(*cells.columns)


def join_pieces(cells: DataFrame, pieces: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join cells to one row per tile piece; the pieces are written, counted and broadcast if few."""
    pieces = stage(pieces, "by-piece")
    few = pieces.count() <= MAX_BROADCAST_PIECES
    return cells.join(F.broadcast(pieces) if few else pieces, keys, how)


def join_per_run(df: DataFrame, table: DataFrame, salt_by: str = "t") -> DataFrame:
    """Add columns known per run. One run may hold a third of all rows.

    The table is written and counted: it is broadcast if it is small, else salted.
    """
    table = stage(table, "per_run")
    if table.count() <= MAX_BROADCAST_ROWS:
        return df.join(F.broadcast(table), "run_id")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_cells(salted, copies, ["run_id", "_salt"]).drop("_salt")
