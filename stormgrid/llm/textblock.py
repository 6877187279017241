"""Whole texts of a record batch as flat NumPy arrays.

Spark deals the documents out; inside a task a batch is cut into blocks of half a
megabyte, and the words of all texts of a block are found and hashed together. A text
is never cut: a text longer than ``max_bytes`` is a block of its own.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A worker holds about 100 bytes for each of these at its peak.
BLOCK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
# 0 space, 1 part of a word, 2 a token of its own
KIND = np.ones(256, np.uint8)
KIND[:128] = [0 if SPACE[c] else 1 if chr(c).isalnum() else 2 for c in range(128)]


class _Tables(dict):
    """Tables of a worker; they are built where they are needed and never travel with a job."""

    def __reduce__(self):
        return (_Tables, ())


_powers = _Tables()


def kept_in_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """An object which a worker process makes once and keeps for later tasks.

    Functions travel to the workers by value, and their globals with them, so what is to
    outlive a task is held by a module of the worker's own.
    """
    held = sys.modules.setdefault("_stormgrid_worker", types.ModuleType("_stormgrid_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection, so it adds no collisions)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        table = np.full(max(n, 2 * BLOCK_BYTES), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _powers[name] = table
    return table


class Block:
    """Some texts as one byte array; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.offsets = offsets.astype(np.int64)
        self.n = len(offsets) - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, the sum of one number per byte."""
        return between(flags, self.offsets)

    def words(self) -> Tokens:
        """Maximal runs of bytes other than ASCII white space."""
        inside = ~SPACE[self.data]
        return self._runs(inside, None)

    def tokens(self) -> Tokens:
        """Runs of letters and digits, and every ASCII punctuation mark by itself."""
        kind = KIND[self.data]
        return self._runs(kind == 1, kind == 2)

    def lines(self) -> Tokens:
        """Pieces between line feeds; an empty text is one empty line."""
        cut = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], cut + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], cut]), kind="stable")
        # the k-th piece of a text starts after its k-th line feed, so counts give the bounds
        feeds = np.concatenate([[0], np.cumsum(np.bincount(self._text_of(cut), minlength=self.n) + 1)])
        return Tokens(self, starts, ends, feeds)

    def _text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets[1:], at, side="right")

    def _runs(self, inside: np.ndarray, single: np.ndarray | None) -> Tokens:
        n = len(inside)
        if not n:
            none = np.zeros(0, np.int64)
            return Tokens(self, none, none, np.zeros(self.n + 1, np.int64))
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = self.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        starts[edge] |= inside[edge]
        ends[edge - 1] |= inside[edge - 1]
        if single is not None:
            starts |= single
            ends |= single
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return Tokens(self, s, e, np.searchsorted(s, self.offsets))


class Tokens:
    """Pieces of the texts; those of text ``i`` are ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, block: Block, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray):
        self.block, self.starts, self.ends = block, starts, ends
        self.bounds = bounds.astype(np.int64)
        self.counts = np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.block.n), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each piece's bytes, the same at every place."""
        data = self.block.data
        n = len(data)
        up, down = _table("up", _BASE, n + 1), _table("down", _INVERSE, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.multiply((LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1), up[:n], out=total[1:])
        np.cumsum(total, out=total)
        h = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def follows(self, k: int) -> np.ndarray:
        """Places from which ``k`` further pieces of the same text follow."""
        n = len(self.starts)
        ok = np.ones(n, bool)
        for j in range(1, k + 1):
            at = self.bounds[1:] - j
            ok[at[at >= self.bounds[:-1]]] = False
        return np.flatnonzero(ok)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of one value per piece."""
        return between(values, self.bounds)


def between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, empty ones included."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    if kind is np.float64:  # no differences of long running sums: each stretch rounds by itself
        full = np.flatnonzero(np.diff(bounds))
        out = np.zeros(len(bounds) - 1)
        if len(full):
            out[full] = np.add.reduceat(values, bounds[full])
        return out
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; NULL is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batch: pa.RecordBatch, text: str, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Cut a batch into stretches of rows with up to ``max_bytes`` of text (one row at least)."""
    data, offsets = text_arrays(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at), Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def slices(batch: pa.RecordBatch, at: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with about ``most`` bytes in one column, one row at least."""
    start, size = 0, 0
    sizes = pa.compute.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_blocks(
    df: DataFrame,
    text: str,
    schema: T.StructType | str,
    work: Callable[[pa.RecordBatch, Block], dict | pa.RecordBatch | None],
    max_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Run ``work`` on every block; it returns the columns of ``schema`` or a record batch."""
    kind = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in blocks(batch, text, max_bytes):
                out = work(rows, block)
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays([as_arrow(out[f.name], f.type) for f in arrow], schema=arrow)
                if out is not None:
                    yield out

    return df.mapInArrow(run, kind)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)
