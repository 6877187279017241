"""Byte-level BPE through a sentencepiece model which is written from the vocabulary alone.

Every vocabulary entry is a piece: each byte is mapped to one printable character, and the
score is the negative rank, so that sentencepiece joins the pair of lowest rank first. The
normaliser is the identity. A text is cut by the pre-token pattern, each pre-token encoded
by itself; one which is an entry as a whole is that entry. Decoding maps ids back to bytes.

Defined results. NULL and empty texts have no ids and decode to nothing. Repeated rows are
encoded one by one. A pre-token may be of any length.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblock import slices

# Distinct pre-tokens whose ids a worker remembers; the table is emptied when it is full.
MEMORY_ENTRIES = 200_000


@dataclass(frozen=True)
class BpeFiles:
    """Path of a rank file (base64 token and rank per line) and the pre-token pattern."""

    ranks: str
    pattern: str


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as lines:
        table = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(table) != list(range(len(table))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [table[i] for i in range(len(table))]


def byte_letters() -> str:
    """One letter per byte: itself where it is printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    code = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(other)}
    return "".join(chr(code[b]) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece model; piece ``i`` is the token of rank ``i``, the last one is unknown."""
    letters = byte_letters()
    unknown = "⁇unknown"
    pieces = [("".join(letters[b] for b in t), -float(i), 1) for i, t in enumerate(tokens)] + [(unknown, 0.0, 2)]
    out = [_field(1, _field(1, p.encode()) + _field(2, score) + _field(3, kind)) for p, score, kind in pieces]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(45, unknown.encode())
    off = (1 << 64) - 1  # minus one: no such piece
    trainer += _field(41, off) + _field(42, off) + _field(43, off)
    normalizer = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*out, _field(2, trainer), _field(3, normalizer)])


class Codec:
    """Encoder and decoder of a worker."""

    empty = {"encode": "", "decode": b""}

    def __init__(self, files: BpeFiles):
        self.tokens = read_ranks(files.ranks)
        self.whole = {t: np.array([i], np.uint32).tobytes() for i, t in enumerate(self.tokens)}
        self.letters = byte_letters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.split = regex.compile(files.pattern).findall
        self.seen: dict[str, bytes] = {}
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _ids(self, word: str) -> bytes:
        raw = word.encode()
        found = self.whole.get(raw)
        if found is None:
            mapped = raw.decode("latin-1").translate(self.letters)
            found = np.array(self.model.encode(mapped), np.uint32).tobytes()
        if len(word) < 64:
            if len(self.seen) >= MEMORY_ENTRIES:
                self.seen.clear()
            self.seen[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        seen = self.seen.get
        return b"".join([seen(w) or self._ids(w) for w in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        return self.flat[take].tobytes()


_codecs: dict[BpeFiles, Codec] = {}


def codec(files: BpeFiles) -> Codec:
    if files not in _codecs:
        _codecs[files] = Codec(files)
    return _codecs[files]


def _replace(df: DataFrame, source: str, target: str, kind: T.DataType, work: str, files: BpeFiles) -> DataFrame:
    """``df`` with the column ``source`` replaced by ``target``, row by row in Arrow batches."""
    schema = T.StructType([T.StructField(target, kind) if f.name == source else f for f in df.schema])
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import byte_bpe

        own = byte_bpe.codec(files)
        each = getattr(own, work)
        for batch in batches:
            for rows in slices(batch, at):
                values = pa.array([each(v.as_py() or own.empty[work]) for v in rows.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [values if i == at else c for i, c in enumerate(rows.columns)],
                    names=[target if i == at else n for i, n in enumerate(rows.schema.names)],
                )

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, files: BpeFiles, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows, the text replaced by its ids (binary, little-endian unsigned 32-bit)."""
    return _replace(docs, text, ids, T.BinaryType(), "encode", files)


def decode(encoded: DataFrame, files: BpeFiles, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All rows, the ids replaced by the bytes which they stand for."""
    return _replace(encoded, ids, decoded, T.BinaryType(), "decode", files)


def count(ids: str = "ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")
