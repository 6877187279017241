"""Bytes kept losslessly in baseline JPEG files, and files read back to thumbnails.

A payload byte, less 128, is one quantised coefficient of an 8 x 8 block (all quantisers are
1), so a file gives its bytes back exactly; 64 bytes are a block, in the order of the file, and a
row of blocks is a restart interval. The reader parses the markers of any baseline file with one interleaved
scan, decodes the Huffman codes, and rebuilds the luminance of each block from its DC
coefficient alone. All restart intervals of a batch are decoded side by side in NumPy: one
step reads one symbol of every interval.

Defined results. NULL and empty texts are one row of padding. Repeated rows have equal
files. Files which are no baseline JPEG, or end early, raise an error that names the fault.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblock import Block, map_blocks

UNIT = 576
ROW_BLOCKS = UNIT // 64
MAX_SIDE = 65535 // 8
LENGTH_NOTE = b"payload bytes "

# The writer's Huffman codes. DC: nine categories of 4 bits. AC: short codes for values
# without zeros before them, by how often letters, blanks and digits of a text have that
# category; all other symbols have 11 bits, so any data can be written.
DC_SYMBOLS = list(range(9))
AC_WIDTHS = {1: [5], 2: [4], 3: [7], 5: [6], 6: [3], 8: [1, 2, 8]}
AC_WIDTHS[11] = [0x00, 0xF0] + [run << 4 | size for run in range(1, 16) for size in range(1, 9)]


def _tables() -> bytes:
    dc = bytes([0x00]) + bytes(len(DC_SYMBOLS) if n == 4 else 0 for n in range(1, 17)) + bytes(DC_SYMBOLS)
    ac = bytes([0x10]) + bytes(len(AC_WIDTHS.get(n, [])) for n in range(1, 17))
    return dc + ac + bytes(sum(AC_WIDTHS.values(), []))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _ac_codes() -> tuple[np.ndarray, np.ndarray]:
    code, size, next_, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for width, symbols in AC_WIDTHS.items():
        next_ <<= width - last
        code[symbols], size[symbols] = next_ + np.arange(len(symbols)), width
        next_, last = next_ + len(symbols), width
    return code, size


def category(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


# ------------------------------------------------------------------- writer


def payload_of(data: bytes) -> bytes:
    """The bytes, padded with 255 up to a positive multiple of 576."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def _entropy(coefs: np.ndarray, lane_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of blocks (n, 64), a byte-aligned stretch per lane, and the bounds of the lanes."""
    n = len(coefs)
    first = np.ones(n, bool)
    first[1:] = lane_of[1:] != lane_of[:-1]
    before = np.concatenate([[0], coefs[:-1, 0]])
    diff = coefs[:, 0] - np.where(first, 0, before)

    block, k = np.nonzero(coefs[:, 1:])
    value = coefs[:, 1:][block, k]
    last = np.full(len(k), -1)
    same = block[1:] == block[:-1]
    last[1:][same] = k[:-1][same]
    run = k - last - 1
    skips, run = run >> 4, run & 15
    end = np.full(n, -1)
    end[block] = k  # the last one written is the greatest
    open_ = np.flatnonzero(end < 62)

    code_of, size_of = _ac_codes()
    size = category(value)
    symbol = run << 4 | size
    bits = np.where(value < 0, value + (1 << size) - 1, value)
    dsize = category(diff)
    dbits = np.where(diff < 0, diff + (1 << dsize) - 1, diff)
    skipped = np.repeat(np.arange(len(k)), skips)
    # every code with its place: block, coefficient, and its order there
    place = np.concatenate([np.arange(n) * 256, block * 256 + 3 * (k + 1) + 1, block[skipped] * 256 + 3 * (k[skipped] + 1), open_ * 256 + 255])
    words = np.concatenate(
        [dsize << dsize | dbits, code_of[symbol] << size | bits, np.full(len(skipped), code_of[0xF0]), np.full(len(open_), code_of[0])]
    )
    widths = np.concatenate([dsize + 4, size_of[symbol] + size, np.full(len(skipped), size_of[0xF0]), np.full(len(open_), size_of[0])])
    order = np.argsort(place, kind="stable")
    words, widths, lanes = words[order], widths[order], lane_of[place[order] >> 8]

    # ones fill each lane up to a whole byte
    n_lanes = int(lane_of[-1]) + 1
    used = np.bincount(lanes, weights=widths, minlength=n_lanes).astype(np.int64)
    fill = -used % 8
    at = np.searchsorted(lanes, np.arange(n_lanes), side="right")
    words, widths = np.insert(words, at, (1 << fill) - 1), np.insert(widths, at, fill)
    return _pack(words.astype(np.uint64), widths), np.concatenate([[0], np.cumsum((used + fill) >> 3)])


def _pack(words: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Numbers of ``widths`` bits one behind another, as bytes."""
    ends = np.cumsum(widths)
    starts = ends - widths
    slot, over = starts >> 6, (starts & 63) + widths - 64
    high = np.where(over > 0, words >> np.maximum(over, 0).astype(np.uint64), words << np.maximum(-over, 0).astype(np.uint64))
    high[widths == 0] = 0
    out = np.zeros((ends[-1] >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    out[slot[first]] = np.bitwise_or.reduceat(high, first)
    cut = np.flatnonzero(over > 0)
    out[slot[cut] + 1] |= words[cut] << (64 - over[cut]).astype(np.uint64)
    return out.astype(">u8").view(np.uint8)[: ends[-1] >> 3]


def write_files(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One file per stretch of ``data``."""
    parts, shapes, lanes, n_lanes = [], [], [], 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        payload = payload_of(data[a:b].tobytes())
        units = len(payload) // UNIT
        wide = -(-units // MAX_SIDE)  # units in a row of blocks, so that the height fits
        rows = -(-units // wide)
        coefs = np.zeros(rows * wide * UNIT, np.int64)
        coefs[: len(payload)] = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
        parts.append(coefs.reshape(-1, 64))
        shapes.append((rows, wide * ROW_BLOCKS, len(payload)))
        lanes.append(n_lanes + np.repeat(np.arange(rows), wide * ROW_BLOCKS))
        n_lanes += rows
    coded, bounds = _entropy(np.concatenate(parts), np.concatenate(lanes))
    out, lane = [], 0
    for rows, columns, length in shapes:
        scan = []
        for i in range(rows):
            if i:
                scan.append(bytes([0xFF, 0xD0 + (i - 1) % 8]))
            scan.append(coded[bounds[lane + i] : bounds[lane + i + 1]].tobytes().replace(b"\xff", b"\xff\x00"))
        lane += rows
        frame = bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * columns).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
        out.append(
            b"".join(
                [
                    b"\xff\xd8",
                    _segment(0xFE, LENGTH_NOTE + str(length).encode()),
                    _segment(0xDB, bytes([0]) + b"\x01" * 64),
                    _segment(0xC0, frame),
                    _segment(0xC4, _tables()),
                    _segment(0xDD, columns.to_bytes(2, "big")),
                    _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
                    *scan,
                    b"\xff\xd9",
                ]
            )
        )
    return out


# ------------------------------------------------------------------- reader


@dataclass
class Header:
    """What the markers of one file say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, bytes] = field(default_factory=dict)  # class << 4 | number: counts and symbols
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component index, dc, ac
    interval: int = 0
    note: bytes = b""
    lanes: list[bytes] = field(default_factory=list)

    def mcus(self) -> tuple[int, int]:
        h = max(c[1] for c in self.components)
        v = max(c[2] for c in self.components)
        if len(self.components) == 1:
            h = v = 1
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    def plan(self) -> tuple:
        """Component and code tables of each block of an MCU, in order."""
        out = []
        for at, dc, ac in self.scan:
            _, h, v, _ = self.components[at]
            out += [(at, self.codes[dc], self.codes[16 | ac])] * (1 if len(self.components) == 1 else h * v)
        return tuple(out)


def parse(data: bytes) -> Header:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG: start marker missing")
    head, at = Header(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("JPEG ends before its scan")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                head.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                head.codes[body[0]] = bytes(body[1:n])
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            head.height, head.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            head.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
            raise ValueError("no baseline JPEG")
        elif marker == 0xDD:
            head.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            head.note = bytes(body)
        elif marker == 0xDA:
            ids = [c[0] for c in head.components]
            head.scan = [(ids.index(body[i]), body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            if len(head.scan) != len(head.components):
                raise ValueError("JPEG with several scans")
            break
    raw = np.frombuffer(data, np.uint8, offset=at)
    mark = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0))
    kinds = raw[mark + 1]
    stop = np.flatnonzero((kinds < 0xD0) | (kinds > 0xD7))
    if not len(stop):
        raise ValueError("JPEG without end marker")
    cuts = mark[: stop[0] + 1].tolist()
    for a, b in zip([0, *(c + 2 for c in cuts[:-1])], cuts):
        head.lanes.append(raw[a:b].tobytes().replace(b"\xff\x00", b"\xff"))
    return head


_lookups: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16 bits; length 0 where no code begins so."""
    if table not in _lookups:
        symbols, sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        at, k = 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                span = 1 << (16 - length)
                symbols[at : at + span], sizes[at : at + span] = table[k], length
                at, k = at + span, k + 1
        _lookups[table] = symbols, sizes
    return _lookups[table]


class _Bits:
    """A read position in each of many byte strings."""

    def __init__(self, strings: list[bytes]):
        data = np.frombuffer(b"".join(strings) + b"\xff" * 8, np.uint8).astype(np.int64)
        self.words = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        sizes = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(sizes) * 8
        self.at = self.ends - sizes * 8

    def symbol(self, who: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at = self.at[who]
        seen = self.words[at >> 3] >> (16 - (at & 7)) & 0xFFFF
        sizes = table[1][seen]
        at += sizes
        if not sizes.all() or (at > self.ends[who]).any():
            raise ValueError("damaged JPEG scan")
        self.at[who] = at
        return table[0][seen]

    def number(self, who: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = self.at[who]
        v = self.words[at >> 3] >> (32 - (at & 7) - size) & ((1 << size) - 1)
        self.at[who] = at + size
        return np.where((v >> np.maximum(size - 1, 0) == 0) & (size > 0), v - (1 << size) + 1, v)


def decode_lanes(strings: list[bytes], mcus: np.ndarray, plan: tuple) -> np.ndarray:
    """Zigzag coefficients of all blocks, lane after lane."""
    per = len(plan)
    starts = np.concatenate([[0], np.cumsum(mcus * per)])
    out = np.zeros((starts[-1], 64), np.int64)
    bits = _Bits(strings)
    dc = defaultdict(lambda: np.zeros(len(strings), np.int64))
    for m in range(int(mcus.max(initial=0))):
        lanes = np.flatnonzero(mcus > m)
        for j, (component, dc_table, ac_table) in enumerate(plan):
            rows = starts[lanes] + m * per + j
            dc[component][lanes] += bits.number(lanes, bits.symbol(lanes, lookup(dc_table)))
            out[rows, 0] = dc[component][lanes]
            table, who, row, k = lookup(ac_table), lanes, rows, np.ones(len(lanes), np.int64)
            while len(who):
                symbol = bits.symbol(who, table)
                run, size = symbol >> 4, symbol & 15
                k = k + run
                value = bits.number(who, size)
                put = size > 0
                if (k[put] > 63).any():
                    raise ValueError("damaged JPEG scan")
                if put.all():
                    out[row, k] = value
                else:
                    out[row[put], k[put]] = value[put]
                    k[(size == 0) & (run == 0)] = 64
                k = k + 1
                more = k < 64
                if not more.all():
                    who, row, k = who[more], row[more], k[more]
    return out


@dataclass
class Picture:
    """A read file: size in pixels, luminance thumbnail, and the blocks' coefficients."""

    width: int
    height: int
    thumbnail: np.ndarray
    coefficients: np.ndarray
    note: bytes


def read_files(files: list[bytes]) -> list[Picture]:
    heads = [parse(f) for f in files]
    alike = defaultdict(list)
    for i, head in enumerate(heads):
        alike[head.plan()].append(i)
    out: list[Picture | None] = [None] * len(files)
    for plan, members in alike.items():
        strings, mcus, per_file = [], [], []
        for i in members:
            rows, columns = heads[i].mcus()
            total, step = rows * columns, heads[i].interval or rows * columns
            counts = [min(step, total - a) for a in range(0, total, step)]
            if len(counts) != len(heads[i].lanes):
                raise ValueError("JPEG with missing restart intervals")
            strings += heads[i].lanes
            mcus += counts
            per_file.append(total * len(plan))
        coefs = decode_lanes(strings, np.array(mcus, np.int64), plan)
        at = 0
        for i, n in zip(members, per_file):
            out[i] = _picture(heads[i], plan, coefs[at : at + n])
            at += n
    return out


def _picture(head: Header, plan: tuple, coefs: np.ndarray) -> Picture:
    rows, columns = head.mcus()
    first = plan[0][0]
    _, h, v, q = head.components[first]
    if len(head.components) == 1:
        h = v = 1
    luminance = coefs.reshape(rows, columns, len(plan), 64)[:, :, : h * v, 0].reshape(rows, columns, v, h)
    dc = luminance.transpose(0, 2, 1, 3).reshape(rows * v, columns * h) * head.quantisers[q][0]
    thumb = np.clip(np.floor(dc / 8 + 128.5), 0, 255).astype(np.uint8)
    return Picture(head.width, head.height, thumb, coefs, head.note)


def payload_from(picture: Picture) -> bytes:
    """The payload which ``write_files`` stored."""
    length = int(picture.note[len(LENGTH_NOTE) :])
    return (picture.coefficients.ravel()[:length] + 128).astype(np.uint8).tobytes()


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are lighter than the mean."""
    rows = np.arange(9) * thumb.shape[0] // 8
    cols = np.arange(9) * thumb.shape[1] // 8
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    top, low = np.minimum(rows[:-1], thumb.shape[0] - 1), np.maximum(rows[1:], rows[:-1] + 1)
    left, right = np.minimum(cols[:-1], thumb.shape[1] - 1), np.maximum(cols[1:], cols[:-1] + 1)
    sums = total[np.ix_(low, right)] - total[np.ix_(top, right)] - total[np.ix_(low, left)] + total[np.ix_(top, left)]
    area = np.outer(low - top, right - left)
    lighter = sums * thumb.size > int(total[-1, -1]) * area
    return np.packbits(lighter.ravel()).tobytes().hex()


# ------------------------------------------------------------------- Spark


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, bytes of the text and its file."""
    rows = docs.select(key, text)

    def work(part: pa.RecordBatch, block: Block) -> dict:
        files = write_files(block.data, block.offsets)
        return {key: part.column(key), "n_bytes": np.diff(block.offsets), "media": files}

    return map_blocks(rows, text, f"`{key}` {dict(rows.dtypes)[key]}, n_bytes long, media binary", work, 1 << 20)


FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "width int, height int, thumbnail_sha256 string, thumbnail_hash string"
)


def media_features(media: DataFrame, column: str = "media") -> DataFrame:
    """All columns of ``media``, the file replaced by what reading it gives."""
    others = [f for f in media.columns if f != column]
    kinds = dict(media.dtypes)

    def work(part: pa.RecordBatch, block: Block) -> dict:
        files = [block.data[a:b].tobytes() for a, b in zip(block.offsets[:-1], block.offsets[1:])]
        pictures = read_files(files)
        payloads = [payload_from(p) for p in pictures]
        return {
            **{c: part.column(c) for c in others},
            "payload_bytes": [len(p) for p in payloads],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
            "tail_crc32": [zlib.crc32(p[-32:]) for p in payloads],
            "media_bytes": [len(f) for f in files],
            "media_sha256": [hashlib.sha256(f).hexdigest() for f in files],
            "width": [p.width for p in pictures],
            "height": [p.height for p in pictures],
            "thumbnail_sha256": [hashlib.sha256(p.thumbnail.tobytes()).hexdigest() for p in pictures],
            "thumbnail_hash": [thumbnail_hash(p.thumbnail) for p in pictures],
        }

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), FEATURES])
    return map_blocks(media, column, schema, work, 1 << 20)
