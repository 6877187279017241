"""Documents as token pieces, packed into sequences by linear grouping and best fit.

Lengths are whole numbers up to the capacity, so the number of pieces per length is all
that planning needs: at most ``capacity`` numbers come to the driver, whatever the corpus.
Large lengths are sorted, cut into groups of equal cardinality and rounded up to the
greatest length of their group. For these few sizes all configurations (which sizes share a
sequence) are listed and a linear program says how often each is used. Then real lengths
take the slots of their group, and the small ones and what rounding left over go, by
falling length, each to the fullest sequence where it fits. The plan is kept as runs of
equal sequences. Spark numbers the pieces of each length, and the number finds the place.

Defined results. A NULL or empty text is its end token alone. Repeated rows are packed one
by one. Without rows nothing is packed. Which of several pieces of one length takes which
place is given by a hash of the row. A length outside 1..capacity raises an error.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .textblock import kept_in_worker, slices

# Counts per length and salt are broadcast up to this number of rows.
MAX_BROADCAST_COUNTS = 1_000_000
ROWS_PER_SALT = 250_000
MIN_SALTS = 64
MEMORY_ENTRIES = 300_000

Run = tuple[int, tuple[tuple[int, int], ...]]  # sequences, and (length, times) in each


@dataclass(frozen=True)
class PackConfig:
    """``groups`` rounded sizes; a length above ``capacity / large_part`` is large."""

    capacity: int = 4096
    groups: int = 24
    large_part: int = 4
    end_id: int = 1


# ------------------------------------------------------------------- plan on counts


def linear_groups(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cut (length, count), falling, into groups of equal cardinality."""
    total = sum(n for _, n in lengths)
    size = -(-total // groups)
    out, room = [], 0
    for length, n in lengths:
        while n:
            if not room:
                out.append([])
                room = size
            t = min(n, room)
            out[-1].append((length, t))
            n, room = n - t, room - t
    return out


def configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """Every choice of sizes that fits into a sequence, as counts per size."""
    out, most = [], capacity // min(sizes)
    for k in range(1, most + 1):
        for chosen in combinations_with_replacement(range(len(sizes)), k):
            if sum(sizes[i] for i in chosen) <= capacity:
                out.append(np.bincount(chosen, minlength=len(sizes)))
    return np.array(out)


def solve(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Whole numbers of configurations from the linear program, rounded down (simplex)."""
    table = configurations(sizes, capacity)
    k = len(sizes)
    basis = np.diag(capacity // np.array(sizes)).astype(float)
    cost = np.ones(k)
    for _ in range(200 * k):
        price = np.linalg.solve(basis.T, cost)
        gain = table @ price - 1
        best, lowest = int(gain.argmax()), int(price.argmin())
        if gain[best] > max(1e-9, -price[lowest]):
            column, c = table[best].astype(float), 1.0
        elif price[lowest] < -1e-9:
            column, c = -np.eye(k)[lowest], 0.0  # more of a size than demanded
        else:
            break
        now, change = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, now / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out], cost[out] = column, c
    times = np.floor(np.linalg.solve(basis, demand) + 1e-6).astype(np.int64)
    return [(int(t), np.rint(basis[:, i]).astype(int)) for i, t in enumerate(times) if t > 0 and cost[i] > 0]


def _take(pool: list[list[int]], most: int) -> tuple[int, int]:
    """Up to ``most`` pieces of the pool's first length."""
    length, n = pool[0]
    t = min(n, most)
    pool[0][1] -= t
    if not pool[0][1]:
        pool.pop(0)
    return length, t


def substitute(plan: list[tuple[int, np.ndarray]], groups: list[list[tuple[int, int]]]) -> tuple[list[Run], dict[int, int]]:
    """Real lengths in the slots of the configurations, and the pieces without a slot."""
    pools = [[list(x) for x in g] for g in groups]
    runs: list[Run] = []
    for times, counts in plan:
        open_: list[Run] = [(times, ())]
        for g in np.repeat(np.arange(len(counts)), counts).tolist():
            filled: list[Run] = []
            for n, items in open_:
                while n and pools[g]:
                    length, t = _take(pools[g], n)
                    filled.append((t, (*items, (length, 1))))
                    n -= t
                if n:
                    filled.append((n, items))
            open_ = filled
        runs += [r for r in open_ if r[1]]
    rest: dict[int, int] = {}
    for pool in pools:
        for length, n in pool:
            rest[length] = rest.get(length, 0) + n
    return runs, rest


def best_fit(runs: list[Run], rest: dict[int, int], capacity: int) -> list[Run]:
    """Put the remaining pieces, by falling length, where the least room stays."""
    room: dict[int, list[Run]] = {}
    order: list[int] = []

    def put(run: Run, left: int) -> None:
        if left not in room:
            room[left] = []
            insort(order, left)
        room[left].append(run)

    for n, items in runs:
        put((n, items), capacity - sum(a * b for a, b in items))
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                for bins, k in ((n // each, each), (int(n % each > 0), n % each)):
                    if bins:
                        put((bins, ((length, k),)), capacity - k * length)
                break
            left = order[at]
            bins, items = room[left].pop()
            if not room[left]:
                del room[left], order[at]
            # as many into each as go, unless there are fewer pieces than sequences
            k = max(1, min(left // length, n // bins))
            t = min(bins, n // k)
            put((t, (*items, (length, k))), left - k * length)
            if bins > t:
                put((bins - t, items), left)
            n -= t * k
    return [run for left in order for run in room[left]]


def plan_sequences(histogram: dict[int, int], cfg: PackConfig) -> list[Run]:
    """Runs of equal sequences for (length: count)."""
    if any(not 1 <= length <= cfg.capacity for length in histogram):
        raise ValueError(f"lengths must be 1 to {cfg.capacity}")
    full: list[Run] = [(histogram[cfg.capacity], ((cfg.capacity, 1),))] if cfg.capacity in histogram else []
    others = {a: n for a, n in histogram.items() if a != cfg.capacity}
    large = sorted(((a, n) for a, n in others.items() if a * cfg.large_part > cfg.capacity), reverse=True)
    runs: list[Run] = []
    rest = {a: n for a, n in others.items() if a * cfg.large_part <= cfg.capacity}
    if large:
        groups = linear_groups(large, cfg.groups)
        merged: dict[int, list[tuple[int, int]]] = {}
        for g in groups:  # groups with one greatest length are one size
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        demand = np.array([sum(n for _, n in merged[s]) for s in sizes], float)
        runs, left = substitute(solve(sizes, demand, cfg.capacity), [merged[s] for s in sizes])
        rest |= left
    return full + best_fit(runs, rest, cfg.capacity)


class Places:
    """Where the piece with a given number among those of its length goes."""

    def __init__(self, runs: list[Run]):
        used: dict[int, int] = {}
        rows, base = [], 0
        for n, items in runs:
            at = 0
            for length, k in items:
                rows.append((length, used.get(length, 0), base, k, at))
                used[length] = used.get(length, 0) + n * k
                at += length * k
            base += n
        rows.sort()
        columns = np.array(rows, np.int64).reshape(-1, 5).T
        self.length, self.first, self.base, self.each, self.at = columns
        self.key = (self.length << 44) + self.first
        self.sequences = base

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 44) + number, side="right") - 1
        nth = number - self.first[i]
        return self.base[i] + nth // self.each[i], self.at[i] + nth % self.each[i] * length


# ------------------------------------------------------------------- Spark


# The splitting which the quick way understands. It cuts a lower-cased text
# into contractions, runs of letters, single digits and runs of other signs.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
# Below this code point composition, case and classes of characters do not depend on context
# or on the version of the character tables.
PLAIN = 0x250


def _class_of(kinds: str) -> str:
    """A character class of the plain characters of some categories, and of what they become in lower case."""
    plain = {d for c in map(chr, range(PLAIN)) for d in (c, *c.lower())}
    return "".join(re.escape(c) for c in sorted(plain) if unicodedata.category(c)[0] in kinds)


class _Encoder:
    """Ids of texts.

    Plain texts are cut by the file's own pattern, and each different piece goes through the
    file's merges once. Other texts (far scripts, special tokens, or a file with other
    rules) are encoded word by word: white space ends a token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        normalizer, before = rules.get("normalizer") or {}, (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.plain = (
            normalizer.get("normalizers") == NORMALIZERS
            and len(before) == 2
            and before[0].get("pattern") == {"Regex": SPLIT_PATTERN}
            and (before[0].get("behavior"), before[0].get("invert")) == ("Removed", True)
            and before[1].get("type") == "ByteLevel"
            and not (before[1].get("add_prefix_space") or before[1].get("use_regex"))
            and rules["model"]["type"] == "BPE"
            and not rules["model"].get("dropout")
        )
        self.special = [t["content"] for t in rules.get("added_tokens") or []]
        letters, digits = _class_of("L"), _class_of("N")
        white = r"\x09-\x0D\x20\x85\xA0"
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{white}{letters}{digits}]+").findall
        self.beyond = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]").search
        # byte-level vocabularies show each byte as a printable character
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _remember(self, held: dict[str, bytes], part: str, ids: list[int]) -> bytes:
        found = np.array(ids, "<u4").tobytes()
        if len(part) < 64:
            if len(held) >= MEMORY_ENTRIES:
                held.clear()
            held[part] = found
        return found

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.letters)
        return self._remember(self.pieces, piece, [t.id for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        return self._remember(self.words, word, self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if self.plain and not self.beyond(text) and not any(t in text for t in self.special):
            parts, held, ids_of = self.split(text.lower()), self.pieces, self._piece
        else:
            parts, held, ids_of = [w.decode() for w in text.encode().split()], self.words, self._word
        ids = list(map(held.get, parts))
        if None in ids:
            ids = [ids_of(p) if found is None else found for p, found in zip(parts, ids)]
        return b"".join(ids)


def token_pieces(
    docs: DataFrame, tokenizer: str, cfg: PackConfig = PackConfig(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Key, piece, start, length and ids (binary, little-endian unsigned 32-bit) of every piece."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    end, width = np.array([cfg.end_id], "<u4").tobytes(), 4 * cfg.capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_in_worker(("tokenizer", tokenizer), lambda: _Encoder(tokenizer)).encode
        for batch in batches:
            for part in slices(batch, 1):
                owner, piece, ids = [], [], []
                for i, value in enumerate(part.column("_text")):
                    whole = encode(value.as_py() or "") + end
                    for at in range(0, len(whole), width):
                        owner.append(i)
                        piece.append(at // width)
                        ids.append(whole[at : at + width])
                piece = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_key").take(pa.array(owner, pa.int64())),
                        pa.array(piece),
                        pa.array(piece.astype(np.int64) * cfg.capacity),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=[key, "piece", "start", "length", "ids"],
                )

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)['_key']}, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """All rows and columns of ``pieces`` with their ``sequence_id`` and ``offset``.

    ``length`` is the size of a piece. One length may be that of a third of all pieces, so
    pieces are numbered within (length, salt), and the salts' counts are added up.
    """
    pieces = stage(pieces, "pieces")
    total = pieces.count()
    salts = max(MIN_SALTS, -(-total // ROWS_PER_SALT))
    rows = pieces.withColumn("_hash", F.xxhash64(*pieces.columns))
    rows = rows.withColumn("_salt", F.pmod("_hash", F.lit(salts)).cast("int"))
    counts = stage(rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = pieces.sparkSession.sparkContext.broadcast(Places(plan_sequences(histogram, cfg)))

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if len(histogram) * salts <= MAX_BROADCAST_COUNTS:
        counts = F.broadcast(counts)
    within = Window.partitionBy("length", "_salt").orderBy("_hash")
    rows = rows.withColumn("_number", F.row_number().over(within) - 1).join(counts, ["length", "_salt"])
    rows = rows.select(*pieces.columns, (F.col("_number") + F.col("_before")).alias("_number"))
    schema = ", ".join(f"`{c}` {k}" for c, k in pieces.dtypes) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            found = places.value.find(length, batch.column("_number").to_numpy())
            columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != "_number"]
            names = [n for n in batch.schema.names if n != "_number"]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, found)], names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(place, schema)


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per sequence: its ids in order, and the (document, offset) of each piece."""
    item = F.struct("offset", "length", F.col(key).alias("key"), "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    ids = F.aggregate("_items", F.lit(b""), lambda done, one: F.concat(done, one["ids"]))
    where = F.transform("_items", lambda one: F.struct(one["key"].alias(key), one["offset"], one["length"]))
    return rows.select("sequence_id", ids.alias("ids"), where.alias("pieces"))
