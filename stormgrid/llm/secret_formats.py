"""Secrets found by fixed patterns, and by probabilistic automata inferred from them.

The fixed patterns give labelled credentials. Per kind, a prefix tree of (at most
``max_credentials`` distinct) credentials is reduced by state merging: a state is merged
into the most likely of the states whose symbol frequencies, and those of all their
successors, differ by less than a Hoeffding bound; a state compatible with none becomes a
state of the automaton. Then every candidate of all texts (a maximal run of
``[A-Za-z0-9+/_-]`` of ``min_length`` characters or more) is scored: its bits are the log
ratio of its likelihood under the best automaton and under letter pairs counted over all
words of all documents outside the fixed matches. Candidates with ``min_bits`` or more which
touch no fixed match are reported beside the fixed matches.

Only the fitted sample is bounded. Letter pairs are counted in Spark over all texts (69 x 69
numbers reach the driver), and all texts are searched whole.

Defined results. NULL or empty text: no spans. Repeated rows are scanned one by one. No
credential of a kind: no automaton, so the fixed patterns decide alone. Equal scores: the
kind listed first. Positions are code points, the end exclusive. Other columns of the
input are not read, so their names do not matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .textblock import Block, blocks, map_blocks

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_LENGTHS = (6, 20, 24)

SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.="
N_SYMBOLS = len(SYMBOLS)
END = N_SYMBOLS  # the end of a credential; also the start and end of a word
SYMBOL = np.full(256, -1, np.int16)
SYMBOL[list(SYMBOLS)] = np.arange(N_SYMBOLS)
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
CANDIDATE = np.zeros(256, bool)
CANDIDATE[list(SYMBOLS[:-2])] = True

_SPANS = "n_assign long, n_access long, n_hex long, spans array<struct<kind:string,start:long,end:long,base:boolean,bits:double>>"


@dataclass(frozen=True)
class SecretConfig:
    """``max_credentials`` distinct credentials per kind, of which the first ``max_symbols``
    characters are used, fit the automata; ``alpha`` is the level of the merge test and
    ``assumed`` the weight of a uniform prior in each state."""

    max_credentials: int = 1000
    max_symbols: int = 64
    alpha: float = 0.01
    assumed: float = 0.5
    min_length: int = 16
    min_bits: float = 20.0


# ------------------------------------------------------------------- fixed patterns


def base_spans(block: Block) -> list[tuple[int, int, int, int]]:
    """Fixed matches of a block as (text, start byte, end byte, kind), places in the block."""
    found = []
    data, offsets = block.data, block.offsets
    marks = block.sums((data == ord(":")) | (data == ord("=")))
    for i in np.flatnonzero(marks).tolist():
        at = int(offsets[i])
        for m in ASSIGN.finditer(data[at : offsets[i + 1]].tobytes()):
            if m.end(2) - m.start(2) >= MIN_LENGTHS[0]:
                found.append((i, at + m.start(), at + m.end(), 0))
    begins = [m.start() for m in re.finditer(b"AKIA", data.tobytes())]
    for i in np.unique(np.searchsorted(offsets, begins, side="right") - 1).tolist():
        at = int(offsets[i])
        for m in ACCESS.finditer(data[at : offsets[i + 1]].tobytes()):
            if m.end() - m.start() >= MIN_LENGTHS[1]:
                found.append((i, at + m.start(), at + m.end(), 1))
    runs = block._runs(HEX[data], None)
    for k in np.flatnonzero(runs.ends - runs.starts >= MIN_LENGTHS[2]).tolist():
        start = int(runs.starts[k])
        found.append((int(np.searchsorted(runs.bounds, k, side="right")) - 1, start, int(runs.ends[k]), 2))
    return found


def credential(data: np.ndarray, start: int, end: int, kind: int) -> bytes:
    """The secret part of a fixed match."""
    found = data[start:end].tobytes()
    return ASSIGN.match(found).group(2) if kind == 0 else found


def count_formats(docs: DataFrame, text: str = "text", cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """Rows (kind, value, n): credentials of the fixed patterns (cut after ``max_symbols`` and
    one more), and with kind -1 the letter pairs of all words, numbered ``69 * first + second``."""
    width = N_SYMBOLS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(width * width, np.int64)
        for batch in batches:
            for _, block in blocks(batch, "_text"):
                found = base_spans(block)
                pairs += word_pairs(block, found)
                values = [credential(block.data, s, e, kind)[: cfg.max_symbols + 1].decode() for _, s, e, kind in found]
                kinds = np.array([kind for *_, kind in found], np.int32)
                yield pa.RecordBatch.from_pydict({"kind": kinds, "value": pa.array(values, pa.string()), "n": np.ones(len(kinds), np.int64)})
        seen = np.flatnonzero(pairs)
        kinds = np.full(len(seen), -1, np.int32)
        yield pa.RecordBatch.from_pydict({"kind": kinds, "value": pa.array([str(i) for i in seen], pa.string()), "n": pairs[seen]})

    rows = docs.select(F.col(text).alias("_text")).mapInArrow(count, "kind int, value string, n long")
    return rows.groupBy("kind", "value").agg(F.sum("n").alias("n"))


def word_pairs(block: Block, found: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Counts of neighbouring symbols in the runs of symbols outside the fixed matches, with a
    mark at both ends."""
    width = N_SYMBOLS + 1
    plain = SYMBOL[block.data] >= 0
    for _, s, e, _ in found:
        plain[s:e] = False
    runs = block._runs(plain, None)
    inside = plain.copy()
    inside[runs.ends - 1] = False
    symbols = SYMBOL[block.data].astype(np.int64)
    at = np.flatnonzero(inside)
    out = np.bincount(symbols[at] * width + symbols[at + 1], minlength=width * width)
    out += np.bincount(END * width + symbols[runs.starts], minlength=width * width)
    out += np.bincount(symbols[runs.ends - 1] * width + END, minlength=width * width)
    return out


# ------------------------------------------------------------------- grammar inference


@dataclass(frozen=True)
class Automaton:
    """Per state and symbol: the next state, and the bits (log2 of the probability)."""

    step: np.ndarray
    bits: np.ndarray


class PrefixTree:
    """Counts of symbols after each prefix; states are merged in place."""

    def __init__(self, values: list[bytes], max_symbols: int):
        self.next: list[dict[int, int]] = [{}]
        self.counts: list[dict[int, int]] = [{}]
        for value in values:
            at = 0
            for symbol in SYMBOL[list(value[:max_symbols])].tolist():
                self.counts[at][symbol] = self.counts[at].get(symbol, 0) + 1
                if symbol not in self.next[at]:
                    self.next[at][symbol] = len(self.next)
                    self.next.append({})
                    self.counts.append({})
                at = self.next[at][symbol]
            if len(value) <= max_symbols:
                self.counts[at][END] = self.counts[at].get(END, 0) + 1

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Whether the frequencies after ``a`` and ``b``, and after equal continuations, agree."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            left, right = self.counts[a], self.counts[b]
            n, m = sum(left.values()), sum(right.values())
            if not n or not m:
                continue
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if most < 1 and any(abs(left.get(s, 0) / n - right.get(s, 0) / m) > most for s in left.keys() | right.keys()):
                return False
            todo += [(self.next[a][s], c) for s, c in self.next[b].items() if s in self.next[a]]
        return True

    def likeness(self, a: int, b: int, assumed: float) -> float:
        """Mean log probability of the symbols after ``b`` in state ``a``."""
        left, right = self.counts[a], self.counts[b]
        n = sum(left.values()) + assumed
        share = assumed / (N_SYMBOLS + 1)
        return sum(c * math.log((left.get(s, 0) + share) / n) for s, c in right.items()) / max(sum(right.values()), 1)

    def fold(self, a: int, b: int) -> None:
        """Add the counts of the tree below ``b`` to those from ``a`` on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for s, c in self.counts[b].items():
                self.counts[a][s] = self.counts[a].get(s, 0) + c
            for s, c in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], c))
                else:
                    self.next[a][s] = c


def infer(values: list[bytes], cfg: SecretConfig = SecretConfig()) -> Automaton:
    """Merge compatible states of the prefix tree, the most frequent ones first."""
    tree = PrefixTree(sorted(values), cfg.max_symbols)
    bound = math.sqrt(0.5 * math.log(2 / cfg.alpha))
    states = [0]
    while True:
        known = set(states)
        open_ = [(-tree.counts[q][s], states.index(q), s) for q in states for s, c in tree.next[q].items() if c not in known]
        if not open_:
            break
        _, at, s = min(open_)
        new = tree.next[states[at]][s]
        fits = [(-tree.likeness(q, new, cfg.assumed), k) for k, q in enumerate(states) if tree.compatible(q, new, bound)]
        if fits:
            into = states[min(fits)[1]]
            tree.next[states[at]][s] = into
            tree.fold(into, new)
        else:
            states.append(new)
    number = {q: k for k, q in enumerate(states)}
    step = np.repeat(np.arange(len(states)), N_SYMBOLS).reshape(-1, N_SYMBOLS)
    bits = np.zeros((len(states), N_SYMBOLS + 1))
    for k, q in enumerate(states):
        for s, c in tree.next[q].items():
            step[k, s] = number[c]
        for s, c in tree.counts[q].items():
            bits[k, s] = c
    bits = np.log2((bits + cfg.assumed / (N_SYMBOLS + 1)) / (bits.sum(1, keepdims=True) + cfg.assumed))
    return Automaton(step, bits)


@dataclass(frozen=True)
class SecretModel:
    automata: dict[int, Automaton]
    background: Automaton


def fit(docs: DataFrame, text: str = "text", cfg: SecretConfig = SecretConfig()) -> SecretModel:
    """Automata of the credentials, and the letter pairs, of all documents.

    Which distinct credentials are taken is decided by a hash of the credential alone.
    """
    counted = stage(count_formats(docs, text, cfg), "secret-formats")
    picked = [
        counted.where(F.col("kind") == kind).select("kind", "value").orderBy(F.xxhash64("value"), "value").limit(cfg.max_credentials)
        for kind in range(len(KINDS))
    ]
    values: dict[int, list[bytes]] = {}
    for kind, value in picked[0].union(picked[1]).union(picked[2]).toArrow().to_pandas().itertuples(index=False):
        values.setdefault(kind, []).append(value.encode())
    pairs = np.ones((N_SYMBOLS + 1) ** 2)
    seen = counted.where("kind = -1").select(F.col("value").cast("int").alias("at"), "n").toArrow()
    pairs[seen.column("at").to_numpy()] += seen.column("n").to_numpy()
    pairs = pairs.reshape(N_SYMBOLS + 1, N_SYMBOLS + 1)
    step = np.tile(np.arange(N_SYMBOLS), (N_SYMBOLS + 1, 1))  # the state is the symbol before
    background = Automaton(step, np.log2(pairs / pairs.sum(1, keepdims=True)))
    return SecretModel({kind: infer(found, cfg) for kind, found in values.items()}, background)


def likelihood(auto: Automaton, begin: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of each run of symbols; all runs take their n-th step at once, the last few singly."""
    order = np.argsort(starts - ends, kind="stable")
    starts, sizes = starts[order], (ends - starts)[order]
    state = np.full(len(order), begin, np.int64)
    bits = np.zeros(len(order))
    at, live = 0, len(order)
    while live > 4:
        symbol = SYMBOL[data[starts[:live] + at]]
        bits[:live] += auto.bits[state[:live], symbol]
        state[:live] = auto.step[state[:live], symbol]
        at += 1
        live = int(np.searchsorted(-sizes, -at))
    step, cost = auto.step.tolist(), auto.bits.tolist()
    for k in range(live):
        q, total = int(state[k]), 0.0
        for symbol in SYMBOL[data[starts[k] + at : starts[k] + sizes[k]]].tolist():
            total += cost[q][symbol]
            q = step[q][symbol]
        bits[k] += total
        state[k] = q
    out = np.empty(len(order))
    out[order] = bits + auto.bits[state, END]
    return out


def scored_spans(block: Block, model: SecretModel, cfg: SecretConfig) -> tuple[np.ndarray, ...]:
    """All candidates: text, start, end, the kind of the best automaton, bits over the background."""
    runs = block._runs(CANDIDATE[block.data], None)
    long = runs.ends - runs.starts >= cfg.min_length
    starts, ends, owner = runs.starts[long], runs.ends[long], runs.owner()[long]
    plain = likelihood(model.background, END, block.data, starts, ends)
    best, kinds = np.full(len(starts), -np.inf), np.zeros(len(starts), np.int64)
    for kind, auto in sorted(model.automata.items()):
        bits = likelihood(auto, 0, block.data, starts, ends) - plain
        kinds[bits > best] = kind
        best = np.maximum(best, bits)
    return owner, starts, ends, kinds, best


def find_secrets(
    docs: DataFrame, model: SecretModel, text: str = "text", key: str = "doc_id", cfg: SecretConfig = SecretConfig()
) -> DataFrame:
    """Per row: its key, the number of fixed matches of each kind, and all spans in order of
    their start, then of their kind."""
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch, block: Block) -> dict:
        counts = np.zeros((block.n, len(KINDS)), np.int64)
        taken: list[list[tuple]] = [[] for _ in range(block.n)]
        for i, s, e, kind in base_spans(block):
            counts[i, kind] += 1
            taken[i].append((s, kind, e, True, None))
        columns = scored_spans(block, shared.value, cfg)
        good = columns[4] >= cfg.min_bits
        for i, s, e, kind, bits in zip(*(c[good].tolist() for c in columns), strict=True):
            if not any(base and s < to and at < e for at, _, to, base, _ in taken[i]):
                taken[i].append((s, kind, e, False, bits))
        points = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum((block.data & 0xC0) != 0x80, out=points[1:])
        spans = [
            [
                {"kind": KINDS[k], "start": int(points[s] - first), "end": int(points[e] - first), "base": base, "bits": bits}
                for s, k, e, base, bits in sorted(found, key=lambda x: x[:3])
            ]
            for found, first in zip(taken, points[block.offsets[:-1]].tolist(), strict=True)
        ]
        return {key: part.column(0), "n_assign": counts[:, 0], "n_access": counts[:, 1], "n_hex": counts[:, 2], "spans": spans}

    return map_blocks(rows, "_text", f"`{key}` {dict(rows.dtypes)[key]}, {_SPANS}", work)
