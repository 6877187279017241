"""Periodic runs of words: maximal pairs from the LCP-interval tree of each text.

A run is a maximal stretch of words with smallest period q and length of at least
``max(min_length, min_copies * q)``. Two equal stretches of length L at distance p which no
word extends to the left or right (a maximal pair) span one stretch of period p and length
L + p. So the maximal pairs with ``L >= (min_copies - 1) * p`` and ``L + p >= min_length``
are the runs; of pairs which span the same stretch the one of smallest p counts.

Per text: the suffixes are sorted by doubling ranks, neighbours get their common prefix
length, and the tree of LCP intervals is walked from the deepest node up. A node holds the
places of its leaves in order, each with the class of the word on its left. When two
children meet, the places of the smaller one are looked up in the larger one. A partner of
another left class at an allowed distance is a maximal pair, for the word on the right
differs between children. Only the nearest place on either side can be the partner with
the smallest period: one between them would give a smaller period. So each place costs one
search, however often a word is repeated.

Every pair has ``L >= min_length * (min_copies - 1) / min_copies`` words, so a text of which no
window of that many words occurs twice has no run; all windows of all texts are compared
by hash first. Words are compared by a 64-bit hash.

Defined results. NULL, empty or white text: no words, no runs, the empty string. A text is
never cut; one text is held by one task, with about 100 bytes a word. Repeated rows are
treated one by one. Ties of the greatest exponent go to the smallest start, then period.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblock import Block, Tokens, map_blocks, mix, pair

Run = tuple[int, int, int]  # start, length, period


@dataclass(frozen=True)
class RunRule:
    min_length: int = 24
    min_copies: int = 3

    @property
    def min_common(self) -> int:
        """The least common prefix of a pair which spans a run."""
        return -(-self.min_length * (self.min_copies - 1) // self.min_copies)


# ------------------------------------------------------------------- suffixes


def repeated_windows(words: Tokens, h: np.ndarray, size: int) -> np.ndarray:
    """The texts in which some window of ``size`` words occurs twice."""
    at = np.arange(max(len(h) - size + 1, 0))
    window, have = None, 0
    power, span = h, 1
    while have < size:  # the window as a chain of stretches of 1, 2, 4, ... words
        if size & span:
            piece = power[have : have + len(at)]
            window = piece if window is None else pair(window, piece)
            have += span
        power, span = pair(power[:-span], power[span:]) if len(power) > span else power[:0], 2 * span
    owner = words.owner()
    whole = owner[at] == owner[at + size - 1] if len(at) else np.zeros(0, bool)
    window, owner = window[whole] if len(at) else h[:0], owner[at[whole]]
    keys = np.sort(window ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    twice = keys[1:][keys[1:] == keys[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    return np.unique(owner[np.isin(window ^ mix(owner.astype(np.uint64) + np.uint64(1)), twice)])


def sorted_suffixes(ranks: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order; ``ranks`` are dense numbers of the words.

    Ranks by the first k words give ranks by the first 2k; only ties are sorted again.
    """
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    first = np.ones(n, bool)
    first[1:] = ranks[order][1:] != ranks[order][:-1]
    slots = np.flatnonzero(first)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(slots, np.diff(np.append(slots, n)))  # slot of the first equal one
    rank[n] = -1
    out = order.copy()
    k = 1
    while True:
        sizes = np.diff(np.append(np.flatnonzero(first), n))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(tied):
            return out
        at = out[tied]
        old = rank[at]
        after = rank[np.minimum(at + k, n)] + 1
        at = at[np.lexsort((after, old))]
        out[tied] = at
        old, after = rank[at], rank[np.minimum(at + k, n)]
        new_group = np.ones(len(at), bool)
        new_group[1:] = (old[1:] != old[:-1]) | (after[1:] != after[:-1])
        first[tied] = new_group
        starts = np.flatnonzero(new_group)
        rank[at] = np.repeat(tied[starts], np.diff(np.append(starts, len(at))))
        k *= 2


def common_prefixes(words: list[int], order: list[int]) -> list[int]:
    """Common prefix of each suffix in order with the one before it; 0 for the first."""
    n = len(words)
    before = [-1] * n
    for a, b in zip(order, order[1:]):
        before[b] = a
    lcp, k = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            k = 0
            continue
        most = n - max(i, j)
        while k < most and words[i + k] == words[j + k]:
            k += 1
        lcp[i] = k
        if k:
            k -= 1
    return [lcp[i] for i in order]


# ------------------------------------------------------------------- maximal pairs


def find_runs(words: np.ndarray, rule: RunRule = RunRule()) -> list[Run]:
    """All runs of one text, by start, then period; ``words`` are any numbers naming words."""
    dense = np.unique(words, return_inverse=True)[1].astype(np.int64)
    places = sorted_suffixes(dense).tolist()
    left = dense.tolist()
    lcp = common_prefixes(left, places)
    left.append(-1)  # left[-1] is the class at the start of the text
    copies, least, shortest = rule.min_copies - 1, rule.min_length, rule.min_common
    best: dict[tuple[int, int], int] = {}

    def meet(large: list[int], small: list[int], common: int) -> list[int]:
        """Report the pairs between two children of a node, and join their places."""
        if len(large) < len(small):
            large, small = small, large
        reach = common // copies
        near = least - common
        for b in small:
            k = bisect_left(large, b)
            for a in large[max(k - 1, 0) : k + 1]:
                p = b - a if b > a else a - b
                if near <= p <= reach and left[a - 1] != left[b - 1]:
                    start = a if a < b else b
                    stretch = (start, start + p + common)
                    if best.get(stretch, p) >= p:
                        best[stretch] = p
        if len(small) == 1:
            large.insert(bisect_left(large, small[0]), small[0])
            return large
        return sorted(large + small)  # two sorted lists: a merge

    open_: list[tuple[int, list[int]]] = []  # nodes from the root down: depth, places
    for i, place in enumerate(places):
        node = [place]
        depth = lcp[i + 1] if i + 1 < len(lcp) else 0
        if depth < shortest:
            depth = 0
        while open_ and open_[-1][0] > depth:
            at, held = open_.pop()
            node = meet(held, node, at)
        if not depth:
            continue
        if open_ and open_[-1][0] == depth:
            open_[-1] = (depth, meet(open_[-1][1], node, depth))
        else:
            open_.append((depth, node))
    return sorted((s, e - s, p) for (s, e), p in best.items())


def sharpest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period, compared without rounding."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def copies_in(runs: list[Run], n: int) -> np.ndarray:
    """The words which some run holds after its first period."""
    marks = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return np.cumsum(marks[:-1]) > 0


def joined(block: Block, words: Tokens, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text with one space between, as bytes and bounds of the texts."""
    kept = np.flatnonzero(keep)
    bounds = np.searchsorted(kept, words.bounds)
    sizes = words.ends[kept] - words.starts[kept] + 1
    ends = np.cumsum(sizes)
    from_ = np.repeat(words.starts[kept] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    spaces = ends - 1
    from_[spaces] = 0
    out = block.data[from_] if len(from_) else np.zeros(0, np.uint8)
    out[spaces] = 0x20
    return out, np.concatenate([[0], ends])[bounds]


_RUNS = "runs array<struct<start:long,length:long,period:long>>, collapsed string"
_DIGEST = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def block_runs(block: Block, rule: RunRule) -> tuple[Tokens, list[list[Run]], np.ndarray]:
    """The words of a block, the runs of each text, and which words stay without the copies."""
    words = block.words()
    h = words.hashes()
    runs: list[list[Run]] = [[] for _ in range(block.n)]
    keep = np.ones(len(h), bool)
    for i in repeated_windows(words, h, rule.min_common).tolist():
        a, b = int(words.bounds[i]), int(words.bounds[i + 1])
        runs[i] = find_runs(h[a:b], rule)
        keep[a:b] = ~copies_in(runs[i], b - a)
    return words, runs, keep


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", rule: RunRule = RunRule()) -> DataFrame:
    """Per row: its key, its runs, and its words without the copies, joined by one space."""
    rows = docs.select(F.col(key), F.col(text).alias("_text"))

    def work(part: pa.RecordBatch, block: Block) -> dict:
        words, runs, keep = block_runs(block, rule)
        data, bounds = joined(block, words, keep)
        raw = data.tobytes()
        kept = [raw[a : max(b - 1, a)].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        spans = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs]
        return {key: part.column(0), "runs": spans, "collapsed": kept}

    return map_blocks(rows, "_text", f"`{key}` {dict(rows.dtypes)[key]}, {_RUNS}", work)


def run_digests(docs: DataFrame, text: str = "text", key: str = "doc_id", rule: RunRule = RunRule()) -> DataFrame:
    """Per row: its key, the number of runs, the sharpest one, and SHA-256 of all runs (a line
    ``start,length,period`` each) and of the words without the copies."""
    rows = docs.select(F.col(key), F.col(text).alias("_text"))

    def work(part: pa.RecordBatch, block: Block) -> dict:
        words, runs, keep = block_runs(block, rule)
        data, bounds = joined(block, words, keep)
        view = memoryview(data)
        best = [sharpest(found) or (None, None, None) for found in runs]
        lines = ["".join(f"{s},{n},{p}\n" for s, n, p in found) for found in runs]
        return {
            key: part.column(0),
            "n_runs": [len(found) for found in runs],
            "start": [s for s, _, _ in best],
            "length": [n for _, n, _ in best],
            "period": [p for _, _, p in best],
            "exponent_milli": [None if s is None else 1000 * n // p for s, n, p in best],
            "runs_sha256": [hashlib.sha256(line.encode()).hexdigest() for line in lines],
            "collapsed_sha256": [
                hashlib.sha256(view[a : max(b - 1, a)]).hexdigest()
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
            ],
        }

    return map_blocks(rows, "_text", f"`{key}` {dict(rows.dtypes)[key]}, {_DIGEST}", work)
