"""Repair of conversation structure: the cheapest edits which give ``(system? (user assistant)+)?``.

A row is kept (0), its role set to user or assistant (1), or deleted (2, forced for blank and
duplicate rows); an empty user or assistant row is inserted anywhere (5). A truncated row
which is not deleted adds 5. The audit is the initials K, R, D, I of the cheapest edits, the
ASCII-least of several.

Per conversation the rows become one byte each: class of the role, and the first fault
(blank, duplicate, truncated). Re-Pair rules are counted over the bytes of all conversations:
each round replaces the most frequent pairs by new symbols. A symbol stands for a transfer
matrix over the four states of the pattern (start, after system, after user, after
assistant): entry (i, j) is the least cost of all edits of its rows, with insertions before
each, which lead from i to j. A rule's matrix is the min-plus product of its two parts, so
each rule is evaluated once, bottom-up, for all conversations which use it. Its audit rope is
the middle state of each entry; letters are spelled out on demand.

Ties need no letters either. Two different audits of the same rows are never prefixes of
each other (each ends in the letter of the last row), so the first part which differs
decides, and each matrix carries the rank of its entries within a row.

Rows of one conversation may be a third of all rows. Equal rows are counted first; the rest
is split by ranges of (conversation, turn), each range turns its rows into bytes, and only
these are brought together per conversation: one byte per row, like the audit itself, which
is one cell of the result. Repeated texts are found per (conversation, role, text digest).
The repaired rows are streamed in order through one task per conversation, in bounded
memory, because SHA-256 of them is a sequential function.

Defined results. Rows are taken by turn, NULL turns first, equal turns by role, then MD5 of
the text; equal rows are adjacent. A NULL conversation is a conversation. NULL roles and
texts are one space. Roles with another initial than s, u, a can only be reroled or deleted.
No rows, or none left: zeros and the empty audit. Texts are compared by MD5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .textblock import between, text_arrays

OTHER = 3  # classes of roles: 0 system, 1 user, 2 assistant, 3 anything else
OK, BLANK, DUPLICATE, TRUNCATED = range(4)  # first faults; a byte is 4 * class + fault
TERMINALS = 16
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
# the state after a role of class 0, 1, 2, where the pattern allows it
AFTER = {(START, 0): 1, (START, 1): 2, (AFTER_SYSTEM, 1): 2, (AFTER_USER, 2): 3, (AFTER_ASSISTANT, 1): 2}
ROLE_NAMES = ("system", "user", "assistant")
WHITE = " \t\n\x0b\x0c\r"
NEVER = 1 << 40
INSERT, DELETE, REROLE, CUT = 5, 2, 1, 5

PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


@dataclass(frozen=True)
class GrammarConfig:
    """Rounds of Re-Pair, and pairs replaced per round; they change the work, not the result."""

    rounds: int = 5
    rules_per_round: int = 24


# ------------------------------------------------------------------- transfer matrices


@dataclass(frozen=True)
class Matrices:
    """Per symbol: the least costs, the middle states, and the ranks of the audits in each row.
    A symbol without parts has its audits in ``letters`` instead of middle states."""

    cost: np.ndarray
    middle: np.ndarray
    rank: np.ndarray
    rules: tuple[tuple[int, int], ...]
    letters: dict[tuple[int, int, int], str]

    def audit(self, symbol: int, i: int, j: int) -> str:
        """The letters of one entry; those of rules are spelled once per worker."""
        if (symbol, i, j) not in self.letters:
            left, right = self.rules[symbol - TERMINALS]
            k = int(self.middle[symbol, i, j])
            self.letters[symbol, i, j] = self.audit(left, i, k) + self.audit(right, k, j)
        return self.letters[symbol, i, j]


def row_edits(symbol: int) -> dict[tuple[int, int], tuple[int, str]]:
    """For one row: the cheapest way between two states, insertions before the row included."""
    role, fault = divmod(symbol, 4)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for i, n in product(range(4), range(3)):
        at = i
        for _ in range(n):  # insertions go the one way the pattern allows
            at = AFTER[at, 2] if at == AFTER_USER else AFTER[at, 1]
        ways = [(DELETE, "D", at)]
        if fault in (OK, TRUNCATED):
            extra = CUT if fault == TRUNCATED else 0
            ways += [(extra, "K", AFTER[at, role])] if (at, role) in AFTER else []
            ways += [(REROLE + extra, "R", AFTER[at, to]) for to in (1, 2) if (at, to) in AFTER]
        for cost, letter, j in ways:
            found = (INSERT * n + cost, "I" * n + letter)
            best[i, j] = min(best.get((i, j), found), found)
    return best


def ranks(keys: np.ndarray) -> np.ndarray:
    """Ranks along the last axis."""
    return np.argsort(np.argsort(keys, axis=-1, kind="stable"), axis=-1, kind="stable")


def chain(cost: np.ndarray, rank: np.ndarray, then_cost: np.ndarray, then_rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Min-plus product of rows of 4 states (n, 4) with matrices (n, 4, 4): costs, middle states, ranks."""
    total = np.minimum(cost[:, :, None] + then_cost, NEVER)
    middle = np.argmin(total * 4 + rank[:, :, None], axis=1)
    at = np.arange(len(cost))[:, None]
    to = np.arange(4)[None, :]
    keys = rank[at, middle] * 4 + then_rank[at, middle, to]
    best = total[at, middle, to]
    return best, middle, ranks(keys + (best >= NEVER) * 64)


def evaluate(rules: list[tuple[int, int]]) -> Matrices:
    """The matrices of all symbols, rules after their parts."""
    n = TERMINALS + len(rules)
    cost = np.full((n, 4, 4), NEVER, np.int64)
    middle, rank = np.zeros((n, 4, 4), np.int64), np.zeros((n, 4, 4), np.int64)
    letters = {}
    for symbol in range(TERMINALS):
        edits = row_edits(symbol)
        for (i, j), (c, audit) in edits.items():
            cost[symbol, i, j] = c
            letters[symbol, i, j] = audit
        for i in range(4):
            order = sorted(range(4), key=lambda j: edits[i, j][1] if (i, j) in edits else "~")  # noqa: B023
            rank[symbol, i, order] = np.arange(4)
    for r, (left, right) in enumerate(rules):
        at = TERMINALS + r
        cost[at], middle[at], rank[at] = chain(
            cost[left], rank[left], np.broadcast_to(cost[right], (4, 4, 4)), np.broadcast_to(rank[right], (4, 4, 4))
        )
    return Matrices(cost, middle, rank, tuple(rules), letters)


# what is inserted at the end, per last state
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def solve(m: Matrices, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Least cost and audit of each sequence; all sequences take their n-th step at once."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = bounds[:-1][order], sizes[order]
    n = len(order)
    cost = np.full((n, 4), NEVER, np.int64)
    cost[:, START] = 0
    rank = np.tile(np.arange(4), (n, 1))
    back: list[np.ndarray] = []
    for t in range(int(sizes[0]) if n else 0):
        live = int(np.searchsorted(-sizes, -t))
        s = symbols[begin[:live] + t]
        cost[:live], middle, rank[:live] = chain(cost[:live], rank[:live], m.cost[s], m.rank[s])
        back.append(middle.astype(np.int8))
    total = cost + np.array([c for c, _ in CLOSING])
    last = np.argmin(total * 4 + rank, axis=1)
    audits = [""] * n
    for k in range(n):
        j = int(last[k])
        parts = [CLOSING[j][1]]
        for t in range(int(sizes[k]) - 1, -1, -1):
            i = int(back[t][k, j])
            parts.append(m.audit(int(symbols[begin[k] + t]), i, j))
            j = i
        audits[order[k]] = "".join(reversed(parts))
    out = np.empty(n, np.int64)
    out[order] = total[np.arange(n), last]
    return out, audits


# ------------------------------------------------------------------- Re-Pair


def compress(symbols: np.ndarray, bounds: np.ndarray, rules: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Replace the pairs of each rule in turn, from the left, within each sequence."""
    s = symbols.astype(np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for r, (a, b) in enumerate(rules):
        hit = np.zeros(len(s), bool)
        hit[:-1] = (s[:-1] == a) & (s[1:] == b) & (owner[:-1] == owner[1:])
        if a == b:  # of a stretch of equal symbols, every second pair
            at = np.flatnonzero(hit)
            new = np.ones(len(at), bool)
            new[1:] = np.diff(at) > 1
            first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] if len(at) else at
            hit[at[(at - first) % 2 == 1]] = False
        at = np.flatnonzero(hit)
        if len(at):
            s[at] = TERMINALS + r
            keep = np.ones(len(s), bool)
            keep[at + 1] = False
            s, owner = s[keep], owner[keep]
    return s, np.searchsorted(owner, np.arange(len(bounds)))


def sequence_arrays(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Symbols and bounds of each conversation, and the pieces they are joined from."""
    flat = pieces.flatten()
    data, offsets = text_arrays(flat.field("symbols"))
    lists = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    return data, offsets[lists], flat


def learn_rules(sequences: DataFrame, cfg: GrammarConfig = GrammarConfig()) -> list[tuple[int, int]]:
    """The rules of some rounds of Re-Pair over all sequences (``pieces`` of ``sequences``)."""
    rules: list[tuple[int, int]] = []
    for _ in range(cfg.rounds):
        so_far = list(rules)

        def count(batches: Iterator[pa.RecordBatch], so_far: list = so_far) -> Iterator[pa.RecordBatch]:
            width = TERMINALS + len(so_far)
            total = np.zeros(width * width, np.int64)
            for batch in batches:
                s, bounds = compress(*sequence_arrays(batch.column(0))[:2], so_far)
                inner = np.ones(max(len(s) - 1, 0), bool)
                cuts = bounds[1:-1]
                inner[cuts[(cuts > 0) & (cuts < len(s))] - 1] = False
                total += np.bincount((s[:-1] * width + s[1:])[inner], minlength=width * width)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"a": seen // width, "b": seen % width, "n": total[seen]})

        pairs = sequences.select("pieces").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        found = pairs.where("n > 1").orderBy(F.desc("n"), "a", "b").limit(cfg.rules_per_round).collect()
        rules += [(row.a, row.b) for row in found]
        if len(found) < cfg.rules_per_round:
            break
    return rules


# ------------------------------------------------------------------- sequences of rows


def plain_rows(df: DataFrame, conv: str, turn: str, role: str, text: str, times: str | None) -> DataFrame:
    """The columns used, under names of their own; ``_times`` says how often a row stands there."""
    return df.select(
        F.col(conv).alias("_conv"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("_text"),
        (F.col(times) if times else F.lit(1)).cast("long").alias("_times"),
    )


def by_turn() -> list:
    """The order of the rows of a conversation."""
    return [F.col("_conv"), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_digest")]


def row_symbols(rows: DataFrame) -> DataFrame:
    """One row per different row: its symbol, the symbol of its further copies, and how many it stands for."""
    trimmed = F.rtrim("_text", F.lit(WHITE))
    marked = rows.select(
        "_conv",
        "_turn",
        "_role",
        F.unhex(F.md5("_text")).alias("_digest"),
        (trimmed == "").alias("_blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("_cut"),
        "_times",
    )
    marked = marked.groupBy("_conv", "_turn", "_role", "_digest", "_blank", "_cut").agg(F.sum("_times").alias("_times"))
    marked = stage(marked, "turns")
    # the first turn of texts which a conversation holds more than once
    order = F.struct(F.col("_turn").isNotNull().alias("set"), F.col("_turn").alias("turn"))
    seen = marked.where("_times > 0 AND NOT _blank").groupBy("_conv", "_role", "_digest")
    seen = seen.agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    seen = seen.select(*(F.col(c).alias(f"{c}2") for c in ("_conv", "_role", "_digest")), "_first")
    same = F.col("_conv").eqNullSafe(F.col("_conv2")) & (F.col("_role") == F.col("_role2")) & (F.col("_digest") == F.col("_digest2"))
    later = F.coalesce(order > F.col("_first"), F.lit(False))
    fault = F.when(F.col("_blank"), BLANK).when(later, DUPLICATE).when(F.col("_cut"), TRUNCATED).otherwise(OK)
    initial = F.instr(F.lit("sua"), F.substring("_role", 1, 1))
    role = F.when((F.col("_role") != "") & (initial > 0), initial - 1).otherwise(OTHER) * 4
    return marked.join(seen, same, "left").select(
        "_conv",
        "_turn",
        "_role",
        "_digest",
        "_times",
        (role + fault).cast("int").alias("_symbol"),
        (role + F.when(F.col("_blank"), BLANK).otherwise(DUPLICATE)).cast("int").alias("_copy"),
    )


_PIECE = "symbols binary, turns long, low long, high long"


def sequences(rows: DataFrame) -> DataFrame:
    """Per conversation its symbols in order, in ``pieces`` with their range of turns.

    Ranges of (conversation, turn) are dealt out, so a long conversation has many pieces.
    """
    symbols = row_symbols(rows)
    kind = dict(symbols.dtypes)["_conv"]
    ordered = symbols.repartitionByRange(*by_turn()).sortWithinPartitions(*by_turn())
    ordered = ordered.select("_conv", F.col("_turn").cast("long").alias("_turn"), "_times", "_symbol", "_copy")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("_conv")
            before, after = conv.slice(0, len(conv) - 1), conv.slice(1)
            new = pa.compute.fill_null(pa.compute.not_equal(before, after), True).to_numpy(zero_copy_only=False)
            both = pa.compute.and_(pa.compute.is_null(before), pa.compute.is_null(after)).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(new & ~both) + 1])
            n = len(starts)
            bounds = np.append(starts, batch.num_rows)
            times = batch.column("_times").to_numpy()
            symbol = np.repeat(batch.column("_copy").to_numpy().astype(np.uint8), times)
            ends = np.cumsum(times)
            shown = times > 0
            symbol[(ends - times)[shown]] = batch.column("_symbol").to_numpy()[shown]
            cuts = np.concatenate([[0], ends])[bounds]
            raw = symbol.tobytes()

            known = shown & batch.column("_turn").is_valid().to_numpy(zero_copy_only=False)
            turn = batch.column("_turn").fill_null(0).to_numpy()
            home = np.repeat(np.arange(n), np.diff(bounds))[known]
            turn = turn[known]
            fresh = np.ones(len(turn), bool)
            fresh[1:] = (turn[1:] != turn[:-1]) | (home[1:] != home[:-1])
            have = np.bincount(home, minlength=n) > 0
            first, last = np.searchsorted(home, np.arange(n)), np.searchsorted(home, np.arange(n), side="right") - 1
            some = np.append(turn, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    conv.take(pa.array(starts)),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(at, at + n)),
                    pa.array([raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()),
                    pa.array(np.bincount(home[fresh], minlength=n)),
                    pa.array(some[np.where(have, first, -1)], mask=~have),
                    pa.array(some[np.where(have, last, -1)], mask=~have),
                ],
                ["_conv", "part", "at", "symbols", "turns", "low", "high"],
            )
            at += n

    pieces = ordered.mapInArrow(build, f"_conv {kind}, part int, at long, {_PIECE}")
    piece = F.struct("part", "at", "symbols", "turns", "low", "high")
    return pieces.groupBy("_conv").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))


def turn_gaps(bounds: np.ndarray, pieces: pa.StructArray) -> np.ndarray:
    """Numbers missing between the least and the greatest turn; pieces may share a turn."""
    out = np.zeros(len(bounds) - 1, np.int64)
    columns = [pieces.field(name).to_pylist() for name in ("turns", "low", "high")]
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        known = [(n, low, high) for n, low, high in zip(*(c[a:b] for c in columns), strict=True) if low is not None]
        if known:
            shared = sum(x[2] == y[1] for x, y in zip(known, known[1:]))
            out[k] = known[-1][2] - known[0][1] + 1 - sum(n for n, _, _ in known) + shared
    return out


def plan_repairs(rows: DataFrame, cfg: GrammarConfig = GrammarConfig()) -> DataFrame:
    """Per conversation of ``plain_rows``: gaps of turns, faulty rows, cost and audit of the repair."""
    table = stage(sequences(rows), "sequences")
    shared = table.sparkSession.sparkContext.broadcast(evaluate(learn_rules(table, cfg)))
    legal = np.zeros(16, bool)
    legal[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            pieces = batch.column("pieces")
            symbols, bounds, flat = sequence_arrays(pieces)
            lists = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
            role, fault = symbols // 4, symbols % 4
            pair = np.zeros(len(symbols), bool)
            pair[:-1] = ~legal[role[:-1] * 4 + role[1:]]
            pair[bounds[1:][np.diff(bounds) > 0] - 1] = False
            cost, audits = solve(m, *compress(symbols, bounds, list(m.rules)))
            counts = [between(fault == kind, bounds) for kind in (BLANK, DUPLICATE, TRUNCATED)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_conv"), *map(pa.array, [turn_gaps(lists, flat), *counts, between(pair, bounds), cost, audits])],
                ["_conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"],
            )

    return table.mapInArrow(work, f"_conv {dict(table.dtypes)['_conv']}, {PLAN}")


# ------------------------------------------------------------------- repaired rows


def repair_stream(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per conversation a head (its plan, ``edit`` NULL), then its repaired rows in order.

    The order holds within a partition, so a following step may read it as a stream.
    """
    names = [f.name for f in T.StructType.fromDDL(PLAN)]
    body = rows.where("_times > 0").withColumn("_digest", F.unhex(F.md5("_text"))).withColumn("_turn", F.col("_turn").cast("long"))
    both = plan.unionByName(body, allowMissingColumns=True)
    both = both.repartition("_conv").sortWithinPartitions("_conv", F.col("audit").isNull(), *by_turn()[1:]).drop("_digest")
    kind = dict(both.dtypes)["_conv"]
    fields = ["_conv", "_turn", "_role", "_text", "edit", *names]
    schema = T.StructType.fromDDL(f"_conv {kind}, _turn long, _role string, _text string, edit string, {PLAN}")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, end, state = "", 0, 0, START

        def role_of(letter: str, role: str) -> str:
            """The role after the edit; the pattern tells which one an edit sets."""
            nonlocal state
            if letter == "K":
                state = AFTER[state, "sua".index(role[0])]
                return role
            to = 2 if state == AFTER_USER else 1
            state = AFTER[state, to]
            return ROLE_NAMES[to]

        for batch in batches:
            out: list[list] = [[] for _ in range(4)]  # source row, role, whether text stays, edit
            roles = batch.column("_role").to_pylist()
            times = batch.column("_times").to_pylist()
            heads = batch.column("audit")
            for i in range(batch.num_rows):
                if times[i] is None:
                    audit, at, state = heads[i].as_py(), 0, START
                    end = len(audit.rstrip("I"))
                    edits = [None]
                else:
                    edits = []
                    for _ in range(times[i]):
                        begin = at
                        while audit[at] == "I":
                            at += 1
                        at += 1
                        edits += audit[begin:at]
                    if at == end:  # the last row, so what is inserted after it follows
                        edits += audit[at:]
                for letter in edits:
                    if letter == "D":
                        continue
                    out[0].append(i)
                    out[1].append(None if letter is None else role_of(letter, roles[i]))
                    out[2].append(letter in ("K", "R"))
                    out[3].append(letter)
            source = pa.array(out[0], pa.int64())
            stays = pa.array(out[2], pa.bool_())
            new = pa.array([letter is not None for letter in out[3]], pa.bool_())
            text = pa.compute.if_else(stays, batch.column("_text").take(source), pa.compute.if_else(new, "", pa.scalar(None, pa.string())))
            turn = pa.compute.if_else(stays, batch.column("_turn").take(source), pa.scalar(None, pa.int64()))
            plans = [pa.compute.if_else(new, pa.scalar(None, batch.column(c).type), batch.column(c).take(source)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_conv").take(source), turn, pa.array(out[1], pa.string()), text, pa.array(out[3], pa.string()), *plans], fields
            )

    return both.mapInArrow(apply, schema)


def repaired_turns(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: str | None = None
) -> DataFrame:
    """The rows of the repaired conversations, with the edit (K, R or I) each comes from."""
    rows = plain_rows(df, conv, turn, role, text, times)
    found = repair_stream(rows, plan_repairs(rows)).where("edit IS NOT NULL")
    return found.select(*(F.col(f"_{c}").alias(n) for c, n in (("conv", conv), ("turn", turn), ("role", role), ("text", text))), "edit")


def repair_digests(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    times: str | None = None,
    cfg: GrammarConfig = GrammarConfig(),
) -> DataFrame:
    """Per conversation: its plan, and SHA-256 of its repaired rows (``role:text``, line feeds between)."""
    rows = plain_rows(df, conv, turn, role, text, times)
    stream = repair_stream(rows, plan_repairs(rows, cfg))
    kind = dict(stream.dtypes)["_conv"]
    names = [f.name for f in T.StructType.fromDDL(PLAN)]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, state, rows_in = None, hashlib.sha256(), 0
        schema = None
        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in ["_conv", *names]]
            schema = pa.schema([*(batch.schema.field(k) for k in at), pa.field("repaired_sha256", pa.string())])
            done: list[tuple] = []
            heads = batch.column("edit").is_null().to_pylist()
            for i, (r, t) in enumerate(zip(batch.column("_role").to_pylist(), batch.column("_text").to_pylist(), strict=True)):
                if heads[i]:
                    if head is not None:
                        done.append((*head, state.hexdigest()))
                    head, state, rows_in = tuple(batch.column(k)[i].as_py() for k in at), hashlib.sha256(), 0
                else:
                    state.update((("\n" if rows_in else "") + r + ":" + t).encode())
                    rows_in += 1
            if done:
                yield rows_of(done, schema)
        if head is not None:
            yield rows_of([(*head, state.hexdigest())], schema)

    def rows_of(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema, strict=True)], schema=schema)

    out = stream.mapInArrow(digest, f"_conv {kind}, {PLAN}, repaired_sha256 string")
    return out.withColumnRenamed("_conv", conv)
