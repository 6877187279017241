"""Interpolated modified Kneser-Ney language model (word pairs), counted and scored in Spark.

The model is never in one place. Texts are encoded in blocks of a few megabytes: the
sorted hashes of the block's words, and its tokens as places in that array. A block sends
the sorted hashes of its distinct word pairs to hash shards; a shard merges them and
answers every block with the corpus counts of its pairs, as far as they differ from the
block's own. Statistics per word go the same way. So each block ends with exactly that part
of the corpus model which its texts need, as sorted arrays, which the worker maps into
memory from a file while it scores. Work, shuffle and memory per task grow with the
block, not with the corpus, and no key is a group: hashes spread evenly over the shards.

Per context v:  p(w|v) = max(c(vw) - D, 0) / c(v) + gamma(v) * p(w),
and below it    p(w) = max(N1+(.w) - D', 0) / N1+(..) + gamma' / (V + 1),
with three discounts each, from the counts of counts (Chen and Goodman).

Defined results. A text is its words (bytes other than ASCII white space, A-Z lower-cased)
and one end token; a NULL or empty text is the end token alone. Rows with a NULL fold are
scored, not learned from. Without training rows every probability is 1 / (V + 1) = 1.
Repeated rows count each time. The order of rows does not matter.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, stage_dir
from .textblock import Block, blocks, pair

BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
LOW48 = np.uint64((1 << 48) - 1)

_ENCODED = "block long, n_docs int, n_tokens long, keys array<{key}>, held binary, lengths binary, vocab binary, tokens binary"


@dataclass(frozen=True)
class LmConfig:
    """Text per block, and distinct pairs or words a shard is meant to hold."""

    block_bytes: int = 12 << 20
    shard_items: int = 1 << 20


# ------------------------------------------------------------------- encoded blocks


def encode_blocks(docs: DataFrame, key: str, text: str, held: str, cfg: LmConfig) -> DataFrame:
    """One row per block of whole texts: word hashes, tokens, and which texts are held out."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(F.expr(held), F.lit(True)).alias("_held"))
    schema = _ENCODED.format(key=dict(rows.dtypes)["_key"])

    def flush(number: int, keys: list, held: list, hashes: list, lengths: list) -> pa.RecordBatch:
        n_tokens = sum(map(len, hashes))
        vocab, local = distinct(np.concatenate([*hashes, [BEGIN]]))
        hashes.clear()
        flags = np.concatenate(held)
        owners = pa.concat_arrays(keys)
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()),
                "n_docs": pa.array([len(flags)], pa.int32()),
                "n_tokens": pa.array([n_tokens], pa.int64()),
                "keys": pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), owners),
                "held": [flags.tobytes()],
                "lengths": [np.concatenate(lengths).astype(np.int64).tobytes()],
                "vocab": [vocab.tobytes()],
                "tokens": [local[:-1].tobytes()],
            }
        )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, parts = 0, 0, ([], [], [], [])
        for batch in batches:
            for part, block in blocks(batch, "_text"):
                words = block.words()
                # copied: a slice would hold the texts of its whole batch until the block is full
                parts[0].append(part.column("_key").take(pa.array(range(part.num_rows), pa.int32())))
                parts[1].append(part.column("_held").to_numpy(zero_copy_only=False).astype(bool))
                parts[2].append(np.insert(words.hashes(lower=True), words.bounds[1:], END))
                parts[3].append(words.counts + 1)
                size += len(block.data) + 64 * block.n
                if size >= cfg.block_bytes:
                    yield flush(number, *parts)
                    number, size, parts = number + 1, 0, ([], [], [], [])
        if parts[0]:
            yield flush(number, *parts)

    return rows.mapInArrow(encode, schema)


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """Written once in the shared folder, bucketed by block: later joins do not move it."""
    spark = df.sparkSession
    table = f"lm_{name}_{uuid.uuid4().hex}"
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4096))
    writer = df.write.format("parquet").bucketBy(n, "block").sortBy("block")
    writer.option("path", f"{stage_dir(spark)}/stormgrid/{table}").option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


class Encoded:
    """An encoded block read back, with its distinct word pairs in shard order."""

    def __init__(self, row: dict, bits: int):
        self.vocab = np.frombuffer(row["vocab"], np.uint64)
        self.tokens = np.frombuffer(row["tokens"], np.uint32)
        self.held = np.frombuffer(row["held"], bool)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        codes = np.empty(len(self.tokens), np.int64)
        codes[1:] = self.tokens[:-1]
        codes[self.starts] = np.searchsorted(self.vocab, BEGIN)
        codes *= len(self.vocab)
        codes += self.tokens
        codes, place = distinct(codes)
        first, second = codes // len(self.vocab), codes % len(self.vocab)
        key = shard_key(pair(self.vocab[first], self.vocab[second]), bits)
        order = np.argsort(key)
        self.keys, self.first, self.second = key[order], first[order], second[order]
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        self.pair_of_token = rank[place]
        self.learned = np.repeat(~self.held, self.lengths)
        self.count = np.bincount(self.pair_of_token[self.learned], minlength=len(order))

    def shards(self, bits: int) -> list[tuple[int, int, int]]:
        return runs(shard_of(self.keys, bits))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each value's place among them; ``np.unique`` takes twice the memory."""
    order = np.argsort(values)
    values = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    values = values[new]
    place = np.empty(len(order), np.uint32)
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return values, place


def shard_key(h: np.ndarray, bits: int) -> np.ndarray:
    """Hash reduced to its shard (the top ``bits``) and 48 more bits, or all of it."""
    if bits > 16:
        return h
    return ((h >> np.uint64(64 - bits)) << np.uint64(48) if bits else np.uint64(0)) | (h & LOW48)


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Shard of keys made by ``shard_key``."""
    return (keys >> np.uint64(48)).astype(np.int64) if 0 < bits <= 16 else word_shard_of(keys, bits)


def word_shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Shard of whole hashes: their top ``bits``."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def runs(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted shards."""
    cut = np.flatnonzero(np.diff(shard)) + 1
    edges = [0, *cut.tolist(), len(shard)]
    return [(int(shard[a]), a, b) for a, b in zip(edges[:-1], edges[1:]) if b > a]


def pack_sorted(keys: np.ndarray) -> bytes:
    """The low 48 bits of a shard's sorted keys: their steps, in as few bytes as the widest needs."""
    steps = np.diff(keys & LOW48, prepend=np.uint64(0))
    width = (int(steps.max()).bit_length() + 7) // 8 or 1
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(steps), 8), np.uint8)
    out[:, :width] = steps
    return np.cumsum(out.reshape(-1).view(np.uint64), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Numbers below 2^32, most of them small: a byte each, larger ones once more at the end."""
    small = np.minimum(values, 255).astype(np.uint8)
    data = small.tobytes() + values[small == 255].astype(np.uint32).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack_small(data: bytes, n: int) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    plain = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    out = np.frombuffer(plain, np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(plain[n:], np.uint32)
    return out


# ------------------------------------------------------------------- counts of pairs


_PAIRS = "shard long, block long, keys binary, counts binary"
_ANSWERS = "block long, shard long, more binary, owned binary"


def pair_lists(encoded: DataFrame, bits: int) -> DataFrame:
    """Per block and shard the sorted hashes of its pairs, with counts in training texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            e = Encoded(row, bits)
            out = [(s, row["block"], pack_sorted(e.keys[a:b]), pack_small(e.count[a:b])) for s, a, b in e.shards(bits)]
            yield _batch(_PAIRS, out)

    return encoded.drop("keys", "n_docs", "n_tokens").mapInArrow(work, _PAIRS)


def merge_pairs(lists: DataFrame) -> DataFrame:
    """Corpus counts for every block whose own count is not the whole story.

    A pair belongs to the first block which has it in a training text, so that statistics
    over distinct pairs can be added up over blocks.
    """

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        shard = group.column("shard")[0].as_py()
        keys = [unpack_sorted(x.as_py()) for x in group.column("keys")]
        sizes = [len(k) for k in keys]
        all_keys = np.concatenate(keys)
        all_counts = np.concatenate([unpack_small(x.as_py(), n) for x, n in zip(group.column("counts"), sizes)])
        order = np.argsort(all_keys, kind="stable")  # equal keys stay in block order
        new = np.ones(len(order), bool)
        new[1:] = np.diff(all_keys[order].view(np.int64)) != 0
        number = np.cumsum(new) - 1
        totals = np.bincount(number, weights=all_counts[order]).astype(np.int64)
        known = order[all_counts[order] > 0]
        owner = np.full(len(totals), -1)
        first_number = number[all_counts[order] > 0]
        lead = np.ones(len(known), bool)
        lead[1:] = first_number[1:] != first_number[:-1]
        owner[first_number[lead]] = known[lead]
        total = np.empty(len(order), np.int64)
        total[order] = totals[number]
        owned = np.empty(len(order), bool)
        owned[order] = owner[number] == order
        out, at = [], 0
        for block, n in zip(group.column("block").to_pylist(), sizes):
            t, o, c = total[at : at + n], owned[at : at + n], all_counts[at : at + n]
            if (t != c).any():
                shared = (t != c) & (c > 0)  # learned from here and elsewhere: one block owns it
                out.append((block, shard, pack_small(t - c), np.packbits(o[shared]).tobytes()))
            at += n
        return pa.Table.from_batches([_batch(_ANSWERS, out)])

    return lists.groupBy("shard").applyInArrow(merge, _ANSWERS)


def _answered(row: dict, e: Encoded, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Corpus count of each pair of the block, and whether the block owns it."""
    total, owned = e.count.copy(), e.count > 0
    part = {s: (a, b) for s, a, b in e.shards(bits)}
    for one in row["answers"] or ():
        a, b = part[one["shard"]]
        more = unpack_small(one["more"], b - a)
        total[a:b] += more
        shared = a + np.flatnonzero((more > 0) & (e.count[a:b] > 0))
        owned[shared] = np.unpackbits(np.frombuffer(one["owned"], np.uint8), count=len(shared)).astype(bool)
    return total, owned


def _with_answers(encoded: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Blocks with the list of their answers; a block has one answer per shard at most."""
    fields = [c for c in answers.columns if c != "block"]
    lists = answers.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias(name))
    return encoded.hint("merge").join(lists.hint("merge"), "block", "left")


# ------------------------------------------------------------------- statistics of words

# c: count as a token (of BEGIN: training texts); n1, n2, n3: distinct followers seen once,
# twice, more; before: distinct predecessors
STATS = ["c", "n1", "n2", "n3", "before"]
_WORDS = "shard long, block long, hashes binary, stats binary, totals binary"
_WORD_ANSWERS = "block long, shard long, stats binary, totals binary"


def word_lists(blocks_: DataFrame, bits: int, word_bits: int) -> DataFrame:
    """Per block and word shard: hashes and statistics from the pairs which the block owns.

    ``totals`` (one row per block) are the counts of counts n1 to n4 of its pairs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            e = Encoded(row, bits)
            total, owned = _answered(row, e, bits)
            v = len(e.vocab)
            stats = np.zeros((len(STATS), v), np.int64)
            stats[0] = np.bincount(e.tokens[e.learned], minlength=v)
            stats[0, np.searchsorted(e.vocab, BEGIN)] += int((~e.held).sum())
            for j, which in enumerate((total == 1, total == 2, total >= 3)):
                stats[1 + j] = np.bincount(e.first[owned & which], minlength=v)
            stats[4] = np.bincount(e.second[owned], minlength=v)
            per = [int((owned & (total == k)).sum()) for k in (1, 2, 3, 4)]
            out = []
            for i, (s, a, b) in enumerate(runs(word_shard_of(e.vocab, word_bits))):
                out.append((s, row["block"], e.vocab[a:b].tobytes(), pack_small(stats[:, a:b].ravel()),
                            np.array(per if i == 0 else [0] * 4, np.int64).tobytes()))
            yield _batch(_WORDS, out)

    return blocks_.mapInArrow(work, _WORDS)


def merge_words(lists: DataFrame) -> DataFrame:
    """Corpus statistics of each block's words; rows with block -1 carry sums over a shard."""

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        shard = group.column("shard")[0].as_py()
        hashes = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("hashes")]
        stats = [unpack_small(x.as_py(), len(STATS) * len(h)).reshape(len(STATS), -1) for x, h in zip(group.column("stats"), hashes)]
        words, number = np.unique(np.concatenate(hashes), return_inverse=True)
        flat = np.concatenate(stats, axis=1)
        total = np.stack([np.bincount(number, weights=row, minlength=len(words)) for row in flat]).astype(np.int64)
        token = words != BEGIN
        before = total[4][token]
        sums = [int(total[0][token].sum()), int((total[0][token] > 0).sum()), int(before.sum())]
        sums += [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before > 4).sum())]
        pairs = np.sum([np.frombuffer(x.as_py(), np.int64) for x in group.column("totals")], axis=0)
        out = [(-1, shard, b"", np.array([*sums, *pairs], np.int64).tobytes())]
        at = 0
        for block, own in zip(group.column("block").to_pylist(), hashes):
            own_stats = total[:, number[at : at + len(own)]]
            out.append((block, shard, pack_small(own_stats.ravel()), b""))
            at += len(own)
        return pa.Table.from_batches([_batch(_WORD_ANSWERS, out)])

    return lists.groupBy("shard").applyInArrow(merge, _WORD_ANSWERS)


@dataclass(frozen=True)
class Globals:
    """Numbers of the whole training corpus; their count does not grow with it."""

    tokens: int
    words: int
    kinds: int  # distinct pairs
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    floor: float  # mass which the word level leaves to the uniform distribution

    @staticmethod
    def of(sums: np.ndarray) -> Globals:
        n, v, kinds, m1, m2, m3, m4, more, *pairs = (int(x) for x in sums)
        low = discounts(m1, m2, m3, m4)
        left = low[0] * m1 + low[1] * m2 + low[2] * (m3 + m4 + more)
        return Globals(n, v, kinds, discounts(*pairs), low, left / kinds if kinds else 1.0)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; where a class is empty, k minus one half."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = []
    for k, (now, after) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * after / now if now and after else k - 0.5
        out.append(min(max(d, 0.0), float(k)))
    return tuple(out)


def discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3)], 0.0)


# ------------------------------------------------------------------- scores


def mapped(**arrays: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays, read back through a memory map of an unnamed file of the worker."""
    out = {}
    for name, a in arrays.items():
        if not a.size:
            out[name] = a
            continue
        with tempfile.TemporaryFile() as f:
            np.ascontiguousarray(a).tofile(f)
            f.flush()
            out[name] = np.memmap(f, a.dtype, "r", shape=a.shape)
    return out


def block_scores(row: dict, bits: int, word_bits: int, g: Globals) -> dict:
    e = Encoded(row, bits)
    total, _ = _answered(row, e, bits)
    stats = np.zeros((len(STATS), len(e.vocab)), np.int64)
    part = {s: (a, b) for s, a, b in runs(word_shard_of(e.vocab, word_bits))}
    for one in row["words"]:
        a, b = part[one["shard"]]
        stats[:, a:b] = unpack_small(one["stats"], len(STATS) * (b - a)).reshape(len(STATS), -1)
    model = mapped(hashes=e.vocab, stats=stats, pairs=e.keys, counts=total)
    c, before = model["stats"][0], model["stats"][4]
    low = (discounted(before, g.word_discounts) / g.kinds if g.kinds else 0.0) + g.floor / (g.words + 1)
    d = g.pair_discounts
    seen = np.maximum(c, 1)
    back = np.where(c > 0, (d[0] * model["stats"][1] + d[1] * model["stats"][2] + d[2] * model["stats"][3]) / seen, 1.0)
    p = discounted(model["counts"], d) / seen[e.first] + back[e.first] * low[e.second]
    own = np.where(model["hashes"] == BEGIN, 0, c)
    base = np.log10((own + 0.1) / (g.tokens + 0.1 * (g.words + 1)))
    return {
        "held_out": e.held,
        "n_tokens": e.lengths,
        "n_known": np.add.reduceat((own > 0)[e.tokens], e.starts, dtype=np.int64),
        "train_tokens": np.full(len(e.held), g.tokens),
        "base_score": np.add.reduceat(base[e.tokens], e.starts),
        "score": np.add.reduceat(np.log10(p)[e.pair_of_token], e.starts),
    }


_SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(
    docs: DataFrame, held: str, key: str = "doc_id", text: str = "text", cfg: LmConfig = LmConfig()
) -> DataFrame:
    """Learn from the rows for which the SQL condition ``held`` is false; score all rows.

    Per row: key, held_out, n_tokens, n_known, train_tokens, and log10 probabilities of
    the text: ``base_score`` by smoothed single tokens, ``score`` by the model.
    """
    spark: SparkSession = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    encoded = _bucketed(encode_blocks(docs, key, text, held, cfg), "blocks")
    tokens = encoded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if not tokens:
        return spark.createDataFrame([], f"`{key}` {kind}, {_SCORES}")
    bits = max(0, math.ceil(math.log2(tokens / cfg.shard_items)))
    word_bits = max(0, bits - 2)

    answers = stage(merge_pairs(pair_lists(encoded, bits)), "lm-pairs")
    core = encoded.select("block", "held", "lengths", "vocab", "tokens")
    told = _with_answers(core, answers, "answers")
    words = stage(merge_words(word_lists(told, bits, word_bits)), "lm-words")
    sums = np.sum([np.frombuffer(r[0], np.int64) for r in _shard_sums(words)], axis=0)
    g = Globals.of(sums)
    full = _with_answers(encoded.select("block", "keys", "held", "lengths", "vocab", "tokens"), answers, "answers")
    full = _with_answers(full, words.where("block >= 0").drop("totals"), "words")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {k: one.column(k)[0].as_py() for k in ("held", "lengths", "vocab", "tokens", "answers", "words")}
                out = block_scores(row, bits, word_bits, g)
                names = [key, *out]
                yield pa.RecordBatch.from_arrays([one.column("keys").flatten(), *(pa.array(x) for x in out.values())], names=names)

    return full.mapInArrow(work, f"`{key}` {kind}, {_SCORES}")


def _shard_sums(words: DataFrame) -> list:
    """Sums of the shards, 96 bytes each, added up in Spark before they reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(12, np.int64)
        for batch in batches:
            for x in batch.column("totals"):
                total += np.frombuffer(x.as_py(), np.int64)
        yield _batch("totals binary", [(total.tobytes(),)])

    return words.where("block = -1").select("totals").mapInArrow(add, "totals binary").collect()


# ------------------------------------------------------------------- helpers


_ARROW = {"long": pa.int64(), "binary": pa.binary()}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), _ARROW[t]) for c, (_, t) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])
