"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio.

Two multinomials over the same hashed n-grams (single tokens and pairs) are counted: one
over trusted documents, one over the whole raw corpus. A document's score is the mean of
``log p_trusted - log p_raw`` over its n-grams; a document below ``threshold`` is rejected.

Defined results. NULL or empty text: no words, so the base rules reject it. Repeated rows
are counted and judged one by one. A document with several labels is trusted only if all
of them are 1. No trusted document, or an empty corpus: all ratios are 0, and only the
base rules decide. Ties with the threshold are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblock import Block, as_arrow, between, blocks, map_blocks, mix, pair

# Labelled ids are broadcast up to this count (8 bytes each); beyond it they are shuffled.
MAX_BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class RatioModel:
    """``buckets`` hash classes; ``prior`` trusted n-grams per class are assumed a priori,
    spread as in the raw corpus; documents with a mean ratio under ``threshold`` go."""

    buckets: int = 1 << 16
    prior: float = 20.0
    threshold: float = -0.1


@dataclass(frozen=True)
class BaseRules:
    min_words: int = 50
    max_repeat_percent: int = 50


SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

_COUNTS = "bucket int, raw long, trusted long"
_RULES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "llr double, base_failed boolean, kept boolean"
)


def gram_buckets(block: Block, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hash classes of the single tokens and of the pairs, each with their text bounds."""
    tok = block.tokens()
    h = tok.hashes(lower=True)
    first = tok.follows(1)
    two = pair(h[first], h[first + 1])
    classes = np.uint64(buckets)
    return [
        ((h % classes).astype(np.int64), tok.bounds),
        ((two % classes).astype(np.int64), np.searchsorted(first, tok.bounds)),
    ]


def count_grams(docs: DataFrame, labels: DataFrame, model: RatioModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per hash class, its n-grams in the raw corpus and in the trusted documents."""
    good = labels.select(F.col(key).alias("_label_key"), "quality").where("_label_key IS NOT NULL")
    good = good.groupBy("_label_key").agg(F.min("quality").alias("_worst")).where("_worst = 1").drop("_worst")
    if good.count() <= MAX_BROADCAST_IDS:
        good = F.broadcast(good)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = rows.join(good, F.col("_key") == F.col("_label_key"), "left")
    rows = rows.select("_text", F.col("_label_key").isNotNull().alias("_good"))
    buckets = model.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part, block in blocks(batch, "_text"):
                good = part.column("_good").to_numpy(zero_copy_only=False).astype(bool)
                for grams, bounds in gram_buckets(block, buckets):
                    raw += np.bincount(grams, minlength=buckets)
                    trusted += np.bincount(grams[np.repeat(good, np.diff(bounds))], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int32()), "raw": raw[seen], "trusted": trusted[seen]})

    return rows.mapInArrow(count, _COUNTS).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def log_ratios(counts: DataFrame, model: RatioModel) -> np.ndarray:
    """One log ratio per hash class; at most ``model.buckets`` rows come to the driver."""
    table = counts.toPandas()
    raw, trusted = np.zeros(model.buckets), np.zeros(model.buckets)
    at = table["bucket"].to_numpy(np.int64)
    raw[at], trusted[at] = table["raw"], table["trusted"]
    if not trusted.sum():
        return np.zeros(model.buckets)
    p_raw = (raw + 1) / (raw.sum() + model.buckets)
    assumed = model.prior * model.buckets
    return np.log((trusted + assumed * p_raw) / (trusted.sum() + assumed)) - np.log(p_raw)


def base_statistics(block: Block) -> dict[str, np.ndarray]:
    """Counts of the fixed rules for each text of a block."""
    words = block.words()
    h = words.hashes()
    owner = words.owner()
    letters = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=letters[1:])
    chars = words.sums(letters[words.ends] - letters[words.starts])

    lines = block.lines()
    home = lines.owner()
    has_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    keys = pair(lines.hashes()[has_word], mix(home[has_word].astype(np.uint64)))
    home = home[has_word]
    _, first, times = np.unique(keys, return_index=True, return_counts=True)
    dup_lines = np.bincount(home[first], weights=times - 1, minlength=block.n)

    at = words.follows(2)
    repeated = np.zeros(len(h), bool)
    if len(at):
        window = pair(pair(h[at], h[at + 1]), h[at + 2] ^ mix(owner[at].astype(np.uint64)))
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for step in range(3):
            repeated[at[twice] + step] = True
    return {
        "n_words": words.counts,
        "word_chars": chars,
        "n_symbols": block.sums(SYMBOLS[block.data]),
        "n_dup_lines": dup_lines.astype(np.int64),
        "n_repeat_words": words.sums(repeated),
    }


def judge(block: Block, ratios: np.ndarray, model: RatioModel, rules: BaseRules) -> dict[str, np.ndarray]:
    out = base_statistics(block)
    total, n = np.zeros(block.n), np.zeros(block.n)
    for grams, bounds in gram_buckets(block, model.buckets):
        total += between(ratios[grams], bounds)
        n += np.diff(bounds)
    out["llr"] = np.divide(total, n, out=np.zeros(block.n), where=n > 0)
    out["base_failed"] = (out["n_words"] < rules.min_words) | (
        100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"]
    )
    out["kept"] = ~out["base_failed"] & (out["llr"] >= model.threshold)
    return out


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    model: RatioModel = RatioModel(),
    rules: BaseRules = BaseRules(),
) -> DataFrame:
    """One row per document: its key, the base statistics, the mean log ratio and the verdict."""
    ratios = log_ratios(count_grams(docs, labels, model, text, key), model)
    rows = docs.select(F.col(key), F.col(text))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = f"`{key}` {dict(rows.dtypes)[key]}, {_RULES}"

    def work(part: pa.RecordBatch, block: Block) -> dict:
        return {key: part.column(key), **judge(block, shared.value, model, rules)}

    return map_blocks(rows, text, schema, work)


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    model: RatioModel = RatioModel(),
    rules: BaseRules = BaseRules(),
) -> DataFrame:
    """The documents which pass, with all their columns; nothing is joined or shuffled."""
    ratios = log_ratios(count_grams(docs, labels, model, text, key), model)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def work(part: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        return part.filter(as_arrow(judge(block, shared.value, model, rules)["kept"], pa.bool_()))

    return map_blocks(docs, text, docs.schema, work)
