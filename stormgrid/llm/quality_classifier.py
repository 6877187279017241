"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

Features of a text: single tokens and pairs of neighbours, hashed; a pair of equal tokens
is the one feature "repetition". Values are shares of all n-grams of the text, scaled, so
that long and short texts compare. Training follows the regularised leader: per-coordinate
learning rates and an L1 term, which leaves rare features at zero, one document at a time
in an order given by a hash. Scoring is a sparse dot product per document.

Defined results. NULL and empty texts have no features and get the bias alone. Labels
which are NULL or contradict each other are not learned from. Without any usable label all
scores are the sigmoid of 0. Repeated rows get equal scores. A score equal to the
threshold counts as 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import MAX_BROADCAST_ROWS, salted_join
from .textblock import Block, as_arrow, between, map_blocks, pair


@dataclass(frozen=True)
class FtrlConfig:
    """``max_rows`` bounds the labelled rows which are fitted; a larger set is sampled by
    the hash of its key, so the sample is the same in every run."""

    features: int = 1 << 18
    max_rows: int = 12_000
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001
    scale: float = 20.0
    threshold: float = 0.3


def gram_features(block: Block, features: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers of single tokens and of pairs, each with their text bounds."""
    tok = block.tokens()
    h = tok.hashes(lower=True)
    first = tok.follows(1)
    a, b = h[first], h[first + 1]
    two = np.where(a == b, np.uint64(1), pair(a, b))
    classes = np.uint64(features)
    return [
        ((h % classes).astype(np.int64), tok.bounds),
        ((two % classes).astype(np.int64), np.searchsorted(first, tok.bounds)),
    ]


def _n_grams(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return sum(np.diff(bounds) for _, bounds in parts)


def sparse_rows(block: Block, cfg: FtrlConfig) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct features and their values."""
    parts = gram_features(block, cfg.features)
    n = _n_grams(parts)
    out = []
    for i in range(block.n):
        own = np.concatenate([grams[bounds[i] : bounds[i + 1]] for grams, bounds in parts])
        at, times = np.unique(own, return_counts=True)
        out.append((at.astype(np.int32), (cfg.scale * times / max(1, n[i])).astype(np.float32)))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, learn: str, cfg: FtrlConfig, text: str, key: str) -> DataFrame:
    """Feature rows of at most ``cfg.max_rows`` labelled documents for which ``learn`` holds.

    Labels without a document do not count, and rows with equal keys and texts are one.
    """
    sure = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).where(F.expr(learn))
    sure = sure.groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
    sure = sure.where("_low = _high").select("_key", F.col("_low").alias("_y"))
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_digest", F.sha2("_text", 256))
    if sure.count() <= MAX_BROADCAST_ROWS:
        found = rows.select("_key", "_digest").join(F.broadcast(sure), "_key")
    else:
        found = salted_join(rows.select("_key", "_digest"), sure, ["_key"], "_digest")
    order = F.xxhash64(F.col("_key").cast("string"))
    found = found.distinct().orderBy(order, "_key", "_digest").limit(cfg.max_rows)
    rows = rows.join(F.broadcast(found), ["_key", "_digest"]).dropDuplicates(["_key", "_digest"])
    rows = rows.select("_key", "_y", "_text")

    def work(part: pa.RecordBatch, block: Block) -> dict:
        own = sparse_rows(block, cfg)
        return {
            "_key": as_arrow(part.column("_key").cast(pa.string()), pa.string()),
            "_y": part.column("_y"),
            "at": [a.tobytes() for a, _ in own],
            "value": [v.tobytes() for _, v in own],
        }

    return map_blocks(rows, "_text", "_key string, _y int, at binary, value binary", work)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], cfg: FtrlConfig) -> np.ndarray:
    """Weights after ``cfg.epochs`` passes; the last one is the bias."""
    z, n = np.zeros(cfg.features + 1), np.zeros(cfg.features + 1)
    for _ in range(cfg.epochs):
        for y, at, value in rows:
            # widened one row at a time, so that the driver holds the rows only as they came
            at, x = np.append(at, np.int32(cfg.features)), np.append(value, np.float32(1)).astype(np.float64)
            w = _weights(z[at], n[at], cfg)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / cfg.alpha * w
            n[at] = more
    return _weights(z, n, cfg)


def _weights(z: np.ndarray, n: np.ndarray, cfg: FtrlConfig) -> np.ndarray:
    w = (np.sign(z) * cfg.l1 - z) / ((cfg.beta + np.sqrt(n)) / cfg.alpha + cfg.l2)
    return np.where(np.abs(z) <= cfg.l1, 0.0, w)


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: str = "true",
    cfg: FtrlConfig = FtrlConfig(),
    text: str = "text",
    key: str = "doc_id",
) -> np.ndarray:
    """Fit on labelled documents whose label row fulfils the SQL condition ``learn``.

    The driver gets the features of at most ``cfg.max_rows`` documents, never texts.
    """
    table = training_rows(docs, labels, learn, cfg, text, key).toArrow().combine_chunks()
    keys = table["_key"].to_pylist()
    at, value, y = (table[c] for c in ("at", "value", "_y"))
    rows = [
        (y[i].as_py(), np.frombuffer(at[i].as_buffer(), np.int32), np.frombuffer(value[i].as_buffer(), np.float32))
        for i in sorted(range(len(keys)), key=lambda i: hash_key(keys[i]))
    ]
    return fit(rows, cfg)


def hash_key(key: str) -> tuple[int, str]:
    import zlib

    return zlib.crc32(f"order {key}".encode()), key


def scores(block: Block, weights: np.ndarray, cfg: FtrlConfig) -> np.ndarray:
    parts = gram_features(block, cfg.features)
    total = sum(between(weights[grams], bounds) for grams, bounds in parts)
    x = cfg.scale * total / np.maximum(1, _n_grams(parts)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def classify(
    docs: DataFrame, weights: np.ndarray, cfg: FtrlConfig = FtrlConfig(), text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Key, score and predicted class of every document."""
    rows = docs.select(F.col(key), F.col(text))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = f"`{key}` {dict(rows.dtypes)[key]}, score double, predicted int"

    def work(part: pa.RecordBatch, block: Block) -> dict:
        score = scores(block, shared.value, cfg)
        return {key: part.column(key), "score": score, "predicted": (score >= cfg.threshold).astype(np.int32)}

    return map_blocks(rows, text, schema, work)


def keep_predicted(
    docs: DataFrame, weights: np.ndarray, cfg: FtrlConfig = FtrlConfig(), text: str = "text"
) -> DataFrame:
    """The documents of class 1, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work(part: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        return part.filter(as_arrow(scores(block, shared.value, cfg) >= cfg.threshold, pa.bool_()))

    return map_blocks(docs, text, docs.schema, work)
