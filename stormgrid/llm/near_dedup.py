"""Near-duplicate classes: ProbMinHash signatures, banding, exact verification, components.

A text is a set of word shingles weighted by how often they occur. Each shingle is a
Poisson process whose rate is its weight; every arrival falls on one of the signature's
registers, and a register keeps the shingle of its earliest arrival. A process is stopped
as soon as its next arrival is later than every register of its text. Two registers agree
with the probability Jaccard similarity of the two weighted sets. Registers are hashed in
bands to find candidates; a candidate counts only if the similarity itself, computed from
the two shingle sets, reaches the threshold. Classes are the components of these links.

No group is expanded into all its pairs. Equal texts are one node. In a bucket every node
is first compared with one hub; a bucket whose nodes are then one component is settled.
In an open bucket the nodes outside its largest component are compared with all nodes of
other components, if there are at most ``small`` of them, so that the pairs stay in
proportion to the bucket. The nodes of buckets with more are joined exactly by prefixes, a
superset of the pairs in these buckets. Write A and B for the normalised weight which the
common shingles have in either text. The probability Jaccard similarity is at most
1 / (1/A + 1/B - 1), so A and B reach the threshold, and two texts near to each other share
one of the shingles which come first in a common order, up to the weight they may differ
in. Pairs which the weight before a common shingle, or a parity bitmap of the shingles,
already excludes are dropped in the join; the others are verified like all pairs. The rows
of a shingle in n sets are dealt to n / 4096 tasks, and each row is copied as often; inside a
task all of them are compared, so the comparisons (not the rows) of a group whose texts
share nearly all shingles but stay below the threshold grow with its square. Verification
compares 32-bit hashes of shingles.

Defined results. Words are compared with A-Z lower-cased; a text with fewer words than a
shingle is one shingle, a text without words (NULL too) is its own class. Rows with equal
keys are one node. Rows with a NULL key have a NULL class. The class is the smallest key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import reduce_to_stars
from ..session import stage
from .textblock import Block, map_blocks, mix, pair

# Keys of candidate documents are broadcast up to this count (8 bytes each).
MAX_BROADCAST_IDS = 1_000_000
# Counters for the order of shingles (bits of their hash; one byte each goes to the tasks, so
# 1 MB), the rows in which a task sends them, words of a parity bitmap, rows of one shingle which
# a task compares with all others of it, and what sums of weights may be off by.
ORDER_BITS = 20
COUNTER_PARTS = 16
MOST_COUNTED = 255
PARITY_WORDS = 8
PREFIX_ROWS = 4096
SLACK = 1e-9


@dataclass(frozen=True)
class NearDedupConfig:
    """With 24 bands of 4 registers a pair of similarity 0.8 is missed once in 300 000."""

    shingle_words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 4
    small: int = 32


# ------------------------------------------------------------------- shingles, signatures


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles with their text and weight, ordered by text; a digest per text."""
    words = block.words()
    h = words.hashes(lower=True)
    at = words.follows(k - 1)
    sh = h[at]
    for j in range(1, k):
        sh = pair(sh, h[at + j])
    owner = words.owner()[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    digests = [
        hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest()
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())
    ]
    if len(short):
        whole = np.array([int.from_bytes(digests[i][:8], "little") for i in short], np.uint64)
        sh, owner = np.concatenate([sh, whole]), np.concatenate([owner, short])
    order = np.lexsort((sh, owner))
    sh, owner = sh[order], owner[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(sh)))
    return sh[first], owner[first], weight, digests


def prob_min_hash(sh: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """``n`` signatures of ``m`` registers; a register of a text without shingles stays 0."""
    best = np.full(n * m, np.inf)
    kept = np.zeros(n * m, np.uint64)
    live, clock, step = np.arange(len(sh)), np.zeros(len(sh)), 0
    while len(live):
        # few processes left: several arrivals of each at once
        draws = 1 if len(live) > 4096 else 16
        count = (step + 1 + np.arange(draws, dtype=np.uint64)) * np.uint64(0xE7037ED1A0B428DB)
        bits = mix(sh[live][:, None] + count[None, :])
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
        arrival = clock[live][:, None] + np.cumsum(gaps, axis=1) / weight[live][:, None]
        slot = (owner[live][:, None] * m + (mix(bits) % np.uint64(m)).astype(np.int64)).ravel()
        when = arrival.ravel()
        np.minimum.at(best, slot, when)
        hit = best[slot] == when
        kept[slot[hit]] = np.repeat(sh[live], draws)[hit]
        clock[live] = arrival[:, -1]
        latest = best.reshape(n, m).max(axis=1)
        live = live[clock[live] < latest[owner[live]]]
        step += draws
    return kept.reshape(n, m)


def band_keys(signature: np.ndarray, cfg: NearDedupConfig) -> np.ndarray:
    parts = signature.reshape(len(signature), cfg.bands, cfg.rows)
    key = np.broadcast_to(np.arange(cfg.bands, dtype=np.uint64), parts.shape[:2])
    for r in range(cfg.rows):
        key = pair(key, parts[:, :, r])
    return key.astype(np.int64)


def signatures(docs: DataFrame, key: str, text: str, cfg: NearDedupConfig) -> DataFrame:
    """Per row: its key, a digest of its words and its band keys (none without words)."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("_text"))

    def work(part: pa.RecordBatch, block: Block) -> dict:
        sh, owner, weight, digests = shingles(block, cfg.shingle_words)
        keys = band_keys(prob_min_hash(sh, owner, weight, block.n, cfg.bands * cfg.rows), cfg)
        has = np.bincount(owner, minlength=block.n) > 0
        lengths = np.where(has, cfg.bands, 0)
        flat = pa.array(keys[has].ravel())
        bounds = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        return {"id": part.column("id"), "digest": digests, "bands": pa.ListArray.from_arrays(bounds, flat)}

    kind = dict(rows.dtypes)["id"]
    return map_blocks(rows, "_text", f"id {kind}, digest binary, bands array<long>", work)


# ------------------------------------------------------------------- verification


def shingle_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, cfg: NearDedupConfig) -> DataFrame:
    """Sorted 32-bit shingle hashes and weights of the documents in ``ids``."""
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = rows.join(ids, F.col("_id") == F.col("id")).select("id", "_text")

    def work(part: pa.RecordBatch, block: Block) -> dict:
        sh, owner, weight, _ = shingles(block, cfg.shingle_words)
        bounds = np.searchsorted(owner, np.arange(block.n + 1)).tolist()
        sets, weights = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = (sh[a:b] >> np.uint64(32)).astype(np.uint32)  # still sorted
            sets.append(own.tobytes())
            weights.append(weight[a:b].astype(np.uint32).tobytes() if (weight[a:b] > 1).any() else None)
        return {"id": part.column("id"), "items": sets, "weights": weights}

    kind = dict(ids.dtypes)["id"]
    sets = map_blocks(rows, "_text", f"id {kind}, items binary, weights binary", work)
    # rows with equal keys: one of their texts stands for the node
    return sets.groupBy("id").agg(F.min(F.struct("items", "weights")).alias("s")).select("id", "s.*")


def similarity(a: np.ndarray, wa: np.ndarray | None, b: np.ndarray, wb: np.ndarray | None) -> float:
    """Probability Jaccard of two weighted sets of sorted items."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = b[at] == a if len(b) else np.zeros(len(a), bool)
    n = int(common.sum())
    if wa is None and wb is None:
        union = len(a) + len(b) - n
        return n / union if union else 0.0
    wa = np.ones(len(a)) if wa is None else wa.astype(np.float64)
    wb = np.ones(len(b)) if wb is None else wb.astype(np.float64)
    x, y = wa[common], wb[at[common]]
    only_a = wa.sum() - x.sum()
    only_b = wb.sum() - y.sum()
    pairs, times = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    total = 0.0
    for (u, v), k in zip(pairs.T, times):
        total += k / (only_a / u + only_b / v + np.maximum(x / u, y / v).sum())
    return total


def verify(pairs: DataFrame, sets: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """The pairs (u, v) which reach the threshold. A node with many pairs is dealt out."""
    share = 256
    degree = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("n"))
    hubs = degree.join(sets.select(F.col("id").alias("v"), F.struct("items", "weights").alias("hub")), "v")
    hubs = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    own = sets.select(F.col("id").alias("u"), F.struct("items", "weights").alias("own"))
    dealt = pairs.join(degree, "v").withColumn("part", F.pmod(F.xxhash64("u"), F.col("n").cast("long")).cast("int")).drop("n")
    both = dealt.join(own, "u").join(hubs, ["v", "part"]).select("u", "v", "own", "hub")

    def set_of(one: dict) -> tuple[np.ndarray, np.ndarray | None]:
        return np.frombuffer(one["items"], np.uint32), None if one["weights"] is None else np.frombuffer(one["weights"], np.uint32)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, hub = batch.column("own"), batch.column("hub")
            good = [
                similarity(*set_of(own[i].as_py()), *set_of(hub[i].as_py())) >= cfg.similarity
                for i in range(batch.num_rows)
            ]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(check, pairs.schema)


# ------------------------------------------------------------------- exact join by prefixes


def _set_of(items: bytes, weights: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(items, np.uint32)
    return a, np.ones(len(a)) if weights is None else np.frombuffer(weights, np.uint32).astype(np.float64)


def counters(sets: DataFrame) -> DataFrame:
    """Per task, how many of its sets hold a shingle of each hash class: ``COUNTER_PARTS`` rows at most,
    however many shingles the sets have. Sums which stop at a number may be stopped before they are added."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("items").to_pylist()), np.uint32)
            total += np.bincount(flat >> np.uint32(32 - ORDER_BITS), minlength=len(total))
        parts = np.minimum(total, MOST_COUNTED).astype(np.uint8).reshape(COUNTER_PARTS, -1)
        seen = np.flatnonzero(parts.any(axis=1))
        made = pa.array([parts[i].tobytes() for i in seen], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), made], ["part", "n"])

    return sets.select("items").mapInArrow(count, "part int, n binary")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle, by the leading bits of its hash; a fixed number of counters,
    which stop at ``MOST_COUNTED``. A shingle counted once is in no other set."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch.column("part").to_pylist(), batch.column("n")):
                own = totals.get(part, np.uint16(0)) + np.frombuffer(n.as_py(), np.uint8).astype(np.uint16)
                totals[part] = np.minimum(own, np.uint16(MOST_COUNTED))
        made = pa.array([x.astype(np.uint8).tobytes() for x in totals.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), made], ["part", "n"])

    found = counters(sets).repartition(COUNTER_PARTS, "part").mapInArrow(merge, "part int, n binary")
    total = np.zeros((COUNTER_PARTS, (1 << ORDER_BITS) // COUNTER_PARTS), np.uint8)
    for row in found.collect():
        total[row["part"]] = np.frombuffer(row["n"], np.uint8)
    return total.ravel()


def prefixes(sets: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """The first shingles of each set, rare ones first, each with the share of weight before it.

    Two sets of which neither has a shingle in common with the other's first ones differ in
    more weight than the threshold allows. Any order common to all sets is right; the counts
    only keep shingles of many sets out. First ones which no other set holds are left out.
    """
    counts = shingle_counts(sets)
    rows = sets.select("id", "c", "items", "weights")
    words = [f"p{i}" for i in range(PARITY_WORDS)]
    kind, bits = dict(rows.dtypes)["id"], 64 * PARITY_WORDS
    names = ["item", "before", "total", *words]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], [[] for _ in names]
            for i, (items, weights) in enumerate(zip(batch.column("items").to_pylist(), batch.column("weights").to_pylist())):
                a, w = _set_of(items, weights)
                order = np.lexsort((a, counts[a >> np.uint32(32 - ORDER_BITS)]))
                before = (np.cumsum(w[order]) - w[order]) / w.sum()
                n = int(np.searchsorted(before, 1 - cfg.similarity + SLACK, "right"))
                parity = np.packbits(np.bincount(a % np.uint32(bits), minlength=bits) & 1 > 0).view(np.int64)
                seen = np.flatnonzero(counts[a[order[:n]] >> np.uint32(32 - ORDER_BITS)] > 1)
                n = len(seen)
                at.append(np.full(n, i))
                values = [a[order[seen]].astype(np.int64), before[seen], np.full(n, w.sum()), *(np.full(n, x) for x in parity)]
                for column, value in zip(made, values):
                    column.append(value)
            if at:
                own = batch.select(["id", "c"]).take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(np.concatenate(x)) for x in made)], ["id", "c", *names])

    parity_kinds = ", ".join(f"{x} long" for x in words)
    return rows.mapInArrow(first, f"id {kind}, c {kind}, item long, before double, total double, {parity_kinds}")


def prefix_pairs(sets: DataFrame, cfg: NearDedupConfig) -> DataFrame:
    """All pairs (u, v) of sets in different components ``c`` which may reach the threshold, and few others."""
    rows = stage(prefixes(sets, cfg), "prefixes")
    items = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    # the rows of a shingle in many sets are dealt out
    items = items.where("low < high").select("item", F.ceil(F.col("n") / PREFIX_ROWS).cast("int").alias("n"))
    rows = stage(rows.join(items, "item"), "shared-prefixes")
    left = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("n").cast("long")).cast("int"))
    right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    right = right.select(*[F.col(x).alias(f"{x}_2") for x in right.columns])
    most = 1 + 1 / cfg.similarity
    share = 1 / (1 - F.col("before")) + 1 / (1 - F.col("before_2")) <= most + SLACK
    # shingles in one set only, each of weight 1 or more: by Cauchy-Schwarz from 1/A + 1/B <= most
    roots = F.sqrt("total") + F.sqrt("total_2")
    apart = F.col("total") + F.col("total_2") - roots * roots / most
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"p{i}_2"))) for i in range(PARITY_WORDS)), F.lit(0))
    near = (F.col("id") > F.col("id_2")) & (F.col("c") != F.col("c_2")) & share & (differ <= apart + SLACK * F.col("total"))
    both = left.join(right, (F.col("item") == F.col("item_2")) & (F.col("part") == F.col("part_2")) & near)
    return both.select(F.col("id").alias("u"), F.col("id_2").alias("v")).distinct()


# ------------------------------------------------------------------- components of links


class _Links:
    """Verified links so far, and the component of every node that has one."""

    def __init__(self, docs: DataFrame, key: str, text: str, cfg: NearDedupConfig):
        self.docs, self.key, self.text, self.cfg = docs, key, text, cfg
        self.stars: DataFrame | None = None
        self.sets: DataFrame | None = None

    def prepare(self, ids: DataFrame) -> None:
        self.sets = stage(shingle_sets(self.docs, ids, self.key, self.text, self.cfg), "shingle-sets")

    def component(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        if self.stars is None:
            return rows.withColumn(name, F.col(node))
        roots = self.stars.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
        joined = rows.join(roots, F.col(node) == F.col("_u"), "left")
        return joined.withColumn(name, F.coalesce("_v", node)).drop("_u", "_v")

    def add(self, pairs: DataFrame) -> None:
        """Verify pairs (u > v) and merge the components which they link."""
        found = stage(verify(pairs, self.sets, self.cfg), "links")
        if self.stars is not None:
            found = found.unionByName(self.stars.select("u", "v"))
        self.stars = reduce_to_stars(found, [])


def _ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose bucket holds two nodes or more, as a written table."""
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    return stage(rows.join(shared, "bucket"), "buckets")


def near_links(docs: DataFrame, nodes: DataFrame, key: str, text: str, cfg: NearDedupConfig) -> DataFrame | None:
    """Stars (u, v) over all linked nodes: v is the smallest node of u's component."""
    rows = _shared(nodes.select("id", F.explode("bands").alias("bucket")))
    links = _Links(docs, key, text, cfg)
    links.prepare(rows.select("id").distinct())

    # a random order of all nodes, so that the buckets of a group agree on few hubs
    rank = F.xxhash64(F.col("id").cast("string"), F.lit(1))
    hubs = rows.groupBy("bucket").agg(F.min(F.struct(rank.alias("r"), "id")).alias("h"))
    spokes = rows.join(hubs.select("bucket", F.col("h.id").alias("hub")), "bucket").where("id <> hub")
    spokes = stage(spokes.groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n")), "spokes")
    best = spokes.groupBy("id").agg(F.max(F.struct("n", "hub")).alias("b"))
    links.add(best.select(*_ordered("id", "b.hub")).distinct())
    rest = links.component(links.component(spokes, "id", "ca"), "hub", "cb").where("ca <> cb")
    rest = stage(rest.select(*_ordered("id", "hub")).distinct(), "spokes")
    if not rest.isEmpty():
        links.add(rest)

    # a bucket is open while some of its nodes are outside its largest component
    named = links.component(rows, "id", "c")
    parts = named.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "c")).alias("most"))
    open_ = parts.select("bucket", F.col("most.c").alias("main"), (F.col("size") - F.col("most.n")).alias("outside"))
    named = stage(named.join(open_.where("outside > 0"), "bucket"), "open")
    few = named.where(F.col("outside") <= cfg.small)
    left = few.where("c <> main").select("bucket", "id", "c", "main")
    right = few.select("bucket", F.col("id").alias("id2"), F.col("c").alias("c2"))
    once = (F.col("c") != F.col("c2")) & ((F.col("c2") == F.col("main")) | (F.col("id") > F.col("id2")))
    pairs = left.join(right.withColumnRenamed("bucket", "_b"), (F.col("bucket") == F.col("_b")) & once)
    pairs = stage(pairs.select(*_ordered("id", "id2")).distinct(), "pairs")
    if not pairs.isEmpty():
        links.add(pairs)
    # the links just found close many of the larger buckets too
    many = named.where(F.col("outside") > cfg.small).select("id", "bucket")
    parts = links.component(many, "id", "c").groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    many = stage(many.join(parts.where("low < high").select("bucket"), "bucket").select("id").distinct(), "many")
    if not many.isEmpty():
        pairs = stage(prefix_pairs(links.component(links.sets.join(many, "id"), "id", "c"), cfg), "pairs")
        if not pairs.isEmpty():
            links.add(pairs)
    return links.stars


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: NearDedupConfig = NearDedupConfig()
) -> DataFrame:
    """One row per row of ``docs``: its key as ``id`` and its ``class_id``."""
    signed = stage(signatures(docs, key, text, cfg), "signatures")
    worded = signed.where("id IS NOT NULL AND size(bands) > 0")
    nodes = worded.groupBy("digest").agg(
        F.min("id").alias("id"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")
    )
    nodes = stage(nodes, "texts")
    stars = near_links(docs, nodes, key, text, cfg)
    if stars is not None:
        named = nodes.join(stars.withColumnRenamed("u", "id"), "id", "left")
    else:
        named = nodes.withColumn("v", F.lit(None).cast(dict(nodes.dtypes)["id"]))
    named = named.where("copies > 1 OR v IS NOT NULL")
    named = named.select(F.col("digest").alias("_digest"), F.coalesce("v", "id").alias("_class"))
    joined = signed.join(named, F.col("digest") == F.col("_digest"), "left")
    return joined.select("id", F.when(F.col("id").isNotNull(), F.coalesce("_class", "id")).alias("class_id"))


def _fresh(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = f"_{name}"
    return name


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: NearDedupConfig = NearDedupConfig()
) -> DataFrame:
    """The documents with one of each class, all columns kept.

    The row with the smallest key stays. If keys repeat or are NULL, a row is named by its key
    and a digest of its text, NULL keys last, so unlike texts of one key are judged on their
    own. Of rows with equal key and text one stays, whichever.
    """
    keys = docs.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    unique = keys.where("n > 1 OR k IS NULL").isEmpty()
    own, lost = _fresh(docs, "_row"), _fresh(docs, "_gone")
    name = F.col(key)
    if not unique:
        digest = F.unhex(F.md5(F.col(text).cast("binary")))
        name = F.struct(name.isNull().alias("none"), name.alias("key"), digest.alias("digest"))
    nodes = docs.select(name.alias("id"), F.col(text).alias("text"))
    found = stage(near_duplicates(nodes, "id", "text", cfg), "classes")
    gone = found.where("id <> class_id").select(F.col("id").alias(lost)).distinct()
    if gone.count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    rows = docs.withColumn(own, name)
    kept = rows.join(gone, F.col(own) == F.col(lost), "left_anti")
    return (kept if unique else kept.dropDuplicates([own])).drop(own)
