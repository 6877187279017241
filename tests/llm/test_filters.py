"""Near-duplicate classes and quality rules against brute force, on small tables with odd rows."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stormgrid.llm import near_dedup, quality_rules, textblock

SCHEMA = "doc_id long, text string, id string, bucket string"


def shingle_weights(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    if 0 < len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def probability_jaccard(a, b):
    return sum(1 / sum(max(a[z] / a[x], b[z] / b[x]) for z in a.keys() | b.keys()) for x in a.keys() & b.keys())


def classes(rows):
    """The smallest key of each component of the links, every pair compared."""
    sets = [(i, shingle_weights(t)) for i, t, *_ in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and probability_jaccard(a, b) >= 0.8:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in root}


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=4))
    texts = [None, "", "  ", "two words", "TWO words", "a b c d e " * 40, "a b c d e " * 41]
    for _ in range(4):
        base = [word() for _ in range(80)]
        for edits in (0, 0, 1, 1, 2, 2, 3, 4, 6):
            copy = list(base)
            for at in draw.sample(range(80), edits):
                copy[at] = word()
            texts.append(" ".join(copy))
    return [(i, t, "x", None) for i, t in enumerate(texts)] + [(None, "two words", None, None)]


@pytest.mark.parametrize("small", [32, 1])
def test_near_duplicate_classes_equal_all_pairs(spark, rows, small):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = near_dedup.near_duplicates(docs, cfg=near_dedup.NearDedupConfig(small=small)).collect()
    assert len(found) == len(rows)
    assert {r.id: r.class_id for r in found if r.id is not None} == classes(rows)
    assert [r.class_id for r in found if r.id is None] == [None]


def test_one_document_of_each_class_stays(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    expected = sorted(i for i, c in classes(rows).items() if i == c)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == expected
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0


def base_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def test_base_rules_equal_a_plain_count(spark):
    texts = [None, "", " \n\n", "é ü 日本 #a|<b>", "x y\nx y\n \nx y", "a b c a b c", "same " * 60, "\n".join(f"w{i} v{i}" for i in range(50))]
    rows = [(i, t, "x", None) for i, t in enumerate(texts)] + [(None, "a", None, None), (3, texts[3], "y", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(7, 1, 0), (6, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = quality_rules.apply_rules(docs, labels).collect()
    key = repr
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in found), key=key) == sorted(((i, *base_rules(t)) for i, t, *_ in rows), key=key)
    assert all(not r.kept for r in found if r.base_failed)
    assert [r.doc_id for r in quality_rules.keep_good(docs, labels).collect()] == [r.doc_id for r in found if r.kept]
    assert quality_rules.apply_rules(docs.where("false"), labels).count() == 0


def template_group(seed):
    """One long template: texts far from one another, and couples of near copies between them."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    base, texts = [word() for _ in range(100)], []
    for n in range(24):
        copy = list(base)
        for at in draw.sample(range(0, 100, 5), 4):
            copy[at] = word()
        copy += ["again and again and once more"] * (n % 3)
        texts.append(" ".join(copy))
        if n % 2:
            copy[draw.randrange(20, 90)] = word()
            texts.append(" ".join(copy))
    draw.shuffle(texts)
    return [(i, t, "x", None) for i, t in enumerate(texts)]


def near_pairs(sets):
    """The pairs of similarity 0.8; it is never above the common normalised weight."""
    sizes = {i: sum(a.values()) for i, a in sets.items()}
    common = lambda i, j: sum(min(sets[i][x] / sizes[i], sets[j][x] / sizes[j]) for x in sets[i].keys() & sets[j].keys())
    return [(i, j) for i in sets for j in sets if i > j and common(i, j) > 0.79 and probability_jaccard(sets[i], sets[j]) >= 0.8]


def test_pairs_of_a_large_open_bucket_are_all_compared(spark):
    rows = template_group(3)
    docs = spark.createDataFrame(rows, SCHEMA)
    cfg = near_dedup.NearDedupConfig(bands=1, rows=1, small=1)
    signed = {r.id: set(r.bands) for r in near_dedup.signatures(docs, "doc_id", "text", cfg).collect()}
    near = near_pairs({i: shingle_weights(t) for i, t, *_ in rows})
    shared = [(i, j) for i, j in near if signed[i] & signed[j]]
    found = {r.id: r.class_id for r in near_dedup.near_duplicates(docs, cfg=cfg).collect()}
    assert len(shared) > 4
    assert [(i, j) for i, j in shared if found[i] != found[j]] == []


def test_prefix_pairs_hold_every_near_pair(spark):
    rows = template_group(4) + [(1000 + i, t, "x", None) for i, t in enumerate(["a b c d e " * 40, "a b c d e " * 41, "one two"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    cfg = near_dedup.NearDedupConfig()
    made = near_dedup.shingle_sets(docs, docs.select(docs.doc_id.alias("id")), "doc_id", "text", cfg)
    found = {(r.u, r.v) for r in near_dedup.prefix_pairs(made.withColumn("c", made.id), cfg).collect()}
    near = set(near_pairs({i: shingle_weights(t) for i, t, *_ in rows}))
    assert len(near) > 10 and near <= found
    assert len(found) < len(rows) ** 2 / 4


def test_shingle_counters_are_few_rows_whatever_the_sets_hold(spark):
    """Each distinct shingle of a task was a row of its own."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 32, 300, np.uint32)
    items = [np.unique(np.append(common, rng.integers(0, 1 << 32, 2000, np.uint32))) for _ in range(320)]
    sets = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(items)], "id long, items binary").repartition(5)
    assert near_dedup.counters(sets).count() <= 5 * near_dedup.COUNTER_PARTS
    want = np.bincount(np.concatenate(items) >> np.uint32(32 - near_dedup.ORDER_BITS), minlength=1 << near_dedup.ORDER_BITS)
    assert (near_dedup.shingle_counts(sets) == np.minimum(want, near_dedup.MOST_COUNTED)).all() and want.max() > 300


def test_a_worker_holds_little_beside_its_batch():
    """Blocks of 2 MB took more than 64 MB for tables of powers alone, in each worker."""
    text = "the quick brown fox, jumps over the lazy dog; " * 40
    batch = pa.RecordBatch.from_pydict({"_text": [text] * 3000})
    textblock._powers.clear()
    tracemalloc.start()
    try:
        for _, block in textblock.blocks(batch, "_text"):
            quality_rules.base_statistics(block)
            quality_rules.gram_buckets(block, 1 << 16)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20
