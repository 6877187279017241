"""Repeated keys in near-duplicate removal, the language model and the pipeline against plain versions."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_filters import base_rules, classes

import corpus_pipeline
from stormgrid.llm import kneser_ney, near_dedup


def test_unlike_texts_of_one_key_are_judged_on_their_own(spark):
    long = [" ".join(f"w{k * 97 + i}" for i in range(60)) for k in range(4)]
    rows = [
        (1, long[0], "a"), (1, long[1], "b"), (1, long[1], "b"), (2, long[0], "c"), (3, long[2] + " more", "d"),
        (None, long[2], "e"), (None, long[3], "f"), (None, long[3], "f"), (4, None, "g"), (4, "", "h"), (None, None, "i"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string").withColumn("_row", F.lit(0))
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id or 0, r._gone) for r in kept.collect()))
    assert found == [(0, "f"), (0, "i"), (1, "a"), (1, "b"), (3, "d"), (4, "g"), (4, "h")]
    assert near_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def discounts(values):
    n = Counter(values)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
    plain = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else k - 0.5 for k in (1, 2, 3)]
    return [0, *(min(max(d, 0), k) for k, d in enumerate(plain, 1))]


def kneser_ney_scores(train, texts):
    """log10 probability of each text and by smoothed single tokens, from the formulas."""
    pairs, heads, single = Counter(), Counter(), Counter()
    for text in train:
        seq = tokens_of(text)
        for v, w in zip([0, *seq], seq):
            pairs[v, w] += 1
            heads[v] += 1
            single[w] += 1
    left = Counter(w for _, w in pairs)
    d2, d1 = discounts(pairs.values()), discounts(left.values())
    spare = sum(d1[min(n, 3)] for n in left.values()) / len(pairs)
    freed = Counter()
    for (v, _), n in pairs.items():
        freed[v] += d2[min(n, 3)]

    def p(v, w):
        low = max(left[w] - d1[min(left[w], 3)], 0) / len(pairs) + spare / (len(single) + 1)
        if not heads[v]:
            return low
        return max(pairs[v, w] - d2[min(pairs[v, w], 3)], 0) / heads[v] + freed[v] / heads[v] * low

    total, kinds = sum(single.values()), len(single)
    out = []
    for text in texts:
        seq = tokens_of(text)
        score = sum(math.log10(p(v, w)) for v, w in zip([0, *seq], seq))
        base = sum(math.log10((single[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in seq)
        out.append((len(seq), sum(single[w] > 0 for w in seq), base, score))
    return out


@pytest.mark.parametrize("cfg", [kneser_ney.LmConfig(), kneser_ney.LmConfig(block_bytes=20_000, shard_items=2_000)])
def test_scores_equal_the_formulas(spark, sf_dir, cfg):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "Same same SAME"), (-3, "Same same SAME")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    rows = docs.collect()
    held = {r.doc_id for r in rows if r.doc_id % 7 == 3}
    got = kneser_ney.score_texts(docs, "doc_id % 7 = 3", cfg=cfg).collect()
    want = kneser_ney_scores([r.text for r in rows if r.doc_id not in held], [r.text for r in rows])
    want = sorted((r.doc_id, r.doc_id in held, *w) for r, w in zip(rows, want))
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [x for g in got for x in g[4:]] == pytest.approx([x for w in want for x in w[4:]], rel=1e-9)


def test_pipeline_stages_keep_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, work in corpus_pipeline.STAGES:
        out = work(spark, docs, sf_dir)
        if name == "packing":
            break
        rows = out.collect()
        assert out.columns == columns and len({r.doc_id for r in rows}) == len(rows)
        assert all(seen[r.doc_id] == r.text for r in rows)
        left = {r.doc_id for r in rows}
        if name == "quality_rules":
            assert left <= {i for i, t in seen.items() if not base_rules(t)[-1]}
        if name == "near_dedup":
            assert left == {i for i, c in classes(list(seen.items())).items() if i == c}
        assert left
        seen = {i: t for i, t in seen.items() if i in left}
        docs = out
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == set(seen)
    at = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096


@pytest.mark.parametrize("bits", [0, 1, 5, 16, 17, 20])
def test_words_go_to_as_many_shards_as_wanted(bits):
    """All 65 536 values of the top 16 bits were shards of their own, for up to 16 bits."""
    hashes = np.sort(np.random.default_rng(bits).integers(0, 1 << 64, 100_000, np.uint64, endpoint=False))
    runs = kneser_ney.runs(kneser_ney.word_shard_of(hashes, bits))
    assert len(runs) <= 1 << bits and [a for _, a, _ in runs] == [0, *(b for _, _, b in runs[:-1])] and runs[-1][2] == 100_000
    keys = np.sort(kneser_ney.shard_key(hashes, bits))
    for _, a, b in kneser_ney.runs(kneser_ney.shard_of(keys, bits))[:50]:
        assert (kneser_ney.unpack_sorted(kneser_ney.pack_sorted(keys[a:b])) == keys[a:b] & kneser_ney.LOW48).all()


@pytest.mark.parametrize("values", [[], [0], [254, 255, 256, 0, 1, (1 << 32) - 1], [255] * 3])
def test_small_numbers_come_back(values):
    values = np.array(values, np.int64)
    assert (kneser_ney.unpack_small(kneser_ney.pack_small(values), len(values)) == values).all()
