"""The operators for training data against brute force, on small tables with odd rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stormgrid.llm import byte_bpe, jpeg_media, license_lookup, license_texts, packing, quality_classifier, url_rules, warc
from stormgrid.llm.queries import URL_RULES

FILES = byte_bpe.BpeFiles(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, host string, _salt string"
TEXTS = [None, "", " ", "a", "Hello, world!", "żółć 日本語 🙂\n\tdon't", "x" * 5000, "one two three " * 3000, "<unk>", "a\x00b"]
ROWS = [(i, t, "h", None) for i, t in enumerate(TEXTS)] + [(4, "Hello, world!", "h", "s"), (None, "no number", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def raw(text):
    return (text or "").encode()


def by_text(rows):
    return sorted(rows, key=repr)


def test_byte_bpe_equals_tiktoken_and_round_trips(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILES.ranks, "rb"))}
    own = tiktoken.Encoding("own", pat_str=FILES.pattern, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(docs, FILES)
    found = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.collect()]
    assert by_text(found) == by_text((i, own.encode_ordinary(t or "")) for i, t, *_ in ROWS)
    back = [(r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(encoded, FILES).collect()]
    assert by_text(back) == by_text((i, raw(t)) for i, t, *_ in ROWS)
    assert byte_bpe.encode(docs.where("false"), FILES).count() == 0


def test_media_gives_every_byte_back(docs):
    found = jpeg_media.media_features(jpeg_media.store_media(docs)).collect()
    expected = []
    for i, t, *_ in ROWS:
        data = raw(t)
        data += b"\xff" * (-len(data) % 576 if data else 576)
        expected.append((i, len(raw(t)), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:])))
    assert by_text((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == by_text(expected)
    assert jpeg_media.media_features(jpeg_media.store_media(docs.where("false"))).count() == 0


@pytest.mark.parametrize("data", [bytes(range(256)) * 9, b"\x80" * 5000, b"\x80" * 60 + b"a", np.random.default_rng(1).bytes(70_000)])
def test_any_bytes_survive_and_thumbnails_follow_dc(data):
    (file,) = jpeg_media.write_files(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    (picture,) = jpeg_media.read_files([file])
    payload = jpeg_media.payload_of(data)
    assert jpeg_media.payload_from(picture) == payload
    first = np.frombuffer(payload, np.uint8)[::64].astype(int)
    assert picture.thumbnail.ravel().tolist() == np.clip(np.floor((first - 128) / 8 + 128.5), 0, 255).astype(int).tolist()


def test_damaged_media_is_named():
    (file,) = jpeg_media.write_files(np.frombuffer(b"abc", np.uint8), np.array([0, 3]))
    with pytest.raises(ValueError, match="JPEG"):
        jpeg_media.read_files([file[: len(file) // 2]])


PAGES = [
    (1, "http://a.example.com/en/1", "x" * 200),
    (2, "HTTP://B.Example.NET/de/8?q#f", "x" * 200),
    (3, None, None),
    (4, "no scheme", ""),
    (5, "https://example.com/en/77", "short"),
    (5, "https://example.com/en/77", "short"),
    (None, "http://c.org/es/", "x" * 200),
    (7, "http://alias.info/p", '<link rel="canonical" href="http://x.com/en/q">'),
    (8, "http://hop.info/p", '<meta http-equiv="refresh" content="0;url=//alias.info/p">'),
    (9, "http://freed.info/p", '<link href="https://example.com/en/7" rel=\'canonical\'>'),
    (10, "http://freed.info/q", '<link rel="canonical" href="/p"><meta http-equiv="refresh" content="0; url=http://x.net/y">'),
]


def test_url_rules_and_aliases(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, _node string")
    found = {r.page_id: r for r in url_rules.judge_urls(pages, URL_RULES).collect()}
    for number, url, _ in PAGES:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        row = found[number]
        assert (row.host, row.path, row.rule) == (host, path, best and best.name)
        if best:
            assert row.verdict == best.verdict
    assert [found[i].verdict for i in (3, 4, 7, 8, 9, 10)] == ["allow", "allow", "block", "block", "allow", "allow"]
    assert url_rules.judge_urls(pages.where("false"), URL_RULES).count() == 0


def test_links_are_read_in_all_usual_forms(spark):
    pages = [
        ("http://h.org/a/b/c?x=1", "<LINK data-href=z REL='next Canonical' HREF=page2>", "h.org/a/b/page2"),
        ("http://h.org/a/b/d", '<link href="../x?y=../z" rel=canonical>', "h.org/a/x?y=../z"),
        ("http://h.org/a/e", '<link rel="canonical" href="?p=2&amp;ref=x&#38;k=1&#x26;l=2">', "h.org/a/e?p=2&ref=x&k=1&l=2"),
        ("http://h.org", '<link rel="icon" href="/i"><link title="a > rel=x" rel="canonical" href="./q/./">', "h.org/q/"),
        ("http://h.org/f", "<meta http-equiv=Refresh content='0; Url=http://N.com/z'>", "n.com/z"),
        ("http://h.org/g", '<META CONTENT="5;URL=\'../../up\'" HTTP-EQUIV="REFRESH">', "h.org/up"),
        ("http://h.org/i", '<link rel="canonicals" href="/no"><link data-rel="canonical" href="/no"><metal http-equiv=refresh>', None),
        ("http://h.org/j", '<link rel="canonical" href="mailto:a@b"><link rel="canonical" href="#top">', None),
    ]
    docs = spark.createDataFrame([p[:2] for p in pages], "url string, html string")
    found = {(r.u, r.v) for r in url_rules.alias_edges(docs).collect()}
    ends = [(u.split("://")[1], v) for u, _, v in pages if v]
    assert found == {(max(e), min(e)) for e in ends}


def test_warc_round_trip_and_index(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    cfg = warc.WarcConfig(archive_bytes=600)
    normal = warc.normalise(warc.write_archives(pages, cfg), cfg)
    found = [(r.page, r.record_type, r.refers, r.payload_bytes, r.payload_digest) for r in warc.read_records(normal).collect()]
    expected = []
    for number, _, html in PAGES:
        body, name = raw(html), "" if number is None else str(number)
        again = html == "x" * 200 and number != 1
        expected.append((name, "revisit" if again else "response", "1" if again else None, len(body), hashlib.sha256(body).hexdigest()))
    assert by_text(found) == by_text(expected)
    for row in normal.collect():
        assert sum(e.length for e in row["index"]) == len(row.content)
    assert warc.read_records(warc.normalise(warc.write_archives(pages.where("false")))).count() == 0


def test_pieces_have_the_ids_of_the_whole_tokenizer():
    """Every plain character in several surroundings, far scripts, marks and special tokens."""
    own = packing._Encoder(WORDS)
    assert own.plain
    texts = [x for c in map(chr, range(packing.PLAIN)) for x in (c, f"a{c}b", f"{c}{c}'s", f"1{c}2", f"É{c}'LL ")]
    texts += ["ΑΣ ΟΔΟΣ", "İstanbul ıİ", "e\u0301 é", "<|endoftext|> a", "a<|startoftext|>", "漢字 12½ x\u3000y", "ﬁ Ǆ ǅ", "Kelvin", "a\u200bb", ""]
    for text in texts:
        want = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want, repr(text)


def test_packing_is_whole_gapless_and_tight(docs):
    pieces = packing.token_pieces(docs, WORDS)
    packed = packing.pack(pieces)
    rows = packed.collect()
    tokenizer = Tokenizer.from_file(WORDS)
    expected = []
    for i, t, *_ in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            expected.append((i, at // 4096, at, len(ids[at : at + 4096]), np.array(ids[at : at + 4096], "<u4").tobytes()))
    assert by_text((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows) == by_text(expected)
    for one in packing.sequences(packed).collect():
        own = sorted((r for r in rows if r.sequence_id == one.sequence_id), key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert bytes(one.ids) == b"".join(bytes(r.ids) for r in own) and len(one.ids) <= 4 * 4096
    assert packing.pack(pieces.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plans_hold_every_piece(seed):
    draw = np.random.default_rng(seed)
    lengths = np.clip(draw.lognormal(6, 1.2, 5000).astype(int), 1, 4096)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True))))
    runs = packing.plan_sequences(histogram, packing.PackConfig())
    used = {}
    for n, items in runs:
        assert sum(a * k for a, k in items) <= 4096
        for a, k in items:
            used[a] = used.get(a, 0) + n * k
    assert used == histogram
    assert sum(n for n, _ in runs) <= 1.02 * lengths.sum() / 4096 + 1


def test_licenses_are_found_whatever_their_layout(spark):
    known = spark.createDataFrame(license_texts.LICENSES, "license_id string, text string")
    mit = license_texts.LICENSES[0][1]
    texts = ["Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ;"), mit.replace("sublicense", "sub-license"), mit + " more", None, "", "..."]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license_id string")
    found = {r.doc_id: r.license_id for r in license_lookup.find_licenses(docs, known).collect()}
    assert found == {0: "MIT", 1: "MIT", 2: None, 3: None, 4: None, 5: None}
    assert license_lookup.find_licenses(docs, known.where("false")).where("license_id IS NOT NULL").count() == 0


def test_classifier_learns_and_takes_odd_rows(spark):
    rows = [(i, ("good words here " if i % 2 else "bad junk here ") * (1 + i % 5)) for i in range(80)] + [(80, None), (81, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.where("doc_id < 80").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    weights = quality_classifier.train(docs, labels)
    found = {r.doc_id: r for r in quality_classifier.classify(docs, weights).collect()}
    assert all((found[i].score > found[i + 1].score) == bool(i % 2) for i in range(79))
    assert 0 <= found[80].score == found[81].score <= 1


def test_classifier_fits_no_more_rows_than_stated(spark):
    rows = [(1, f"text {i % 30}") for i in range(60)] + [(i, f"own {i}") for i in range(2, 12)] + [(12, None), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    made = lambda n: quality_classifier.training_rows(
        docs, labels, "true", quality_classifier.FtrlConfig(max_rows=n), "text", "doc_id"
    ).count()
    assert (made(7), made(41), made(1000)) == (7, 41, 41)
