"""Conversation repair, periodic runs and secret formats against brute force."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from stormgrid.llm import conversation_repair, periodic_runs, secret_formats
from stormgrid.llm.queries import LLM_QUERIES, damaged_conversations, repeated_tails

WHITE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------- conversations


@functools.cache
def every_repair(rows):
    """The least (cost, audit, repaired rows) of all sequences of edits with few insertions."""
    best = None
    names = {"s": "system", "u": "user", "a": "assistant"}
    gaps = [()] + [tuple(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    ways = []
    for role, text, fault in rows:
        extra = 5 if fault == "truncated" else 0
        row = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            row += [(extra, "K", (role, text)), (1 + extra, "R", ("user", text)), (1 + extra, "R", ("assistant", text))]
        ways.append(row)
    for edits in itertools.product(*ways):
        for holes in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for hole, edit in itertools.zip_longest(holes, edits):
                cost += 5 * len(hole)
                audit += "I" * len(hole)
                out += [(names[x], "") for x in hole]
                if edit:
                    cost += edit[0]
                    audit += edit[1]
                    out += [edit[2]] if edit[2] else []
            if best is not None and (cost, audit) >= best[:2]:
                continue
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                best = (cost, audit, out)
    return best


def faults_of(rows):
    """(role, text, fault) in order of turns."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, out = set(), []
    for _, role, text in rows:
        if not text.strip(WHITE):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "ok" if text.strip(WHITE)[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return tuple(out)


def expected_repair(rows):
    known = sorted({t for t, _, _ in rows if t is not None})
    marked = faults_of(rows)
    initials = [r[:1] for r, _, _ in marked]
    cost, audit, out = every_repair(marked)
    return {
        "gaps": known[-1] - known[0] + 1 - len(known) if known else 0,
        **{f: sum(x == f for _, _, x in marked) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": sha("\n".join(f"{r}:{t}" for r, t in out)),
    }


@pytest.fixture(scope="module")
def conversations():
    draw = random.Random(11)
    texts = ["Good day.", "So what?", "cut off", "", " \t", "Ends! \n", "é.", "no end"]
    table = {}
    for c in [None, *range(60)]:
        turns = [draw.choice([None, 0, 1, 2, 3, 5, 9]) for _ in range(draw.randint(0, 3))]
        table[c] = [(t, draw.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), draw.choice(texts)) for t in turns]
    table[7] = [(3, "user", "Same."), (3, "user", "Same."), (4, "assistant", "Yes."), (5, "user", "Same.")]
    return table


@pytest.fixture(scope="module")
def expected(conversations):
    return {c: expected_repair(found) for c, found in conversations.items()}


@pytest.mark.parametrize("cfg", [conversation_repair.GrammarConfig(), conversation_repair.GrammarConfig(0, 1), conversation_repair.GrammarConfig(3, 2)])
def test_repairs_equal_every_sequence_of_edits(spark, conversations, expected, cfg):
    rows = [(c, *r, 1, "x") for c, found in conversations.items() for r in found]
    rows += [(c, 0, "user", "gone", 0, "x") for c, found in conversations.items() if not found]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, times int, _conv string").repartition(7)
    got = conversation_repair.repair_digests(df, times="times", cfg=cfg).collect()
    assert len(got) == len(conversations)
    for row in got:
        assert {k: v for k, v in row.asDict().items() if k != "conv_id"} == expected[row.conv_id], row


def test_repaired_rows_and_empty_table(spark, conversations):
    rows = [(str(c), *r) for c, found in conversations.items() for r in found]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {}
    for row in conversation_repair.repaired_turns(df).collect():
        got.setdefault(row.conv_id, []).append((row.role, row.text))
        assert row.turn is None or row.edit != "I"
    for c, found in conversations.items():
        assert got.get(str(c), []) == every_repair(faults_of(found))[2]
    assert conversation_repair.repair_digests(df.limit(0)).collect() == []
    assert conversation_repair.repaired_turns(df.limit(0)).collect() == []


def test_long_conversation_in_many_pieces(spark):
    """The rules, the pieces and repeated texts of one conversation over many partitions."""
    draw = random.Random(3)
    rows = [(1, i - i % 2, draw.choice(["user", "assistant"]), f"{draw.randint(0, 900)}" + draw.choice([".", ""])) for i in range(3000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = {r.conv_id: r for r in conversation_repair.repair_digests(df).collect()}
    marked = faults_of([r[1:] for r in rows if r[0] == 1])
    assert got[1].duplicate == sum(f == "duplicate" for *_, f in marked)
    best = {0: (0, "")}
    for role, _, fault in marked:  # all ways row by row
        symbol = 4 * "sua".index(role[0]) + ("ok", "blank", "duplicate", "truncated").index(fault)
        new = {}
        for (i, j), (cost, audit) in conversation_repair.row_edits(symbol).items():
            if i in best:
                found = (best[i][0] + cost, best[i][1] + audit)
                new[j] = min(new.get(j, found), found)
        best = new
    ends = [(best[j][0] + c, best[j][1] + a) for j, (c, a) in enumerate(conversation_repair.CLOSING) if j in best]
    assert (got[1].cost, got[1].audit) == min(ends)
    assert got[1].gaps == 2998 + 1 - 1500 and got[2].audit == "KK" and got[2].gaps == 0


def test_planted_damage(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t, r, x in [(None, None, None), (0, "user", "A. b!"), (1, "assistant", "C?"), (2, "user", "d.")]]
    got = damaged_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for row, (c, t, r, x) in zip(got, rows, strict=True):
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        assert row.times == {0: 0, 3: 2}.get(code, 1)
        assert row.role == ("user" if code == 4 else r)
        assert row.text == ("" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x)


# ------------------------------------------------------------------- periodic runs


def all_runs(words):
    ids = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0, int)
    n, found = len(ids), {}
    for p in range(1, n // 3 + 1):
        same = np.concatenate([[False], ids[:-p] == ids[p:], [False]]).astype(int)
        for s, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            length = int(e - s + p)
            if length >= max(24, 3 * p) and (int(s), length) not in found:
                found[int(s), length] = p
    return sorted((s, length, p) for (s, length), p in found.items())


def expected_runs(words):
    runs = all_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return {
        "n_runs": len(runs),
        "start": best and best[0],
        "length": best and best[1],
        "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
        "collapsed_sha256": sha(kept),
    }


def tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_equal_all_periods(spark):
    draw = random.Random(12)
    texts = [None, "", " \n ", "a " * 500, "a b " * 40 + "c", "x" + " a b a" * 30 + " a b a b" * 30]
    for _ in range(150):
        out = []
        while len(out) < draw.randint(20, 300):
            base = [draw.choice("abc") for _ in range(draw.randint(1, 12))]
            out += (base * draw.randint(1, 14))[: draw.randint(1, 100)]
        texts.append("\t".join(out))
    words = list("ab")
    while len(words[1]) < 900:  # words of a Fibonacci string
        words = [words[1], words[1] + words[0]]
    texts.append(" ".join(words[1]))
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    for row in periodic_runs.run_digests(df).collect():
        assert {k: v for k, v in row.asDict().items() if k != "doc_id"} == expected_runs(split(texts[row.doc_id])), row
    for row in periodic_runs.periodic_runs(df).collect():
        assert [tuple(r) for r in row.runs] == all_runs(split(texts[row.doc_id]))
        assert sha(row.collapsed) == expected_runs(split(texts[row.doc_id]))["collapsed_sha256"]
    assert periodic_runs.run_digests(df.limit(0)).collect() == []


def test_runs_query_on_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = LLM_QUERIES["op12_periodic_runs"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert sum(r.n_runs > 0 for r in got) > 5
    for row in got:
        want = expected_runs(tail(row.doc_id, split(docs[row.doc_id])))
        assert {k: v for k, v in row.asDict().items() if k != "doc_id"} == want, row.doc_id


def test_repeated_tails_keep_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), *((i, "a　b c\x0bd e") for i in range(40))]
    got = repeated_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for row, (i, text) in zip(got, rows, strict=True):
        assert split(row.text) == (split(text) if i is None else tail(i, split(text)))


def test_very_long_text_of_one_word(spark):
    df = spark.createDataFrame([(1, "w " * 60_000)], "doc_id long, text string")
    row = periodic_runs.run_digests(df).first()
    assert (row.n_runs, row.start, row.length, row.period, row.collapsed_sha256) == (1, 0, 60_000, 1, sha("w"))


# ------------------------------------------------------------------- secrets

ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def fixed(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def shown(spans):
    return ",".join(f"{secret_formats.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_fixed_patterns_on_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = LLM_QUERIES["op13_secret_formats"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for row in got:
        base = fixed(docs[row.doc_id] or "")
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert row.base_sha256 == sha(shown(base))
        assert not base or set(shown(base).split(",")) <= set(row.spans.split(","))


def test_formats_are_learned_and_clean_texts_left_alone(spark):
    draw = random.Random(13)
    hexes = ["".join(draw.choices("0123456789abcdef", k=40)) for _ in range(300)]
    keys = ["AKIA" + "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) for _ in range(300)]
    word = lambda: "".join(draw.choice("btrdlsnm") + draw.choice("aeiou") for _ in range(draw.randint(1, 4)))
    prose = lambda: " ".join(word() if draw.random() < 0.8 else word().title() for _ in range(60)) + " NASA DNA"
    rows = [(i, f"{prose()} {h} é {k} {prose()}") for i, (h, k) in enumerate(zip(hexes, keys, strict=True))]
    rows += [(1000 + i, prose() + " 4785380592391139 unternehmensgruppenleiter 152.143.123.131") for i in range(300)]
    rows += [(2000 + i, f"{prose()} {hexes[i][:20]} {prose()}") for i in range(50)]
    rows += [(3000 + i, f"é {keys[i][:18]}, {prose()}") for i in range(20)]
    odd = [(None, None), (4001, ""), (4002, "AKIA" * 6), (4003, 'TOKEN: "a.b-c_d" Api_Key=short1 api-key=notone1'), (4004, "a" * 70_000), (4004, "password = 12345")]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, spans string")
    model = secret_formats.fit(df)
    got = {r.doc_id: r for r in secret_formats.find_secrets(df, model).collect()}
    for i, text in rows:
        spans = [(s.start, secret_formats.KINDS.index(s.kind), s.end) for s in got[i].spans if s.base]
        assert spans == fixed(text)
        added = [(s.kind, s.start, s.end) for s in got[i].spans if not s.base]
        if i < 2000:
            assert added == [], text
        elif i < 3000:
            at = text.index(hexes[i - 2000][:20])
            assert added == [("hex", at, at + 20)]
        else:
            assert added == [("access", 2, 20)]
    for i, text in odd:
        if i != 4004:
            assert [(s.start, secret_formats.KINDS.index(s.kind), s.end) for s in got[i].spans if s.base] == fixed(text or "")


def test_automaton_of_a_simple_language():
    """States of (ab)*c are told apart: two before the end, and one after it."""
    draw = random.Random(1)
    values = [b"ab" * draw.choice([1, 1, 1, 2, 2, 3]) + b"c" for _ in range(3000)]
    auto = secret_formats.infer(values)
    data = np.frombuffer(b"ababcaacb", np.uint8)
    good, bad = secret_formats.likelihood(auto, 0, data, np.array([0, 5]), np.array([5, 9]))
    assert good > -6 and bad < -25
    assert len(auto.step) <= 8


def test_no_credentials_and_empty_table(spark):
    df = spark.createDataFrame([(1, "nothing here"), (2, None)], "doc_id long, text string")
    model = secret_formats.fit(df)
    assert model.automata == {}
    assert [r.spans for r in secret_formats.find_secrets(df, model).collect()] == [[], []]
    none = df.limit(0)
    assert secret_formats.find_secrets(none, secret_formats.fit(none)).collect() == []
