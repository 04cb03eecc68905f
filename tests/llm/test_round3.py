"""Conversation repair, BPE and centroid clusters against brute force, the library and exact integers."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from silkloom.llm import bpe_codec, centroid_clusters, conversation_repair

MERGES = public_tokenizers.path("word_bpe_49k.json")


# Conversations.


def cheapest(rows):
    """(cost, audit, result) of (initial, role, text, must_go, truncated) rows: every edit tried, whole audits compared."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @functools.cache
    def best(i, state, inserted):
        found = []
        if i == len(rows):
            found += [(0, "", ())] if state in ("", "a") else []
        else:
            initial, role, text, must_go, truncated = rows[i]
            c, a, r = best(i + 1, state, 0)
            found.append((4 + c, "D" + a, r))
            for edit, name, cost in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                if not must_go and (to := after[state].get(initial if edit == "K" else name[0])):
                    c, a, r = best(i + 1, to, 0)
                    found.append((cost + 3 * truncated + c, edit + a, (f"{name}:{text}", *r)))
        for name in ("user", "assistant") if inserted < 3 else ():
            if to := after[state].get(name[0]):
                c, a, r = best(i, to, inserted + 1)
                found.append((3 + c, "I" + a, (f"{name}:", *r)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def repaired(rows):
    """The contract, row by row, of (conv, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = convs[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            kept += [row] * (2 if kind == 3 else 1)
    out = []
    for conv, kept in convs.items():
        key = lambda r: hashlib.sha256(said(conv, r[1], r[2]).encode()).digest()  # noqa: B023, E731
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], key(r)))  # noqa: B023
        seen, faults, marked = set(), [], []
        for _, role, text in kept:
            there = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not there else "duplicate" if (role, text) in seen else "truncated" if there[-1] not in ".!?" else "")
            seen.add((role, text))
            marked.append((role[:1], role, text, faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[0] + b[0] for a, b in zip(marked, marked[1:])]
        cost, audit, lines = cheapest(tuple(marked))
        out.append((conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(repr, out))


def said(conv, role, text):
    """What ties within a turn are ordered by."""
    import json

    row = {"conv": conv, "role": role, "text": text}
    return json.dumps({k: v for k, v in row.items() if v is not None}, separators=(",", ":"), ensure_ascii=False)


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "ok!", "A.B", "so \n", "fine. ", None, "é…"]
    rows = []
    for conv in [None, *range(n)]:
        for i in range(rng.choice([0, 1, 2, 3, 5, 8])):
            turn = rng.choice([i, i, i, i + 1, None])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]), rng.choice(texts)))
    return rows


def test_conversations(spark):
    rows = conversations(3, 250) + [(999, i, ("user", "assistant")[i % 2], f"Line {i % 50}.") for i in range(600)] + [(1000, 7, "user", "Same.")] * 40
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n", "'x' as audit", "'y' as conv").repartition(5)
    got = [tuple(r) for r in conversation_repair.damage_and_repair(frame).collect()]
    assert sorted(map(repr, got)) == repaired(rows)


def test_conversations_across_tasks(spark):
    """One conversation that spans all tasks has one signature."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"Line {i}.") for i in range(500)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [repr(tuple(r)) for r in conversation_repair.damage_and_repair(frame).collect()] == repaired(rows)


def test_conversation_payload_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_repair.damage_and_repair(spark.createDataFrame([], schema)).count() == 0
    rows = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate([("system", "S."), ("user", "Q?"), ("assistant", "A.")])]
    for r in conversation_repair.damage_and_repair(spark.createDataFrame(rows, schema), payload=True).collect():
        assert hashlib.sha256(r.repaired.encode()).hexdigest() == r.repaired_sha256
        roles = "".join(line.split(":")[0][:1] for line in r.repaired.split("\n"))
        assert re.fullmatch("(s?(ua)+)?", roles)


def test_signatures_against_every_edit():
    rng = random.Random(9)
    for _ in range(3000):
        signature = "".join(rng.choice(conversation_repair.LETTERS) for _ in range(rng.randint(0, 9)))
        rows = tuple((c, c, "x", f in (1, 2), f == 3) for letter in signature for f, i in [divmod(conversation_repair.LETTERS.index(letter), 4)] for c in "sua?"[i])
        assert conversation_repair.solve(signature)[4:] == cheapest(rows)[:2]


# BPE.


def awkward(seed, n):
    rng = random.Random(seed)
    letters = "aAbBeEiInNtThHé" + "".join(map(chr, (0x130, 0x131, 0x3A3, 0x3C3, 0x301, 0x338, 0xE01, 0xE49, 0x1112, 0x1161, 0xAC00, 0x672C, 0x1F600, 0x1F3FD, 0x200D, 0xBD, 0x2167, 0xFB01, 0x1C5, 0x200B, 0xFEFF))) + "'.,!?<|>_-/\\0123"
    letters += "".join(map(chr, (9, 10, 13, 28, 29, 32, 32, 32, 0x85, 0xA0, 0x2003, 0x3000)))
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 4, 15, 120]))) for _ in range(n)]
    texts += [t[:3] + s + t[3:] for t, s in zip(texts[: n // 10], ["<|endoftext|>", "<|startoftext|>", "<|endoftext|><|endoftext|> "] * n)]
    return [*texts, "", " ", "\n", "a" * 3000, "ab" * 3000, "in" * 999, "word " * 60000, "x" * 300000, "it's IT'S 'tis they'll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MERGES)


def test_bpe_equals_library(spark, library):
    texts = [None, *awkward(1, 3000)]
    frame = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string, known string").repartition(3)
    got = {r.doc_id: r for r in bpe_codec.encode_decode(frame, MERGES, keep=("doc_id", "known"), payload=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        told = library.decode(want, skip_special_tokens=False)
        r = got[i]
        assert (r.ids, r.n_tokens, r.decoded) == (want, len(want), told), repr(t[:100])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(told.encode()).hexdigest()


def test_bpe_small_tables(library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "PAIRS", 50)
    monkeypatch.setattr(bpe_codec, "BLOCK", 40)
    monkeypatch.setattr(bpe_codec, "IDS", 7)
    c = bpe_codec.Coder(MERGES, table_bytes=2000)
    for t in awkward(2, 600):
        ids = library.encode(t, add_special_tokens=False).ids
        assert c.encode(t).tolist() == ids
        if len(ids) < 2000:
            assert c.decode(c.encode(t)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_every_character(library):
    c = bpe_codec.Coder(MERGES)
    points = [x for x in range(1, 0x110000) if not 0xD800 <= x < 0xE000]
    for s in range(0, len(points), 512):
        text = "".join(f"a{chr(x)}b " for x in points[s : s + 512])
        assert c.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_pairs_against_merging():
    """Compatible pairs are those that merging letter by letter leaves apart."""
    m = bpe_codec.coder(MERGES).merges

    def merged(letters):
        now = [m.letters[c] for c in letters]
        while True:
            ranks = [(m.rank.get(p, math.inf), k) for k, p in enumerate(zip(now, now[1:]))]
            rank, k = min(ranks, default=(math.inf, 0))
            if rank == math.inf:
                return now
            now[k : k + 2] = [next(c for c in (m.tokens.get(m.spelled[now[k]] + m.spelled[now[k + 1]]),))]

    rng = random.Random(4)
    inner = [i for i, s in m.spelled.items() if ord(s[-1]) < bpe_codec.LAST]
    for _ in range(4000):
        a, b = rng.choice(inner), rng.choice(list(m.whole) if rng.random() < 0.01 else inner)
        assert m.compatible(a, b) == (merged(m.spelled[a] + m.spelled[b]) == [a, b])


def test_bpe_refuses_other_files(spark):
    with pytest.raises(ValueError):
        bpe_codec.check_model(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe_codec.encode_decode(spark.createDataFrame([], "doc_id long, text string"), MERGES).count() == 0


# Centroids.


def clusters(rows, k, rounds, dims):
    kept = [(key, tuple(max(-(2**27), min(2**27, math.floor(256 * x))) for x in v)) for key, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), i) for i, x in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [tuple(sum(x) // len(own[i]) for x in zip(*own[i])) if i in own else c[i] for i in range(len(c))]
    found = [(key, *near(v)[::-1]) for key, v in kept]
    spread = defaultdict(int)
    for _, i, d in found:
        spread[i] += d
    return sorted(repr((key, i, d, spread[i], sum(spread.values()), hashlib.sha256(",".join(map(str, c[i])).encode()).hexdigest())) for key, i, d in found)


def vectors(n, dims):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n)] + [(rows[3][0], rows[4][1]), rows[5], rows[5], (None, rows[6][1]), (None, [0.0] * dims)]
    rows += [(2000, None), (2001, []), (2002, [0.5] * (dims - 1)), (2003, [None] + [0.1] * (dims - 1)), (2004, [math.nan] + [0.1] * (dims - 1)), (2005, [math.inf] * dims), (2006, [-0.0] * dims), (2007, [1e30] + [0.0] * (dims - 1))]
    return rows


@pytest.mark.parametrize(("k", "rounds", "dims"), [(5, 4, 3), (40, 5, 64), (300, 2, 2)])
def test_centroids(spark, k, rounds, dims):
    rows = vectors(120, dims)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, n int").repartition(5)
    got = centroid_clusters.cluster(frame, k=k, rounds=rounds, dims=dims)
    assert sorted(repr(tuple(r)) for r in got.drop("centroid").collect()) == clusters(rows, k, rounds, dims)


def test_centroids_of_nothing(spark):
    assert centroid_clusters.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert centroid_clusters.cluster(spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")).count() == 0
