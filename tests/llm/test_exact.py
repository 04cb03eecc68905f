"""The training-data operators against brute force, on small rows with the awkward cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from silkloom.llm import embedding_dedup, license_scan, near_copies, sentencepiece_codec, simhash, source_mix, substring_dedup, token_counts
from silkloom.llm.common import connected_components

MODEL = public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [None, "", " ", "\n", "one", "one two", "A\x00b\tc", "MIT License", "é 😀 ①\n\n  x", "▁ ▁▁a  b", "w " * 5000, "x" * 70000]


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, label string").repartition(3)


def random_texts(seed, n=60, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        out.append(" ".join(t))
    return out


def least_reachable(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60) if i % 7] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, i) for i in range(501, 700)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = least_reachable({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash.


def plain_fingerprint(text, k=3):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("leaf", [2, 2048])
def test_simhash(spark, monkeypatch, leaf):
    texts = AWKWARD + random_texts(1, words=60) + ["ÉCOLE Mit"] + ["one"] * 3
    monkeypatch.setattr(simhash.covering_links, "__defaults__", (3, leaf))
    got = {r.doc_id: r for r in simhash.simhash_groups(documents(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert {i: r.component_id for i, r in got.items()} == least_reachable(range(len(fps)), linked)
    left = simhash.simhash_dedup(documents(spark, texts))
    assert left.columns == ["doc_id", "text", "id", "label"] and left.count() == len({r.component_id for r in got.values()})
    assert simhash.simhash_groups(documents(spark, [])).count() == 0


def test_covering_masks_cover():
    rng = random.Random(5)
    for radius in (1, 2, 3, 4):
        for free in ((1 << 64) - 1, 0xFFFF0000FF):
            masks = simhash.covering_masks(free, radius)
            bits = [i for i in range(64) if free >> i & 1]
            assert len(masks) == 2 ** (radius + 1) - 1
            for _ in range(300):
                differing = sum(1 << b for b in rng.sample(bits, radius))
                assert any(m & differing == 0 for m in masks)


# Near copies.


def plain_shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("list_bytes", [4000, 4 << 20])
def test_pipeline_stage_finds_all_near_copies(spark, monkeypatch, list_bytes):
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "LIST_BYTES", list_bytes)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = list(AWKWARD) + ["One Two", "short text of four", "short TEXT of four"]
    for n in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([12, 60, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(3):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t[rng.randint(0, 2) :]))
    line, base = "a line that a third of all texts hold in the same words ".split(), [rng.choice(words) for _ in range(80)]
    for n in range(60):
        t = line + [rng.choice(words) for _ in range(30)] if n % 2 else list(base)
        if n % 2 == 0:
            for _ in range(rng.randint(1, 3)):
                t[rng.randrange(80)] = f"e{n}"
        texts.append(" ".join(t))
    ids = rng.sample(range(-50, 900), len(texts))
    sets = [plain_shingles(t) for t in texts]
    linked = [(ids[i], ids[j]) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    near = [(a, b) for a, b in linked if sets[ids.index(a)] != sets[ids.index(b)]]
    part = least_reachable(ids, linked)
    left = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, documents(spark, texts, ids), "")
    assert left.columns == ["doc_id", "text", "id", "label"] and len(near) > 100
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i in ids if part[i] == i)


def test_pipeline_stage_links_by_fingerprints(spark):
    """Without the check that follows, all pairs of fingerprints within the radius that are similar are joined, and no others."""
    rng = random.Random(4)
    texts = ["", "one two", "One two"]
    for _ in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 200, 600]))]
        texts += [" ".join(base[: len(base) - n]) for n in (0, 1, 2)]
    sets = [near_copies.shingles(t) for t in texts]
    fps = [near_copies.fingerprint(s) for s in sets]
    for s, fp in zip(sets, fps):
        ones = [sum(int(h) >> bit & 1 for h in s) for bit in range(64)]
        assert fp % (1 << 64) == sum(1 << bit for bit, n in enumerate(ones) if 2 * n > len(s))
    nodes = [near_copies.class_of(s) for s in sets]
    rows = [(n, f) for n, f in sorted({*zip(nodes, fps)})]
    got = {tuple(sorted(r)) for r in near_copies._fingerprint_pairs(near_copies.materialise(spark.createDataFrame(rows, "node long, fp long"))).collect()}
    near = {(a, b) for a, x in rows for b, y in rows if a < b and ((x ^ y) % (1 << 64)).bit_count() <= near_copies.RADIUS}
    part = lambda pairs: least_reachable([n for n, _ in rows], list(pairs))
    assert len(near) > 10 and got <= near and part(got) == part(near)


def test_pairs_apart_in_a_list():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 40, 60).astype(np.uint64)) for _ in range(80)]
    parts = rng.integers(0, 9, 80)
    got = near_copies.apart(parts, sets)
    assert all(parts[x] != parts[y] and near_copies.similar(sets[x], sets[y]) for x, y in got)
    want = {tuple(sorted((parts[x], parts[y]))) for x in range(80) for y in range(x) if parts[x] != parts[y] and 5 * len({*sets[x]} & {*sets[y]}) >= 4 * len({*sets[x]} | {*sets[y]})}
    assert {tuple(sorted((parts[x], parts[y]))) for x, y in got} == want and want
    assert near_copies.apart(parts[:1], sets[:1]) == []


# Substrings.


def plain_removal(rows):
    rows = sorted((i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in rows)
    first, out = {}, {}
    for i, w in rows:
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    for i, w in rows:
        gone = {p for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (i, s) for p in range(s, s + 20)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("block", [50, 1_500_000])
def test_substrings(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(2000)}"
    passage, texts = [word() for _ in range(57)], list(AWKWARD)
    for n in range(50):
        t = [word() for _ in range(rng.randint(0, 60))]
        if n % 2:
            s, e = sorted(rng.sample(range(58), 2))
            t[rng.randint(0, len(t)) : 0] = passage[s:e]
        if n % 5 == 0:
            t += t
        texts.append(" ".join(t))
    texts += [" ".join(passage[:20]), " ".join(passage[3:23]), " ".join(passage[:19]), "a " * 41, texts[20]]
    ids = rng.sample(range(-50, 400), len(texts))
    docs = documents(spark, texts, ids)
    want = plain_removal(list(zip(ids, texts)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_digests(docs).collect()}
    assert got == {i: w[:3] for i, w in want.items()}
    cut = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs.withColumn("found", F.lit(1))).collect()}
    assert all(cut[i] == (want[i][3] if want[i][1] else t) for i, t in zip(ids, texts))
    assert substring_dedup.dedup_digests(documents(spark, [])).count() == 0


def test_substrings_with_null_and_repeated_ids(spark):
    t = " ".join(f"q{i}" for i in range(25))
    got = [(r.doc_id, r.n_removed) for r in substring_dedup.dedup_digests(documents(spark, [t, t, t, t], [None, 4, 4, 9])).collect()]
    assert sorted(got, key=str) == sorted([(None, 0), (4, 25), (4, 25), (9, 25)], key=str)


def test_difference_cover():
    for i in range(substring_dedup.PERIOD):
        for j in range(substring_dedup.PERIOD):
            assert any((i + k) % 13 in substring_dedup.COVER and (j + k) % 13 in substring_dedup.COVER for k in range(13))


# Tokens.


def test_sentencepiece(spark):
    rng = random.Random(4)
    texts = AWKWARD + ["".join(rng.choice(" \n▁ab①é\r;.()\t") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    sp = SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in sentencepiece_codec.encode_decode(documents(spark, texts), MODEL, payload=True).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        data = np.array(ids, "<u4").tobytes()
        assert (got[i].n_tokens, bytes(got[i].ids), got[i].decoded) == (len(ids), data, sp.decode(ids))
        assert got[i].ids_sha256 == hashlib.sha256(data).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_decode(documents(spark, []), MODEL).count() == 0


def test_small_chunk_table_gives_the_same_ids(monkeypatch):
    texts = random_texts(7) * 2
    small, large = (list(sentencepiece_codec.ChunkTable(MODEL, n).code(pa.array(texts))) for n in (10, 100_000))
    monkeypatch.setattr(sentencepiece_codec, "SLICE_CHARS", 300)
    assert small == large == list(sentencepiece_codec.ChunkTable(MODEL, 10).code(pa.array(texts)))


def plain_count(word, scores):
    w, longest = "▁" + word, max(map(len, scores))
    best = [(0.0, 0)]
    for i in range(1, len(w) + 1):
        found = [(best[j][0] + scores[w[j:i]], -j, best[j][1] + 1) for j in range(max(0, i - longest), i) if w[j:i] in scores]
        if w[i - 1] not in scores:
            n = len(w[i - 1].encode())
            found.append((best[i - 1][0] + n * token_counts.BYTE_SCORE, -i, best[i - 1][1] + n))
        top = max(found)
        best.append((top[0], top[2]))
    return best[-1][1]


def test_token_counts(spark):
    texts = AWKWARD + random_texts(8) + ["internationalization unbelievably 😀①é"] * 2
    scores = token_counts.piece_scores(MODEL)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(documents(spark, texts), MODEL).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        assert got[i] == (len(w), sum(n * plain_count(x, scores) for x, n in Counter(w).items()))
    assert token_counts.count_tokens(documents(spark, []), MODEL).count() == 0


def test_trie_shares_prefixes():
    trie = token_counts.Trie(token_counts.piece_scores(MODEL))
    trie.insert(["national", "nationality", "nations"])
    assert trie.scored == len("▁nationality") + 1
    trie.insert(["nationally"])
    assert trie.scored == len("▁nationality") + 1 + 2
    small = token_counts.Trie(trie.scores, 20)
    texts = random_texts(3) + [None, "", " a", "b" * 300 + " b"]
    for some in (texts[:20], texts[20:], texts):
        got, want = (t.totals(pa.array(some)) for t in (small, trie))
        assert [x.tolist() for x in got] == [x.tolist() for x in want]


# Embeddings.


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.3, 2.0])
        rows.append((i, [float(x) for x in v], i % 3 if i % 50 else None, "x"))
    rows += [(1000, None, 1, "x"), (1001, [0.0] * 16, 1, "x"), (1002, [float("nan")] * 16, 1, "x"), (1003, [1.0] * 15 + [None], 1, "x"), (1004, [1e300] * 16, 1, "x"), (1005, [], 1, "x"), (1006, [1.0, 0.0], 1, "x"), (1007, [2.0, 0.1], 1, "x")]
    rows += [(2000 + i, rows[1][1], rows[1][2], "x") for i in range(5)] + [rows[1]]
    nobody = spark.createDataFrame([(None, rows[1][1], rows[1][2], "x")] * 2, "vec_id long, embedding array<double>, label int, links string")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, links string")
    got = defaultdict(set)
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0
    for r in embedding_dedup.embedding_groups(df.union(nobody)).collect():
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
            continue
        got[r.vec_id].add((r.n_links, r.component_id, r.kept))
    ok = [(k, v / np.linalg.norm(v), g) for k, x, g, _ in rows if g is not None and x and None not in x and np.isfinite(v := np.array(x) / max(np.abs(x).max(), 1e-300)).all() and v.any()]
    links, edges = Counter(), []
    for a in range(len(ok)):
        for b in range(a):
            if ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= 0.93:
                links.update([ok[a][0], ok[b][0]])
                edges.append((ok[a][0], ok[b][0]))
    links[1] //= 2  # its row is there twice
    parts = least_reachable({r[0] for r in rows}, edges)
    assert {k: v for k, v in got.items()} == {k: {(links[k], parts[k], parts[k] == k)} for k in got} and len(got) == len({r[0] for r in rows})


def test_embedding_recall_with_split_lists(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 32))
    x = np.vstack([x, x[:300] + rng.normal(size=(300, 32)) * 0.25])
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & ~np.eye(len(u), dtype=bool)
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_groups(df, per_list=25, coarse=4).collect()}
    assert all(got[i] <= near[i].sum() for i in got)
    assert sum(got.values()) >= 0.9 * near.sum() > 200
    q = embedding_dedup.Quantiser(u, 40, 4)
    lists = q.near(u, 3)
    every = np.array([((u[:, None, :] - q.centroids(np.arange(40))) ** 2).sum(2)])[0]
    assert len(q.splits) == 10 and np.mean(lists[:, 0] == every.argmin(axis=1)) > 0.8


# Licences.


def test_licenses(spark):
    texts = AWKWARD + ["MIT license, mit LICENSE", "the apache-license and mit mit license", "general public license", "general public", "Licensed under CC BY-NC 4.0.", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "licénse mit license ", "mitlicense"]
    got = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = sorted((s, label) for p, label in license_scan.BASE_PHRASES.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None)
        assert r.base_labels == ",".join(sorted({x[1] for x in hits})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    n = len(AWKWARD)
    assert got[n + 4].labels == "cc-by-nc" and got[n + 5].labels == "mit" and got[n + 5].n_base == 0 and got[n + 5].score == 1


# Mixing.


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 9), ["a", "a", "a", "b", None][i % 5], ["en", "fr"][i % 7 == 0], "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight string")
    wanted = {"source": {"a": 0.3, "b": 0.4, None: 0.3}, "lang": {"en": 0.5, "fr": 0.5}, "topic": 0.0}
    got = source_mix.mix(df, targets=wanted).cache()
    for dim in ("source", "lang"):
        sums = {r[0]: r[1] for r in got.groupBy(dim).agg(F.sum(F.col("n_tokens") * F.col("probability"))).collect()}
        assert all(abs(v / sum(sums.values()) - wanted[dim][k]) < 1e-3 for k, v in sums.items())
    assert got.agg(F.max("probability")).first()[0] == 1.0 and 0 < got.where("kept").count() < 4000
    again = source_mix.mix(df.repartition(7), targets=wanted).where("kept").select("doc_id")
    assert {r[0] for r in again.collect()} == {r[0] for r in got.where("kept").select("doc_id").collect()}


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "", "s", "en"), (None, "a b", "s", "en"), (3, "a@b", "s", "fr"), (3, "a@b", "s", "fr")], "doc_id long, text string, source string, lang string")
    rows = {(r.doc_id, r.text): r for r in source_mix.mix(df).collect()}
    assert rows[(1, None)].kept and rows[(1, None)].n_tokens == 0 and rows[(3, "a@b")].topic == "contact"
    assert source_mix.mix(df.limit(0)).count() == 0
    big = source_mix.mix(df)
    source_mix_small = (source_mix.MAX_CELLS, source_mix.BROADCAST_CELLS)
    try:
        source_mix.MAX_CELLS = source_mix.BROADCAST_CELLS = 0
        assert sorted(map(repr, source_mix.mix(df).collect())) == sorted(map(repr, big.collect()))
    finally:
        source_mix.MAX_CELLS, source_mix.BROADCAST_CELLS = source_mix_small


# Source mix.


def test_mix_meets_its_targets_on_either_path(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "b", "", None]), rng.choice(["en", "fr", None]), "own") for i in range(600)] + [(7, None, "a", "en", "own")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight string")
    targets = {"source": {"a": 0.5, "b": 0.25, "": 0.125, None: 0.125}, "lang": 0.5}
    seen = []
    for cells in (source_mix.MAX_CELLS, 3):
        monkeypatch.setattr(source_mix, "MAX_CELLS", cells)
        got = source_mix.mix(docs, targets=targets).collect()
        weight, own = {(r.source, r.lang): r.weight for r in got if r.n_tokens}, Counter()
        for (source, _), w in weight.items():
            own[source] += w
        assert all(abs(own[v] - part) < 1e-5 for v, part in targets["source"].items()) and len(weight) == 12
        assert max(r.probability for r in got) == 1 and len({r.kept for r in got if r.doc_id == 7}) == 1
        seen.append(sorted((r.doc_id, r.kept) for r in got))
    assert seen[0] == seen[1] and source_mix.mix(docs.limit(0), targets=targets).count() == 0
