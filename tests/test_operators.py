"""Validation, metrics, augmentation, similarity and graphs on small rows."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from silkloom.operators import augment, graph, metrics, similarity, validate

SYN = {"a": ["x", "y"], "b": ["b", "z"]}


def u(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16) / 4294967296.0


def reason(spark, task, schema, *values):
    return spark.createDataFrame([values], schema).select(validate.validate_sample(task).alias("v")).first().v


def test_classification(spark):
    s = "text string, label int"
    assert not reason(spark, "text_classification", s, "a good long text", 0).is_valid
    assert "nan" in reason(spark, "text_classification", s, "finance report ok", 1).reason
    assert not reason(spark, "text_classification", s, "x" * 9, 1).is_valid
    assert reason(spark, "text_classification", s, "x" * 10, 1).is_valid and reason(spark, "text_classification", s, "x" * 1000, 1).is_valid
    assert not reason(spark, "text_classification", s, "x" * 1001, 1).is_valid
    assert reason(spark, "other", s, "x" * 10, 1).reason == validate.UNSUPPORTED + "other"


def test_tokens_and_questions(spark):
    s = "text string, tokens array<string>, tags array<string>"
    assert reason(spark, "ner", s, "t", ["t"], ["O"]).is_valid
    assert reason(spark, "ner", s, "t", ["t"], ["O", "O"]).reason == validate.UNEQUAL
    assert reason(spark, "token_classification", s, "t", [], []).reason == validate.MISSING["ner"]
    q = "context string, questions array<struct<question:string,answer:string>>"
    assert reason(spark, "question_answering", q, "c", [("what is it now", "yes")]).is_valid
    assert reason(spark, "question_answering", q, "c", [("what is it now", "yes"), ("what is it now", "null")]).reason == validate.FOUND_IN.format("คำตอบ", "null")
    assert reason(spark, "question_answering", q, "c", None).reason == validate.MISSING["question_answering"]


def test_class_balance(spark):
    labels = lambda *x: spark.createDataFrame([(v,) for v in x], "label string")
    r = metrics.class_balance(labels("a", "a", "b")).first()
    assert [round(v, 6) for v in r[1:]] == [0.918296, 0.444444, 0.5, 0.918296]
    one = metrics.class_balance(labels("a", "a")).first()
    assert one.entropy == 0 and one.balance_score == 1
    assert metrics.class_balance(labels()).first().entropy is None


def test_diversity_and_metrics(spark):
    texts = spark.createDataFrame([(t,) for t in ("The cat sat", "the cat", "The cat sat")], "text string")
    d = metrics.text_diversity(texts).first()
    assert (d.text_count, d.unique_text_count, d.vocabulary_size, d.total_words, d.length_min, d.length_max, d.length_median) == (3, 2, 4, 8, 7, 11, 11)
    assert round(d.length_std, 6) == 1.885618 and d.type_token_ratio == 0.5
    m = metrics.corpus_metrics(texts).first()
    assert (m.vocabulary_size, m.total_words, m.hapax_legomena) == (3, 8, 0) and round(m.std_sentence_length, 6) == 0.471405
    assert metrics.upper_median(spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "x int"), "x").first()[0] == 3
    assert metrics.corpus_metrics(texts.limit(0)).first().type_token_ratio is None


def test_summaries_and_coverage(spark):
    r = metrics.pair_quality(spark.createDataFrame([("a b c d", "a x")], "article string, summary string")).first()
    assert round(r.compression, 6) == 0.428571 and not r.is_substring and r.overlap == 0.5
    c = spark.createDataFrame([([(0, 3), (2, 5), (8, 12)],), ([],), (None,)], "e array<struct<start:int,end:int>>").select(metrics.entity_coverage(F.col("e"), F.lit(10))).collect()
    assert [x[0] for x in c] == [0.5, 0.0, 0.0]


def test_augmentation(spark):
    texts = {1: "a b c a b", 2: "", 3: "single", 4: "a a a b b b c c c d"}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.doc_id: r for r in df.select("doc_id", augment.delete_words("doc_id", "text", 0.5).alias("d"), augment.swap_words("doc_id", "text", 0.5).alias("s"), augment.insert_words("doc_id", "text", 0.5, SYN).alias("i"), augment.replace_synonyms("doc_id", "text", 0.5, SYN).alias("r")).collect()}
    syn = {"a": ["x", "y"], "b": ["z"]}
    for k, t in texts.items():
        w = t.split()
        kept = [x for i, x in enumerate(w) if u(k, "del", 0, i) >= 0.5]
        assert got[k].d == (" ".join(kept) if kept else (w[math.floor(u(k, "del", 0, "keep") * len(w))] if w else ""))
        s = w.copy()
        for i in range(len(w) - 1):
            if u(k, "swap", 0, i) < 0.5:
                j = math.floor(u(k, "swap", 0, i, "to") * len(w))
                s[i], s[j] = s[j], s[i]
        assert got[k].s == " ".join(s) and Counter(s) == Counter(w)
        grown = w.copy()
        for i in range(len(w)):
            own = syn.get(w[math.floor(u(k, "ins", 0, i, "word") * len(w))])
            if u(k, "ins", 0, i) < 0.5 and own:
                grown.insert(i, own[math.floor(u(k, "ins", 0, i, "pick") * len(own))])
        assert got[k].i == " ".join(grown)
        assert got[k].r == " ".join(syn[x][math.floor(u(k, "syn", 0, i, "pick") * len(syn[x]))] if u(k, "syn", 0, i) < 0.5 and x in syn else x for i, x in enumerate(w))
    every = df.select(augment.insert_words("doc_id", F.lit("a a a"), 1.0, {"a": ["X"]})).first()[0]
    assert every == "X X X a a a"


def test_augment_is_the_same_on_any_partitioning(spark):
    df = spark.createDataFrame([(i, "a b c d e f g") for i in range(20)], "doc_id int, text string")
    one, many = (sorted(map(tuple, augment.augment(df.repartition(n), SYN).collect())) for n in (1, 7))
    assert one == many and max(Counter(k for k, _ in one).values()) <= 4


def test_params():
    assert augment.AugmentParams().with_(max_augmentations=9).max_augmentations == 9
    for bad in ({"synonym_replace_prob": 1.5}, {"max_augmentations": 0}, {"nothing": 1}):
        with pytest.raises(ValueError):
            augment.AugmentParams().with_(**bad)
    assert augment.AugmentParams.info()["max_augmentations"]["max"] == 100


def test_near_duplicates_equal_brute_force(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda omicron"
    texts = {1: base, 2: base + " sigma", 3: "other words entirely here now", 4: base.upper(), 5: "", 6: "x", 7: None, 8: base.replace("alpha", "álpha")}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    rows = {(r.i, r.j): r for r in similarity.near_duplicates(df).collect()}
    assert rows[(1, 1)].n_pairs == 3 and (1, 2) in rows and rows[(1, 2)].n_pairs == 3
    got = similarity.redundancy(df).first()
    assert got.near_duplicate_pairs == 6 and round(got.redundancy_rate, 6) == round(6 / 28, 6)
    assert similarity.redundancy(df.limit(1)).first().redundancy_rate == 0.0


def test_near_duplicates_of_many_blocks_equal_brute_force(spark, monkeypatch):
    """Blocks of a few texts, frequencies of a few terms sent to the tasks, parts of a few pairs: the same pairs."""
    import math
    import random
    from collections import Counter

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(2, 4) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    texts += [" ".join(w for w in t.split() if rng.random() > 0.05) for t in texts] + texts[:5]
    monkeypatch.setattr(similarity, "BLOCK", 150)
    monkeypatch.setattr(similarity, "FREQUENT", 7)
    monkeypatch.setattr(similarity, "CELLS", 50)
    got = {(r.i, r.j): (round(r.similarity, 6), r.n_pairs) for r in similarity.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    bags = {}
    for k, t in enumerate(texts):
        if t:
            bags.setdefault(tuple(sorted(t.split())), []).append(k)
    df = Counter(w for bag, ks in bags.items() for w in set(bag) for _ in ks)
    vectors = {}
    for bag, ks in bags.items():
        w = {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in Counter(bag).items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        vectors[ks[0], len(ks)] = {t: x / size for t, x in w.items()}
    want = {(i, i): (1.0, m * (m - 1) // 2) for i, m in vectors if m > 1}
    for (i, m), a in vectors.items():
        for (j, n), b in vectors.items():
            if i < j and (s := sum(x * b.get(t, 0.0) for t, x in a.items())) > similarity.THRESHOLD:
                want[i, j] = (round(s, 6), m * n)
    assert got == want and sum(i < j for i, j in want) > 20 and similarity.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_are_built_once_a_task_and_pairs_equal_brute_force(monkeypatch):
    """A task that meets three blocks in six pairs builds three; few slots and meetings at a time give the same pairs."""
    import math
    import random
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    bags = [[rng.randint(1, 60) for _ in range(rng.randint(3, 30))] for _ in range(60)]
    bags += [b[: len(b) - len(b) // 12] + [rng.randint(100, 999)] * rng.randint(0, 1) for b in bags]
    bags = [list(b) for b in sorted({tuple(sorted(b)) for b in bags})]
    df = Counter(t for b in bags for t in set(b))
    packed = []
    for k in range(3):
        mine = [i for i in range(len(bags)) if i % 3 == k]
        rows = [(i, 0, bags[i]) for i in mine] + [(i, 1, []) for i in mine]
        columns = [pa.array([k] * len(rows), pa.int32()), *(pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()))))]
        frequent = np.array(sorted(df)), np.array([df[t] for t in sorted(df)])
        packed += similarity._packed(frequent)([pa.RecordBatch.from_arrays(columns, names=["block", "id", "m", "terms"])])
    built = []
    init = similarity.Block.__init__
    monkeypatch.setattr(similarity.Block, "__init__", lambda self, *a: (built.append(1), init(self, *a))[1])
    monkeypatch.setattr(similarity, "CELLS", 50)
    monkeypatch.setattr(similarity, "SLOT", 3, raising=False)
    pairs = [pa.RecordBatch.from_arrays(packed[x].columns + packed[y].columns, names=[f"{c}_{s}" for s in "ab" for c in packed[0].schema.names]) for x in range(3) for y in range(x, 3)]
    got = {(r["i"], r["j"]): round(r["similarity"], 9) for b in similarity._compared(len(bags), 0.9, pa.int64())(pairs) for r in b.to_pylist()}
    vectors = [{t: n * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t, n in Counter(b).items()} for b in bags]
    size = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    product = {(i, j): sum(x * b.get(t, 0.0) for t, x in a.items()) / size[i] / size[j] for i, a in enumerate(vectors) for j, b in enumerate(vectors) if i < j}
    assert got == {k: round(x, 9) for k, x in product.items() if x > 0.9} and len(got) > 30
    assert len(built) == 3


def test_pairs_of_blocks_come_one_a_batch(spark, monkeypatch):
    """Two pairs of blocks in a batch are twice the memory; the session's own setting is back afterwards."""
    name, seen, store = "spark.sql.execution.arrow.maxBytesPerBatch", [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, *a: (seen.append(spark.conf.get(name, None)), store(df, *a))[1])
    before = spark.conf.get(name, None)
    similarity.near_duplicates(spark.createDataFrame([(1, "one two"), (2, "two one")], "doc_id long, text string"))
    assert seen[-1] == "1" and "1" not in seen[:-1] and spark.conf.get(name, None) == before


def test_graph(spark):
    answers = {"root": "is_a: thing\npart_of: whole", "thing": "is_a: root\nrelated_to: far", "far": "is_a: deeper"}

    def answer(frontier):
        told = spark.createDataFrame(list(answers.items()), "concept string, response string")
        return frontier.join(told, "concept")

    nodes, edges = graph.expand(*graph.empty_graph(spark), spark.createDataFrame([("root",)], "concept string"), answer, 2)
    assert {r.concept: r.depth for r in nodes.collect()} == {"root": 0, "thing": 1, "whole": 1, "far": 2}
    assert {tuple(r) for r in edges.collect()} == {("root", "thing", "is_a"), ("root", "whole", "part_of"), ("thing", "root", "is_a"), ("thing", "far", "related_to")}
    c = graph.coverage(nodes, edges).first()
    assert c.total_nodes == 4 and c.is_a == 2 and c.opposite_of == 0
    again = graph.from_json(graph.to_json(nodes, edges))
    assert again[0].count() == 4 and {tuple(r) for r in again[1].collect()} == {tuple(r) for r in edges.collect()}
