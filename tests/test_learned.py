"""What is learned from or looked up over a corpus, against brute force."""

from __future__ import annotations

import json
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silkloom.operators import entities, graph, segment, sentence_ends, spelling
from silkloom.sources import files

# Sentence ends.

PLAIN = ["He came and the dog ran.", "The cat sat and it rained.", "It was so and he saw it.", "The dog and the cat came.", "He ran and sat and saw.", "It came so he went.", "The end of it was so.", "They went so it ended."]
ABBREVIATED = ["Ask Dr. {} about it.", "We met Dr. {} and went.", "He saw Dr. {} and Mr. {} there.", "Mr. {} ran."]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    names = ["Smith", "Jones", "Brown", "Miller", "Adams", "Clark"]
    texts = []
    for _ in range(200):
        said = [rng.choice(PLAIN) for _ in range(4)] + [rng.choice(ABBREVIATED).format(rng.choice(names), rng.choice(names))]
        said.append(f"He paid 3.50 and {rng.choice('ABC')}. {rng.choice(names)} paid no. {rng.randint(1, 9)} then.")
        rng.shuffle(said)
        texts.append(" ".join(said))
    return sentence_ends.learn(spark.createDataFrame([(t,) for t in texts], "text string"))


def split(spark, model, *texts):
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, pos int")
    got = sentence_ends.learned_sentences(rows, model=model, least=1).orderBy("doc_id", "pos").collect()
    return [[r.sentence for r in got if r.doc_id == i] for i in range(len(texts))]


def test_abbreviations(model):
    found = {r.type for r in model.abbreviations.collect()}
    assert {"dr", "mr"} <= found and not found & {"it", "so", "ran", "came"}


def test_learned_sentences(spark, model):
    got = split(
        spark, model, "I met Dr. Smith today. He was well.", "It cost 3.50 for J. Smith. The dog ran.", "So it was... and then more. Really?! Yes.", 'The dog said "so." Then it left. (It did.) He ran.', "no end here", "", None, "  \n ", "One.\n\nTwo.\tThree.",
        "In the end we took no. 7 and the dog.", "He had cats, dogs etc. The end.",
    )
    assert got[0] == ["I met Dr. Smith today.", "He was well."]
    assert got[1] == ["It cost 3.50 for J. Smith.", "The dog ran."]
    assert got[2] == ["So it was... and then more.", "Really?!", "Yes."]
    assert got[3] == ['The dog said "so."', "Then it left.", "(It did.)", "He ran."]
    assert got[4:8] == [["no end here"], [], [], []]
    assert got[8] == ["One.", "Two.", "Three."] and got[9] == ["In the end we took no. 7 and the dog."]


def test_learned_sentences_keep_rows_apart(spark, model):
    rows = [(1, "Ask Dr. Smith. He ran."), (1, "Ask Dr. Smith. He ran."), (1, "Mr. Jones sat. He ran. So."), (None, "Ask Dr. Smith. He ran.")]
    got = sentence_ends.learned_sentences(spark.createDataFrame(rows, "doc_id long, text string"), model=model, least=1)
    want = [(1, 0, "Ask Dr. Smith."), (1, 1, "He ran.")] * 2 + [(1, 0, "Mr. Jones sat."), (1, 1, "He ran."), (1, 2, "So."), (None, 0, "Ask Dr. Smith."), (None, 1, "He ran.")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sentence_ends.learned_sentences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_types_are_worked_out_once_a_word(spark, monkeypatch):
    """No filter on types moves below the count of words, where it would be worked out at every place."""
    plans, kept = [], sentence_ends.stored

    def stored(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df)

    monkeypatch.setattr(sentence_ends, "stored", stored)
    model = sentence_ends.learn(spark.createDataFrame([("Ask Dr. Smith. He ran.",), ("- He ran.",)], "text string"))
    assert model.starters.where("type = ''").count() == 0
    counted = next(p for p in plans if "inner_upper" in p and "explode" in p)
    every = [line for line in counted.splitlines() if "Filter" in line]
    assert every and not any("lower(" in line for line in every), every


# Spelling.


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(rng, word, n, letters):
    w = list(word)
    for _ in range(n):
        at = rng.randrange(len(w) + 1)
        kind = rng.choice("ids")
        if kind == "i":
            w.insert(at, rng.choice(letters))
        elif w:
            at = min(at, len(w) - 1)
            w[at : at + 1] = [] if kind == "d" else [rng.choice(letters)]
    return "".join(w)


@pytest.mark.parametrize(("letters", "sizes"), [("ab", (1, 9)), ("abcdé", (6, 11)), ("abc", (17, 27))])
def test_lookup_finds_every_pair(spark, letters, sizes):
    rng = random.Random(sizes[0])
    known = ["".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(60)]
    asked = [edited(rng, rng.choice(known), rng.randint(0, 4), letters) for _ in range(150)] + ["", None, "ab", "b"]
    words = spark.createDataFrame([(w, "clash") for w in asked], "word string, errors string")
    listed = spark.createDataFrame([(w, 1) for w in [*known, "", None]], "known string, key int")
    got = sorted(map(tuple, spelling.lookup(words, listed).collect()))
    allowed = lambda w: 0 if len(w) < 3 else 1 if len(w) < 8 else 2
    want = sorted((a, k, distance(a, k)) for a in {a for a in asked if a} for k in set(known) if distance(a, k) <= allowed(a))
    assert got == want and len(want) > 20


def test_no_suggestions_from_nothing(spark):
    assert spelling.suggest(spark.createDataFrame([(None,), ("",)], "text string")).count() == 0


# Entities.


@pytest.mark.parametrize("whole", [True, False])
def test_entities(spark, whole):
    rng = random.Random(2)
    names = [("ab", "x"), ("a", "y"), ("ab", "z"), ("b a", "x"), ("ไทย", "place"), ("!", None), ("", "none"), (None, "none")]
    texts = ["".join(rng.choice("ab !cไทย") for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "a" * 3000]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, entities string").repartition(3)
    table = spark.createDataFrame(names, "name string, type string")
    word = lambda c: c.isalnum() or c == "_"
    for r in entities.find_entities(rows, table, whole_words=whole).collect():
        t = texts[r.doc_id] or ""
        want = set()
        for name, kind in names:
            for s in range(len(t)) if name else ():
                e = s + len(name)
                inside = (s and word(t[s]) and word(t[s - 1])) or (e < len(t) and word(t[e - 1]) and word(t[e]))
                if t.startswith(name, s) and not (whole and inside):
                    want.add((s, e, kind))
        assert len(r.entities) == len(want) and {tuple(x) for x in r.entities} == want
        covered = {i for s, e, _ in want for i in range(s, e)}
        assert r.coverage == pytest.approx(len(covered) / len(t) if t else 0)


def test_names_are_bounded(spark):
    with pytest.raises(ValueError):
        entities.collected(spark.range(20).select(F.col("id").cast("string").alias("name")), "name", most=10)
    found = entities.find_entities(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "name string, type string"))
    assert [tuple(r) for r in found.collect()] == [(1, [], 0.0)]


# Words without spaces.


def ways(run, words):
    """Every way to cut a run into dictionary words and single clusters, at cluster borders."""
    cluster = "(?s)(?:[@-@][^#@-@]|.)[#]*".replace("@-@", f"{chr(0xE40)}-{chr(0xE44)}").replace("#", "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xE30, 0xE3A), (0xE45, 0xE45), (0xE47, 0xE4E), (0x300, 0x36F))))
    borders = {m.start() for m in re.finditer(cluster, run)} | {len(run)}
    steps = {m.start(): m.end() for m in re.finditer(cluster, run)}

    def go(i):
        if i == len(run):
            yield ()
            return
        for e in range(i + 1, len(run) + 1):
            if run[i:e] in words and e in borders:
                for rest in go(e):
                    yield ((run[i:e], True), *rest)
        for rest in go(steps[i]):
            yield ((run[i : steps[i]], False), *rest)

    return go(0)


def best_way(run, words):
    key = lambda way: (sum(len(w) for w, k in way if not k), sum(k for _, k in way), [(-len(w) if k else 0) for w, k in way])
    out = []
    for w, known in min(ways(run, words), key=key):
        same = out and not known and not out[-1][1] and (0xE00 <= ord(out[-1][0][0]) < 0xE80) == (0xE00 <= ord(w[0]) < 0xE80)
        if same:
            out[-1] = (out[-1][0] + w, False)
        else:
            out.append((w, known))
    return out


@pytest.mark.parametrize("letters", ["abc", "กเา่ขa"])
def test_segments_equal_brute_force(letters):
    rng = random.Random(3)
    for _ in range(150):
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 9))}
        s = segment.Segmenter([*words, "", "a b"])
        for _ in range(8):
            run = "".join(rng.choice(letters) for _ in range(rng.randint(1, 10)))
            assert s.words(run) == best_way(run, words), (run, words)


def test_segmenter_by_the_model_equals_the_lattice_and_is_faster():
    rng = random.Random(5)
    for _ in range(300):
        words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12))]
        s = segment.Segmenter(words)
        for _ in range(20):
            run = "".join(rng.choice("abcéx😀") for _ in range(rng.randint(1, 40)))
            assert s.run(run) == s.lattice(run)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    s, run = segment.Segmenter(words), "".join(rng.choice(words) for _ in range(20_000))
    took = []
    for split in (s.run, s.lattice):
        split(run[:100])
        began = time.process_time()
        took.append((split(run), time.process_time() - began))
    assert took[0][0] == took[1][0] and took[0][1] < 0.6 * took[1][1]


def test_a_dictionary_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(50).select(F.concat(F.lit("w"), F.col("id")).alias("word")).mapInArrow(noted, "word string")
    assert sorted(entities.collected(rows, "word")) == sorted((f"w{i}",) for i in range(50)) and seen.value == 50
    with pytest.raises(ValueError):
        entities.collected(rows, "word", most=49)


def test_documents_without_blanks(spark):
    """Texts of a dictionary's words, blanks taken out, row by row."""
    rng = random.Random(5)
    words = ["the", "them", "me", "eat", "at", "hem", "tea", "ate", "a"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 5))) + rng.choice(["", " ", "\n"]) + rng.choice(["", "at"]) for _ in range(60)] + [None, ""]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, words int").repartition(3)
    table = spark.createDataFrame([(w,) for w in [*words, None]], "word string")
    for r in segment.segment(rows, table).collect():
        want = [x for run in (texts[r.doc_id] or "").split() for x in best_way(run, set(words))]
        assert (r.words, r.unknown) == ([w for w, _ in want], sum(not k for _, k in want))


def test_thai_words(spark):
    words = ["ไป", "โรงเรียน", "โรง", "เรียน", "ตา", "ตาก", "กลม", "ลม", "ที่", "บ้าน", "มาก", "ๆ"]
    texts = ["ไปโรงเรียน", "ตากลม", "อยู่ที่บ้าน", "ดีSparkมาก", "ไปโรงเรียน มากๆ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = segment.segment(rows, spark.createDataFrame([(w,) for w in words], "word string"))
    table = {r.doc_id: r for r in got.withColumns({"fixed": segment.fix_common_errors("words"), "tones": segment.tonal_metrics("words")}).collect()}
    assert table[0].words == ["ไป", "โรงเรียน"] and table[1].words == ["ตาก", "ลม"]
    assert table[2].words == ["อยู่", "ที่", "บ้าน"] and table[2].unknown == 1
    assert table[3].words == ["ดี", "Spark", "มาก"] and table[3].fixed == "ดี Spark มาก"
    assert table[4].fixed == "ไป โรงเรียน มากๆ" and table[2].tones.no_tone_words == 0


# Graphs.


def test_reach(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", "is_a") for _ in range(90)] + [("hub", f"n{i}", "is_a") for i in range(30)] + [("x", None, ""), (None, "x", "")]
    seeds = ["hub", "n3", "alone", None, "hub"]
    frame = spark.createDataFrame(edges, "source string, target string, type string")
    for depth in (0, 1, 3, 9):
        want, last = {s: 0 for s in seeds if s}, {s for s in seeds if s}
        for d in range(1, depth + 1):
            last = {b for a, b, _ in edges if a in last and b} - want.keys()
            want |= {n: d for n in last}
        got = graph.reach(frame, spark.createDataFrame([(s, 1) for s in seeds], "concept string, depth int"), depth).collect()
        assert len(got) == len(want) and {r.concept: r.depth for r in got} == want


# Records.


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_records_however_the_file_is_split(spark, tmp_path, end):
    rng = random.Random(8)
    blocks = [[f"w{i} {rng.choice(['A', 'é ไ'])}{j}" for j in range(rng.randint(1, 6))] for i in range(400)]
    gaps = [end * 2, end * 3, end + "  " + end, end + "\t" + end * 3]
    data = end + "".join(end.join(("  " if rng.random() < 0.1 else "") + line for line in b) + rng.choice(gaps) for b in blocks)
    (tmp_path / "a.conll").write_bytes(data.encode())
    want = sorted("\n".join(b) for b in blocks)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size, least in [("128m", 1), ("997", 5), ("211", 20)]:
            spark.conf.set(name, size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            read = files.load_text(spark, str(tmp_path / "a.conll"), "conll")
            assert read.rdd.getNumPartitions() >= least
            assert sorted(r.text for r in read.collect()) == want
            plain = sorted(r.text for r in files.load_text(spark, str(tmp_path / "a.conll")).collect())
            assert plain == sorted(line for b in blocks for line in b)
    finally:
        spark.conf.set(name, before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_formats_of_a_caller(spark, tmp_path):
    files.register("semicolons", files.TextFormat(lambda c: F.filter(F.split(c, ";"), lambda x: F.trim(x) != "")))
    try:
        (tmp_path / "a.txt").write_text("a;b\nc; ;d")
        assert sorted(r.text for r in files.load_text(spark, str(tmp_path / "a.txt"), "semicolons").collect()) == ["a", "b\nc", "d"]
    finally:
        del files.FORMATS["semicolons"]
    (tmp_path / "empty.conll").write_text("")
    assert files.load_text(spark, str(tmp_path / "empty.conll"), "conll").count() == 0


def nested(rng, depth=0):
    kind = rng.choice("snbdal") if depth < 3 else rng.choice("snb")
    if kind == "s":
        return "".join(rng.choice('ab,[]{}"\\é\n: ไ') for _ in range(rng.randint(0, 12)))
    if kind == "n":
        return rng.randint(-9, 10**6)
    if kind == "b":
        return rng.choice([True, False])
    if kind == "d":
        return {f"k{i},": nested(rng, depth + 1) for i in range(rng.randint(0, 3))}
    return [nested(rng, depth + 1) for _ in range(rng.randint(0, 3))]


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_over_many_splits(spark, tmp_path, indent):
    rng = random.Random(11)
    files_of = {"a.json": [nested(rng) for _ in range(300)], "b.json": [], "c.json": ["x" * 3000, [["y," * 500]], 7]}
    for name, items in files_of.items():
        (tmp_path / name).write_text(" \n" * (name == "a.json") + json.dumps(items, indent=indent, ensure_ascii=name == "c.json") + "\n", encoding="utf-8")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    want = sorted(json.dumps(i, sort_keys=True) for items in files_of.values() for i in items)
    try:
        for size in ("128m", "501", "97"):
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], "0")
            got = [r.c for r in files.read_items(spark, str(tmp_path)).collect()]
            assert sorted(json.dumps(json.loads(c), sort_keys=True) for c in got) == want
        texts = sorted(r.text for r in files.load_text(spark, str(tmp_path / "c.json"), "array").collect())
        assert texts == sorted(["x" * 3000, json.dumps([["y," * 500]]), "7"])
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


# Neighbours.


def test_neighbours(spark):
    import math
    from collections import Counter, defaultdict

    from silkloom.operators import augment, neighbours

    rng = random.Random(13)
    animals, colours = ["dog", "cat", "horse"], ["red", "blue", "green"]
    texts = [f"The {rng.choice(colours)} {rng.choice(animals)} eats {rng.choice(['grass', 'bread'])}, then a {rng.choice(animals)} sleeps." for _ in range(200)] + ["", None, "dog"]
    got = neighbours.neighbours(spark.createDataFrame([(t,) for t in texts], "text string"), size=12, window=2, shift=1.2, top=3)
    words = [[w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()] for t in texts]
    kept = {w for w, _ in sorted(Counter(w for t in words for w in t).items(), key=lambda x: (-x[1], x[0]))[:12]}
    n = Counter()
    for t in words:
        for i in range(len(t)):
            for j in range(i + 1, min(i + 3, len(t))):
                if t[i] in kept and t[j] in kept:
                    n[t[i], t[j]] += 1
                    n[t[j], t[i]] += 1
    of = Counter()
    for (a, _), k in n.items():
        of[a] += k
    x = defaultdict(dict)
    for (a, b), k in n.items():
        v = math.log(k * sum(n.values()) / (of[a] * of[b])) - math.log(1.2)
        if v > 0:
            x[a][b] = v
    size = {a: math.sqrt(sum(v * v for v in e.values())) for a, e in x.items()}
    want = []
    for a in x:
        found = sorted((-round(sum(v * x[b].get(c, 0) for c, v in x[a].items()) / size[a] / size[b], 6), b) for b in x if b != a)
        want += [(a, k, b, -s) for k, (s, b) in enumerate([f for f in found if -f[0] > 0.2][:3], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    table = neighbours.as_synonyms(got)
    assert {"cat", "horse"} <= set(table["dog"])
    text = spark.createDataFrame([(1, "a dog sleeps")], "doc_id long, text string").select(augment.replace_synonyms("doc_id", "text", 1.0, table)).first()[0]
    assert text != "a dog sleeps" and len(text.split()) == 3
    assert neighbours.neighbours(spark.createDataFrame([], "text string")).count() == 0


def by_lines(rows):
    """(path, start, edge, unit) of lines, line by line."""
    cutter, out = files._Cutter("\n"), []
    for path, start, line in rows:
        cutter.at(path, start)
        if line.strip():
            cutter.pieces.append(line)
        else:
            cutter.end()
    cutter.close()
    return cutter.found


def cut(rows, size):
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), (pa.string(), pa.int64(), pa.string()))], names=["path", "start", "value"]) for i in range(0, len(rows), size)]
    return [[tuple(r.values()) for b in files._cut_at_blanks(inner)(iter(batches)) for r in b.to_pylist()] for inner in (True, False)]


def test_blocks_are_cut_as_line_by_line_and_faster():
    rng = random.Random(3)
    for _ in range(300):
        rows, at = [], [("a", 0)]
        for _ in range(rng.randint(1, 40)):
            if rng.random() < 0.15:
                at.append(rng.choice([("a", len(at)), ("b", at[-1][1])]))
            rows.append((*at[-1], rng.choice(["", " ", "\t", "\x1c", "\u3000", "\u00e9", "\u4e00 x", " a", "b T1", "c"])))
        want, (inner, edges) = by_lines(rows), cut(rows, rng.randint(1, 9))
        assert inner == [w for w in want if not w[2]] and edges == [w for w in want if w[2]]
    rows = [("f", 0, f"word{i} T{i % 5}" if i % 150 else "") for i in range(60_000)]
    batches = [pa.RecordBatch.from_pylist([{"path": p, "start": s, "value": v} for p, s, v in rows[i : i + 10_000]]) for i in range(0, len(rows), 10_000)]
    began = time.process_time()
    n = sum(b.num_rows for b in files._cut_at_blanks(True)(iter(batches)))
    took = time.process_time() - began
    began = time.process_time()
    read = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("path", "start", "value")))]
    want = len([w for w in by_lines(read) if not w[2]])
    assert n == want and took < 0.6 * (time.process_time() - began)


def test_conll_lines_are_stripped_as_one_by_one(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "b", " ", "\t", "\n", "\n", "\r", "\r\n", "\u00a0", "\u2028", "\x1c", "\x0b"]) for _ in range(rng.randint(0, 30))) for _ in range(500)] + ["", " ", None]
    white = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", files.conll_blocks(F.col("t")).alias("b")).collect()
    for r in rows:
        lines = "\n".join(x.strip(white) for x in re.split("\r\n|\r|\n", texts[r.i])) if texts[r.i] is not None else None
        assert r.b == (None if lines is None else [b.strip(white) for b in re.split("\n{2,}", lines) if b.strip(white)]), texts[r.i]
