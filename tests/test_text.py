"""Text columns against plain Python on hand-made and generated texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from silkloom.functions import text as txt
from silkloom.functions import thai

TEXTS = ["See http://x.y/z,  now: ok!", "", " ", "a b　c\x1cd", "www.a.b www", "ค่า น้ำ", "x" * 25, "aaaa bbbb cccc dddd", "ab ab ab abcdefghijkl m", "A. B! Long sentence one here. Another\nsentence? no"]


def rows(spark, *columns):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    return [r[1:] for r in sorted(df.select("i", *columns).collect())]


def python_clean(t):
    t = re.sub(r"http\S+|www\S+", "", t)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s.!?]", " ", t)).strip()


def test_tokens_are_python_split(spark):
    assert [r[0] for r in rows(spark, txt.tokens("text"))] == [t.split() for t in TEXTS]


def test_clean_text(spark):
    assert [r[0] for r in rows(spark, txt.clean_text("text"))] == [python_clean(t) for t in TEXTS]


def test_clean_stats(spark):
    s = rows(spark, txt.clean_stats("text"))[0][0]
    assert (s.original_length, s.urls_removed, s.special_chars_removed, s.spaces_normalized, s.final_length) == (27, 1, 1, 3, 11)
    assert round(s.reduction_ratio, 6) == 0.592593
    assert rows(spark, txt.clean_stats("text"))[1][0].reduction_ratio is None


def python_chunks(text, size, overlap):
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            space = text.rfind(" ", start + 1, end + 1)
            end = space if space > start else end
        out.append(text[start:end].strip())
        if end >= len(text):
            return out
        start = end - overlap if end - overlap > start else end


def test_chunks(spark):
    for size, overlap in ((10, 2), (10, 9), (4, 0), (7, 3)):
        assert [r[0] for r in rows(spark, txt.chunks("text", size, overlap))] == [python_chunks(t, size, overlap) for t in TEXTS]
    assert python_chunks("aaaa bbbb cccc dddd", 10, 2) == ["aaaa bbbb", "bb cccc", "cc dddd"]


def test_sections(spark):
    paper = "Title\nAbstract\nWe do this.\nIntroduction \nIt began.\n2. Method\nSteps\n3. x\nResult\ngood\nConclusion\nDone.\nReferences\n[1]"
    s = spark.createDataFrame([(paper,), ("nothing",)], "text string").select(txt.sections("text").alias("s")).collect()
    assert s[0].s.abstract == "We do this." and s[0].s.introduction == "It began." and s[0].s.conclusion == "Done."
    assert s[1].s.abstract == "" and s[1].s.full_text == "nothing"


def test_html_text(spark):
    page = "<html><head><style>p{}</style></head><nav>menu</nav><p> a &amp; b </p><script>x</script><b>c</b></html>"
    assert spark.createDataFrame([(page,)], "h string").select(txt.html_text("h")).first()[0] == "a & bc"


def test_character_references(spark):
    from html import unescape

    texts = ["a &amp; b", "&lt;&#39;&#x27;&eacute;&hellip;&nbsp;x", "&amp;lt;", "& &; &x; &bogus; a&b", "&#8364;&#x1F600;&#3585;", "plain", "", "&NotEqualTilde; &fjlig;&AMP;", "&&amp;&"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", txt.unescape("t").alias("u"))
    assert all(r.u == unescape(r.t) for r in df.collect())
    odd = "&#0;&#xD800;&#1114112;&#9999999;"
    assert spark.createDataFrame([(odd,)], "t string").select(txt.unescape("t")).first()[0] == odd


def test_thai(spark):
    df = spark.createDataFrame([("ดี ๆ ใช้Sparkดี !",)], "text string")
    assert df.select(thai.fix_common_errors("text")).first()[0] == "ดีๆ ใช้ Spark ดี!"
    one = lambda t, c: spark.createDataFrame([(t,)], "text string").select(c).first()[0]
    assert one("ก่อน​ ๑๒ ทำ", thai.fix_unicode("text")) == "ก่อน 12 ทะะ"
    tones = one("ค่า น้ำ ตา", thai.tonal_metrics("text"))
    assert (tones.tone_1, tones.tone_2, tones.no_tone_words) == (1, 1, 1) and round(tones.tonal_complexity_score, 6) == 1.333333
    assert len(one("ก่้๊ข", thai.orthography("text")).double_tone_instances) == 2
    assert one("คุณ ครับ ดี มาก", thai.formality("text")).formality_score == 0.5
    assert one(None, thai.clean_thai("text")) == ""
    assert one("ดี มาก ok", thai.clean_thai("text", ["มาก"])) == "ดี ok"


def test_uniform(spark):
    assert spark.range(1).select(txt.uniform(F.lit(7), F.lit("del"), F.lit(0), F.lit(3))).first()[0] == 0.7051996695809066


def plain_chunks(t, size, overlap):
    if len(t) <= size:
        return [t]
    out, start = [], 0
    while True:
        end = min(start + size, len(t))
        if end < len(t):
            space = t.rfind(" ", start + 1, start + size + 1)
            end = space if space > start else end
        out.append(t[start:end].strip())
        if end >= len(t):
            return out
        start = end - overlap if end - overlap > start else end


def test_chunks_of_long_words_and_control_characters(spark):
    import random

    rng = random.Random(3)
    texts = ["x" * 25, "a " * 30 + "y" * 90 + " b" * 30, "z" * 5000]
    texts += [" ".join("w" * rng.choice([1, 2, 5, 9, 10, 11, 12, 40]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for size, overlap in ((10, 2), (10, 9), (12, 5)):
        got = {r.i: list(r.c) for r in df.select("i", txt.chunks("t", size, overlap).alias("c")).collect()}
        assert got == {i: plain_chunks(t, size, overlap) for i, t in enumerate(texts)}
    one = spark.createDataFrame([("a text with \x01 in it. And one more!",)], "t string")
    assert one.select(txt.sentences("t")).first()[0] == ["a text with \x01 in it.", "And one more!"]


def test_tones_are_counted_without_lists_of_words(spark):
    from silkloom.functions import thai

    texts = ["", " ", "\u0e48", "a\u0e48b\u0e49\u0e49 c\u3000d\u0e4b\n e ", "ab", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", thai.tonal_metrics("text").alias("s"))
    for r in df.collect():
        words = (texts[r.id] or "").split()
        if texts[r.id] is not None:
            assert [r.s[f"tone_{i}"] for i in range(1, 5)] == [texts[r.id].count(t) for t in thai.TONES]
            assert r.s.no_tone_words == sum(not any(t in w for t in thai.TONES) for w in words)
        assert r.s.tonal_complexity_score == (4 / len(words) if words else 0.0)
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
