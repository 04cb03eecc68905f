"""Properties on generated rows: one Spark job a property, over many generated texts."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silkloom.functions import text as txt
from silkloom.operators import augment, metrics

CHARS = st.text(alphabet=st.sampled_from(list("ab Zé.!? \n\t ค่_1-​")), max_size=60)
FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


@FEW
@given(st.lists(CHARS, min_size=1, max_size=40), st.integers(2, 30), st.data())
def test_chunks_cover_and_end(spark, texts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    for r in frame(spark, texts).select("text", txt.chunks("text", size, overlap).alias("c")).collect():
        assert all(len(c) <= max(size, len(r.text) if len(r.text) <= size else 0) for c in r.c)
        left = r.text
        for word in "".join(left.split()):
            assert any(word in c for c in r.c)


@FEW
@given(st.lists(CHARS, min_size=1, max_size=40))
def test_cleaning_is_stable_and_counts_add_up(spark, texts):
    for r in frame(spark, texts).select(txt.clean_text("text").alias("c"), txt.clean_text(txt.clean_text("text")).alias("cc"), txt.clean_stats("text").alias("s")).collect():
        assert r.c == r.cc and len(r.c) == r.s.final_length <= r.s.original_length


@FEW
@given(st.lists(CHARS, min_size=1, max_size=40), st.sampled_from([0.0, 0.3, 1.0]))
def test_deletion_and_swap(spark, texts, p):
    df = frame(spark, texts).select("text", augment.delete_words("doc_id", "text", p).alias("d"), augment.swap_words("doc_id", "text", p).alias("s"))
    for r in df.collect():
        words = r.text.split()
        assert sorted(r.s.split()) == sorted(words) and bool(r.d) == bool(words)
        rest = iter(words)
        assert all(w in rest for w in r.d.split())


@FEW
@given(st.lists(st.tuples(st.integers(-2, 12), st.integers(-2, 12)), max_size=6), st.integers(0, 10))
def test_coverage_is_the_union(spark, spans, n):
    df = spark.createDataFrame([(spans, n)], "e array<struct<start:int,end:int>>, n int")
    got = df.select(metrics.entity_coverage(F.col("e"), F.col("n"))).first()[0]
    valid = [(s, e) for s, e in spans if 0 <= s < n and 0 < e <= n and s < e]
    assert got == (len({i for s, e in valid for i in range(s, e)}) / n if n else 0.0)
