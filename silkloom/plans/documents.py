"""Whole documents: cleaning, sections, sentences, chunks and measures in one projection; corpus reports; term coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkloom.functions import text as txt
from silkloom.functions import thai
from silkloom.functions.responses import critic_prompt, generator_prompt
from silkloom.operators import metrics, similarity, validate
from silkloom.services import ask


def process_text(docs: DataFrame, text: str = "text", thai_text: bool = False, size: int = 1000, overlap: int = 100) -> DataFrame:
    """docs with clean_text, sections, sentences, chunks, stats and, for Thai, thai_metrics.

    Sections come from the uncleaned text, as cleaning removes the line ends they need; Thai measures too, as cleaning
    removes vowel and tone marks.
    """
    out = docs.withColumns({"clean_text": txt.clean_text(text), "sections": txt.sections(text), "__cleaning": txt.clean_stats(text)})
    out = out.withColumns({"sentences": txt.sentences("clean_text"), "chunks": txt.chunks("clean_text", size, overlap)})
    count = lambda c: F.size(c).cast("long")
    stats = F.struct(txt.word_count("clean_text").alias("word_count"), count("sentences").alias("sentence_count"), count("chunks").alias("chunk_count"), F.col("__cleaning").alias("cleaning_stats"))
    out = out.withColumn("stats", stats).drop("__cleaning")
    if thai_text:
        out = out.withColumn("thai_metrics", F.struct(thai.tonal_metrics(text).alias("tonal"), thai.formality(text).alias("formality"), thai.orthography(text).alias("orthography")))
    return out


def validate_sentences(processed: DataFrame, client: Callable[[str], str | None], key: str = "doc_id") -> DataFrame:
    """key, pos, sentence and the two scores of every sentence, by a generator and a critic question."""
    rows = processed.select(key, F.posexplode("sentences").alias("pos", "sentence"))
    one = ask(rows.withColumn("prompt", generator_prompt("sentence", "sentence validation")), client).withColumnRenamed("response", "generator_response").drop("prompt", "error")
    two = ask(one.withColumn("prompt", critic_prompt("sentence", "sentence validation")), client).withColumnRenamed("response", "critic_response").drop("prompt", "error")
    return validate.dual_validation(two)


def analyze(texts: DataFrame, key: str = "doc_id", text: str = "text", stopwords: tuple[str, ...] = similarity.ENGLISH) -> DataFrame:
    """All corpus metrics with near_duplicate_pairs and redundancy_rate in one row."""
    return metrics.corpus_metrics(texts, text).crossJoin(similarity.redundancy(texts, key, text, stopwords=stopwords))  # one row each
