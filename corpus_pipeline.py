"""From raw documents to token ids, in five stages; each is written as Parquet and read again by the next.

1. language_id    drops documents without a letter and those whose two best languages are too close to call;
                  a missing lang is filled in.
2. simhash_dedup  keeps the document of smallest id of each group of near copies: links at a Jaccard similarity of
                  five-word shingles of 0.8 or more, found by SimHash fingerprints and checked exactly.
3. substring_dedup cuts passages of 20 words and more that also start earlier; documents left empty go.
4. source_mix     samples documents so that source, language and topic meet their target shares of tokens.
5. sentencepiece  encodes each text, decodes it again and returns ids and digests in place of the text.

The columns doc_id, text, lang, source and n_chars are read; all others are passed on, whatever their names, but for
those that the last stage makes (n_tokens, ids, decoded and their digests). Empty tables pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkloom import ship
from silkloom.llm import language_id, near_copies, sentencepiece_codec, source_mix, substring_dedup
from silkloom.llm.common import bounded_batches, materialise, scratch

MODEL = "piece_bpe_32k.model"
#: Lead over the second language below which a document is rejected.
LEAD = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs, ~F.coalesce(language_id.held_out(), F.lit(True)))
    said = docs.withColumn("__said", language_id.prediction(model, "text", LEAD))
    kept = said.where((F.col("__said.lang_pred") != language_id.UNKNOWN) & ~F.col("__said.ambiguous"))
    return kept.withColumn("lang", F.coalesce("lang", "__said.lang_pred")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(docs).where(F.col("text") != "")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(docs.select(*(F.col(c).alias(f"in_{c}") for c in docs.columns)), "in_doc_id", "in_text", dimensions={"source": "in_source", "lang": "in_lang"})
    return mixed.where("kept").select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = ("text", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    kept = tuple(c for c in docs.columns if c not in made)
    return sentencepiece_codec.encode_decode(docs, public_tokenizers.path(MODEL), keep=kept, payload=True)


def _stage(function: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with the package on the executors and Arrow batches of bounded size."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        bounded_batches(spark)
        return function(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", _stage(identify_language)),
    ("simhash_dedup", _stage(drop_near_copies)),
    ("substring_dedup", _stage(cut_repeats)),
    ("source_mix", _stage(mix_sources)),
    ("sentencepiece", _stage(encode)),
]

#: The language classifier, the covering tables and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for _, stage in STAGES:
        with scratch(spark) as keep:
            docs = materialise(stage(spark, docs, sf_dir), before)
            keep(docs)
        before = (docs,)
    return docs
