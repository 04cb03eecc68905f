"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from silkloom.llm import (
    bpe_codec, centroid_clusters, conversation_repair, embedding_dedup, html_extract, image_copies, language_id, license_scan, sentencepiece_codec, simhash, source_mix,
    substring_dedup, token_counts,
)

PIECES, MERGES = "piece_bpe_32k.model", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_copies.image_groups(image_copies.gallery(table(spark, sf_dir, "embeddings")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digests(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("hits")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(MERGES))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


#: Every pair of vectors compared, and components by spreading the smallest id along links until nothing changes.
LINKED = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(embedding::double[], embedding::double[]) > 0),
l as (select a.vec_id as i, b.vec_id as j from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
c as (select vec_id, vec_id as part from embeddings union select l.j, c.part from c join l on c.vec_id = l.i),
p as (select vec_id, min(part) as component_id from c group by vec_id)
select vec_id, (select count(*) from l where i = vec_id)::bigint as n_links, component_id, vec_id = component_id as kept from p"""

#: Every window listed and ranked by its place.
REPEATED = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
k as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from w where len(w) >= 20)),
r as (select doc_id, s, row_number() over (partition by k order by doc_id, s) as n from k),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as pos from r where n > 1),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from w),
kept as (select words.doc_id, count(gone.pos) as n_removed, string_agg(word, ' ' order by words.pos) filter (gone.pos is null) as kept from words left join gone on words.doc_id = gone.doc_id and words.pos = gone.pos group by words.doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept on w.doc_id = kept.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_image_copies, op2_simhash, op3_source_mix, op4_embedding_dedup, op5_token_counts, op6_language_id, op7_substring_dedup, op8_sentencepiece, op9_html_extract, op10_license_scan, op11_conversation_repair, op12_bpe, op13_centroid_clusters]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_source_mix": source_mix.oracle_sql(), "op4_embedding_dedup": LINKED, "op7_substring_dedup": REPEATED,
        "op11_conversation_repair": conversation_repair.oracle_sql(), "op13_centroid_clusters": centroid_clusters.oracle_sql(),
    }
