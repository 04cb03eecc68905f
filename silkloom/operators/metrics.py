"""Metrics of a corpus or a labelled dataset. Each function returns a one-row DataFrame, or one row a class or bin.

Every aggregate is partial before its shuffle; words are counted by word, not collected. Ratios of nothing are null.
Deviations are those of the population.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silkloom.functions.text import tokens
from silkloom.functions.thai import STYLES, has_style



def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def words(texts: DataFrame, text: str = "text", lower: bool = True) -> DataFrame:
    """word, n: all words with their counts."""
    found = texts.select(F.explode(tokens(F.lower(text) if lower else F.col(text))).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n"))


def corpus_metrics(texts: DataFrame, text: str = "text") -> DataFrame:
    """vocabulary_size, total_words, type_token_ratio, hapax_legomena (lower-cased words), avg and std_sentence_length."""
    vocabulary = words(texts, text).agg(F.count("*").alias("vocabulary_size"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.count_if(F.col("n") == 1).alias("hapax_legomena"))
    n = F.size(tokens(text))
    lengths = texts.agg(F.avg(n).alias("avg_sentence_length"), F.stddev_pop(n).alias("std_sentence_length"))
    both = vocabulary.crossJoin(lengths)  # one row each
    return both.select("vocabulary_size", "total_words", _ratio(F.col("vocabulary_size"), F.col("total_words")).alias("type_token_ratio"), "hapax_legomena", "avg_sentence_length", "std_sentence_length")


def corpus_metadata(texts: DataFrame, text: str = "text") -> DataFrame:
    """n_samples, vocab_size (as written), avg_length in words."""
    vocabulary = words(texts, text, lower=False).agg(F.count("*").alias("vocab_size"), F.coalesce(F.sum("n"), F.lit(0)).alias("w"))
    n = texts.agg(F.count("*").alias("n_samples"))
    return n.crossJoin(vocabulary).select("n_samples", "vocab_size", _ratio(F.col("w"), F.col("n_samples")).alias("avg_length"))


def top_words(texts: DataFrame, text: str = "text", k: int | None = 20) -> DataFrame:
    """word, n: the k most frequent words, ties by the word; all of them for k = None."""
    found = words(texts, text)
    return found if k is None else found.orderBy(F.desc("n"), "word").limit(k)


def length_histogram(texts: DataFrame, text: str = "text", bins: int = 30) -> DataFrame:
    """bin, n: text lengths in words in equal bins from least to most, the last one closed; empty bins are absent."""
    lengths = texts.select(F.size(tokens(text)).alias("x")).groupBy("x").agg(F.count("*").alias("m"))
    span = lengths.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))), F.lit(bins - 1)))
    return lengths.crossJoin(span).groupBy(at.cast("int").alias("bin")).agg(F.sum("m").alias("n"))


def class_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n, frequency of every label that is not null."""
    counted = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return counted.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy()))


def class_deviation(rows: DataFrame, label: str = "label") -> DataFrame:
    """number_of_classes, max_class_deviation from equal shares, is_balanced (below 0.1)."""
    found = class_counts(rows, label).withColumn("k", F.count("*").over(Window.partitionBy()))
    most = F.max(F.abs(F.col("frequency") - 1 / F.col("k")))
    return found.agg(F.count("*").alias("number_of_classes"), most.alias("max_class_deviation"), (most < 0.1).alias("is_balanced"))


def class_balance(rows: DataFrame, label: str = "label") -> DataFrame:
    """entropy (bits), gini_impurity, min_max_ratio, balance_score (entropy over its most; 1 for one class)."""
    p = F.col("frequency")
    entropy = F.sum(-p * F.log2(p)) + 0.0
    k = F.count("*")
    return class_counts(rows, label).agg(
        k.alias("n_classes"), entropy.alias("entropy"), (1 - F.sum(p * p)).alias("gini_impurity"), (F.min(p) / F.max(p)).alias("min_max_ratio"),
        F.when(k > 1, entropy / F.log2(k.cast("double"))).when(k == 1, 1.0).alias("balance_score"),
    )


def upper_median(values: DataFrame, value: str) -> DataFrame:
    """median: the value at position n div 2 (from 0) of the sorted values. Counts by value are summed, so rows of equal
    values never meet in one task."""
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("m"))
    below = counted.withColumn("up_to", F.sum("m").over(Window.orderBy("x"))).withColumn("all", F.sum("m").over(Window.partitionBy()))
    return below.where(F.col("up_to") > F.floor(F.col("all") / 2)).agg(F.min("x").alias("median"))


def text_diversity(texts: DataFrame, text: str = "text") -> DataFrame:
    """text_count, unique_text_count, uniqueness_ratio, vocabulary_size (as written), total_words, type_token_ratio, and
    least, most, mean, upper median and deviation of the length in characters."""
    present = texts.where(F.col(text).isNotNull())
    distinct = present.groupBy(F.sha2(text, 256).alias("h")).agg(F.count("*").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("text_count"), F.count("*").alias("unique_text_count"))
    vocabulary = words(present, text, lower=False).agg(F.count("*").alias("vocabulary_size"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"))
    lengths = present.select(F.length(text).alias("len"))
    spread = lengths.agg(F.min("len").alias("length_min"), F.max("len").alias("length_max"), F.avg("len").alias("length_mean"), F.stddev_pop("len").alias("length_std"))
    median = upper_median(lengths, "len").withColumnRenamed("median", "length_median")
    row = distinct.crossJoin(vocabulary).crossJoin(spread).crossJoin(median)  # one row each
    ratios = {"uniqueness_ratio": ("unique_text_count", "text_count"), "type_token_ratio": ("vocabulary_size", "total_words")}
    return row.withColumns({c: _ratio(F.col(a), F.col(b)) for c, (a, b) in ratios.items()})


def pair_quality(pairs: DataFrame, article: str = "article", summary: str = "summary") -> DataFrame:
    """pairs with compression (0 for an empty article), is_substring, overlap of the lower-cased words."""
    a, s = F.array_distinct(tokens(F.lower(article))), F.array_distinct(tokens(F.lower(summary)))
    return pairs.withColumns({
        "compression": F.when(F.length(article) > 0, F.length(summary) / F.length(article)).otherwise(0.0),
        "is_substring": F.contains(F.col(article), F.col(summary)),
        "overlap": F.when(F.size(s) > 0, F.size(F.array_intersect(a, s)) / F.size(s)).otherwise(0.0),
    })


def summarization_quality(pairs: DataFrame, article: str = "article", summary: str = "summary") -> DataFrame:
    """pairs, mean, least and most of compression and overlap, substring_ratio."""
    measures = [f(c).alias(f"{c}_{n}") for c in ("compression", "overlap") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return pair_quality(pairs, article, summary).agg(F.count("*").alias("pairs"), *measures, F.avg(F.col("is_substring").cast("int")).alias("substring_ratio"))


def entity_coverage(entities: Column, length: Column) -> Column:
    """Share of a text of this length that the union of its valid spans covers; others and null bounds count as 0."""
    spans = F.transform(entities, lambda e: F.struct(F.coalesce(e["start"], F.lit(0)).alias("s"), F.coalesce(e["end"], F.lit(0)).alias("e")))
    valid = F.filter(spans, lambda x: (x["s"] >= 0) & (x["s"] < length) & (x["e"] > 0) & (x["e"] <= length) & (x["s"] < x["e"]))
    # Sorted spans, and how far the ones before reached: no position is listed.
    state = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    covered = F.aggregate(F.array_sort(valid), state, lambda t, x: F.struct(F.greatest(t["to"], x["e"]).alias("to"), (t["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(t["to"], x["s"]))).alias("n")), lambda t: t["n"])
    return F.coalesce(covered / F.when(length > 0, length), F.lit(0.0))


def coverage_summary(samples: DataFrame, entities: str = "entities", text: str = "text") -> DataFrame:
    """Mean, least and most entity coverage."""
    c = samples.select(entity_coverage(F.col(entities), F.length(text)).alias("c"))
    return c.agg(F.avg("c").alias("mean_coverage"), F.min("c").alias("min_coverage"), F.max("c").alias("max_coverage"))


def dataset_diversity(samples: DataFrame, text: str = "text") -> DataFrame:
    """unique_text_ratio and least, most, mean and deviation of the length."""
    n = F.length(text)
    by_text = samples.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("h")).agg(F.count("*").alias("m"))
    unique = by_text.agg(_ratio(F.count("*"), F.sum("m")).alias("unique_text_ratio"))
    return unique.crossJoin(samples.agg(F.min(n).alias("length_min"), F.max(n).alias("length_max"), F.avg(n).alias("length_mean"), F.stddev_pop(n).alias("length_std")))


def label_balance(samples: DataFrame, label: str = "label") -> DataFrame:
    """label, n, and class_balance (the sum of squared shares, lower when more even) on every row."""
    return class_counts(samples, label).withColumn("class_balance", F.sum(F.col("frequency") * F.col("frequency")).over(Window.partitionBy()))


def entity_types(samples: DataFrame, entities: str = "entities") -> DataFrame:
    """type, n over the entities of all samples."""
    return samples.select(F.explode(entities).alias("e")).groupBy("e.type").agg(F.count("*").alias("n"))


def style_clusters(texts: DataFrame, text: str = "text") -> DataFrame:
    """Texts with formal, informal and question markers, their ratios, and the ratio of distinct texts."""
    n = F.count("*")
    counts = [F.count_if(has_style(text, s)) for s in STYLES]
    return texts.agg(
        *(c.alias(f"{s}_count") for s, c in zip(STYLES, counts)), *(F.coalesce(_ratio(c, n), F.lit(0.0)).alias(f"{s}_ratio") for s, c in zip(STYLES, counts)),
        F.coalesce(_ratio(F.count_distinct(F.sha2(text, 256)), n), F.lit(0.0)).alias("semantic_diversity_score"),
    )


def quality_summary(validity: Column, dual: Column, diversity: Column, threshold: float = 0.8) -> list[Column]:
    """overall_quality_score (mean of the scores that are there, 0 if none), meets_quality_threshold, error_rate."""
    there = F.array_compact(F.array(*(c.cast("double") for c in (validity, dual, diversity))))
    score = F.coalesce(F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(there), F.lit(0)), F.lit(0.0))
    return [score.alias("overall_quality_score"), (score >= threshold).alias("meets_quality_threshold"), (1 - score).alias("error_rate")]


#: Advice on a dataset.
ADVICE = {
    "score": ("ควรปรับปรุงคุณภาพข้อมูลโดยรวม เนื่องจากคะแนนต่ำกว่าเกณฑ์ที่กำหนด (", " < ", ")"),
    "classes": "ควรปรับปรุงความสมดุลของคลาส เนื่องจากมีความไม่สมดุลสูง",
    "texts": "ควรเพิ่มความหลากหลายของข้อความ เนื่องจากมีข้อความที่ซ้ำกันมาก",
    "spelling": "พบปัญหาการสะกดภาษาไทย ควรตรวจสอบและแก้ไขการสะกดให้ถูกต้อง",
    "tones": "พบปัญหาการใช้วรรณยุกต์ ควรตรวจสอบการใช้วรรณยุกต์ให้ถูกต้อง",
}


def dataset_advice(score: Column, gini: Column, uniqueness: Column, misspellings: Column, double_tones: Column, threshold: float = 0.8) -> Column:
    """Array of advice. The class rule warns of a gini above 0.5, as its users know it."""
    low = F.concat(F.lit(ADVICE["score"][0]), F.format_string("%.2f", score), F.lit(ADVICE["score"][1]), F.lit(str(threshold)), F.lit(ADVICE["score"][2]))
    return F.array_compact(F.array(
        F.when(score < threshold, low), F.when(gini > 0.5, F.lit(ADVICE["classes"])), F.when(uniqueness < 0.8, F.lit(ADVICE["texts"])),
        F.when(misspellings > 0, F.lit(ADVICE["spelling"])), F.when(double_tones > 0, F.lit(ADVICE["tones"])),
    ))
