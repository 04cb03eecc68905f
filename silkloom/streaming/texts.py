"""Row operators on unbounded input: cleaning and validation run unchanged on a stream; counts need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from silkloom.functions.text import clean_stats, clean_text, tokens
from silkloom.operators.validate import validate_sample


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def cleaned(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with clean_text and the cleaning statistics; no state."""
    return texts.withColumn("clean_text", clean_text(text)).select("*", clean_stats(text).alias("stats"))


def checked(samples: DataFrame, task: str, **fields: str) -> DataFrame:
    """samples with is_valid and reason; no state."""
    return samples.withColumn("v", validate_sample(task, **fields)).select(*samples.columns, "v.*")


def windowed_counts(texts: DataFrame, time: str, text: str = "text", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """start, n_texts, n_words by event-time window; rows later than the watermark are left out."""
    by = texts.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return by.agg(F.count("*").alias("n_texts"), F.sum(F.size(tokens(text))).alias("n_words")).select(F.col("w.start").alias("start"), "n_texts", "n_words")


def first_seen(texts: DataFrame, time: str, text: str = "text", late: str = "1 hour") -> DataFrame:
    """Each distinct text once within the watermark."""
    keyed = texts.withColumn("text_hash", F.sha2(text, 256)).withWatermark(time, late)
    return keyed.dropDuplicatesWithinWatermark(["text_hash"])


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """An exactly-once file sink."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
