"""Answers of services and sources in a table bucketed by key, so that looking keys up never shuffles the table.

The table lies in the warehouse, clustered by key into a fixed number of buckets. New answers are appended, one file a bucket
at most; the newest row of a key is the one that counts. Reading them needs no exchange, as all rows of a key lie in one
bucket; only the keys that are looked up are dealt out, to the same buckets. `compact` rewrites the table with one row a key.
Take as many buckets as shuffle partitions or more: with fewer, Spark may prefer to deal both sides anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silkloom.storage import ensure_checkpoint_dir

COLUMNS = "key string, value string, timestamp timestamp"


class AnswerCache:
    """key -> value, with an age at which an answer is no longer used (None: never). A new table gets as many buckets as the
    session has shuffle partitions, unless told otherwise."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, ttl: str | None = None):
        self.spark, self.name, self.ttl = spark, name, ttl
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._create(name)

    def _create(self, name: str) -> None:
        self.spark.sql(f"create table if not exists {name} ({COLUMNS}) using parquet clustered by (key) sorted by (key) into {self.buckets} buckets")

    def newest(self) -> DataFrame:
        """key, value, timestamp: the newest row of each key, without an exchange; of rows of one time the greatest value."""
        last = F.max(F.struct("timestamp", "value"))
        return self.spark.table(self.name).groupBy("key").agg(last.alias("r")).select("key", "r.value", "r.timestamp")

    def live(self, now: Column | None = None) -> DataFrame:
        """key, value of the answers that count: neither empty nor too old."""
        rows = self.newest().where("value <> ''")
        if self.ttl is not None:
            rows = rows.where(F.col("timestamp") > (F.current_timestamp() if now is None else now) - F.expr(f"interval {self.ttl}"))
        return rows.select("key", "value")

    def probe(self, keys: DataFrame, now: Column | None = None) -> DataFrame:
        """keys (key) with value, null where there is no live answer."""
        return keys.join(self.live(now), "key", "left")

    def put(self, answers: DataFrame) -> None:
        """Append key, value (and timestamp, now if there is none); null keys and values are left out."""
        stamped = answers if "timestamp" in answers.columns else answers.withColumn("timestamp", F.current_timestamp())
        rows = stamped.where("key is not null and value is not null").select("key", "value", "timestamp")
        # Dealt by the same hash as the buckets, so that each bucket gets one file.
        rows.repartition(self.buckets, "key").write.insertInto(self.name)

    def compact(self) -> None:
        """One row a key: written to a second table, which then takes the name of the first."""
        fresh, old = f"{self.name}_compacted", f"{self.name}_before"
        for name in (fresh, old):
            self.spark.sql(f"drop table if exists {name}")
        self._create(fresh)
        self.newest().write.insertInto(fresh)
        self.spark.sql(f"alter table {self.name} rename to {old}")
        self.spark.sql(f"alter table {fresh} rename to {self.name}")
        self.spark.sql(f"drop table {old}")

    def through(self, requests: DataFrame, ask: Callable[[DataFrame], DataFrame], key: Column) -> DataFrame:
        """requests with value and error: what is known comes from the table, the rest from `ask` and is kept.

        `ask` gets the distinct requests that have no live answer, with their `key`, and returns key, value and error. It is run
        once, its answers are stored before they are used, and failures are asked again the next time.
        """
        ensure_checkpoint_dir(self.spark)
        # Stored, so that the answers appended below don't change what was known.
        known = self.probe(requests.withColumn("key", key).dropDuplicates(["key"])).checkpoint()
        told = ask(known.where("value is null").drop("value")).select("key", "value", "error").checkpoint()
        self.put(told.where("error is null"))
        found = known.where("value is not null").select("key", "value", F.lit(None).cast("string").alias("error")).unionByName(told)
        return requests.withColumn("key", key).join(found, "key").drop("key")
