"""Shared plumbing of the training-data operators: shared folder, stored tables, joins of hot keys, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the characters that end a word, as bytes.split() takes them too.
WORD = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="silkloom-"))
    return sc.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, drop: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    Its shuffle files go when it is written, and so do the stored tables in `drop`, which it was made of.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/silkloom/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    for made in _OPEN[-1:]:
        made.append(path)
    delete(spark, *(p for d in drop if (p := _PATHS.pop(d, None))))
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove stored tables, wherever they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables stored in this block are removed at its end, but for those passed to the function it gives."""
    made: list[str] = []
    kept: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield kept.append
    finally:
        _OPEN.remove(made)
        own = {_PATHS[d] for d in kept if d in _PATHS}
        delete(spark, *(p for p in made if p not in own))


def sliced(batches, rows: int = 512):
    """Arrow batches in slices: what is made of the texts of a slice is all that a worker holds at a time."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def bounded_batches(spark: SparkSession, most: str = "2m") -> None:
    """Arrow batches of `most` bytes, unless the session names a size of its own: documents are long, and every Python
    operator of a task holds a batch on either side."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)
    if spark.conf.get(name, default).rstrip("b") == default:
        spark.conf.set(name, most)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(rows: DataFrame, table: DataFrame, on: str, count: str, total: int | None = None, how: str = "left") -> DataFrame:
    """rows joined to a table of one row a key, whose column `count` says how many of the rows have the key.

    Keys with more rows than a quarter of an even share of a partition are looked up by broadcast: by that measure there
    are fewer than four for each partition, however large the input. All other rows are shuffled. Both sides are read
    more than once, so they should be stored tables. Null keys find nothing and are not shuffled.
    """
    total = rows.count() if total is None else total
    table = table.where(F.col(on).isNotNull())
    hot = F.broadcast(table.where(F.col(count) * (4 * partitions(rows.sparkSession)) > total).drop(count))
    named = rows.where(F.col(on).isNotNull())
    found = named.join(hot, on).unionByName(named.join(hot.select(on), on, "left_anti").join(table.drop(count), on, how))
    return found.unionByName(rows.where(F.col(on).isNull()), allowMissingColumns=True) if how == "left" else found


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, component), component being the smallest id reachable.

    Alternating large-star and small-star rounds, until every node either is the least of its neighbourhood or has one
    neighbour. Least neighbours come from aggregations that combine before the shuffle, and go back to the links by
    `hot_join`, so no task gets the links of a hub. Nodes without links are absent.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars, drop = pairs.distinct(), ()
    while True:
        size, open_nodes = Observation(), Observation()
        stars = materialise(stars.observe(size, F.count("*").alias("n")), drop)
        n = size.get.get("n", 0)
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        least = materialise(least.observe(open_nodes, F.count_if(F.expr("m <> a and n > 1")).alias("n")))
        if not n or not open_nodes.get.get("n", 0):
            return least.select(F.col("a").alias("node"), F.col("m").alias("component"))
        large = hot_join(both, least, "a", "n", 2 * n, "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large, (least,))
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = hot_join(large, low, "a", "n", n, "inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        drop = (stars, large, low)
        stars = small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
