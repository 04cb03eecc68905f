"""Centroid clustering of integer vectors, on distinct vectors with their multiplicities.

Each component x becomes the integer floor(256 * x). Equal integer vectors are one row with their number, counted before
anything is shuffled; Lloyd's rounds run on these distinct vectors. A round is one pass over the stored table: every task
assigns its vectors to the nearest centroid (squared distance, ties to the smaller number) and gives one row of weighted
integer sums a cluster; the sums of all tasks are added, and a centroid becomes the floor of sum / count, component by
component. Empty clusters keep their centroid. All arithmetic is on integers, so the result does not depend on how the rows
are dealt. At the end each distinct vector's assignment is joined back to the rows that have it.

The driver and the tasks hold k centroids of `dims` components: a bound that does not grow with the input. The first
centroids are the k vectors whose id has the smallest SHA-256 of `2:<id>`; ties go to the smaller vector, null ids last.

Vectors that are null, of another length, or with a null or non-finite component are left out. Repeated ids are rows of their
own; a null id is kept and clustered. Fewer than k vectors give fewer centroids, none an empty result. Components beyond
+-2**27 are taken as +-2**27, so that every distance fits a long; sums are exact for up to 2**36 such rows, and for more the
smaller the components are. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkloom.llm.common import hot_join, materialise

K, DIMS, ROUNDS, SCALE, SEED, BOUND = 40, 64, 5, 256, 2, 1 << 27


def quantised(vector: Column, dims: int = DIMS, scale: int = SCALE) -> Column:
    """Array of integers; null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), F.floor(v * scale).cast("double"))).cast("int"))
    return F.when(good, whole)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x from rows of c, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most * most * x.shape[1] < 1 << 51:  # every sum is an exact double
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    column = b.column("q")
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _summed(centroids: np.ndarray):
    """One row a cluster of a task's vectors: their number and weighted sums."""

    def run(batches):
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for b in batches:
            x, n = _vectors(b), b.column("n").to_numpy()
            near = squares(x, centroids).argmin(1)
            np.add.at(count, near, n)
            np.add.at(total, near, x * n[:, None])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    """Each distinct vector's digest and number, with its cluster and squared distance."""

    def run(batches):
        for b in batches:
            d = squares(_vectors(b), centroids)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["digest", "n", "cluster", "distance"])

    return run


def lloyd_round(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over (q, n); the driver gets k rows of sums."""
    parts = distinct.select("q", "n").mapInArrow(_summed(centroids), "cluster int, n long, sums array<long>")
    added = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    moved = centroids.copy()
    for r in added.collect():
        moved[r["cluster"], r["at"]] = r["x"] // r["n"]
    return moved


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (array<long>): one row a kept vector."""
    whole = vectors.select(F.col(key).alias("key"), quantised(F.col(vector), dims).alias("q")).where("q is not null")
    named = materialise(whole.withColumn("digest", F.unhex(F.sha2(F.array_join(F.transform("q", lambda v: v.cast("string")), ","), 256))))
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    start = [r["q"] for r in named.orderBy(F.asc_nulls_last(first), "q").limit(k).select("q").collect()]
    centroids = np.array(start, np.int64).reshape(-1, dims)
    # The number of a vector's rows is summed before the shuffle: a vector that a third of all rows share is one row a task.
    distinct = materialise(named.groupBy("digest", "q").agg(F.count("*").alias("n")))
    for _ in range(rounds if start else 0):
        centroids = lloyd_round(distinct, centroids)
    spark = vectors.sparkSession
    spans = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), c) for i, c in enumerate(centroids.tolist())]
    finals = spark.createDataFrame(spans, "cluster int, centroid_sha256 string, centroid array<long>")
    near = materialise(distinct.select("digest", "q", "n").mapInArrow(_assigned(centroids), "digest binary, n long, cluster int, distance long"))
    spread = near.groupBy("cluster").agg(F.sum(F.col("n") * F.col("distance")).alias("cluster_inertia"))
    total = spread.agg(F.sum("cluster_inertia").alias("inertia"))
    table = F.broadcast(spread.join(F.broadcast(finals), "cluster").crossJoin(total))  # k rows at most
    rows = hot_join(named.select("key", "digest"), near, "digest", "n")
    found = rows.join(table, "cluster")
    return found.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def oracle_sql(k: int = K, dims: int = DIMS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """Every vector against every centroid, round by round, without deduplication."""
    near = "select v.id, arg_min(c.i, (list_sum(list_transform(list_zip(v.q, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.i)) as i from v, {c} c group by v.id"
    steps = [f"""with v as (select row_number() over () as id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by h, q) - 1 as i, q as c from (select sha256('{seed}:' || vec_id) as h, q from v order by h nulls last, q limit {k}))"""]
    for r in range(rounds):
        steps.append(f"""a{r} as materialized ({near.format(c=f"c{r}")}),
s{r} as (select i, j, sum(q[j])::hugeint as s, count(*) as n from (select a.i, v.q, unnest(range(1, {dims + 1})) as j from a{r} a join v on a.id = v.id) group by i, j),
m{r} as (select i, list(((s - (((s % n) + n) % n)) // n)::bigint order by j) as c from s{r} group by i),
c{r + 1} as materialized (select c.i, coalesce(m.c, c.c) as c from c{r} c left join m{r} m on c.i = m.i)""")
    steps.append(f"""a as materialized ({near.format(c=f"c{rounds}")}),
d as (select v.vec_id, a.i, c.c, list_sum(list_transform(list_zip(v.q, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance from a join v on a.id = v.id join c{rounds} c on c.i = a.i)""")
    return ",\n".join(steps) + """
select vec_id, i::int as cluster, distance, (sum(distance) over (partition by i))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from d"""
