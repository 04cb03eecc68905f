"""Embedding near-duplicates by product quantisation.

Vectors are compared only when their labels are equal and not null, by cosine in double precision; those that
are null, zero or hold a null or non-finite component link with nothing. A pair links at cosine >= the threshold.

Equal directions are collapsed first, with their number. Each distinct vector is stored in the inverted list of
its nearest coarse centroid, as the subspace codes of its residual. Each vector probes its PROBES nearest lists:
asymmetric table-lookup distances (dot products of its parts with the codebooks) estimate all cosines of a list,
and those within the stored residual error of the threshold, which by Cauchy-Schwarz are all that can reach it,
are decided by exact cosine. So only the choice of lists can lose a pair: README has the recall against brute force.

Lists are dealt by label in chunks of about CHUNK vectors on either side, so a list of any length is compared in
bounded tasks; a chunk reports link counts and a spanning forest, never its pairs. A pair seen from both sides
is counted from each; one seen from one side only is reported for both. The number of lists follows the number of
vectors (LIST vectors a list). Up to COARSE lists each has a centroid of its own; beyond, a second codebook of the
residuals splits every coarse list, up to COARSE * SPLITS lists in all, and probing takes the nearest sums. Centroids
and codebooks are fitted on the driver on a sample bounded by SAMPLE vectors.

Vectors of different length only link within their length. Repeated ids count as separate vectors, and a vector
of a null id links with nothing and is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkloom.llm.common import connected_components, hot_join, materialise, sliced

THRESHOLD, PROBES, LIST, COARSE, SPLITS, CHUNK, SAMPLE, PARTS, CODES = 0.93, 8, 800, 2048, 1024, 2048, 16384, 8, 64


def unit(values: list | None) -> np.ndarray | None:
    """The vector at unit length in double precision, or None if it links with nothing."""
    if not values or None in values:
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def directions(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, label, digest, v (float64 bytes at unit length); digest and v are null where nothing may link."""

    def run(batches):
        for b in sliced(batches):
            digests, found = [], []
            for who, values, group in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                x = unit(values) if who is not None and group is not None else None
                data = None if x is None else (x + 0.0).tobytes()
                found.append(data)
                digests.append(None if x is None else hashlib.blake2b(len(data).to_bytes(8, "little") + data + str(group).encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digests, pa.binary()), pa.array(found, pa.binary())], names=["key", "label", "digest", "v"])

    chosen = vectors.select(key, vector, F.col(label).cast("string"))
    return chosen.mapInArrow(run, f"key {chosen.schema[key].dataType.simpleString()}, label string, digest binary, v binary")


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds from a random start; empty ones keep their place."""
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _least(d: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n least values of each row, in order."""
    n = min(n, d.shape[1])
    part = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1), 1)


class Quantiser:
    """Lists, as sums of a coarse centroid and a split of its residuals, and codebooks of what is left in PARTS subspaces."""

    def __init__(self, x: np.ndarray, lists: int, coarse: int = COARSE):
        self.coarse, self.splits = k_means(x, min(lists, coarse)), np.zeros((1, x.shape[1]))
        if lists > coarse:
            first = self.near(x, 1)[:, 0]
            self.splits = k_means(x - self.coarse[first], min(SPLITS, -(-lists // coarse)))
        rest = x - self.centroids(self.near(x, 1)[:, 0])
        self.cuts = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
        self.books = [k_means(rest[:, s:e], CODES) for s, e in zip(self.cuts, self.cuts[1:])]

    def centroids(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.splits)] + self.splits[lists % len(self.splits)]

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n lists nearest to each vector, nearest first; splits are looked for in the n nearest coarse lists."""
        if len(x) > 1024:
            return np.vstack([self.near(x[s : s + 1024], n) for s in range(0, len(x), 1024)])
        d = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        best = _least(d, n)
        if len(self.splits) == 1:
            return best
        # |x - c - s|^2 = |x - c|^2 - 2 x.s + 2 c.s + |s|^2
        cross = 2 * self.coarse @ self.splits.T + (self.splits**2).sum(1)
        both = np.take_along_axis(d, best, 1)[:, :, None] + cross[best] - 2 * (x @ self.splits.T)[:, None, :]
        at = _least(both.reshape(len(x), -1), n)
        return np.take_along_axis(best, at // len(self.splits), 1) * len(self.splits) + at % len(self.splits)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes, and the length of what they leave out."""
        rest = x - self.centroids(lists)
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for m, (book, s, e) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            codes[:, m] = np.argmin((book**2).sum(1) - 2 * rest[:, s:e] @ book.T, axis=1)
            rest[:, s:e] -= book[codes[:, m]]
        return codes, np.sqrt((rest**2).sum(1))

    def estimate(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Estimated dot products of queries with the stored vectors of one list, by table lookup."""
        got = np.repeat((q @ self.centroids(np.array([which]))[0])[:, None], len(codes), axis=1)
        for m, (book, s, e) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            got += (q[:, s:e] @ book.T)[:, codes[:, m]]
        return got


_ROWS = "label string, list int, role int, key {kind}, n long, v binary, lists binary, codes binary, error double"


def _dealt(quantisers: dict[int, Quantiser], kind: pa.DataType, probes: int):
    """Each vector once as stored (role 0) and once as a query of each list that it probes (role 1)."""

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            lengths = [len(v) // 8 for v in b.column("v").to_pylist()]
            for length in sorted(set(lengths)):
                part = t.filter(pa.array([n == length for n in lengths]))
                x = np.frombuffer(b"".join(part.column("v").to_pylist()), np.float64).reshape(-1, length)
                quantiser = quantisers[length]
                near = quantiser.near(x, probes)
                codes, error = quantiser.encode(x, near[:, 0])
                rows = near.shape[1]
                who = np.concatenate([np.arange(len(x)), np.repeat(np.arange(len(x)), rows)])
                lists = np.concatenate([near[:, 0], near.ravel()]).astype(np.int32)
                role = np.concatenate([np.zeros(len(x), np.int32), np.ones(len(x) * rows, np.int32)])
                sent = part.take(pa.array(who))
                probed = pa.array([r.astype(np.int32).tobytes() for r in near], pa.binary()).take(pa.array(who))
                yield pa.RecordBatch.from_arrays(
                    [
                        sent.column("label").combine_chunks(), pa.array(lists), pa.array(role), sent.column("key").combine_chunks().cast(kind), sent.column("n").combine_chunks(), sent.column("v").combine_chunks(), probed,
                        pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(who)), pa.array(error).take(pa.array(who)),
                    ],
                    names=["label", "list", "role", "key", "n", "v", "lists", "codes", "error"],
                )

    return run


def _components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index reachable, for each of n nodes."""
    part = np.arange(n)
    while len(left):
        low = np.minimum(part[left], part[right])
        before = part.copy()
        np.minimum.at(part, left, low)
        np.minimum.at(part, right, low)
        part = part[part]
        if (part == before).all():
            break
    return part


def _compared(quantisers: dict[int, Quantiser], threshold: float, kind: pa.DataType):
    def run(t: pa.Table) -> pa.Table:
        which = t.column("list")[0].as_py()
        length = t.column("dim")[0].as_py()
        role = t.column("role").to_numpy()
        keys = t.column("key").to_numpy()
        n = t.column("n").to_numpy()
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(-1, length)
        lists = np.frombuffer(b"".join(t.column("lists").to_pylist()), np.int32).reshape(len(x), -1)
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
        error = t.column("error").to_numpy()
        stored, asking = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        uniq, code = np.unique(keys, return_inverse=True)
        links, part = np.zeros(len(uniq), np.int64), np.arange(len(uniq))
        for s in range(0, len(asking) if len(stored) else 0, 512):
            q = asking[s : s + 512]
            near = quantisers[length].estimate(x[q], which, codes[stored]) >= threshold - error[stored] - 1e-9
            a, b = np.nonzero(near)
            a, b = q[a], stored[b]
            a, b = a[other := keys[a] != keys[b]], b[other]
            exact = np.empty(len(a))
            for k in range(0, len(a), 65536):
                exact[k : k + 65536] = np.einsum("ij,ij->i", x[a[k : k + 65536]], x[b[k : k + 65536]])
            a, b = a[hit := exact >= threshold], b[hit]
            np.add.at(links, code[a], n[b])
            # The stored vector finds the query itself only if it probes the query's list.
            one_way = ~(lists[b] == lists[a][:, :1]).any(axis=1)
            np.add.at(links, code[b[one_way]], n[a[one_way]])
            part = np.minimum(part, part[_components(len(uniq), np.concatenate([code[a], np.arange(len(uniq))]), np.concatenate([code[b], part]))])
        some = (links > 0) | (part != np.arange(len(uniq)))
        return pa.table([pa.array(uniq[some]).cast(kind), pa.array(links[some]), pa.array(uniq[part[some]]).cast(kind)], names=["key", "links", "peer"])

    return run


def embedding_groups(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, probes: int = PROBES, per_list: int = LIST, coarse: int = COARSE) -> DataFrame:
    """key, n_links, component_id (smallest key reachable), kept (key = component_id): one row for each vector."""
    named = materialise(directions(vectors, key, vector, label))
    good = named.where("digest is not null").groupBy("label", "digest")
    total = named.count()
    distinct = materialise(good.agg(F.min("key").alias("key"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("dim", F.expr("cast(octet_length(v) / 8 as int)")))
    sql = named.schema["key"].dataType.simpleString()
    kind = pa.int64() if sql == "bigint" else pa.int32()
    sizes = {r["dim"]: r["count"] for r in distinct.groupBy("dim").count().collect()}
    quantisers = {}
    for dim, count in sizes.items():
        sample = distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").collect()
        x = np.frombuffer(b"".join(bytes(r["v"]) for r in sample), np.float64).reshape(-1, dim)
        quantisers[dim] = Quantiser(x, min(coarse * SPLITS, -(-count // per_list)), coarse)
    dealt = materialise(distinct.mapInArrow(_dealt(quantisers, kind, probes), _ROWS.format(kind=sql)).withColumn("dim", F.expr("cast(octet_length(v) / 8 as int)")))
    group = ["label", "dim", "list"]
    chunks = dealt.groupBy(*group).agg(*(F.ceil(F.count_if(F.col("role") == r) / CHUNK).cast("int").alias(c) for r, c in ((0, "db"), (1, "qs"))))
    chunks = materialise(chunks)
    parted = dealt.join(chunks, group)
    at = F.pmod(F.xxhash64("key", "role"), F.when(F.col("role") == 0, F.greatest("db", F.lit(1))).otherwise(F.greatest("qs", F.lit(1)))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("role") == 0, F.greatest("qs", F.lit(1))).otherwise(F.greatest("db", F.lit(1))) - 1)
    spread = parted.withColumn("at", at).withColumn("other", F.explode(others))
    spread = spread.withColumn("d", F.when(F.col("role") == 0, F.col("at")).otherwise(F.col("other"))).withColumn("q", F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("at")))
    found = materialise(spread.groupBy(*group, "d", "q").applyInArrow(_compared(quantisers, threshold, kind), f"key {sql}, links long, peer {sql}"))
    parts = connected_components(found.select(F.col("key").cast("long").alias("a"), F.col("peer").cast("long").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    classes = distinct.select("digest", "key", "n").join(links, "key", "left").join(parts, F.col("key") == F.col("node"), "left")
    classes = materialise(classes.select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "key").cast(sql).alias("component_id"), "n"))
    rows = hot_join(named.select("key", "digest"), classes, "digest", "n", total)
    component = F.coalesce("component_id", "key")
    return rows.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
