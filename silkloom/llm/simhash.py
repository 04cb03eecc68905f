"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit i is set if it is set in over half of the XXH64 values (seed 42) of the text's
word shingles, repeats included. Two fingerprints link if at most `radius` bits differ.

Covering masks: give bit i a non-zero vector m(i) of radius + 1 bits, and take for every non-zero v the mask of
the bits with odd parity of v & m(i). The at most `radius` bits in which a linked pair differs have vectors that
span less than the whole space, so some v is orthogonal to all of them, and under that mask the pair is equal:
each linked pair shares a bucket in some of the 2^(radius+1) - 1 tables (15 for radius 3), for certain.

Equal fingerprints are collapsed before anything is compared. Buckets of one fingerprint are dropped by a count;
a bucket of over LEAF distinct fingerprints is covered again over the bits its mask leaves free, which at least
halves the free bits, so after a few levels a bucket holds fewer than LEAF fingerprints by construction. A leaf
bucket gives a spanning forest of its links, never all its pairs. Components are found by star contraction.

Null, empty and blank texts have fingerprint 0 and link like any others; so do texts below k words, whose only
shingle is the whole word sequence. Repeated ids give repeated rows. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkloom.llm.common import connected_components, hot_join, materialise, sliced

BITS = 64
LEAF = 2048
_HASH = partial(xxhash.xxh64_intdigest, seed=42)
#: For each byte value, its eight bits, lowest first.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, k: int = 3) -> int:
    """The fingerprint as an unsigned integer; k words a shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < k:
        return _HASH(b" ".join(words))
    ones = np.zeros(BITS, np.int64)
    n = len(words) - k + 1
    for start in range(0, n, 65536):
        part = words[start : start + 65536 + k - 1]
        h = np.fromiter(map(_HASH, map(b" ".join, zip(*(part[i:] for i in range(k))))), "<u8")
        lanes = h.view(np.uint8).reshape(-1, 8)
        for lane in range(8):
            ones[8 * lane : 8 * lane + 8] += np.bincount(lanes[:, lane], minlength=256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """key, fp: the fingerprint as a signed long."""

    def run(batches):
        for b in sliced(batches):
            fp = np.array([fingerprint(t, k) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the bits of `free`, such that any `radius` of its bits are cleared by one of them."""
    own = [i for i in range(BITS) if free >> i & 1]
    span = 2 ** (radius + 1) - 1
    return [sum(1 << i for j, i in enumerate(own) if ((1 + j % span) & v).bit_count() & 1) for v in range(1, span + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges (parent, child) of a spanning forest of the links among distinct fingerprints."""
    left, parents, children = fps, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                got, left = left[near], left[~near]
                parents += [int(x)] * len(got)
                children += got.tolist()
                queue += list(got)
    return parents, children


def covering_links(fps: DataFrame, radius: int = 3, leaf: int = LEAF) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) with the same components as all links within the radius."""
    everything = (1 << BITS) - 1
    masks, level = covering_masks(everything, radius), fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    links, rows = None, level.count()
    while True:
        # Masks of the next level by the mask so far; few, and the same at any size of the input.
        if links is None:
            refined = {0: masks}
        else:
            refined = {m: [m | x for x in covering_masks(everything & ~m, radius)] for (m,) in level.select("mask").distinct().collect() for m in [m % (1 << 64)]}
        tables = [(_signed(m), [_signed(x) for x in xs]) for m, xs in refined.items()]
        masked = level.sparkSession.createDataFrame(tables, "mask long, finer array<long>")
        keys = level.join(F.broadcast(masked), "mask").select(F.explode("finer").alias("mask"), "fp")
        # A bucket's name is a hash of mask and masked bits: two buckets of one name are compared as one.
        keys = keys.select("mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "fp")
        sizes = materialise(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("rows", F.col("n")))
        shared = materialise(hot_join(keys, sizes, "bucket", "rows", rows * (2 ** (radius + 1) - 1), "inner"), (sizes,))
        small = shared.where(F.col("n") <= leaf).groupBy("bucket").agg(F.sort_array(F.collect_set("fp")).alias("fps"))
        found = small.select("fps").mapInArrow(_forests(radius), "a long, b long").distinct()
        links = found if links is None else links.union(found)
        level = materialise(shared.where(F.col("n") > leaf).select("mask", "fp").distinct())
        rows = level.count()
        if not rows:
            return links


def _forests(radius: int):
    def run(batches):
        for b in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for fps in b.column(0):
                for side, got in zip(out, forest(fps.values.to_numpy(zero_copy_only=False).view(np.uint64), radius)):
                    side += got
            sides = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays(sides, names=["a", "b"])

    return run


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """key, fp, fingerprint (16 hex digits), component_id (smallest key reachable by links)."""
    fps = materialise(fingerprints(docs, key, text, k))
    total = fps.count()
    first = materialise(fps.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("copies")))
    parts = connected_components(covering_links(first.select("fp"), radius))
    named = materialise(first.join(parts, first.fp == parts.node, "left").select("fp", "first", "copies", F.coalesce("component", "fp").alias("part")))
    least = materialise(named.groupBy("part").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    classes = materialise(hot_join(named, least, "part", "n").select("fp", "component_id", "copies"), (named, least))
    return hot_join(fps, classes, "fp", "copies", total).select(key, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """docs with one row, that of the smallest key, of each group. Rows of a null key stay."""
    lost = simhash_groups(docs.where(F.col(key).isNotNull()), key, text, k, radius).where(F.col(key) != F.col("component_id")).select(key)
    return docs.join(lost, key, "left_anti").select(docs.columns)
