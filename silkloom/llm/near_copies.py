"""Near copies by SimHash and the Jaccard similarity of five-word shingles: links at SIMILAR or more, decided on the whole sets.

A text's set holds the XXH64 values (seed 42) of its runs of K words, in lower case (ASCII); a text below K words has
its whole word sequence as only shingle. Texts of equal sets are one class, named by 64 bits of a digest of the set, and
only classes are compared.

Candidates come from SimHash: a set's fingerprint has the bits that are set in over half of its values, and the covering
tables of `simhash` give a spanning forest of the fingerprints that differ in RADIUS bits at most. Each of its links, and each
class with the first one of its fingerprint, is decided by the whole sets. Fingerprints lie further apart than that for most pairs
near 0.8 (nearly ten bits of 64 on average), so an exact check follows between the components that they leave.

That check has BANDS keys of ROWS minima each. A pair of similarity s shares a key but for a chance of
(1 - s^ROWS)^BANDS: 5e-8 at 0.8, less above; the similarity itself then decides, so no pair below 0.8 links. In a
bucket every class is first compared with a head of another component drawn from the bucket, if their sizes allow 0.8 at all.
What is linked by then is one component; buckets that hold several are read with their sets, in lists of about LIST_BYTES, and
each class outside a list's largest component is counted against the whole list by shared shingles. So every pair that
shares a bucket is decided or already joined, a group of copies costs a row a class and band, and pairs are never rows.

Null, empty and blank texts have the empty set and are one class. Repeated ids give repeated rows; rows of a null key
link with none. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkloom.llm.common import connected_components, hot_join, materialise, sliced
from silkloom.llm.simhash import BITS, covering_links

K, BANDS, ROWS = 5, 32, 4
#: Bits in which fingerprints of candidates differ at most.
RADIUS = 3
#: Bytes of sets that are one side of a list.
LIST_BYTES = 4 << 20
#: Least Jaccard similarity of a link, as a fraction.
SIMILAR = (4, 5)
_RNG = np.random.default_rng(17)
_BY = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_S32 = np.uint64(32)


def shingles(text: str | None, k: int = K) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = text.encode().lower().split() if text else []
    runs = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, 42) for r in runs), np.uint64))


def class_of(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def fingerprint(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set as a signed integer; 0 for the empty set."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(found), 65536):
        part = found[start : start + 65536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found), bitorder="little").tobytes(), "little", signed=True)


def band_keys(found: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set as signed longs; none for the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 1024):
        np.minimum(least, (found[start : start + 1024, None] * _BY + _PLUS).min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(ROWS, BANDS):
        key = (key ^ row) * _MIX
        key ^= key >> _S32
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _classed(batches):
    for b in sliced(batches):
        found = [shingles(t) for t in b.column(1).to_pylist()]
        keys = [band_keys(x) for x in found]
        ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
        nodes, sizes, fps = (pa.array([f(x) for x in found], pa.int64()) for f in (class_of, len, fingerprint))
        yield pa.RecordBatch.from_arrays([b.column(0), nodes, sizes, fps, bands], names=["key", "node", "size", "fp", "bands"])


def _sets(batches):
    """(node, found) of the rows whose text is of the class asked for: an id may name several texts."""
    for b in sliced(batches):
        rows = [(n, x.tobytes()) for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if class_of(x := shingles(t)) == n]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["node", "found"])


def _verified(batches):
    for b in batches:
        hit = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
        yield b.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))


def apart(parts: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Positions (x, y) of similar sets of different parts; one for a set and part at most."""
    names, part, n = np.unique(parts, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(tokens := np.concatenate(sets), kind="stable")
    tokens, owners = tokens[order], np.repeat(np.arange(len(sets)), sizes)[order]
    out = []
    for x in np.flatnonzero(part != n.argmax()):
        low, high = np.searchsorted(tokens, sets[x]), np.searchsorted(tokens, sets[x], "right")
        at = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
        both = np.bincount(owners[at], minlength=len(sets))
        hits = np.flatnonzero((part != part[x]) & (SIMILAR[1] * both >= SIMILAR[0] * (sizes + sizes[x] - both)))
        out += [(x, hits[i]) for i in np.unique(part[hits], return_index=True)[1]]
    return out


def _apart(batches):
    """Rows sorted by list -> links (a, b) between the parts of each list."""

    def found(rows):
        nodes = [r[1] for r in rows]
        got = apart(np.array([r[2] for r in rows]), [np.frombuffer(r[3], np.uint64) for r in rows])
        sides = [[min(nodes[x], nodes[y]) for x, y in got], [max(nodes[x], nodes[y]) for x, y in got]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in sides], names=["a", "b"])

    now, rows = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("list", "node", "part", "found"))):
            if row[0] != now and rows:
                yield found(rows)
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield found(rows)


def _sets_of(nodes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """node, found: the sets of some classes, from their texts."""
    asked = nodes.distinct().join(reps, "node").select("node", "rep")
    again = docs.join(asked, docs["key"] == asked["rep"]).select("text", "node").mapInArrow(_sets, "node long, found binary")
    return materialise(again.dropDuplicates(["node"]))


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are similar; only texts of classes in a pair are read again."""
    pairs = materialise(pairs.distinct())
    sets = _sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), reps, docs)
    one, two = sets.select(F.col("node").alias("a"), F.col("found").alias("x")), sets.select(F.col("node").alias("b"), F.col("found").alias("y"))
    return materialise(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"))


def _fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that hold together the fingerprints within RADIUS bits: a forest of the fingerprints, each named by
    its first class, and every class with the first one of its fingerprint."""
    least = materialise(classes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    near = covering_links(least.select("fp"), RADIUS)
    one, two = (least.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    across = near.join(one, "a").join(two, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    same = hot_join(classes.select("fp", "node"), least, "fp", "n", how="inner").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return across.union(same).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _links_apart(shared: DataFrame, links: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """What links the components of each bucket that holds several."""
    parts = connected_components(links).withColumnRenamed("node", "__node")
    part = materialise(shared.join(parts, F.col("node") == F.col("__node"), "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("part")))
    mixed = part.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.sum("size").alias("total"), F.count("*").alias("n")).where("p <> q")
    mixed = materialise(mixed.select("bucket", F.ceil(F.col("total") * 8 / LIST_BYTES).alias("sides"), "n"))
    left = materialise(hot_join(part, mixed, "bucket", "n", how="inner"), (mixed, part))
    # A long bucket is dealt to sides, and each two sides are a list.
    own, other = F.pmod(F.xxhash64("node"), F.col("sides")), F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    dealt = left.select("bucket", "node", "part", own.alias("own"), other.alias("other"))
    dealt = dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("list"), "node", "part")
    lists = dealt.join(_sets_of(left.select("node"), reps, docs), "node").repartition("list").sortWithinPartitions("list")
    return materialise(lists.select("list", "node", "part", "found").mapInArrow(_apart, "a long, b long").distinct())


def _fits(x: str, y: str):
    return (F.col(x) * SIMILAR[1] >= F.col(y) * SIMILAR[0]) & (F.col(y) * SIMILAR[1] >= F.col(x) * SIMILAR[0])


def near_copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, node (class of equal sets), component_id (smallest key reachable by links)."""
    chosen = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    known = materialise(chosen.mapInArrow(_classed, f"key {docs.schema[key].dataType.simpleString()}, node long, size long, fp long, bands array<long>"))
    total = known.count()
    classes = materialise(known.groupBy("node").agg(F.min("key").alias("rep"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count("*").alias("copies")))
    reps = classes.select("node", "rep")
    near = _links(_fingerprint_pairs(classes), reps, chosen)
    # What fingerprints leave apart.
    joined = connected_components(near).withColumnRenamed("node", "__node")
    named = classes.join(joined, F.col("node") == F.col("__node"), "left").select(F.explode("bands").alias("bucket"), "node", "size", F.coalesce("component", "node").alias("part"))
    entries = materialise(named)
    several = materialise(entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("bucket", "n"))
    shared = materialise(hot_join(entries, several, "bucket", "n", classes.count() * BANDS, "inner"), (several, entries))
    # A head is any class of the bucket, another one in each: a copy far from one head is near to others.
    drawn = shared.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "node"), "node", "size", "part")).alias("h"), F.count("*").alias("n"))
    heads = materialise(drawn.select("bucket", F.col("h.node").alias("head"), F.col("h.size").alias("hsize"), F.col("h.part").alias("hpart"), "n"))
    pairs = hot_join(shared, heads, "bucket", "n", how="inner").where("part <> hpart").where(_fits("size", "hsize"))
    links = near.union(_links(pairs.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")), reps, chosen))
    links = links.union(_links_apart(shared.drop("part"), links, reps, chosen))
    parts = connected_components(links).withColumnRenamed("component", "part")
    named = materialise(classes.select("node", "rep", "copies").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")))
    least = materialise(named.groupBy("part").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    found = materialise(hot_join(named, least, "part", "n").select("node", "component_id", "copies"), (named, least))
    return hot_join(known.select("key", "node"), found, "node", "copies", total).select(F.col("key").alias(key), "node", "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row, that of the smallest key, of each group. Rows of a null key stay."""
    lost = near_copy_groups(docs, key, text).where(F.col(key) != F.col("component_id")).select(key)
    return docs.join(lost, key, "left_anti").select(docs.columns)
