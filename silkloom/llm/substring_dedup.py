"""Exact removal of repeated word windows, found through difference-cover anchors.

A window is WINDOW consecutive words of one document. Every word covered by a window whose word sequence also
starts earlier (smaller id, or the same document at an earlier start) is removed; windows are judged on the input.

The set COVER = {0, 1, 3, 9} is a perfect difference cover modulo PERIOD = 13: for any two positions some common
shift below 13 brings both onto cover positions. So anchors of WINDOW - PERIOD + 1 = 8 words are hashed only at
cover positions (4 of 13), and any two equal windows contain an equal, aligned anchor. Steps:

1. Anchors. Blocks of documents send each distinct anchor hash once, with the id of its document; an anchor that
   repeats within a block is known to be shared there and then. Bucket by bucket, the hashes that come from more
   than one block are found by sorting and reported to their documents.
2. Extension. Only documents with shared anchors are read again, from a table stored for it. Each shared anchor is
   extended to all whole windows around it; blocks send each distinct window once, at its earliest place, and buckets
   find the earliest place of all. Windows are compared by 96 bits, mixed of two independent hashes of each word.
3. Each document receives the starts of its repeated windows and drops the words they cover.

No step sends more than one record of a hash for each block, so a passage that a third of all documents share
costs a record a block, not one a document; no pairs are formed. Buckets are sorted one at a time.

Null, empty and short texts have no window and lose nothing. An id names one text: rows that repeat an id are
taken as the same document, and as equal places do not start earlier than themselves, both keep their words.
Null ids order before all others. An empty table gives an empty result. Other columns, whatever their names, are passed
on by `remove_repeats` and left out by `dedup_digests`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkloom.llm.common import materialise, partitions, sliced

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Words that are handled as one block.
BLOCK_WORDS = 400_000
_NULL_ID = -(1 << 63)
_SPREAD = np.zeros(PERIOD, bool)
_SPREAD[list(COVER)] = True
_C1, _C2, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_S33, _S29 = np.uint64(33), np.uint64(29)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent hashes of each word, as the columns of an array."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def _roll(h: np.ndarray, at: np.ndarray, width: int, c: np.uint64) -> np.ndarray:
    """Mixed hashes of `width` word hashes from each position of `at`."""
    got = h[at]
    for i in range(1, width):
        got = got * c + h[at + i]
    got = (got ^ (got >> _S33)) * _MIX
    return got ^ (got >> _S29)


def anchor_places(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in concatenated documents, of all anchors, and the index of each one's document."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(doc)) - starts[doc]
    at = np.flatnonzero(_SPREAD[within % PERIOD] & (within + ANCHOR <= lengths[doc]) & (lengths[doc] >= WINDOW))
    return at, doc[at]


def _blocks(batches, *columns: str) -> Iterator[tuple]:
    """(ids, word hashes by document, other columns) of about BLOCK_WORDS words."""
    ids, words, rest, n = [], [], [], 0
    for b in sliced(batches):
        cols = [b.column(c).to_pylist() for c in columns]
        for k, (i, t) in enumerate(zip(b.column("__id").to_pylist(), b.column("__text").to_pylist(), strict=True)):
            own = word_hashes(t.encode().split() if t else [])
            ids.append(i), words.append(own), rest.append([c[k] for c in cols])
            n += len(own)
            if n >= BLOCK_WORDS:
                yield ids, words, rest
                ids, words, rest, n = [], [], [], 0
    if ids:
        yield ids, words, rest


def _laid_out(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both word hashes of all documents in a row, the documents' starts and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    return np.ascontiguousarray(np.concatenate(words).T), starts, lengths


def _by_doc(ids: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(id, the bytes of its values); each document once."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    cuts = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)) if len(ids) else []
    for s, e in zip(cuts, [*cuts[1:], len(ids)]):
        yield int(ids[s]), values[s:e].tobytes()


#: direct rows already name a document (id) and its payload; the others hold a bucket's hashes and owners.
_SENT = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("third", pa.binary())])
_SENT_SQL = "bucket int, id long, first binary, second binary, third binary"


def _send(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _SENT)], schema=_SENT)


def _slices(buckets: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted bucket numbers."""
    edges = np.searchsorted(buckets, np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), int(edges[k]), int(edges[k + 1])


def _send_anchors(n_buckets: int):
    def run(batches):
        for ids, words, _ in _blocks(batches):
            (h, _), starts, lengths = _laid_out(words)
            at, doc = anchor_places(starts, lengths)
            hashes, own = _roll(h, at, ANCHOR, _C1), np.array(ids, np.int64)[doc]
            order = np.argsort(hashes)
            hashes, own = hashes[order], own[order]
            first = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1])) if len(hashes) else np.zeros(0, np.int64)
            many = np.diff(first, append=len(hashes)) > 1
            again = np.repeat(many, np.diff(first, append=len(hashes)))
            rows = [(i % n_buckets, i, v, None, None) for i, v in _by_doc(own[again], hashes[again])]
            # The owner's last bit says whether the block has already told the documents.
            hashes, own = hashes[first], own[first]
            bucket = (hashes >> np.uint64(32)) % np.uint64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            hashes, own, many, bucket = hashes[order], own[order], many[order], bucket[order]
            for k, s, e in _slices(bucket, n_buckets):
                rows.append((k, None, hashes[s:e].tobytes(), _packed(own[s:e]), np.packbits(many[s:e]).tobytes()))
            yield _send(rows)

    return run


def _packed(ids: np.ndarray) -> bytes:
    """Ids as their least, then 32-bit offsets where they fit, else 64-bit ones."""
    low = ids.min()
    wide = int(ids.max()) - int(low) >= 1 << 32
    return low.tobytes() + (ids.tobytes() if wide else (ids - low).astype(np.uint32).tobytes())


def _unpacked(data: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(data, np.int64, 1)[0]
    return np.frombuffer(data, np.int64, n, 8) if len(data) == 8 + 8 * n else low + np.frombuffer(data, np.uint32, n, 8).astype(np.int64)


def _short(begin: np.ndarray) -> bytes:
    """Starts as 16-bit numbers where they fit, else as 32-bit ones."""
    return (begin.astype(np.uint16) if begin.max() < 1 << 16 else begin).tobytes()


def _buckets(batches) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """(direct rows, sent rows) of each bucket; rows come sorted by bucket."""
    now, direct, sent = None, [], []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != now and now is not None:
                yield direct, sent
                direct, sent = [], []
            now = row[0]
            (sent if row[1] is None else direct).append(row[1:])
    if now is not None:
        yield direct, sent


class _Replies:
    """Values for documents, packed by group of documents: a few rows a task, however many documents are told."""

    SCHEMA = "team int, ids binary, found binary"

    def __init__(self, teams: int):
        self.teams, self.ids, self.found, self.n = teams, [], [], 0

    def add(self, ids: np.ndarray, found: np.ndarray) -> None:
        self.ids.append(ids), self.found.append(found)
        self.n += len(ids)

    def rows(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """What has been added, once it is at least so much."""
        if self.n >= least:
            ids, found = np.concatenate(self.ids), np.concatenate(self.found)
            team = ((ids.astype(np.uint64) * _C1) >> np.uint64(32)) % np.uint64(self.teams)
            order = np.argsort(team, kind="stable")
            ids, found = ids[order], found[order]
            cuts = list(_slices(team[order], self.teams))
            columns = ([k for k, _, _ in cuts], [ids[s:e].tobytes() for _, s, e in cuts], [found[s:e].tobytes() for _, s, e in cuts])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["team", "ids", "found"])
            self.ids, self.found, self.n = [], [], 0

    def direct(self, rows: list[tuple], kind: type) -> None:
        for r in rows:
            got = np.frombuffer(r[1], kind)
            self.add(np.full(len(got), r[0], np.int64), got)


def _delivered(kind: type):
    """Sorted rows of teams -> (id, found): one row for each document."""

    def run(batches):
        now, ids, found = None, [], []

        def rows():
            got = list(_by_doc(np.concatenate(ids), np.concatenate(found)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in got], pa.int64()), pa.array([r[1] for r in got], pa.binary())], names=["id", "found"])

        for b in batches:
            for team, i, f in zip(*(c.to_pylist() for c in b.columns)):
                if team != now and now is not None:
                    yield rows()
                    ids, found = [], []
                now = team
                ids.append(np.frombuffer(i, np.int64)), found.append(np.frombuffer(f, kind))
        if now is not None:
            yield rows()

    return run


#: Values that a task holds before it passes them on.
_HELD = 250_000


def _shared_anchors(teams: int):
    def run(batches):
        replies = _Replies(teams)
        for direct, sent in _buckets(batches):
            replies.direct(direct, np.uint64)
            if sent:
                hashes = np.concatenate([np.frombuffer(r[1], np.uint64) for r in sent])
                sizes = [len(r[1]) // 8 for r in sent]
                own = np.concatenate([_unpacked(r[2], n) for r, n in zip(sent, sizes)])
                told = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8), count=n) for r, n in zip(sent, sizes)]).astype(bool)
                order = np.argsort(hashes)
                h = hashes[order]
                same = h[1:] == h[:-1]
                hit = order[np.append(same, False) | np.insert(same, 0, False)]
                hit = hit[~told[hit]]
                replies.add(own[hit], hashes[hit])
            yield from replies.rows(_HELD)
        yield from replies.rows()

    return run


def _send_windows(n_buckets: int):
    def run(batches):
        for ids, words, rest in _blocks(batches, "found"):
            (h, g), starts, lengths = _laid_out(words)
            at, doc = anchor_places(starts, lengths)
            hashes = _roll(h, at, ANCHOR, _C1)
            # An anchor that is shared anywhere in the block is shared in every document that has it.
            known = np.unique(np.concatenate([np.frombuffer(r[0], np.uint64) for r in rest if r[0]] or [np.zeros(0, np.uint64)]))
            if not len(known):
                continue
            spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            at, doc = at[known[spot] == hashes], doc[known[spot] == hashes]
            # Windows that hold the anchor at a shift below PERIOD: mark [anchor - PERIOD + 1, anchor].
            mark = np.zeros(len(h) + 1, np.int32)
            np.add.at(mark, np.maximum(at - PERIOD + 1, starts[doc]), 1)
            np.add.at(mark, at + 1, -1)
            where = np.flatnonzero(np.cumsum(mark[:-1]))
            doc = np.searchsorted(starts, where, "right") - 1
            fits = where + WINDOW <= starts[doc] + lengths[doc]
            where, doc = where[fits], doc[fits]
            own, begin = np.array(ids, np.int64)[doc], where - starts[doc]
            h1, h2 = _roll(h, where, WINDOW, _C1), _roll(g, where, WINDOW, _C2).astype(np.uint32)
            order = np.lexsort((begin, own, h2, h1))
            h1, h2, own, begin = h1[order], h2[order], own[order], begin[order]
            new, later = _later(h1, h2, own, begin)
            rows = [(i % n_buckets, i, v, None, None) for i, v in _by_doc(own[later], begin[later].astype(np.uint32))]
            h1, h2, own, begin = h1[new], h2[new], own[new], begin[new].astype(np.uint32)
            bucket = (h1 >> np.uint64(32)) % np.uint64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            h1, h2, own, begin, bucket = h1[order], h2[order], own[order], begin[order], bucket[order]
            for k, s, e in _slices(bucket, n_buckets):
                rows.append((k, None, h1[s:e].tobytes() + h2[s:e].tobytes(), _packed(own[s:e]), _short(begin[s:e])))
            yield _send(rows)

    return run


def _later_windows(teams: int):
    def run(batches):
        replies = _Replies(teams)
        for direct, sent in _buckets(batches):
            replies.direct(direct, np.uint32)
            if sent:
                sizes = [len(r[1]) // 12 for r in sent]
                h1 = np.concatenate([np.frombuffer(r[1], np.uint64, n) for r, n in zip(sent, sizes)])
                h2 = np.concatenate([np.frombuffer(r[1], np.uint32, n, 8 * n) for r, n in zip(sent, sizes)])
                own = np.concatenate([_unpacked(r[2], n) for r, n in zip(sent, sizes)])
                begin = np.concatenate([np.frombuffer(r[3], np.uint16 if len(r[3]) == 2 * n else np.uint32).astype(np.uint32) for r, n in zip(sent, sizes)])
                order = np.lexsort((begin, own, h2, h1))
                h1, h2, own, begin = h1[order], h2[order], own[order], begin[order]
                later = _later(h1, h2, own, begin)[1]
                replies.add(own[later], begin[later])
            yield from replies.rows(_HELD)
        yield from replies.rows()

    return run


def _later(h1: np.ndarray, h2: np.ndarray, own: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows sorted by hash, document and start: which are the first of their hash, and which start later."""
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    return new, (own != own[lead]) | (begin != begin[lead])


def _gathered(df: DataFrame, find, kind: type, n: int) -> DataFrame:
    dealt = df.repartition(n, "bucket").sortWithinPartitions("bucket")
    told = dealt.mapInArrow(find(n), _Replies.SCHEMA)
    return told.repartition(n, "team").sortWithinPartitions("team").mapInArrow(_delivered(kind), "id long, found binary")


def repeated_starts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, found: the starts of the document's repeated windows, as uint32 bytes; documents with some only.

    Null keys are coded as the least long.
    """
    n = partitions(docs.sparkSession)
    chosen = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID)).alias("__id"), F.col(text).alias("__text"))
    anchors = materialise(_gathered(chosen.mapInArrow(_send_anchors(2 * n), _SENT_SQL), _shared_anchors, np.uint64, n))
    again = materialise(chosen.join(anchors, chosen["__id"] == anchors["id"]).select("__id", "__text", "found"), (anchors,))
    return materialise(_gathered(again.mapInArrow(_send_windows(2 * n), _SENT_SQL), _later_windows, np.uint32, n), (again,))


def kept_words(words: list[bytes], found: bytes | None) -> list[bytes]:
    """The words that no repeated window covers."""
    if not found:
        return words
    starts = np.unique(np.frombuffer(found, np.uint32).astype(np.int64))
    starts = starts[starts + WINDOW <= len(words)]
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    keep = np.cumsum(cover[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def _with_found(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with __starts, whatever their columns are called."""
    starts = repeated_starts(docs, key, text).select(F.col("id").alias("__rid"), F.col("found").alias("__starts"))
    return docs.join(starts, F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID)) == F.col("__rid"), "left").drop("__rid")


def dedup_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def run(batches):
        for b in sliced(batches):
            rows = []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = t.encode().split() if t else []
                kept = kept_words(words, found)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=[key, "n_words", "n_removed", "kept_sha256"])

    chosen = docs.select(key, text)
    kind = chosen.schema[key].dataType.simpleString()
    return _with_found(chosen, key, text).select(key, text, "__starts").mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated windows cut out of the text: changed texts are their kept words joined by one space."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, x in ((t, x) for s in range(0, len(texts), 512) for t, x in zip(texts.slice(s, 512).to_pylist(), found.slice(s, 512).to_pylist(), strict=True)):
            out.append(b" ".join(kept_words(t.encode().split(), x)).decode() if t and x else t)
        return pa.array(out, pa.string())

    joined = _with_found(docs, key, text)
    return joined.withColumn(text, F.when(F.col("__starts").isNull(), F.col(text)).otherwise(cut(text, "__starts"))).select(docs.columns)
