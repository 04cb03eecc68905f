"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model crosses into a white space marker, and no piece holds a newline, so the merges inside one marked
word (its run of markers and what follows, up to the next marker or newline) do not depend on its neighbours. The same
holds at a mark such as a comma that follows a letter, if no piece has a letter before that mark: `marks_after_letters`
reads the marks off the model, and words are split there too, which lets "word" and "word," share a row. Each worker segments a distinct marked word once, keeps its ids, and joins them back by
position. What the ids of a word decode to is put together from the pieces (markers are spaces, byte pieces are bytes);
it is kept only where it differs from the word itself with its markers as spaces, which a model with byte pieces never
does. The table is bounded (TABLE_ROWS): a full one is emptied and refilled on demand, which changes the time but never a
result. `check_model` refuses models for which the argument doesn't hold.

Nulls are taken as empty texts: their ids are begin and end only. Texts are never cut; repeated rows give repeated
results; an empty table gives an empty result; extra columns are kept by `encode_decode(..., keep=...)` and kept columns
may have any name but those of the results.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from silkloom.llm.common import sliced

TABLE_ROWS = 500_000
#: Bytes of text, or one longer text, whose marked words are looked up together.
SLICE_CHARS = 2_000_000
MARK = "▁"
def marks_after_letters(pieces: list[str]) -> bytes:
    """ASCII marks that no piece has after an ASCII letter."""
    crossed = {m for p in pieces for m in re.findall(r"[A-Za-z](?=([!-/:-@\[-`{-~]))", p)}
    return bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in crossed)


_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])


def word_starts(data: np.ndarray, texts: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Where marked words start in UTF-8 bytes, of texts that start at `texts`: at a newline and after one, at the first
    of a run of markers, and at the bytes told by `mark` after a letter."""
    line, space = data == 10, data == 32
    start = line | space
    start[1:] &= ~(space[1:] & space[:-1])
    start[1:] |= line[:-1] | mark[data[1:]] & _LETTER[data[:-1]]
    start[texts] = True
    return np.flatnonzero(start)


def check_model(path: str) -> None:
    """Raise ValueError unless marked words are independent under the model."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("the model's normalisation looks across words")
    if MARK not in {p.piece for p in spec.pieces}:
        raise ValueError("the model has no piece for a lone marker")
    for p in spec.pieces:
        if p.type in (1, 4) and ("\n" in p.piece or MARK in p.piece.lstrip(MARK) or p.type == 4):
            raise ValueError(f"piece {p.piece!r} may cross a marked word")


class _Rows(dict):
    """Word -> its row; a new word gets the next row and waits in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row


class ChunkTable:
    """Distinct marked words by row: ids as little-endian uint32 bytes; `odd` has the decoded bytes of words that change."""

    def __init__(self, path: str, rows: int = TABLE_ROWS):
        from sentencepiece import SentencePieceProcessor

        self.sp, self.rows, self.filled = SentencePieceProcessor(model_file=path), rows, 0
        n = self.sp.get_piece_size()
        normal = [self.sp.id_to_piece(i) for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.splits = np.isin(np.arange(256), list(marks_after_letters(normal)))
        self.skip = len(self.sp.encode("\n"))  # ids of a newline put before a word without a marker: prefix and newline
        self.said = [self._said(i) for i in range(n)]
        self.special = [struct.pack("<I", i) for i in (self.sp.bos_id(), self.sp.eos_id())]
        self.mark = self.sp.piece_to_id(MARK)  # a lone marker, which encode() would take as an empty text
        self.row, self.ids, self.odd = _Rows(), [], {}

    def _said(self, i: int) -> bytes:
        """What a piece decodes to inside a text."""
        piece = self.sp.id_to_piece(i)
        if self.sp.is_control(i):
            return b""
        if self.sp.is_unknown(i):
            return " \u2047 ".encode()
        return bytes([int(piece[3:5], 16)]) if self.sp.is_byte(i) else piece.replace(MARK, " ").encode()

    def fill(self) -> None:
        """Segment the words that have a row but no ids yet."""
        new, self.row.new = self.row.new, []
        self.filled += len(new)
        # The dummy prefix stands for the first marker; a word without one is encoded after a newline.
        coded = self.sp.encode([w[1:] if w[0] in " ▁" else "\n" + w for w in new], num_threads=1)
        coded = [(c or [self.mark]) if w[0] in " ▁" else c[self.skip :] for w, c in zip(new, coded)]
        ends = [0, *itertools.accumulate(map(len, coded))]
        data = array("I", itertools.chain.from_iterable(coded)).tobytes()
        first = len(self.ids)
        self.ids += [data[4 * s : 4 * e] for s, e in zip(ends, ends[1:])]
        said = self.said.__getitem__
        if b"".join(map(said, itertools.chain.from_iterable(coded))) != "".join(new).replace(MARK, " ").encode():
            texts = [b"".join(map(said, c)) for c in coded]
            self.odd.update((first + k, t) for k, (w, t) in enumerate(zip(new, texts)) if t != w.replace(MARK, " ").encode())

    def code(self, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """(ids with begin and end, decoded text) of each text, both as bytes."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, SLICE_CHARS + (size[at - 1] if at else 0), "right")))
            yield from self._coded(texts.slice(at, end - at))
            at = end

    def _coded(self, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        if len(self.row) > self.rows:
            self.row, self.ids, self.odd = _Rows(), [], {}
        begin, end = self.special
        # A marker of the text's own is a space to the model; one more stands before each text.
        told = pc.binary_join_element_wise(pa.scalar(""), pc.replace_substring(texts.filter(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0)), MARK, " "), pa.scalar(" "))
        told = told.combine_chunks() if isinstance(told, pa.ChunkedArray) else told
        some = iter(self._joined(told) if len(told) else ())
        for full in pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0).to_pylist():
            yield next(some) if full else (begin + end, b"")

    def _joined(self, told: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        begin, end = self.special
        _, places, data = told.buffers()
        places = np.frombuffer(places, np.int32)[told.offset : told.offset + len(told) + 1]
        low, raw = int(places[0]), np.frombuffer(data, np.uint8)[: places[-1]]
        texts = (places - low).astype(np.int64)
        starts = word_starts(raw[low:], texts[:-1], self.splits)
        edges = pa.py_buffer(np.append(starts + low, places[-1]).astype(np.int32))
        words = pa.StringArray.from_buffers(len(starts), edges, data).dictionary_encode()
        rows = list(map(self.row.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        self.fill()
        own = list(map(self.ids.__getitem__, rows))
        # The ids of all words in a row, by the words' places among the distinct ones.
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        which = words.indices.to_numpy()
        ends = np.cumsum(sizes[which])
        shift = (np.cumsum(sizes) - sizes)[which] - (ends - sizes[which])
        ids = np.frombuffer(b"".join(own), "<u4")[np.repeat(shift, sizes[which]) + np.arange(ends[-1])]
        cuts = np.append(np.searchsorted(starts, texts[:-1]), len(starts))
        tokens = np.append(0, ends)[cuts]
        odd = {k for k, r in enumerate(rows) if r in self.odd} if self.odd else set()
        for k, text in enumerate(told):
            coded = ids[tokens[k] : tokens[k + 1]].tobytes()
            if odd and not odd.isdisjoint(mine := which[cuts[k] : cuts[k + 1]].tolist()):
                yield begin + coded + end, b"".join([self.odd.get(rows[w]) or words.dictionary[w].as_py().encode() for w in mine])[1:]
            else:
                yield begin + coded + end, text.as_buffer().to_pybytes()[1:]


def encode_decode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), payload: bool = False) -> DataFrame:
    """keep columns, n_tokens, ids_sha256, decoded_sha256; with payload also ids (binary uint32) and decoded."""
    check_model(model)
    chosen = docs.select(*keep, docs[text].alias("__text"))
    extra = ", ids binary, decoded string" if payload else ""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text")
    schema += f", n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"

    def run(batches):
        table = ChunkTable(model)
        for b in sliced(batches):
            got = list(table.code(b.column("__text")))
            out = [b.column(c) for c in keep]
            out.append(pa.array([len(i) // 4 for i, _ in got], pa.int64()))
            out += [pa.array([hashlib.sha256(x[k]).hexdigest() for x in got], pa.string()) for k in (0, 1)]
            if payload:
                out += [pa.array([i for i, _ in got], pa.binary()), pa.array([t.decode() for _, t in got], pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if payload else [])]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return chosen.mapInArrow(run, schema)
