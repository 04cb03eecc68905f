"""Token counts by trie-shared dynamic programming under a unigram model.

A text's pre-tokens are its words (no white space inside), each with the marker in front. The count of a pre-token is
the number of pieces in its best segmentation: the one with the highest sum of piece scores, found by the forward
recursion best[i] = max over pieces that end at i. best[i] depends on the first i characters only, so each worker keeps a
trie of the distinct words it has met, from text to text: a node is a prefix and holds its best score and count, a new
word is scored only from where it leaves the trie, and its count is stored as a terminal. Characters that no piece covers
fall back to one token a UTF-8 byte.

Scores come from the vocabulary file of a public tokenizer, which lists pieces by frequency: the piece of rank r
scores -ln(r + 2), as a Zipf law has it. Of equal segmentations the one with the longest last piece wins.

The trie is bounded: beyond NODES nodes it is begun anew, which changes the time only; a word longer than LONG
characters is scored without leaving nodes. Null and empty texts have no tokens. Texts are never cut. Repeated rows give
repeated results, an empty table an empty one. Columns that are not in `keep` are left out, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from silkloom.llm.common import sliced

MARK, NODES, LONG, BYTE_SCORE = "▁", 1_000_000, 200, -12.0
#: White space that ends a word, and texts whose words are looked up together.
SPACE, SLICE = " \t\n\v\f\r", 2048


def piece_scores(path: str) -> dict[str, float]:
    """Piece -> score, of the model's ordinary pieces; runs of markers alone are left out."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    pieces = [p for p in map(sp.id_to_piece, ids) if len(p) == 1 or p.strip(MARK)]
    return {p: -math.log(r + 2) for r, p in enumerate(pieces)}


class Trie:
    """Prefixes of the words met so far: node 0 is the empty one, `after` leads from (node, code point), as one number, to
    the next node."""

    def __init__(self, scores: dict[str, float], nodes: int = NODES):
        self.scores, self.nodes, self.longest, self.scored = scores, nodes, max(map(len, scores), default=1), 0
        self.clear()

    def clear(self) -> None:
        self.after: dict[int, int] = {}
        self.best, self.count, self.terminal = [0.0], [0], {}

    def insert(self, words: list[str]) -> None:
        """Store the counts of new words, which come sorted: the path of the word before is kept as far as it is shared."""
        best, count, path, before = [0.0], [0], [0], ""
        for word in words:
            w = MARK + word
            shared, most = 0, min(len(w), len(path) - 1)
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :], best[shared + 1 :], count[shared + 1 :]
            node, kept = path[-1], len(w) <= LONG
            while len(path) <= len(w) and kept and (follow := self.after.get(node << 21 | ord(w[len(path) - 1]))) is not None:
                path.append(node := follow)
                best.append(self.best[node])
                count.append(self.count[node])
            known = len(path)
            if known <= len(w):
                self._forward(w, best, count)
                for i in range(known, len(w) + 1 if kept else 0):
                    self.after[node << 21 | ord(w[i - 1])] = node = len(self.best)
                    self.best.append(best[i])
                    self.count.append(count[i])
                    path.append(node)
            self.terminal[word], before = count[-1], w
            if not kept:
                best, count, path, before = [0.0], [0], [0], ""

    def _forward(self, w: str, best: list[float], count: list[int]) -> tuple[list[float], list[int]]:
        """best and count of all prefixes, from those of the first ones."""
        get, longest, minus = self.scores.get, self.longest, -math.inf
        self.scored += len(w) + 1 - len(best)
        for i in range(len(best), len(w) + 1):
            top, n = minus, 0
            for j in range(i - longest if i > longest else 0, i):
                s = get(w[j:i])
                if s is not None and best[j] + s > top:
                    top, n = best[j] + s, count[j] + 1
            if get(w[i - 1]) is None:
                size = len(w[i - 1].encode())
                if best[i - 1] + size * BYTE_SCORE > top:
                    top, n = best[i - 1] + size * BYTE_SCORE, count[i - 1] + size
            best.append(top)
            count.append(n)
        return best, count

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text; null counts as empty."""
        if len(self.best) + len(self.terminal) > self.nodes:
            self.clear()
        texts = pc.fill_null(texts, "")
        _, places, data = texts.buffers()
        places = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        words, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        if places[0] == places[-1]:
            return words, tokens
        low, raw = int(places[0]), np.frombuffer(data, np.uint8)[places[0] : places[-1]]
        # A piece of text is a word with the white space after it; white space that opens a text is a piece without a word.
        space = (raw == 32) | (raw >= 9) & (raw <= 13)
        start = ~space
        start[1:] &= space[:-1]
        texts_at = (places - low).astype(np.int64)
        full = np.flatnonzero(np.diff(texts_at))
        start[texts_at[full]] = True
        starts = np.flatnonzero(start)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts + low, places[-1]).astype(np.int32)), data).dictionary_encode()
        named = [p.strip(SPACE) for p in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]
        self.insert(sorted({w for w in named if w and w not in self.terminal}))
        own = np.array([self.terminal[w] if w else -1 for w in named], np.int64)[pieces.indices.to_numpy()]
        cuts = np.searchsorted(starts, texts_at[full])
        words[full], tokens[full] = np.add.reduceat((own >= 0).astype(np.int64), cuts), np.add.reduceat(np.maximum(own, 0), cuts)
        return words, tokens


def count_tokens(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_words, n_tokens."""
    scores = piece_scores(model)
    chosen = docs.select(*keep, docs[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text") + ", n_words long, n_tokens long"

    def run(batches):
        trie = Trie(scores)
        for b in sliced(batches, SLICE):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *map(pa.array, trie.totals(b.column("__text")))], names=[*keep, "n_words", "n_tokens"])

    return chosen.mapInArrow(run, schema)
