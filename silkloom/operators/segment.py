"""Words of texts that are written without spaces, by maximal matching against a dictionary.

All dictionary words that stand in a run of a text make a lattice; of the ways through it the one with the fewest characters
outside the dictionary is taken, then the one with the fewest words, then the one whose first word is longest, and so on from
there. Words begin and end at the borders of character clusters only: a vowel that stands before its consonant is not parted
from it, nor are marks and vowels that stand above, below or after one. What no word covers becomes unknown words, as long as
they go on; they end where Thai meets another script. White space ends a run and is dropped.

A run whose characters are all clusters of their own goes through the tokenizers library: a unigram model that has 1 as every
word's cost takes the cheapest way, and the longest last word of equal ones, so words and run are given to it backwards. Other
runs, and those of LONGEST characters and more, where its costs would not be exact, go through the lattice below.

The dictionary is bounded as `entities.collected` says; words of it that hold white space are left out. Texts are neither
shuffled nor cut; a run is held whole with its lattice. Null and empty texts have no words.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from silkloom.functions import thai
from silkloom.operators.entities import collected

#: Code points of the Thai block: vowels that stand before their consonant; vowels and marks that belong to what stands before
#: them, combining marks of other scripts included.
_LEADS, _FOLLOWS = (0xE40, 0xE44), ((0xE30, 0xE3A), (0xE45, 0xE45), (0xE47, 0xE4E), (0x300, 0x36F))
_THAI = re.compile("[\u0e00-\u0e7f]")
RUN = re.compile(r"\S+")
#: Characters that may make a cluster with their neighbours, or a script of its own.
_CLUSTERED = re.compile("[\u0300-\u036f\u0e00-\u0e7f]")
#: Cost of an unknown character, more than any number of words; with fewer than LONGEST characters sums are exact in a double.
_UNKNOWN, LONGEST = float(1 << 31), 1 << 20


def borders(run: str) -> list[int]:
    """Where the character clusters of a run begin."""
    points = np.frombuffer(run.encode("utf-32-le"), np.uint32)
    starts = np.ones(len(points), bool)
    for low, high in _FOLLOWS:
        starts &= (points < low) | (points > high)
    lead = (points >= _LEADS[0]) & (points <= _LEADS[1])
    starts[1:] &= ~lead[:-1] | lead[1:]
    starts[:1] = True
    return np.flatnonzero(starts).tolist()


class Segmenter:
    """Words of a run by the lattice of a dictionary's words."""

    def __init__(self, words: list[str]):
        self.known = sorted({w for w in words if w and not any(c.isspace() for c in w)})
        # The piece of unknown characters is one that no run holds.
        self.model = Tokenizer(models.Unigram([(" ", -_UNKNOWN), *((w[::-1], -1.0) for w in self.known)], unk_id=0))

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for w in self.known:
            found.add_word(w, len(w))
        if len(found):
            found.make_automaton()
        return found

    def words(self, text: str | None) -> list[tuple[str, bool]]:
        """(word, whether the dictionary has it) of a text."""
        return [w for run in RUN.finditer(text or "") for w in self.run(run[0])]

    def run(self, run: str) -> list[tuple[str, bool]]:
        if len(run) >= LONGEST or _CLUSTERED.search(run):
            return self.lattice(run)
        got = self.model.encode(run[::-1], add_special_tokens=False)
        return [(w[::-1], i != 0) for w, i in zip(reversed(got.tokens), reversed(got.ids))]

    def lattice(self, run: str) -> list[tuple[str, bool]]:
        n = len(run)
        starts = borders(run)
        border = bytearray(n + 1)
        for i in starts:
            border[i] = 1
        border[n] = 1
        sizes: dict[int, list[int]] = {}
        for last, size in self.automaton.iter(run) if len(self.automaton) else ():
            if border[last + 1] and border[start := last + 1 - size]:
                sizes.setdefault(start, []).append(size)
        # From the end: what the best way on costs, an unknown character more than any number of words, and its first step; a
        # step below 0 is an unknown cluster.
        cost, step, after = [0] * (n + 1), [0] * n, n
        for i in reversed(starts):
            best, chosen = cost[after] + (after - i << 32), i - after
            for size in sizes.get(i, ()):
                if cost[i + size] < best:  # sizes grow, so a longer word wins a tie
                    best, chosen = cost[i + size] + 1, size
            cost[i], step[i], after = best, chosen, i
        found: list[tuple[str, bool]] = []
        i = 0
        while i < n:
            size = step[i]
            if size > 0:
                found.append((run[i : i + size], True))
            else:
                size = -size
                piece = run[i : i + size]
                if found and not found[-1][1] and bool(_THAI.match(found[-1][0])) == bool(_THAI.match(piece)):
                    found[-1] = (found[-1][0] + piece, False)
                else:
                    found.append((piece, False))
            i += size
        return found


def segment(texts: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", word: str = "word") -> DataFrame:
    """key, words (array), unknown (how many of them the dictionary does not have)."""
    listed = [w for (w,) in collected(dictionary, word)]

    def run(batches):
        segmenter = Segmenter(listed)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [segmenter.words(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([[w for w, _ in x] for x in found], pa.list_(pa.string())), pa.array([sum(not k for _, k in x) for x in found], pa.int32())], names=["key", "words", "unknown"])

    chosen = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"key {chosen.schema['key'].dataType.simpleString()}, words array<string>, unknown int").withColumnRenamed("key", key)


def spaced(words: Column | str) -> Column:
    """The words as a text with spaces, as the Thai measures and repairs read it."""
    return F.array_join(words, " ")


def fix_common_errors(words: Column | str) -> Column:
    """The repairs of `thai.fix_common_errors` on a text whose words have been set apart."""
    return thai.fix_common_errors(spaced(words))


def tonal_metrics(words: Column | str) -> Column:
    """The tone measures by the dictionary's words."""
    return thai.tonal_metrics(spaced(words))
