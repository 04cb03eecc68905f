"""License scans by a positional index of rare tokens.

Words are lower-cased (A-Z only) and taken as runs of letters, digits and non-ASCII characters. Every template
(a short phrase, or a passage that names a licence) is posted under its rarest words: the ones of highest IDF
over all documents, ties by the word. A document is scanned for posted words only; each hit names an alignment
(template, start = position - relative position). Alignments that enough rare words agree on are candidates,
and a candidate counts only if all mandatory key phrases of its template stand at their places. For a base
phrase every word is posted and mandatory, so the alignments are exactly the places where the phrase stands.

Null texts are empty: no words, no labels, null first and last word. Whole texts are scanned, without caps.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkloom.llm.common import sliced

#: Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Passages of public licence texts, lower case without punctuation, with the label they give.
#: Mandatory key phrases are marked by double slashes.
PASSAGES = {
    "mit": "//permission is hereby granted free of charge// to any person //obtaining a copy// of this software and associated documentation files",
    "apache": "licensed under the apache license version 2 0 the license //you may not use this file except in compliance with the license//",
    "gpl": "this program is free software //you can redistribute it and or modify it// under the terms of the //gnu general public license//",
    "lgpl": "you can redistribute it and or modify it under the terms of the //gnu lesser general public license//",
    "agpl": "you can redistribute it and or modify it under the terms of the //gnu affero general public license//",
    "bsd": "//redistribution and use in source and binary forms// with or without modification are permitted provided that",
    "mpl": "this source code form is subject to the terms of the //mozilla public license//",
    "isc": "//permission to use copy modify and or distribute this software// for any purpose with or without fee is hereby granted",
    "cc": "this work is licensed under a //creative commons// attribution",
    "cc-by": "licensed under //cc by 4 0//",
    "cc-by-nc": "licensed under //cc by nc 4 0//",
    "unlicense": "this is free and unencumbered software //released into the public domain//",
}

#: Bytes of the UTF-8 form that are no part of a word become spaces; A-Z are lower-cased before.
_BREAK = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))



@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    must: tuple[int, ...]  # positions of mandatory words
    base: bool


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_BREAK).split() if text else []


def templates() -> list[Template]:
    found = [Template(label, tuple(p.encode().split()), tuple(range(len(p.split()))), True) for p, label in BASE_PHRASES.items()]
    for label, text in PASSAGES.items():
        words, must = [], []
        for k, part in enumerate(text.split("//")):
            for w in part.split():
                must += [len(words)] * (k % 2)
                words.append(w.encode())
        found.append(Template(label, tuple(words), tuple(must), False))
    return found


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and in how many each vocabulary word stands; counted over all documents."""
    vocab = frozenset(vocabulary)

    def run(batches):
        seen, n = Counter(), 0
        for b in sliced(batches):
            for t in b.column(0).to_pylist():
                n += 1
                seen.update(vocab.intersection(words_of(t)))
        yield pa.RecordBatch.from_pydict({"word": [None, *(w.decode() for w in seen)], "n": [n, *seen.values()]}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"].encode(): r["n"] for r in rows if r["word"] is not None}
    return sum(r["n"] for r in rows if r["word"] is None), df


class RareIndex:
    """Postings word -> [(template, relative position)] for the `rare` rarest words of each template."""

    def __init__(self, found: list[Template], n_docs: int, df: dict[bytes, int], rare: int = 4, agree: float = 0.5):
        self.templates, self.agree = found, agree
        self.idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) for t in found for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.need = []
        for k, t in enumerate(found):
            ranked = sorted(set(t.words), key=lambda w: (-self.idf[w], w))[: len(t.words) if t.base else rare]
            own = [(w, i) for i, w in enumerate(t.words) if w in ranked]
            self.need.append(len(own) if t.base else max(2, math.ceil(len(own) * agree)))
            for w, i in own:
                self.postings.setdefault(w, []).append((k, i))
        self.rare_words = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of its words that stand at their places) of each verified alignment."""
        if self.rare_words.isdisjoint(words):
            return []
        votes: Counter = Counter()
        for p, w in enumerate(words):
            if w in self.rare_words:
                votes.update([(k, p - i) for k, i in self.postings[w]])
        found = []
        for (k, at), n in votes.items():
            t = self.templates[k]
            if n < self.need[k] or at < 0:
                continue
            there = words[at : at + len(t.words)]
            if all(i < len(there) and there[i] == t.words[i] for i in t.must):
                found.append((k, at, sum(a == b for a, b in zip(there, t.words)) / len(t.words)))
        return found


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", rare: int = 4) -> DataFrame:
    """keep columns, n_words, n_base, first_word, last_word, base_labels, labels, score and hits.

    hits lists every verified place (label, word, base, score). score is the best share of matched words over
    the hits: 1 for a base phrase or a whole passage, 0 without hits.
    """
    found = templates()
    n_docs, df = document_frequencies(docs, {w for t in found for w in t.words}, text)
    index = RareIndex(found, n_docs, df, rare)
    chosen = docs.select(*keep, docs[text].alias("__text"))
    hit = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text")
    schema += ", n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, hits array<struct<label:string,word:bigint,base:boolean,score:double>>"
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), hit]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "hits"]

    def run(batches):
        for b in sliced(batches):
            rows = []
            for t in b.column("__text").to_pylist():
                words = words_of(t)
                hits = sorted((at, found[k].label, found[k].base, s) for k, at, s in index.scan(words))
                base = [h for h in hits if h[2]]
                label = lambda some: ",".join(sorted({h[1] for h in some}))
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, label(base), label(hits), max((h[3] for h in hits), default=0.0), [{"label": h[1], "word": h[0], "base": h[2], "score": h[3]} for h in hits]))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=[*keep, *names])

    return chosen.mapInArrow(run, schema)
