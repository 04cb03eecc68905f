"""Language identification by error-correcting output codes.

Each language has a codeword; every bit of the code is predicted by one binary linear classifier over hashed
byte n-grams (1 to 4 bytes of the lower-cased text, white space runs as one space). Decoding is loss-weighted:
a language costs the sum over bits of the bit's weight times the logistic loss of its margin against the
codeword, and the cheapest language wins. The score is the softmax of the negative costs (0 to 1); `ambiguous`
says that the two cheapest languages are closer than a margin.

The classifiers are fitted on the driver on a bounded sample of FEATURES 2-byte floats a row: SAMPLE rows in all, and at
most PER_LANGUAGE of each language, chosen by a hash of the id. At most LANGUAGES languages are learned, those with the
most labelled documents (ties: the lesser name), so junk tags cost the driver nothing. Prediction reads every whole text
and nothing else.

Texts that are null or have no letter (Unicode category L) are `und` with score 0; so is everything if nothing was
labelled. With one language learned, it is the prediction of every text with a letter. Languages of equal cost go to
the lesser name. Repeated rows give repeated results; all rows of an id are held out or none. Empty tables give empty
results. Other columns are not read by `identify`, whatever their names; `predict` replaces clashing ones.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkloom.llm.common import sliced

FEATURES = 8192
PER_LANGUAGE, SAMPLE, LANGUAGES = 700, 6000, 128
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(2654435761)


def counts(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams over the whole text."""
    data = np.frombuffer(b" " + b" ".join(text.lower().encode().split()) + b" ", np.uint8).astype(np.uint32)
    total, gram = np.zeros(FEATURES, np.int64), np.zeros(len(data), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        gram = (gram[:-1] << np.uint32(8) | data[n - 1 :]) if n > 1 else data
        if not len(gram):
            break
        if n in ORDERS:
            total += np.bincount((gram * _MIX ^ np.uint32(n * 0x3C6EF372)) * _MIX >> np.uint32(19), minlength=FEATURES)
    return total


def features(text: str) -> np.ndarray:
    """Square-rooted counts at unit length."""
    x = np.sqrt(counts(text).astype(np.float32))
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each of n classes: the exhaustive code up to 6 classes, else a random code of
    10 log2 n bits that keeps its rows apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        cols = [(1, *c) for c in itertools.product((-1, 1), repeat=n - 1) if -1 in c]
        return np.array(cols, np.int8).T
    rng, width, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = min((a != b).sum() for a, b in itertools.combinations(code, 2))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def decode(self, x: np.ndarray) -> tuple[int, float, float]:
        """Index of the language, its score and its lead over the next."""
        margins = x @ self.weights + self.bias
        cost = (np.logaddexp(0, -self.code * margins) * self.trust).sum(axis=1)
        p = np.exp(cost.min() - cost)
        p /= p.sum()
        best = int(np.argmin(cost))
        rest = np.delete(p, best)
        return best, float(p[best]), float(p[best] - (rest.max() if len(rest) else 0))


def train(x: np.ndarray, y: list[str], steps: int = 300, rate: float = 4.0, decay: float = 1e-5) -> Model:
    """One logistic classifier a bit, classes balanced, by gradient steps with momentum."""
    languages = sorted(set(y))
    code = codewords(len(languages))
    index = np.array([languages.index(v) for v in y], np.int64)
    share = (1 / np.maximum(np.bincount(index, minlength=len(languages)), 1))[index].astype(np.float32)
    share /= max(float(share.sum()), 1e-9)
    goal = code[index].astype(np.float32) if len(index) else np.zeros((0, code.shape[1]), np.float32)
    x = x.astype(np.float32, copy=False)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps if len(languages) > 1 else 0):
        g = -goal / (1 + np.exp(np.clip(goal * (x @ w + b), -30, 30))) * share[:, None]
        vw = 0.9 * vw - rate * (x.T @ g + decay * w)
        vb = 0.9 * vb - rate * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = (share[:, None] * (np.sign(x @ w + b) == goal)).sum(axis=0) if len(languages) > 1 else np.ones(code.shape[1])
    wrong = np.clip(1 - right, 1e-3, 0.49)
    trust = np.log((1 - wrong) / wrong)
    return Model(languages, code, w, b, trust * len(trust) / max(trust.sum(), 1e-9))


def fit(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on usable rows with a label and a letter: of each language those whose hash of the key is below the share that
    gives about per_language rows, or an equal part of SAMPLE if that is less."""
    ok = usable & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}")
    named = docs.where(usable).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where("lang is not null")
    sizes = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return train(np.zeros((0, FEATURES), np.float32), [])
    each = min(per_language, SAMPLE // len(sizes))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in sizes], "lang string, share double")
    at = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)

    def run(batches):
        for b in sliced(batches):
            rows = [features(t).astype(np.float16).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["lang", "x"])

    chosen = docs.where(ok).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).join(F.broadcast(shares), "lang").where(at < F.col("share"))
    got = chosen.select("lang", "text").mapInArrow(run, "lang string, x binary").toArrow()
    if not got.num_rows:
        return train(np.zeros((0, FEATURES), np.float32), [])
    # Ordered by its bytes, so that the fit does not depend on how the rows were spread; held once as Arrow has it and once as numbers.
    order = pc.sort_indices(got, [("lang", "ascending"), ("x", "ascending")]).to_numpy()
    names, found = got.column("lang").to_pylist(), got.column("x")
    x = np.empty((len(order), FEATURES), np.float32)
    for row, at in enumerate(order):
        x[row] = np.frombuffer(found[at].as_buffer(), np.float16)
    del got, found
    pa.default_memory_pool().release_unused()
    return train(x, [names[at] for at in order])


def prediction(model: Model, text: Column | str = "text", lead: float = 0.2) -> Column:
    """Struct (lang_pred, score, ambiguous: the lead over the next language is below `lead`) of a text column."""

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def said(texts: pa.Array) -> pa.Array:
        rows = []
        for t in (t for start in range(0, len(texts), 512) for t in texts.slice(start, 512).to_pylist()):
            if has_letter(t) and model.languages:
                best, score, ahead = model.decode(features(t))
                rows.append({"lang_pred": model.languages[best], "score": score, "ambiguous": ahead < lead})
            else:
                rows.append({"lang_pred": UNKNOWN, "score": 0.0, "ambiguous": True})
        return pa.array(rows, pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())]))

    return said(text)


def predict(docs: DataFrame, model: Model, text: str = "text", lead: float = 0.2) -> DataFrame:
    """docs with lang_pred, score and ambiguous; columns of these names are replaced."""
    told = docs.withColumn("__said", prediction(model, text, lead)).drop("lang_pred", "score", "ambiguous")
    return told.select("*", "__said.*").drop("__said")


def held_out(key: str = "doc_id") -> Column:
    """The quarter of the ids that is never learned from."""
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score, ambiguous; learned from the documents that are not held out."""
    model = fit(docs, ~F.coalesce(held_out(key), F.lit(True)), key, text, lang)
    found = docs.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), prediction(model, text).alias("said"))
    return found.select(key, "held_out", "said.*")
