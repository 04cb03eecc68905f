"""Dictionary lookup with errors: a symmetric-delete index as an equi-join, then exact edit distance.

Two words at most d edits apart have a common string that each becomes by leaving out at most d characters. Every word is
listed under all such strings, words and dictionary are joined on them, and `levenshtein` decides. Words of up to SHORT
characters go this way; the strings of longer ones would be too many, so those are cut into d + 1 parts instead, of which d
edits leave one unchanged and at most d places from where it stood: a longer dictionary word is listed by its parts, and a
word looks for them at all those places. Both ways are exact; a pair of words goes the way of its dictionary word.

Nearly all strings of the words that are looked up are none of the dictionary's. A filter of a fixed size (one bit for each hash
of a dictionary string, 8 MB) drops most of them before they are shuffled; it never drops one that meets, and when a dictionary
is so large that it fills up, it only drops less.

The number of errors allowed grows with the word looked up: none below 3 characters, 1 up to 7, 2 from 8 on. Null and empty
words find nothing. Repeated words are looked up once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkloom.functions.text import WORD_CHARS, as_column
from silkloom.storage import ensure_checkpoint_dir

SHORT, ERRORS = 20, 2
#: Bits of the filter, and of one of its blocks (that of Spark's bitmap functions).
FILTER, BLOCK = 1 << 26, 32768


def allowed_errors(word: Column | str) -> Column:
    n = F.length(as_column(word))
    return F.when(n < 3, 0).when(n < 8, 1).otherwise(ERRORS)


def _without_one(word: Column) -> Column:
    """The word without each of its characters."""
    places = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.when(F.length(word) > 0, F.transform(places, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))).otherwise(F.array().cast("array<string>"))


def deletions(word: Column | str, errors: int) -> Column:
    """The word and what is left of it without up to `errors` characters, each once."""
    found = step = F.array(as_column(word))
    for _ in range(errors):
        step = F.array_distinct(F.flatten(F.transform(step, _without_one)))
        found = F.array_union(found, step)
    return found


def _bits(keys: DataFrame) -> np.ndarray:
    """FILTER bits, set at the keys' places: made by partial aggregation, 8 MB on the driver whatever their number."""
    place = F.pmod("key", F.lit(FILTER))
    of = keys.select((place / BLOCK).cast("long").alias("block"), (place % BLOCK).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(FILTER // 8, np.uint8)
    for r in of.collect():
        bits[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _met(bits: np.ndarray):
    """Rows whose key may be one of the dictionary's."""

    def run(batches):
        for b in batches:
            place = b.column("key").to_numpy() % FILTER
            yield b.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))

    return run


def _exploded(rows: DataFrame, keys: Callable[[Column, int], Column], errors: Column, word: str) -> DataFrame:
    """rows for each key of their word, as many errors allowed as told."""
    cases = F.when(errors == 0, keys(F.col(word), 0))
    for d in range(1, ERRORS + 1):
        cases = cases.when(errors == d, keys(F.col(word), d))
    return rows.select("*", F.explode(cases).alias("key")).withColumn("key", F.xxhash64("errors", "key"))


def _part_start(size: Column, part: int, errors: int) -> Column:
    return F.floor(size * part / (errors + 1)).cast("int")


def _parts(word: Column, errors: int) -> Column:
    """`errors:length:part:string` of the parts of a dictionary word."""
    size = F.length(word)
    found = []
    for p in range(errors + 1):
        start, end = _part_start(size, p, errors), _part_start(size, p + 1, errors)
        found.append(F.concat_ws(":", F.lit(errors), size, F.lit(p), F.substr(word, start + 1, end - start)))
    return F.array(*found)


def _places(word: Column, errors: int) -> Column:
    """The same of a word that is looked up, for all lengths and places that a dictionary word's parts may have."""
    found = []
    for longer in range(-errors, errors + 1):
        size = F.length(word) + longer
        for p in range(errors + 1):
            start, end = _part_start(size, p, errors), _part_start(size, p + 1, errors)
            for shift in range(-errors, errors + 1):
                at = start + shift
                fits = (size > SHORT) & (at >= 0) & (at + end - start <= F.length(word))
                found.append(F.when(fits, F.concat_ws(":", F.lit(errors), size, F.lit(p), F.substr(word, at + 1, end - start))))
    return F.array_distinct(F.array_compact(F.array(*found)))


def lookup(unknown: DataFrame, dictionary: DataFrame, word: str = "word", known: str = "known") -> DataFrame:
    """word, known, distance: for each distinct word all dictionary words within the errors allowed."""
    ensure_checkpoint_dir(unknown.sparkSession)  # the dictionary's keys are read twice
    asked = unknown.select(F.col(word).alias("word")).where("word <> ''").distinct().withColumn("errors", allowed_errors("word"))
    listed = dictionary.select(F.col(known).alias("known")).where("known <> ''").distinct()
    size = F.length("known")
    # A dictionary word may be as many errors away as the word that asks allows, which is not known here: all of them are listed.
    near = [listed.where(size <= SHORT).select("known", F.lit(d).alias("errors"), F.explode(deletions("known", d)).alias("key")) for d in range(ERRORS + 1)]
    far = [listed.where(size > SHORT).select("known", F.lit(d).alias("errors"), F.explode(_parts(F.col("known"), d)).alias("key")) for d in range(ERRORS + 1)]
    short = asked.where(F.length("word") <= SHORT + F.col("errors"))
    long = asked.where(F.length("word") > SHORT - F.col("errors"))
    pairs = []
    for words_, sides, keys in ((short, near, deletions), (long, far, _places)):
        # Keys travel as hashes: two keys of one hash give a pair more, which its distance rules out.
        side = sides[0].unionByName(sides[1]).unionByName(sides[2]).select("known", F.xxhash64("errors", "key").alias("key"))
        side = side.checkpoint()
        probes = _exploded(words_, keys, F.col("errors"), "word").select("word", "key").mapInArrow(_met(_bits(side)), "word string, key long")
        near_enough = probes.join(side, "key").withColumn("distance", F.levenshtein("word", "known")).where(F.col("distance") <= allowed_errors("word"))
        pairs.append(near_enough.select("word", "known", "distance"))
    return pairs[0].unionByName(pairs[1]).distinct()


def rare_and_frequent(texts: DataFrame, text: str = "text", rare: int = 2, frequent: int = 50) -> tuple[DataFrame, DataFrame]:
    """(word, n) of at most `rare` uses, and (known, n_known) of at least `frequent`: runs of letters and digits, lower-cased."""
    ensure_checkpoint_dir(texts.sparkSession)  # the counts are read several times
    counted = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD_CHARS}]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).checkpoint()
    return counted.where(F.col("n") <= rare), counted.where(F.col("n") >= frequent).select(F.col("word").alias("known"), F.col("n").alias("n_known"))


def suggest(texts: DataFrame, text: str = "text", rare: int = 2, frequent: int = 50) -> DataFrame:
    """word, n, suggestion, distance, n_suggestion: for each rare word the nearest frequent word, of these the most frequent,
    then the first; rare words without one are absent."""
    unusual, usual = rare_and_frequent(texts, text, rare, frequent)
    found = lookup(unusual, usual).join(usual, "known")
    best = found.groupBy("word").agg(F.min(F.struct("distance", (-F.col("n_known")).alias("less"), "known")).alias("b"))
    return best.join(unusual, "word").select("word", "n", F.col("b.known").alias("suggestion"), "b.distance", (-F.col("b.less")).alias("n_suggestion"))
