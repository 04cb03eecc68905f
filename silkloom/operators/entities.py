"""Entity spans: every place where a name of a table stands in a text, found in one pass by an Aho-Corasick automaton, and the
share of the text that the union of the spans covers.

The table of names is bounded: at most NAMES of them and BYTES in all, else ValueError. It is read once by the driver and sent
to the tasks; texts are not shuffled. Spans may overlap, also those of one name; each is (start, end, type), in characters,
the end being the first one after it. A name with several types gives a span for each. With `whole_words` a name that begins
or ends in a letter, digit or underscore must not go on in one; scripts without spaces need it off. Null and empty texts have
no spans and a coverage of 0; null and empty names are left out.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkloom.operators.metrics import entity_coverage
from silkloom.storage import delete, stored

NAMES, BYTES = 500_000, 32_000_000
SPANS = "array<struct<start:int,end:int,type:string>>"


def collected(rows: DataFrame, *columns: str, most: int = NAMES, size: int = BYTES) -> list[tuple]:
    """The distinct rows of a small table on the driver, ValueError if it isn't small."""
    chosen = rows.select(*(F.col(c).cast("string") for c in columns)).where(F.col(columns[0]) != "").distinct()
    # Worked out once, and counted where it lies, before any of it comes to the driver.
    table, path = stored(chosen)
    try:
        n, used = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(columns[0])), F.lit(0))).first()
        if n > most or used > size:
            raise ValueError(f"{n} rows of {used} bytes; at most {most} of {size} are sent to the tasks")
        return [tuple(r) for r in table.collect()]
    finally:
        delete(rows.sparkSession, path)


def _of_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Finder:
    """Spans of the names in a text."""

    def __init__(self, names: list[tuple[str, str | None]], whole_words: bool = True):
        self.whole, self.automaton = whole_words, ahocorasick.Automaton()
        types: dict[str, list[str | None]] = {}
        for name, kind in names:
            types.setdefault(name, []).append(kind)
        for name, kinds in types.items():
            self.automaton.add_word(name, (len(name), sorted(kinds, key=lambda k: (k is not None, k or ""))))
        if names:
            self.automaton.make_automaton()

    def _apart(self, text: str, start: int, end: int) -> bool:
        before = start and _of_word(text[start]) and _of_word(text[start - 1])
        return not before and not (end < len(text) and _of_word(text[end - 1]) and _of_word(text[end]))

    def spans(self, text: str | None) -> list[dict]:
        if not text or not len(self.automaton):
            return []
        found = []
        for last, (size, kinds) in self.automaton.iter(text):
            start, end = last + 1 - size, last + 1
            if not self.whole or self._apart(text, start, end):
                found += [{"start": start, "end": end, "type": k} for k in kinds]
        return found


def find_entities(texts: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name: str = "name", kind: str = "type", whole_words: bool = True) -> DataFrame:
    """key, entities, coverage: one row a text; entities by their ends, those that end together longest first."""
    table = collected(names, name, kind)

    def run(batches):
        finder = Finder(table, whole_words)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                told = pa.array([finder.spans(t.as_py()) for t in part.column("text")], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())])))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n"), told], names=["key", "n", "entities"])

    chosen = texts.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.length(text), F.lit(0)).alias("n"))
    found = chosen.mapInArrow(run, f"key {chosen.schema['key'].dataType.simpleString()}, n int, entities {SPANS}")
    return found.select(F.col("key").alias(key), "entities", entity_coverage(F.col("entities"), F.col("n")).alias("coverage"))
