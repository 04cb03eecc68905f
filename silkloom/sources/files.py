"""Reading local or distributed files: plain, CoNLL and JSON text, and documents by extension."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silkloom.functions.text import WS_CHARS, strip, tokens
from silkloom.operators.augment import sample_rows
from silkloom.operators.metrics import corpus_metadata

DATA_TYPE = "text"
#: White space within a line.
_BLANK = f"[{WS_CHARS}&&[^\n]]"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def conll_blocks(content: Column) -> Column:
    """The blocks of a CoNLL text: stripped lines between blank ones, joined by a newline."""
    # White space at either end of a line goes in one pass over the text, not line by line.
    joined = F.regexp_replace(F.regexp_replace(content, "\r\n|\r", "\n"), rf"(?<![^\n]){_BLANK}++|(?<!{_BLANK}){_BLANK}++(?![^\n])", "")
    return F.filter(F.transform(F.split(joined, "\n{2,}"), strip), lambda b: b != "")


def json_items(content: Column) -> Column:
    """The items of a JSON text as text: of a list its items, of an object its values, else the one value. Strings are
    given without quotes, nested values as JSON."""
    parsed = F.try_parse_json(content)
    as_list, as_map = F.try_variant_get(parsed, "$", "array<variant>"), F.try_variant_get(parsed, "$", "map<string,variant>")
    items = F.coalesce(as_list, F.map_values(as_map), F.when(parsed.isNotNull(), F.array(parsed)))
    return F.transform(items, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def array_item(content: Column) -> Column:
    """The text of one item of a JSON array, as an array of one."""
    return json_items(F.concat(F.lit("["), content, F.lit("]")))


def plain_lines(content: Column) -> Column:
    """The lines of a text that aren't blank, stripped."""
    return F.filter(F.transform(F.split(content, "\r\n|\r|\n"), strip), lambda x: x != "")


@dataclass(frozen=True)
class TextFormat:
    """How samples lie in a file: `pieces` turns a unit of it into an array of samples. The unit is a line, a block (lines
    between blank ones), an item of one JSON array, or the whole file. All but whole files are split among tasks, whatever
    their size."""

    pieces: Callable[[Column], Column]
    unit: str = "file"


#: Known formats by name; `register` adds to them.
FORMATS: dict[str, TextFormat] = {"plain": TextFormat(plain_lines, "line"), "conll": TextFormat(conll_blocks, "block"), "json": TextFormat(json_items), "array": TextFormat(array_item, "item")}


def register(name: str, format: TextFormat) -> None:
    """Let `load_text` read files of a caller's format."""
    if format.unit not in ("line", "block", "item", "file"):
        raise ValueError(f"unknown unit: {format.unit}")
    FORMATS[name] = format


_HEAD, _TAIL, _ALL = 1, 2, 3
_CUT = "path string, start long, edge int, unit string"


class _Cutter:
    """Units of the splits of files, whose pieces (lines, or what stands between commas) come in order.

    What lies before the first end of a unit in a split and after the last one may go on in the splits beside it: such edges
    are marked, and null where they have no piece. A split in which no unit ends is one edge. `inner` asks for units of the one
    kind only.
    """

    def __init__(self, separator: str, inner: bool | None = None):
        self.inner, self.separator, self.split, self.pieces, self.cut, self.found = inner, separator, None, [], False, []

    def _add(self, edge: int) -> None:
        if self.inner is None or self.inner == (edge == 0):
            self.found.append((*self.split, edge, self.separator.join(self.pieces) if self.pieces else None))
        self.pieces = []

    def at(self, path: str, start: int) -> bool:
        """Whether a piece of this split is the first one of it."""
        if (path, start) == self.split:
            return False
        self.close()
        self.split, self.cut = (path, start), False
        return True

    def end(self) -> None:
        """A unit ends after the last piece."""
        if self.pieces or not self.cut:
            self._add(0 if self.cut else _HEAD)
        self.cut = True

    def close(self) -> None:
        if self.split:
            self._add(_TAIL if self.cut else _ALL)

    def batch(self) -> pa.RecordBatch:
        found, self.found = self.found, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 4, (pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["path", "start", "edge", "unit"])


def _rows(batch):
    return zip(*(batch.column(c).to_pylist() for c in ("path", "start", "value")))


#: First bytes of the characters that are white space.
_LEADS = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])


def _blank(lines: pa.Array) -> np.ndarray:
    """Which lines hold white space only."""
    raw = lines.cast(pa.large_string())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    found = at[1:] == at[:-1]
    some = np.flatnonzero(~found)
    if len(some):
        some = some[_LEADS[np.frombuffer(raw.buffers()[2], np.uint8)[at[some]]]]
        found[some] = [not x.strip() for x in lines.take(pa.array(some)).to_pylist()]
    return found


def _cut_at_blanks(inner: bool):
    """The inner blocks of the splits, or their edges. Lines are joined by Arrow; Python sees blocks."""

    def run(batches):
        cutter = _Cutter("\n", inner)
        for b in batches:
            if not b.num_rows:
                continue
            path, start, lines = (b.column(c) for c in ("path", "start", "value"))
            starts, blank, first = start.to_numpy(), _blank(lines), np.ones(b.num_rows, bool)
            first[1:] = (starts[1:] != starts[:-1]) | pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False)
            begins = ~blank & (first | np.concatenate([[True], blank[:-1]]))
            kept = lines.filter(pa.array(~blank))
            ends = [*(np.cumsum(~blank) - 1)[begins].tolist(), len(kept)]
            pieces = iter(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kept), "\n").to_pylist())
            for i in np.flatnonzero(first | blank | begins).tolist():
                if first[i]:
                    cutter.at(path[i].as_py(), int(starts[i]))
                if blank[i]:
                    cutter.end()
                else:
                    cutter.pieces.append(next(pieces))
            yield cutter.batch()
        cutter.close()
        yield cutter.batch()

    return run


def _outside(piece: str) -> tuple[int, int, int]:
    """What a piece between two commas of a JSON text does: 1 if it opens or closes a string, and by how much it nests deeper
    if it begins outside a string, and inside one."""
    quoted = (re.sub(r"\\.", "", piece, flags=re.DOTALL) if "\\" in piece else piece).split('"')
    deeper = [0, 0]
    for i, part in enumerate(quoted):
        deeper[i % 2] += part.count("[") + part.count("{") - part.count("]") - part.count("}")
    return (len(quoted) - 1) % 2, deeper[0], deeper[1]


def _summed(batches):
    """Of each split, for a beginning outside and inside a string: whether it ends inside one, and how much deeper."""
    split, ends, deeper = None, [0, 1], [0, 0]
    found = []
    for b in batches:
        for path, start, piece in _rows(b):
            if (path, start) != split:
                found += [(*split, *ends, *deeper)] if split else []
                split, ends, deeper = (path, start), [0, 1], [0, 0]
            flip, *more = _outside(piece)
            deeper = [deeper[s] + more[ends[s]] for s in (0, 1)]
            ends = [end ^ flip for end in ends]
    found += [(*split, *ends, *deeper)] if split else []
    kinds = (pa.string(), pa.int64(), *[pa.int32()] * 2, *[pa.int64()] * 2)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 6, kinds)], names=["path", "start", "end0", "end1", "deeper0", "deeper1"])


def _cut_at_commas(begins: dict[tuple[str, int], tuple[int, int]]):
    """Items of JSON arrays, told in which state each split begins."""

    def run(batches):
        cutter = _Cutter(",")
        inside = depth = 0
        for b in batches:
            for path, start, piece in _rows(b):
                if cutter.at(path, start):
                    inside, depth = begins[path, start]
                flip, *more = _outside(piece)
                if not inside and not depth:  # the array's own bracket
                    piece = piece.lstrip().removeprefix("[")
                inside, depth = inside ^ flip, depth + more[inside]
                if not inside and not depth:
                    piece = piece.rstrip().removesuffix("]")
                cutter.pieces.append(piece)
                if not inside and depth == 1:
                    cutter.end()
            yield cutter.batch()
        cutter.close()
        yield cutter.batch()

    return run


def _units(inner: DataFrame, edges: DataFrame, separator: str) -> DataFrame:
    """c: the units of all splits. Inner ones as they are; the edges, two rows a split, are put together in order: a tail, splits
    in which no unit ends, and the head that ends them."""
    order = Window.partitionBy("path").orderBy("start", "edge")
    edges = edges.withColumn("nth", F.sum(F.when(F.col("edge") == _TAIL, 1).otherwise(0)).over(order))
    joined = edges.groupBy("path", "nth").agg(F.array_sort(F.collect_list(F.struct("start", "edge", "unit"))).alias("e"))
    whole = joined.select(F.array_join(F.filter(F.transform("e", lambda x: x["unit"]), lambda x: x.isNotNull()), separator).alias("c"))
    return inner.select(F.col("unit").alias("c")).unionByName(whole)


def _pieces(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    read = spark.read.text(path, lineSep=separator) if separator else spark.read.text(path)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """c: the blocks of lines between blank ones, of UTF-8 files that are split among tasks at any byte. The files are read
    twice, for the inner blocks and for the edges of the splits."""
    inner, edges = (_pieces(spark, path).mapInArrow(_cut_at_blanks(x), _CUT) for x in (True, False))
    return _units(inner, edges, "\n").where("c <> ''")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """c: the items, as JSON text, of files that hold one JSON array each, in UTF-8, split among tasks at any byte.

    Files are cut at commas. Whether a comma ends an item depends on all that stands before it in the file: in a string or not,
    and how deep. So a first pass sums up each split, for either way in which it may begin; the driver adds the sums (a row a
    split) and tells the second pass how each begins.
    """
    pieces = _pieces(spark, path, ",")
    begins: dict[tuple[str, int], tuple[int, int]] = {}
    before, state = None, (0, 0)
    for r in sorted(pieces.mapInArrow(_summed, "path string, start long, end0 int, end1 int, deeper0 long, deeper1 long").collect()):
        state = state if r["path"] == before else (0, 0)
        before, begins[r["path"], r["start"]] = r["path"], state
        state = (r["end1"], state[1] + r["deeper1"]) if state[0] else (r["end0"], state[1] + r["deeper0"])
    cut = pieces.mapInArrow(_cut_at_commas(begins), _CUT)
    return _units(cut.where("edge = 0"), cut.where("edge > 0"), ",").where(F.trim("c") != "")


def load_text(spark: SparkSession, path: str, format: str = "plain", encoding: str = "utf-8") -> DataFrame:
    """text: one row a sample. Raises FileNotFoundError and ValueError for a missing path and an unknown format.

    UTF-8 files of lines, blocks or items give the same rows whether one task reads them or fifty. Files in other encodings, and
    formats whose unit is the file, are read whole.
    """
    if format not in FORMATS:
        raise ValueError(f"unsupported format: {format}")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    how = FORMATS[format]
    if how.unit == "file" or encoding.lower().replace("-", "") != "utf8":
        units = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("c"))
    else:
        read = {"line": lambda s, p: s.read.text(p).select(F.col("value").alias("c")), "block": read_blocks, "item": read_items}[how.unit]
        units = read(spark, path)
    return units.select(F.explode(how.pieces(F.col("c"))).alias("text"))


def validate(samples: DataFrame, format: str = "plain", text: str = "text") -> DataFrame:
    """is_valid: every sample is there and, for CoNLL, every line of it that is not blank has two fields or more."""
    ok = F.col(text).isNotNull()
    if format == "conll":
        ok = ok & F.forall(F.split(text, "\n"), lambda line: (strip(line) == "") | (F.size(tokens(line)) >= 2))
    return samples.agg(F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(True)).alias("is_valid"))


def metadata(samples: DataFrame, format: str = "plain", text: str = "text") -> DataFrame:
    """n_samples, vocab_size, avg_length; of CoNLL the first column counts."""
    if format == "conll":
        first = F.transform(F.filter(F.split(text, "\n"), lambda line: strip(line) != ""), lambda line: F.get(tokens(line), 0))
        samples = samples.select(F.array_join(first, " ").alias(text))
    return corpus_metadata(samples, text)


def get_sample(samples: DataFrame, n: int, key: str) -> DataFrame:
    return sample_rows(samples, n, key)


def upload(spark: SparkSession, path: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """All samples of a .txt, .csv (taken as plain lines) or .json file, and the first n for a preview."""
    kind = "json" if path.lower().endswith(".json") else "plain"
    found = load_text(spark, path, kind)
    return found, found.limit(n)


#: The UUID namespace of URLs, as in RFC 4122.
_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def url_uuid(name: Column) -> Column:
    """UUID version 5 of a name in the namespace of URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), F.substr(variant, nibble % 4 + 1, F.lit(1)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _txt(data: bytes) -> str:
    return data.decode("utf-8")


def _docx(data: bytes) -> str:
    """Paragraphs of a .docx, joined by newlines."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def _pdf(data: bytes) -> str:
    try:
        import fitz
    except ImportError as e:
        raise ValueError("reading .pdf needs PyMuPDF on the executors") from e
    with fitz.open(stream=data, filetype="pdf") as doc:
        return "".join(page.get_text() for page in doc)


PARSERS: dict[str, Callable[[bytes], str]] = {".txt": _txt, ".docx": _docx, ".doc": _docx, ".pdf": _pdf}


def list_files(spark: SparkSession, folder: str, glob: str = "*", limit: int | None = None) -> DataFrame:
    """paper_id, title (base name), path, extension of the matching files, in path order."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    listed = found.select(url_uuid(F.col("path")).alias("paper_id"), name.alias("title"), "path", F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"))
    return listed if limit is None else listed.orderBy("path").limit(limit)


def read_documents(spark: SparkSession, folder: str, glob: str = "*", parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """paper_id, title, text, source, error: one row a file. Files that fail keep a null text and say why."""
    known = PARSERS | (parsers or {})

    @F.pandas_udf("struct<text:string,error:string>")
    def parse(extension: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = []
        for kind, body in zip(extension, data, strict=True):
            try:
                if kind not in known:
                    raise ValueError(f"unsupported file type: {kind}")
                rows.append((known[kind](body), None))
            except Exception as e:  # noqa: BLE001  a bad file is a row, not the end of the job
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    read = files.withColumn("p", parse(F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)), "content"))
    return read.select(url_uuid(F.col("path")).alias("paper_id"), name.alias("title"), "p.text", F.lit("local").alias("source"), "p.error")


def documents(spark: SparkSession, folder: str, glob: str = "*", limit: int | None = None) -> DataFrame:
    """paper_id, title, text, source of the files that hold text."""
    found = read_documents(spark, folder, glob).where("text <> ''").drop("error")
    return found if limit is None else found.orderBy("title", "paper_id").limit(limit)
