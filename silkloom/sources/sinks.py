"""Writing datasets, reports and checkpoints of task runs."""

from __future__ import annotations

import html
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("json", "lines", "csv", "text", "parquet")


def _flat(samples: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return samples.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in samples.schema))


def save_dataset(samples: DataFrame, folder: str, task: str, format: str = "json", stamp: str | None = None) -> str:
    """Write samples under folder/task_stamp and return the path. json is one file with one array; lines and text are JSON
    lines, a file a task."""
    if format not in FORMATS:
        raise ValueError(f"unsupported format: {format}")
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    path = f"{folder.rstrip('/')}/{task}_{stamp}"
    if format == "json":
        return save_array(samples, f"{path}.json")
    if format == "csv":
        _flat(samples).write.option("header", True).csv(path)
    elif format == "parquet":
        samples.write.parquet(path)
    else:
        samples.write.json(path)
    return path


def save_array(samples: DataFrame, path: str) -> str:
    """One JSON array in one file, in the order of the rows (of `orderBy`, where there is one); fields that are null stay.

    Every task writes its rows as a part; the driver then copies the parts, in order and a buffer at a time, into the file,
    which appears under its name only when it is whole. No rows pass through the driver's memory.
    """
    spark = samples.sparkSession
    parts, unfinished = f"{path}.parts", f"{path}.unfinished"
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in samples.columns)), {"ignoreNullFields": "false"})
    samples.select(F.concat(F.lit(","), row).alias("value")).write.mode("overwrite").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(conf)
    out = fs.create(at(unfinished), True)
    try:
        out.write(ord("["))
        first = True
        found = [f for f in fs.listStatus(at(parts)) if f.getPath().getName().startswith("part-") and f.getLen()]
        for f in sorted(found, key=lambda f: f.getPath().getName()):
            part = fs.open(f.getPath())
            try:
                if first:
                    part.read()  # the comma before the first row
                first = False
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
        out.write(ord("]"))
    finally:
        out.close()
    fs.delete(at(path), False)
    fs.rename(at(unfinished), at(path))
    fs.delete(at(parts), True)
    return path


def save_splits(samples: DataFrame, folder: str, split: str = "split") -> None:
    """Parquet and CSV, a folder for each split."""
    samples.write.partitionBy(split).parquet(f"{folder}/parquet")
    _flat(samples).write.partitionBy(split).option("header", True).csv(f"{folder}/csv")


def with_quality(samples: DataFrame, scores: dict[str, float | None], split: str = "split") -> DataFrame:
    """Scores that are not None as constant quality_* columns of the train split."""
    new = {f"quality_{k}": F.when(F.col(split) == "train", F.lit(float(v))) for k, v in scores.items() if v is not None}
    return samples.withColumns(new) if new else samples


def save_text(texts: DataFrame, path: str, text: str = "text") -> None:
    texts.select(text).write.text(path)


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """A small JSON document, through Spark's file systems."""
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path).collect()  # one line
    return json.loads(rows[0]["value"]) if rows else {}


DESCRIPTIONS = {
    "vocabulary_size": "Number of distinct words",
    "total_words": "Number of words",
    "type_token_ratio": "Distinct words over words",
    "hapax_legomena": "Words that occur once",
    "avg_sentence_length": "Mean words a text",
    "std_sentence_length": "Standard deviation of words a text",
    "redundancy_rate": "Share of text pairs that are near duplicates",
    "near_duplicate_pairs": "Pairs of texts above the similarity threshold",
}


def to_report(metrics: dict, format: str = "markdown") -> str:
    """A report with a heading, a description and the value of each metric. metrics is a row's asDict()."""
    if format not in ("markdown", "html"):
        raise ValueError(f"unsupported format: {format}")
    rows = [(k, DESCRIPTIONS.get(k, "No description available."), v) for k, v in metrics.items()]
    chart = "(Visualizations are available through the web interface)"
    if format == "markdown":
        body = "".join(f"### {k}\n{d}\n\nValue: {v}\n\n" for k, d, v in rows)
        return f"# Data Analysis Report\n\n## Metrics\n\n{body}## Visualizations\n\n{chart}\n\n"
    body = "".join(f"<h3>{html.escape(k)}</h3><p>{html.escape(d)}</p><p>Value: {html.escape(str(v))}</p>" for k, d, v in rows)
    return f"<h1>Data Analysis Report</h1><h2>Metrics</h2>{body}<h2>Visualizations</h2><p>{chart}</p>"
