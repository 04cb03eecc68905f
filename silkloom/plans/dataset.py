"""The quality pipeline over a dataset, and runs of generation tasks with checkpoints."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkloom.functions import thai
from silkloom.functions.responses import critic_prompt, generator_prompt
from silkloom.operators import metrics, validate
from silkloom.operators.graph import Answer, coverage, empty_graph, expand, key_concepts
from silkloom.services import ask
from silkloom.sources.sinks import read_report, save_dataset, write_report


@dataclass(frozen=True)
class QualityConfig:
    min_quality_score: float = 0.8
    max_error_rate: float = 0.1
    max_retries: int = 3
    enable_dual_validation: bool = True
    enable_semantic_expansion: bool = True
    enable_thai_specific: bool = True


def _row(df: DataFrame) -> dict:
    return df.first().asDict(recursive=True)


def thai_analysis(samples: DataFrame, text: str = "text") -> DataFrame:
    """samples with tonal, orthography and formality structs."""
    return samples.withColumns({"tonal": thai.tonal_metrics(text), "orthography": thai.orthography(text), "formality": thai.formality(text)})


def process_dataset(samples: DataFrame, task: str, key: str = "id", config: QualityConfig | None = None, client: Callable[[str], str | None] | None = None, answer: Answer | None = None) -> dict:
    """The report of a dataset: validation, metrics, thai_analysis, semantics, summary and recommendations.

    Only one-row results reach the driver. Without a client there is no dual validation, without an answerer no
    semantic expansion.
    """
    config = config or QualityConfig()
    samples = samples.persist()
    try:
        report: dict = {"validation": {"basic_validation": _row(validate.validate_dataset(samples, task, key))}, "metrics": {}}
        text = next((c for c in ("text", "article", "context") if c in samples.columns), None)
        if config.enable_dual_validation and client and text:
            whole = F.to_json(F.struct(*samples.columns))
            generator, critic = (ask(samples.select(key, prompt(whole, task).alias("prompt")), client).select(key, F.col("response").alias(name)) for prompt, name in ((generator_prompt, "generator_response"), (critic_prompt, "critic_response")))
            scored = validate.dual_validation(generator.join(critic, key))
            report["validation"]["dual_validation"] = _row(validate.dual_advice(validate.overall_scores(scored)))
        if text:
            report["metrics"]["text_diversity"] = _row(metrics.text_diversity(samples, text))
        if "label" in samples.columns:
            report["metrics"]["class_balance"] = _row(metrics.class_balance(samples))
        if task in ("ner", "token_classification"):
            report["metrics"]["entity_coverage"] = _row(metrics.coverage_summary(samples))
        if task == "summarization":
            report["metrics"]["summarization_quality"] = _row(metrics.summarization_quality(samples))
        wrong = {"m": 0, "t": 0}
        if config.enable_thai_specific and text:
            found = thai_analysis(samples.select(F.col(text).alias("text")))
            wrong = _row(found.agg(F.coalesce(F.sum(F.size("orthography.misspellings")), F.lit(0)).alias("m"), F.coalesce(F.sum(F.size("orthography.double_tone_instances")), F.lit(0)).alias("t")))
            report["thai_analysis"] = {"misspellings": wrong["m"], "double_tones": wrong["t"], **_row(metrics.style_clusters(samples, text))}
        if config.enable_semantic_expansion and answer and text:
            nodes, edges = expand(*empty_graph(samples.sparkSession), key_concepts(samples, text), answer)
            report["semantics"] = _row(coverage(nodes, edges))
        dual = report["validation"].get("dual_validation", {}).get("average_score")
        unique = report["metrics"].get("text_diversity", {}).get("uniqueness_ratio")
        valid = report["validation"]["basic_validation"]["validity_ratio"]
        one = samples.sparkSession.range(1)
        scores = [F.lit(v).cast("double") for v in (valid, dual, unique)]
        report["summary"] = _row(one.select(*metrics.quality_summary(*scores, config.min_quality_score))) | {"quality_scores_breakdown": {"validation_score": valid, "dual_validation_score": dual, "diversity_score": unique}}
        score, gini = report["summary"]["overall_quality_score"], report["metrics"].get("class_balance", {}).get("gini_impurity")
        said = metrics.dataset_advice(F.lit(score), F.lit(gini).cast("double"), F.lit(unique).cast("double"), F.lit(wrong["m"]), F.lit(wrong["t"]), config.min_quality_score)
        report["recommendations"] = list(one.select(said.alias("r")).first()["r"])
        return report
    finally:
        samples.unpersist()


@dataclass(frozen=True)
class TaskConfig:
    task_type: str
    num_samples: int = 100
    min_quality_score: float = 0.8
    max_retries: int = 3
    output_dir: str = "datasets"
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class TaskResult:
    task_id: str
    task_type: str
    start_time: str
    end_time: str
    status: str
    dataset_path: str | None = None
    error: str | None = None
    quality_score: float | None = None
    recommendations: list[str] = field(default_factory=list)


class TaskLoop:
    """Runs tasks one by one; each makes samples, saves them and is retried while its score is below the least.

    make(config, attempt) returns (samples, task, key). Results are kept in a report under the checkpoint path; a
    task whose id has succeeded is not run again.
    """

    def __init__(self, spark: SparkSession, make: Callable[[TaskConfig, int], tuple[DataFrame, str, str]], checkpoint: str, quality: QualityConfig | None = None, pause: float = 0.0):
        self.spark, self.make, self.checkpoint, self.quality, self.pause = spark, make, checkpoint, quality or QualityConfig(), pause
        self.results: dict[str, TaskResult] = {}

    def load(self) -> None:
        self.results = {k: TaskResult(**v) for k, v in read_report(self.spark, self.checkpoint).items()}

    def save(self) -> None:
        write_report(self.spark, self.checkpoint, {k: asdict(v) for k, v in self.results.items()})

    def run_task(self, config: TaskConfig, task_id: str | None = None) -> TaskResult:
        task_id = task_id or f"{config.task_type}_{uuid.uuid4().hex[:12]}"
        if (done := self.results.get(task_id)) and done.status == "success":
            return done
        now = lambda: datetime.now(timezone.utc).isoformat()
        result = TaskResult(task_id, config.task_type, now(), now(), "failed")
        try:
            for attempt in range(config.max_retries):
                samples, task, key = self.make(config, attempt)
                report = process_dataset(samples, task, key, replace(self.quality, min_quality_score=config.min_quality_score))
                score = report["summary"]["overall_quality_score"]
                result = replace(result, quality_score=score, recommendations=report["recommendations"])
                if score >= config.min_quality_score:
                    path = save_dataset(samples, config.output_dir, config.task_type)
                    result = replace(result, status="success", dataset_path=path)
                    break
                time.sleep(self.pause)
        except Exception as e:  # noqa: BLE001  the loop goes on with the next task
            result = replace(result, status="error", error=f"{type(e).__name__}: {e}")
        self.results[task_id] = replace(result, end_time=now())
        self.save()
        return self.results[task_id]

    def run_tasks(self, configs: list[TaskConfig]) -> list[TaskResult]:
        return [self.run_task(c) for c in configs]

    def get_result(self, task_id: str) -> TaskResult | None:
        return self.results.get(task_id)

    def get_all_results(self) -> dict[str, TaskResult]:
        return dict(self.results)


def example_tasks() -> list[TaskConfig]:
    return [TaskConfig(t) for t in ("text_classification", "ner", "question_answering", "summarization", "translation")]


def generate_all(loop: TaskLoop, configs: list[TaskConfig], report_path: str) -> dict:
    """Run every task and write the status of each."""
    report = {r.task_id: {"task": r.task_type, "status": r.status, "score": r.quality_score, "path": r.dataset_path} for r in loop.run_tasks(configs)}
    write_report(loop.spark, report_path, report)
    return report
