"""Making labelled samples of texts with a language model: prompts, schemas and handlers by task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkloom.operators.augment import sample_rows
from silkloom.services import ask, parse_samples


@dataclass(frozen=True)
class Task:
    """What a task asks for: an instruction, the schema of the JSON that answers it, and the fields that must be there."""

    name: str
    instruction: str
    schema: str
    required: tuple[str, ...]

    def prompt(self):
        """The prompt for a text, as a column."""
        head = f"{self.instruction}\nAnswer with one JSON object only, with the fields: {self.schema}\n\nText: "
        return F.concat(F.lit(head), F.col("text"))


def text_classification(classes: tuple[str, ...] = ("positive", "negative", "neutral")) -> Task:
    return Task("text_classification", f"Classify the text as one of: {', '.join(classes)}.", "text string, label string, label_id int, confidence double", ("text", "label", "label_id"))


def token_classification(types: tuple[str, ...] = ("PER", "ORG", "LOC", "DATE")) -> Task:
    spans = "array<struct<entity:string,type:string,start:int,end:int>>"
    return Task("ner", f"Find the entities of the types {', '.join(types)} in the text.", f"text string, tokens array<string>, tags array<string>, entities {spans}", ("text", "entities"))


def question_answering(n: int = 3) -> Task:
    return Task("question_answering", f"Write {n} questions that the text answers, with their answers.", "context string, questions array<struct<question:string,answer:string,answer_start:int>>", ("context", "questions"))


def summarization() -> Task:
    return Task("summarization", "Summarise the text.", "article string, summary string, metadata struct<compression_ratio:double,key_points:array<string>>", ("article", "summary"))


def translation(source: str = "en", target: str = "th") -> Task:
    return Task("translation", f"Translate the text from {source} to {target}.", "translation map<string,string>, metadata struct<quality:int,difficulty:int,register:string>", ("translation",))


def sentence_similarity() -> Task:
    return Task("sentence_similarity", "Take a sentence of the text and write another one; say how alike they are, from 0 to 1.", "sentence1 string, sentence2 string, score double", ("sentence1", "sentence2", "score"))


def fill_mask(mask: str = "[MASK]") -> Task:
    return Task("fill_mask", f"Take a sentence of the text, put {mask} in place of one word, and give that word.", "masked string, answer string", ("masked", "answer"))


def zero_shot_classification(labels: tuple[str, ...] = ("news", "opinion", "advice", "story")) -> Task:
    return Task("zero_shot_classification", f"Say which of these labels fits the text best: {', '.join(labels)}.", "text string, candidate_labels array<string>, label string", ("text", "candidate_labels", "label"))


def text_generation() -> Task:
    return Task("text_generation", "Write a prompt that the text would answer, and the text as its answer.", "prompt string, completion string", ("prompt", "completion"))


def text2text_generation() -> Task:
    return Task("text2text_generation", "Write an instruction about the text, the text as its input, and the result.", "instruction string, input string, output string", ("instruction", "input", "output"))


def feature_extraction() -> Task:
    return Task("feature_extraction", "List the key words and the topic of the text.", "text string, keywords array<string>, topic string", ("text", "keywords"))


TASKS: dict[str, Callable[..., Task]] = {
    f.__name__: f
    for f in (
        text_classification, token_classification, question_answering, summarization, translation, sentence_similarity, fill_mask, zero_shot_classification, text_generation,
        text2text_generation, feature_extraction,
    )
}


def generate(texts: DataFrame, task: Task, client: Callable[[str], str | None], n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sample, error of n texts in hash order. Failed and incomplete answers are rows with an error, not samples."""
    chosen = sample_rows(texts, n, key, task.name).select(key, F.col(text).alias("text"))
    asked = ask(chosen.withColumn("prompt", task.prompt()), client)
    return parse_samples(asked, task.schema, task.required).select(key, "sample", "error")


def translation_pairs(samples: DataFrame, source: str = "en", target: str = "th") -> DataFrame:
    """Generated translations as the source and target that validation reads."""
    return samples.withColumn("source", F.col("sample.translation")[source]).withColumn("target", F.col("sample.translation")[target])
