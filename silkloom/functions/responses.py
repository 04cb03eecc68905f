"""Reading what language models answer: scores, issues, JSON, relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silkloom.functions.text import as_column, strip

#: Words that announce a line of an answer.
SCORE, SEVERITY = "คะแนน", "ความรุนแรง"
ADVICE, PROBLEMS = ("แนะนำ", "ปรับปรุง"), ("ปัญหา", "ข้อผิดพลาด")
#: Kinds of relation, in the order in which they are looked for.
RELATIONS = ("is_a", "part_of", "has_property", "related_to", "similar_to", "opposite_of")


def _holds(line: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(line, F.lit(w))
    return found


def _scored(response: Column | str, word: str, others: tuple[str, ...], start: float, failed: float, names: tuple[str, str]) -> Column:
    raw = as_column(response)
    lines = F.split(raw, "\n")
    is_score = lambda x: F.contains(x, F.lit(word)) & F.contains(x, F.lit(":"))
    numbers = F.filter(F.transform(F.filter(lines, is_score), lambda x: strip(F.split(x, ":")[1]).try_cast("double")), lambda v: v.isNotNull())
    score = F.when(raw.isNull(), F.lit(failed)).otherwise(F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit(start)))
    listed = F.transform(F.filter(lines, lambda x: ~is_score(x) & _holds(x, others)), strip)
    return F.struct(score.alias(names[0]), F.coalesce(listed, F.array().cast("array<string>")).alias(names[1]))


def generator_check(response: Column | str) -> Column:
    """Struct: quality_score, the last number after the colon of a score line (0 if none or no answer), suggestions."""
    return _scored(response, SCORE, ADVICE, 0.0, 0.0, ("quality_score", "suggestions"))


def critic_check(response: Column | str) -> Column:
    """Struct: severity_score, the last number of a severity line (1 if none, 5 without an answer), issues."""
    return _scored(response, SEVERITY, PROBLEMS, 1.0, 5.0, ("severity_score", "issues"))


#: What each side of the dual check looks at, and the lines it is asked to answer with.
_GENERATOR = ("Side A: rate one sample of the task {task}: language, sense, agreement of its parts, form.", (f"{SCORE}: <0-1>", f"{ADVICE[0]}: <text>"))
_CRITIC = ("Side B: find faults in one sample of the task {task}: logic, contradictions, nonsense, faults of this kind of task.", (f"{SEVERITY}: <1-5>", f"{PROBLEMS[0]}: <text>"))


def _asked(sample: Column | str, task: str, role: tuple[str, tuple[str, ...]]) -> Column:
    what, lines = role
    answer = "Answer in Thai with these lines only, one number in the first, the second once for each point:"
    return F.concat(F.lit(what.format(task=task) + "\n\n"), as_column(sample), F.lit("\n\n" + "\n".join((answer, *lines))))


def generator_prompt(sample: Column | str, task: str) -> Column:
    """A question whose answer generator_check can read, about a sample given as text or JSON."""
    return _asked(sample, task, _GENERATOR)


def critic_prompt(sample: Column | str, task: str) -> Column:
    """A question whose answer critic_check can read, about a sample given as text or JSON."""
    return _asked(sample, task, _CRITIC)


def combined_score(quality: Column | str, severity: Column | str) -> Column:
    """0.6 of the quality and 0.4 of the severity turned round; missing ones count as 0 and 5."""
    q, s = F.coalesce(as_column(quality), F.lit(0.0)), F.coalesce(as_column(severity), F.lit(5.0))
    return 0.6 * q + 0.4 * (1 - (s - 1) / 4)


def json_part(response: Column | str) -> Column:
    """The JSON text of an answer: a fenced block, else the outermost braces, else {}; bad JSON gives {}."""
    raw = as_column(response)
    fenced = F.regexp_extract(raw, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    found = F.when(fenced != "", fenced).otherwise(braces)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found).otherwise("{}")


def message_content(response: Column | str) -> Column:
    """The content of a chat completion, or ""."""
    return F.coalesce(F.get_json_object(as_column(response), "$.choices[0].message.content"), F.lit(""))


def relations(response: Column | str) -> Column:
    """Array of (type, concept): a line that names a relation sets the type for it and the lines after it; a line with
    a colon gives a concept."""
    lines = F.filter(F.transform(F.split(as_column(response), "\n"), strip), lambda x: x != "")

    def step(state: Column, line: Column) -> Column:
        named = F.coalesce(*[F.when(F.contains(F.lower(line), F.lit(r)), F.lit(r)) for r in RELATIONS], state["kind"])
        concept = strip(F.regexp_replace(line, "(?s)^[^:]*:", ""))
        new = F.when(named.isNotNull() & F.contains(line, F.lit(":")) & (concept != ""), F.array(F.struct(named.alias("type"), concept.alias("concept"))))
        return F.struct(named.alias("kind"), F.concat(state["out"], F.coalesce(new, F.array().cast(_LISTED))).alias("out"))

    return F.aggregate(lines, F.struct(F.lit(None).cast("string").alias("kind"), F.array().cast(_LISTED).alias("out")), step, lambda s: s["out"])


_LISTED = "array<struct<type:string,concept:string>>"
