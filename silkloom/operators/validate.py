"""Sample validation by task: one struct (is_valid, reason) a sample, and reports over a dataset.

A missing field and a null one are the same. Reasons are what the tasks' users expect, word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkloom.functions.responses import combined_score, critic_check, generator_check
from silkloom.functions.text import as_column

#: Patterns that make a text suspicious, in the order in which they are reported.
SUSPICIOUS = ("error", "undefined", "null", "nan", "เกิดข้อผิดพลาด", "ไม่พบข้อมูล", "ไม่สามารถ")
#: Reasons.
OK, EMPTY, UNSUPPORTED = "ผ่านการตรวจสอบ", "ตัวอย่างว่างเปล่า", "ไม่รองรับประเภทงาน: "
MISSING = {
    "text_classification": "ไม่มีข้อความหรือป้ายกำกับ",
    "ner": "ไม่มีข้อความ โทเค็น หรือแท็ก",
    "question_answering": "ไม่มีบริบทหรือคำถาม",
    "question": "คำถามหรือคำตอบว่างเปล่า",
    "summarization": "ไม่มีบทความหรือสรุป",
    "translation": "ไม่มีข้อความต้นทางหรือข้อความปลายทาง",
}
UNEQUAL = "จำนวนโทเค็นและแท็กไม่ตรงกัน"
NAMES = {"text": "ข้อความ", "question": "คำถาม", "answer": "คำตอบ", "article": "บทความ", "summary": "สรุป", "source": "ข้อความต้นทาง", "target": "ข้อความปลายทาง"}
LENGTH, FOUND, FOUND_IN = "ความยาว{}ไม่อยู่ในช่วงที่ยอมรับได้ ({}-{})", "พบคำที่น่าสงสัย: {}", "พบคำที่น่าสงสัยใน{}: {}"

MIN_LENGTH, MAX_LENGTH, PASS_RATIO, REVISION_BELOW = 10, 1000, 0.8, 0.8
TASKS = ("text_classification", "token_classification", "ner", "question_answering", "summarization", "translation")


def _missing(*fields: Column) -> Column:
    gone = F.lit(False)
    for f in fields:
        gone = gone | f.isNull() | (f == "")
    return gone


def _bad_length(text: Column, name: str, least: int, most: int) -> list[tuple[Column, str]]:
    return [(~F.length(text).between(least, most), LENGTH.format(NAMES[name], least, most))]


def _suspicious(*fields: tuple[Column, str | None]) -> list[tuple[Column, str]]:
    """For each pattern, field by field."""
    return [(f.rlike(f"(?iu){p}"), FOUND.format(p) if name is None else FOUND_IN.format(NAMES[name], p)) for p in SUSPICIOUS for f, name in fields]


def _first(cases: list[tuple[Column, str]]) -> Column:
    """The reason of the first case that holds, or null."""
    return F.coalesce(*[F.when(c, F.lit(r)) for c, r in cases])


def sample_reason(task: str, least: int = MIN_LENGTH, most: int = MAX_LENGTH, **fields: Column | str) -> Column:
    """Why a sample fails, or null. fields name the columns where they differ from the task's own names."""
    col = lambda name: as_column(fields.get(name, name))
    if task == "text_classification":
        label = col("label").cast("string")
        cases = [(_missing(col("text"), label) | label.isin("0", "0.0", "false"), MISSING[task])]
        cases += _bad_length(col("text"), "text", least, most) + _suspicious((col("text"), None))
    elif task in ("ner", "token_classification"):
        tokens, tags = col("tokens"), col("tags")
        none = _missing(col("text")) | (F.coalesce(F.size(tokens), F.lit(0)) < 1) | (F.coalesce(F.size(tags), F.lit(0)) < 1)
        cases = [(none, MISSING["ner"]), (F.size(tokens) != F.size(tags), UNEQUAL)] + _suspicious((col("text"), None))
    elif task == "question_answering":
        questions = col("questions")

        def reason(q: Column) -> Column:
            own = [(_missing(q["question"], q["answer"]), MISSING["question"])] + _bad_length(q["question"], "question", least, most)
            return _first(own + _suspicious((q["question"], "question"), (q["answer"], "answer")))

        none = _missing(col("context")) | (F.coalesce(F.size(questions), F.lit(0)) < 1)
        failed = F.filter(F.transform(questions, reason), lambda r: r.isNotNull())
        return F.when(none, F.lit(MISSING[task])).otherwise(F.try_element_at(failed, F.lit(1)))
    elif task in ("summarization", "translation"):
        names = ("article", "summary") if task == "summarization" else ("source", "target")
        one, two = map(col, names)
        cases = [(_missing(one, two), MISSING[task])]
        cases += _bad_length(one, names[0], least, most) + _bad_length(two, names[1], least, most)
        cases += _suspicious((one, names[0]), (two, names[1]))
    else:
        return F.lit(UNSUPPORTED + task)
    return _first(cases)


def validate_sample(task: str, least: int = MIN_LENGTH, most: int = MAX_LENGTH, **fields: Column | str) -> Column:
    """Struct (is_valid, reason)."""
    reason = sample_reason(task, least, most, **fields)
    return F.struct(reason.isNull().alias("is_valid"), F.coalesce(reason, F.lit(OK)).alias("reason"))


def validate_dataset(samples: DataFrame, task: str, key: str = "id", pass_ratio: float = PASS_RATIO, **fields: Column | str) -> DataFrame:
    """One row: total, valid and invalid samples, validity_ratio, passed. Nulls instead of ratios when empty.

    The issues themselves, one row each, are `invalid_samples`.
    """
    checked = samples.select(validate_sample(task, **fields).alias("v"))
    total = F.count("*")
    valid = F.count_if("v.is_valid")
    ratio = valid / F.nullif(total, F.lit(0))
    return checked.agg(total.alias("total_samples"), valid.alias("valid_samples"), (total - valid).alias("invalid_samples"), ratio.alias("validity_ratio"), (ratio >= pass_ratio).alias("passed"))


def invalid_samples(samples: DataFrame, task: str, key: str = "id", **fields: Column | str) -> DataFrame:
    """key, reason of every sample that fails."""
    return samples.select(key, validate_sample(task, **fields).alias("v")).where("not v.is_valid").select(key, "v.reason")


def dual_validation(answers: DataFrame, generator: str = "generator_response", critic: str = "critic_response") -> DataFrame:
    """answers with quality_score, suggestions, severity_score, issues, combined_score and needs_revision."""
    read = answers.withColumn("__g", generator_check(generator)).withColumn("__c", critic_check(critic))
    scored = read.select(*answers.columns, "__g.*", "__c.*").withColumn("combined_score", combined_score("quality_score", "severity_score"))
    return scored.withColumn("needs_revision", F.col("combined_score") < REVISION_BELOW)


def overall_scores(scored: DataFrame) -> DataFrame:
    """One row over dual_validation: average, least, most, deviation, samples that need revision; zeros when empty."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    again = F.count_if("needs_revision")
    return scored.agg(
        zero(F.avg("combined_score")).alias("average_score"), zero(F.min("combined_score")).alias("min_score"), zero(F.max("combined_score")).alias("max_score"),
        zero(F.stddev_pop("combined_score")).alias("std_score"), again.alias("samples_needing_revision"), zero(again / F.nullif(F.count("*"), F.lit(0))).alias("revision_ratio"),
    )


def dual_advice(overall: DataFrame) -> DataFrame:
    """overall with recommendations."""
    percent = F.format_number(F.col("revision_ratio") * 100, 1)
    said = F.array_compact(F.array(
        F.when(F.col("average_score") < 0.8, F.lit(ADVICE["average"])),
        F.when(F.col("revision_ratio") > 0.2, F.concat(F.lit(ADVICE["revision"][0]), F.col("samples_needing_revision").cast("string"), F.lit(ADVICE["revision"][1]), percent, F.lit(ADVICE["revision"][2]))),
        F.when(F.col("std_score") > 0.2, F.lit(ADVICE["spread"])),
    ))
    return overall.withColumn("recommendations", said)


#: Advice.
ADVICE = {
    "average": "ควรปรับปรุงคุณภาพข้อมูลโดยรวม",
    "revision": ("พบข้อมูลที่ต้องแก้ไข ", " รายการ (", "%) ควรทบทวนกระบวนการสร้างข้อมูล"),
    "spread": "ความแปรปรวนของคุณภาพข้อมูลสูงเกินไป ควรสร้างมาตรฐานการตรวจสอบที่เข้มงวดขึ้น",
}


def complete_response(fields: tuple[str, ...] = ("text", "label", "label_id")) -> Column:
    """Whether a parsed answer has all fields that its task needs."""
    there = F.lit(True)
    for f in fields:
        there = there & F.col(f).isNotNull()
    return there
