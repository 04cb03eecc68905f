"""Thai text columns: cleaning, repairs, tones, spelling, formality. No word segmenter is assumed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silkloom.functions.text import NOT_THAI_OR_ASCII, NOT_WS, URL, as_column, collapse, strip, tokens

#: The four tone marks.
TONES = ("\u0e48", "\u0e49", "\u0e4a", "\u0e4b")
#: Correct spelling and its wrong variants.
MISSPELLINGS = {"ทำงาน": ("ท\u0e4d\u0e32งาน",), "เสร็จ": ("เสร็ช", "เสรจ"), "ประเทศ": ("ปะเทศ", "ประเทษ")}
#: Words that mark a style.
STYLES = {"formal": ("ครับ", "ค่ะ", "ท่าน", "กระผม", "ดิฉัน"), "informal": ("จ้า", "ครับผม", "จ๊ะ", "น้า"), "question": ("ไหม", "หรือ", "เหรอ", "มั้ย")}
#: Words that mark formality, by category.
FORMALITY = {
    "honorifics": ("ท่าน", "คุณ", "นาย", "นาง", "นางสาว"),
    "formal_pronouns": ("กระผม", "ดิฉัน", "ข้าพเจ้า"),
    "polite_particles": ("ครับ", "ค่ะ", "นะคะ", "นะครับ"),
}
THAI_DIGITS, ASCII_DIGITS = "๐๑๒๓๔๕๖๗๘๙", "0123456789"


def clean_thai(text: Column | str, stopwords: list[str] | None = None) -> Column:
    """Thai, ASCII letters and digits and end marks stay; null gives "". With stopwords those words go."""
    plain = collapse(F.regexp_replace(F.regexp_replace(as_column(text), URL, ""), NOT_THAI_OR_ASCII, " "))
    if stopwords:
        plain = F.array_join(F.filter(tokens(plain), lambda w: ~w.isin(stopwords)), " ")
    return F.coalesce(F.trim(plain), F.lit(""))


def fix_common_errors(text: Column | str) -> Column:
    """The repetition mark joins its word, spaces before . , ! ? go, Thai and Latin letters are set apart."""
    out = F.regexp_replace(as_column(text), f"({NOT_WS}) ๆ", "$1ๆ")
    out = F.regexp_replace(out, " ([.,!?])", "$1")
    out = F.regexp_replace(out, "([ก-๙])([a-zA-Z])", "$1 $2")
    return strip(F.regexp_replace(out, "([a-zA-Z])([ก-๙])", "$1 $2"))


def fix_unicode(text: Column | str) -> Column:
    """Zero-width characters go, sara am is spelled as two sara a, Thai digits become ASCII."""
    plain = F.translate(as_column(text), THAI_DIGITS + "\u200b\u2060\ufeff", ASCII_DIGITS)
    return F.replace(plain, F.lit("\u0e33"), F.lit("\u0e30\u0e30"))


def tonal_metrics(text: Column | str) -> Column:
    """Struct: count of each tone, words without one, counts by word, and 4 / words (0 without words)."""
    raw, tones = as_column(text), "".join(TONES)
    # A word is counted where it stands; with a tone mark, from its first one on, so once.
    n = F.regexp_count(raw, F.lit(f"{NOT_WS}+"))
    toned = F.regexp_count(raw, F.lit(f"[{tones}]{NOT_WS}*"))
    counts = [(F.length(raw) - F.length(F.replace(raw, F.lit(t), F.lit("")))).cast("long") for t in TONES]
    per_word = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    toneless = (n - toned).cast("long")
    return F.struct(
        *(c.alias(f"tone_{i}") for i, c in enumerate(counts, 1)), toneless.alias("no_tone_words"),
        *(per_word(c).alias(f"tone_{i}_ratio") for i, c in enumerate(counts, 1)), per_word(F.lit(float(len(TONES)))).alias("tonal_complexity_score"),
    )


def orthography(text: Column | str) -> Column:
    """Struct: misspellings (incorrect, correct), overlapping pairs of tone marks, and 1 - misspellings / words (1 for
    an empty text, null if only white space)."""
    raw = as_column(text)
    listed = F.array(*[F.struct(F.lit(v).alias("incorrect"), F.lit(c).alias("correct")) for c, vs in MISSPELLINGS.items() for v in vs])
    wrong = F.filter(listed, lambda m: F.contains(raw, m["incorrect"]))
    tones = "".join(TONES)
    pairs = F.regexp_extract_all(raw, F.lit(f"(?=([{tones}]{{2}}))"), F.lit(1))
    score = F.when(raw == "", 1.0).otherwise(1 - F.size(wrong) / F.nullif(F.size(tokens(raw)), F.lit(0)))
    return F.struct(wrong.alias("misspellings"), pairs.alias("double_tone_instances"), score.alias("orthographic_score"))


def _present(text: Column, markers: tuple[str, ...]) -> Column:
    return sum((F.contains(text, F.lit(m)).cast("long") for m in markers), F.lit(0).cast("long"))


def formality(text: Column | str) -> Column:
    """Struct: how many markers of each category stand in the text, and their number by word."""
    raw = as_column(text)
    counts = {c: _present(raw, ms) for c, ms in FORMALITY.items()}
    n, total = F.size(tokens(raw)), sum(counts.values(), F.lit(0).cast("long"))
    score = F.when(n > 0, total / n).otherwise(0.0)
    return F.struct(*(v.alias(c) for c, v in counts.items()), score.alias("formality_score"), score.alias("formal_word_ratio"))


def has_style(text: Column | str, style: str) -> Column:
    return _present(as_column(text), STYLES[style]) > 0
