"""Text columns: tokens, cleaning, sections, sentences and chunks, as built-in expressions.

Character classes are spelled out so that Java, RE2 and Python agree on them: WS is what Python calls white space,
WORD_CHARS what its `\\w` matches.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_CHARS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_CHARS}]"
NOT_WS = f"[^{WS_CHARS}]"
WORD_CHARS = r"\p{L}\p{N}_"

#: A link: http, https or www and what follows without white space.
URL = f"http{NOT_WS}+|www{NOT_WS}+"
#: What cleaning turns into a space.
SPECIAL = f"[^{WORD_CHARS}{WS_CHARS}.!?]"
#: The same for the Thai cleaner: Thai block, ASCII letters and digits, white space and end marks stay.
NOT_THAI_OR_ASCII = rf"[^\x{{E00}}-\x{{E7F}}a-zA-Z0-9{WS_CHARS}.!?]"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(as_column(text), f"{WS}+"), lambda w: w != "")


def strip(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), f"^{WS}+|{WS}+$", "")


def collapse(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), f"{WS}+", " ")


def clean_text(text: Column | str) -> Column:
    """Links go, special characters become spaces, white space is collapsed and stripped."""
    return F.trim(collapse(F.regexp_replace(F.regexp_replace(as_column(text), URL, ""), SPECIAL, " ")))


def clean_stats(text: Column | str) -> Column:
    """Struct of what cleaning did; the ratio is null for an empty text."""
    raw = as_column(text)
    linkless = F.regexp_replace(raw, URL, "")
    plain = F.regexp_replace(linkless, SPECIAL, " ")
    tight = collapse(plain)
    final = F.length(F.trim(tight))
    return F.struct(
        F.length(raw).cast("long").alias("original_length"),
        F.regexp_count(raw, F.lit(URL)).cast("long").alias("urls_removed"),
        F.regexp_count(linkless, F.lit(SPECIAL)).cast("long").alias("special_chars_removed"),
        (F.length(plain) - F.length(tight)).cast("long").alias("spaces_normalized"),
        final.cast("long").alias("final_length"),
        (1 - final / F.nullif(F.length(raw), F.lit(0))).alias("reduction_ratio"),
    )


#: The words or numerals that open a section and those of the line that ends it.
SECTIONS = {
    "abstract": ("abstract", r"introduction|1[\.\s]|i[\.\s]"),
    "introduction": (r"introduction|1[\.\s]|i[\.\s]", r"related work|background|method|2[\.\s]|ii[\.\s]"),
    "method": (r"method|methodology|approach|proposed method|3[\.\s]|iii[\.\s]", r"experiment|evaluation|result|4[\.\s]|iv[\.\s]"),
    "results": (r"result|experiment|evaluation|4[\.\s]|iv[\.\s]", r"discussion|conclusion|5[\.\s]|v[\.\s]"),
    "conclusion": (r"conclusion|discussion|future work|5[\.\s]|v[\.\s]", "reference|acknowledgment|appendix"),
}


def sections(text: Column | str) -> Column:
    """Struct of the sections of a paper, "" where one is missing, and full_text. Works on uncleaned text, as the
    line breaks are what ends a section."""
    raw = as_column(text)
    found = []
    for name, (opens, ends) in SECTIONS.items():
        pattern = rf"(?is)(?:{opens})\s+(.+?)(?=\n\s*(?:{ends}|$))".replace(r"\s", WS).replace(rf"[\.{WS}]", rf"[\.{WS_CHARS}]")
        found.append(strip(F.regexp_extract(raw, pattern, 1)).alias(name))
    return F.struct(*found, raw.alias("full_text"))


def sentences(text: Column | str, least: int = 10, most: int = 1000) -> Column:
    """Sentences end at . ! or ? before white space; the length limits hold before stripping."""
    ends = F.split(as_column(text), rf"(?<=[.!?]){WS}+")
    return F.transform(F.filter(ends, lambda s: F.length(s).between(least, most)), strip)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def chunks(text: Column | str, size: int = 1000, overlap: int = 100) -> Column:
    """Pieces of at most `size` characters that end at a space where there is one, each starting `overlap`
    characters before the end of the last. Ends with the piece that reaches the end of the text; where an overlap would
    stand still, the next piece starts at the end of the last one.

    A fold over as many steps as the text can have pieces; the state is the cursor and the pieces so far. A window's last
    space is at most the longest word from its end, so each step moves on by size - overlap - longest word at least; and
    whatever the words, three steps together move on by size - overlap: a step that stays behind ends at the last space
    before a long word, the next one starts there or an overlap before it, and the one after that is cut in the word.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    raw = as_column(text)
    n = F.length(raw)

    def step(state: Column, _: Column) -> Column:
        start = state["start"]
        hard = F.least(start + size, n)
        # The last space at or before the limit, after the start.
        window = F.substr(raw, start + 1, F.lit(size + 1))
        back = F.length(F.regexp_replace(window, "(?s)[^ ]*$", "")) - 1

        def cut(end: Column) -> Column:
            after = F.when(end - overlap > start, end - overlap).otherwise(end)
            piece = strip(F.substr(raw, start + 1, end - start))
            return F.struct(F.when(end >= n, n).otherwise(after).cast("int").alias("start"), (end >= n).alias("done"), F.concat(state["out"], F.array(piece)).alias("out"))

        return F.when(state["done"], state).otherwise(_let(F.when((hard < n) & (back > 0), start + back).otherwise(hard), cut))

    first = F.struct(F.lit(0).alias("start"), (n <= size).alias("done"), F.when(n <= size, F.array(raw)).otherwise(F.array().cast("array<string>")).alias("out"))
    longest = F.array_max(F.transform(F.split(raw, " "), F.length))
    steps = F.least(F.ceil(n / F.greatest(F.lit(size - overlap) - longest, F.lit(1))) + 1, 3 * F.ceil(n / F.lit(size - overlap)) + 3).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), steps)), first, step, lambda s: s["out"])


def word_count(text: Column | str) -> Column:
    """Words and single marks."""
    return F.regexp_count(as_column(text), F.lit(f"[{WORD_CHARS}]+|[^{WORD_CHARS}{WS_CHARS}]")).cast("long")


def first_words(text: Column | str, n: int = 3) -> Column:
    return F.slice(tokens(text), 1, n)


def pick_text(*fields: Column | str) -> Column:
    """The first field that is there: text, article or context."""
    return F.coalesce(*map(as_column, fields))


def strip_search_tags(snippet: Column | str) -> Column:
    return F.replace(F.replace(as_column(snippet), F.lit('<span class="searchmatch">'), F.lit("")), F.lit("</span>"), F.lit(""))


def html_text(page: Column | str) -> Column:
    """Text of a page without script, style, iframe and nav parts; text nodes are stripped and joined without a separator."""
    kept = F.regexp_replace(as_column(page), r"(?is)<(script|style|iframe|nav)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "")
    nodes = F.transform(F.split(kept, "<[^>]*>"), lambda t: strip(unescape(t)))
    return F.array_join(nodes, "")


#: The character references that feeds and pages use most, for the SQL of the queries.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


#: A character reference at the start of what follows an ampersand: decimal, hexadecimal or named.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _named() -> Column:
    """Name -> characters, of all references of HTML that end with a semicolon, as one literal."""
    return F.from_json(F.lit(json.dumps({n[:-1]: c for n, c in html5.items() if n.endswith(";")})), "map<string,string>")


def _character(code: Column) -> Column:
    """The character of a code point; null for none: 0, surrogates, beyond Unicode."""
    good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(F.when(good, code)), 8, "0")), "UTF-32"))


def unescape(text: Column | str) -> Column:
    """The text with its character references decoded, each once; those that name nothing stay as they are."""
    raw = as_column(text)

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        hexadecimal = name.rlike("^#[xX]")
        code = F.when(hexadecimal, F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.conv(F.substr(name, F.lit(2)), 10, 10))
        said = F.when(F.startswith(name, F.lit("#")), _character(code.cast("long"))).otherwise(F.try_element_at(_named(), name))
        return F.when((name != "") & said.isNotNull(), F.concat(said, F.substr(piece, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(raw, "&")
    told = F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one), ""))
    return F.when(F.contains(raw, F.lit("&")), told).otherwise(raw)


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of the parts joined by a bar: the same in any engine."""
    joined = F.concat_ws("|", *[as_column(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
