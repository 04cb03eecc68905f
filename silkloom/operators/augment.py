"""Augmentation of texts by words: synonyms, insertion, deletion and swaps.

Every random choice is a hash of (id, technique, sample, position), so results are the same on any cluster and after
any retry. Synonyms are a table given by the caller, as a map literal.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkloom.functions.text import as_column, tokens, uniform


@dataclass(frozen=True)
class AugmentParams:
    """Probabilities by technique, and the most variants of a text."""

    synonym_replace_prob: float = 0.3
    random_insert_prob: float = 0.1
    random_delete_prob: float = 0.1
    random_swap_prob: float = 0.1
    max_augmentations: int = 5

    def __post_init__(self) -> None:
        for name, value in asdict(self).items():
            if name == "max_augmentations":
                if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
                    raise ValueError(f"{name} must be a positive integer")
            elif isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")

    def with_(self, **changes) -> AugmentParams:
        unknown = changes.keys() - asdict(self).keys()
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return replace(self, **changes)

    @staticmethod
    def info() -> dict[str, dict]:
        """Type, default and range of each parameter."""
        found = {}
        for name, value in asdict(AugmentParams()).items():
            found[name] = {"type": type(value).__name__, "default": value, "min": 1 if name == "max_augmentations" else 0.0, "max": 100 if name == "max_augmentations" else 1.0}
        return found

    @staticmethod
    def description() -> str:
        return "Word-level text augmentation: synonym replacement, random insertion, deletion and swap."


def _synonyms_of(word: Column, synonyms: dict[str, list[str]]) -> Column:
    """Distinct synonyms other than the word itself; null if there are none."""
    rows = {w: [s for s in dict.fromkeys(ss) if s != w] for w, ss in synonyms.items()}
    rows = {w: ss for w, ss in rows.items() if ss}
    if not rows:
        return F.lit(None).cast("array<string>")
    table = F.create_map(*[x for w, ss in rows.items() for x in (F.lit(w), F.array(*map(F.lit, ss)))])
    return F.try_element_at(table, word)


def _pick(choices: Column, u: Column) -> Column:
    return F.get(choices, F.floor(u * F.size(choices)).cast("int"))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def delete_words(key: Column | str, text: Column | str, p: float, sample: Column | int = 0) -> Column:
    """Each word goes with probability p; if none is left, one stays."""
    s = F.lit(sample) if isinstance(sample, int) else sample
    words = tokens(text)
    kept = F.filter(words, lambda w, i: uniform(key, F.lit("del"), s, i) >= p)
    one = F.coalesce(_pick(words, uniform(key, F.lit("del"), s, F.lit("keep"))), F.lit(""))
    return F.when(F.size(kept) > 0, _joined(kept)).otherwise(one)


def replace_synonyms(key: Column | str, text: Column | str, p: float, synonyms: dict[str, list[str]], sample: Column | int = 0) -> Column:
    """Each word that has synonyms is replaced by one with probability p."""
    s = F.lit(sample) if isinstance(sample, int) else sample

    def one(w: Column, i: Column) -> Column:
        chosen = _pick(_synonyms_of(w, synonyms), uniform(key, F.lit("syn"), s, i, F.lit("pick")))
        return F.when(uniform(key, F.lit("syn"), s, i) < p, F.coalesce(chosen, w)).otherwise(w)

    return _joined(F.transform(tokens(text), one))


def insert_words(key: Column | str, text: Column | str, p: float, synonyms: dict[str, list[str]], sample: Column | int = 0) -> Column:
    """For each position of the text, with probability p, a synonym of a random word goes in at that index of the list
    as it has grown so far."""
    s = F.lit(sample) if isinstance(sample, int) else sample
    words = tokens(text)

    def new(i: Column) -> Column:
        word = _pick(words, uniform(key, F.lit("ins"), s, i, F.lit("word")))
        return F.struct(i.alias("i"), _pick(_synonyms_of(word, synonyms), uniform(key, F.lit("ins"), s, i, F.lit("pick"))).alias("w"))

    def step(grown: Column, x: Column) -> Column:
        return F.concat(F.slice(grown, F.lit(1), x["i"]), F.array(x["w"]), F.slice(grown, x["i"] + 1, F.size(grown)))

    chosen = F.filter(_positions(F.size(words)), lambda i: uniform(key, F.lit("ins"), s, i) < p)
    return _joined(F.aggregate(F.filter(F.transform(chosen, new), lambda x: x["w"].isNotNull()), words, step))


def _positions(n: Column) -> Column:
    """0 to n - 1; empty for n < 1."""
    return F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), F.greatest(n, F.lit(0)))


def swap_words(key: Column | str, text: Column | str, p: float, sample: Column | int = 0) -> Column:
    """For each position but the last, with probability p, its word changes places with a random one."""
    s = F.lit(sample) if isinstance(sample, int) else sample
    words = tokens(text)
    n = F.size(words)

    def step(now: Column, x: Column) -> Column:
        return F.transform(now, lambda w, k: F.when(k == x["i"], F.get(now, x["j"])).when(k == x["j"], F.get(now, x["i"])).otherwise(w))

    chosen = F.filter(_positions(n - 1), lambda i: uniform(key, F.lit("swap"), s, i) < p)
    swaps = F.transform(chosen, lambda i: F.struct(i.alias("i"), F.floor(uniform(key, F.lit("swap"), s, i, F.lit("to")) * n).cast("int").alias("j")))
    return _joined(F.aggregate(swaps, words, step))


def augment(texts: DataFrame, synonyms: dict[str, list[str]], key: str = "doc_id", text: str = "text", params: AugmentParams | None = None) -> DataFrame:
    """key, text: at most max_augmentations distinct variants of each text, max_augmentations // 4 (at least 1) a
    technique; in hash order where there are more."""
    params = params or AugmentParams()
    each = params.max_augmentations // 4 or 1
    made = []
    for sample in range(each):
        if params.synonym_replace_prob > 0:
            made.append(replace_synonyms(key, text, params.synonym_replace_prob, synonyms, sample))
        if params.random_insert_prob > 0:
            made.append(insert_words(key, text, params.random_insert_prob, synonyms, sample))
        if params.random_delete_prob > 0:
            made.append(delete_words(key, text, params.random_delete_prob, sample))
        if params.random_swap_prob > 0:
            made.append(swap_words(key, text, params.random_swap_prob, sample))
    if not made:
        return texts.select(key, text).where(F.lit(False))
    # All variants of a text come from its one row, so no shuffle is needed to tell them apart.
    by_hash = F.array_sort(F.transform(F.array_distinct(F.array(*made)), lambda t: F.struct(F.md5(F.concat_ws("|", as_column(key).cast("string"), t)).alias("h"), t.alias("t"))))
    return texts.select(key, F.explode(F.slice(by_hash, 1, params.max_augmentations)).alias("v")).select(key, F.col("v.t").alias(text))


def preview(texts: DataFrame, synonyms: dict[str, list[str]], n: int = 5, **options) -> DataFrame:
    return augment(texts, synonyms, **options).limit(n)


def sample_rows(rows: DataFrame, n: int, key: str = "doc_id", salt: str = "sample") -> DataFrame:
    """Exactly min(n, count) rows in hash order, without replacement."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(salt))), key).limit(n)
