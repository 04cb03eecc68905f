"""Words that are used alike, learned from the corpus: a table of synonyms for augmentation where no thesaurus is at hand.

Words of the vocabulary (the most frequent ones, a stated number) are counted together with the words of the vocabulary that
stand up to `window` places from them. Of these counts the pointwise mutual information is kept as far as it is above log
`shift` (shifted positive PMI, Levy and Goldberg 2014): very common words, which stand beside everything, keep few entries.
Two words are as similar as the cosine of their entries. It is found by a sparse product: entries are joined on the word beside
them. Before that, entries are left out that no pair above `least` needs: with the words beside them ordered from the rarest on,
two vectors whose cosine reaches `least` share a word in the parts that leave less than that of their lengths.

All tables but the first count are bounded by the vocabulary, not by the corpus: at most vocabulary squared entries, whatever the
number of texts; the first count is summed before its shuffle. Null and empty texts have no words. A word without neighbours
above `least` is absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silkloom.functions.text import WORD_CHARS
from silkloom.storage import ensure_checkpoint_dir

VOCABULARY, WINDOW, SHIFT, LEAST, TOP = 2000, 2, 5.0, 0.2, 5


def vocabulary(texts: DataFrame, text: str = "text", size: int = VOCABULARY) -> DataFrame:
    """word, n: the most frequent runs of letters and digits, lower-cased; ties by the word."""
    found = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD_CHARS}]+"), F.lit(0))).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)


def counts(texts: DataFrame, words: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """word, beside, n: how often two words of the vocabulary stand at most `window` places apart, either way round."""
    cut = texts.select(F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD_CHARS}]+"), F.lit(0)).alias("w"))
    ahead = [F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - d, F.lit(0))).alias("a"), F.slice("w", F.lit(d + 1), F.greatest(F.size("w") - d, F.lit(0))).alias("b")) for d in range(1, window + 1)]
    pairs = cut.select(F.explode(F.concat(*ahead)).alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n"))
    listed = words.select("word")
    pairs = pairs.join(listed.withColumnRenamed("word", "a"), "a", "left_semi").join(listed.withColumnRenamed("word", "b"), "b", "left_semi")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("beside"), "n").union(pairs.select("b", "a", "n"))
    return both.groupBy("word", "beside").agg(F.sum("n").alias("n"))


def entries(counted: DataFrame, shift: float = SHIFT) -> DataFrame:
    """word, beside, x: shifted positive PMI, each word's entries at unit length."""
    sums = counted.groupBy("word").agg(F.sum("n").alias("of_word"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    sides = counted.join(sums, "word").join(sums.select(F.col("word").alias("beside"), F.col("of_word").alias("of_beside")), "beside").crossJoin(F.broadcast(total))
    pmi = F.ln(F.col("n").cast("double") * F.col("total") / (F.col("of_word").cast("double") * F.col("of_beside"))) - F.ln(F.lit(shift))
    kept = sides.select("word", "beside", pmi.alias("x")).where("x > 0")
    return kept.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("word"))))


def neighbours(texts: DataFrame, text: str = "text", size: int = VOCABULARY, window: int = WINDOW, shift: float = SHIFT, least: float = LEAST, top: int = TOP) -> DataFrame:
    """word, rank, neighbour, similarity: the `top` words of highest cosine above `least`, ties by the word."""
    ensure_checkpoint_dir(texts.sparkSession)
    words = vocabulary(texts, text, size).checkpoint()
    unit = entries(counts(texts, words, text, window).checkpoint(), shift).checkpoint()
    many = unit.groupBy("beside").agg(F.count("*").alias("many"))
    onward = Window.partitionBy("word").orderBy("many", "beside").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    prefix = unit.join(many, "beside").withColumn("rest", F.sum(F.col("x") * F.col("x")).over(onward)).where(F.col("rest") >= least * least - 1e-9)
    a, b = prefix.select("beside", F.col("word").alias("a")), prefix.select("beside", F.col("word").alias("b"))
    pairs = a.join(b, "beside").where("a < b").select("a", "b").distinct()
    one, two = unit.select(F.col("word").alias("a"), "beside", F.col("x").alias("xa")), unit.select(F.col("word").alias("b"), "beside", F.col("x").alias("xb"))
    scored = pairs.join(one, "a").join(two, ["b", "beside"]).groupBy("a", "b").agg(F.round(F.sum(F.col("xa") * F.col("xb")), 6).alias("similarity")).where(F.col("similarity") > least)
    both = scored.select(F.col("a").alias("word"), F.col("b").alias("neighbour"), "similarity").union(scored.select("b", "a", "similarity"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("similarity"), "neighbour")))
    return ranked.where(F.col("rank") <= top).select("word", "rank", "neighbour", "similarity")


def as_synonyms(found: DataFrame) -> dict[str, list[str]]:
    """The table as augmentation takes it; vocabulary times top words at most."""
    rows = found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("r")).collect()
    return {r["word"]: [x["neighbour"] for x in r["r"]] for r in rows}


def neighbours_sql(table: str = "documents", size: int = VOCABULARY, window: int = WINDOW, shift: float = SHIFT, least: float = LEAST, top: int = TOP) -> str:
    """The same by the plain product of all entries."""
    places = ", ".join(f"({d})" for d in range(1, window + 1))
    return f"""
with t as (select regexp_extract_all(lower(text), '[{WORD_CHARS}]+') as w from {table}),
v as materialized (select word, count(*) as n from (select unnest(w) as word from t) group by word order by n desc, word limit {size}),
p as (select w[i] as a, w[i + d] as b, count(*) as n from (select w, d, unnest(range(1, len(w) - d + 1)) as i from t, (values {places}) d(d)) group by all),
k as (select * from p where a in (select word from v) and b in (select word from v)),
c as materialized (select word, beside, sum(n) as n from (select a as word, b as beside, n from k union all select b, a, n from k) group by word, beside),
s as (select word, sum(n) as n from c group by word),
x as (select c.word, c.beside, ln(c.n::double * (select sum(n) from c) / (s.n::double * o.n)) - ln({shift}::double) as x from c join s on c.word = s.word join s o on c.beside = o.word),
u as materialized (select word, beside, x / sqrt(sum(x * x) over (partition by word)) as x from x where x > 0),
m as (select a.word, b.word as neighbour, round(sum(a.x * b.x), 6) as similarity from u a join u b on a.beside = b.beside and a.word <> b.word group by a.word, b.word having round(sum(a.x * b.x), 6) > {least})
select word, rank::int as rank, neighbour, similarity from (select *, row_number() over (partition by word order by similarity desc, neighbour) as rank from m) where rank <= {top}"""
