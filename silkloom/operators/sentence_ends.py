"""Sentence ends learned from the corpus itself, without labels, by the log-likelihood ratios of Kiss and Strunk (2006).

A full stop ends a sentence unless it belongs to an abbreviation, an initial or a number. What is counted in one pass over the corpus
tells which: words with and without a full stop (an abbreviation nearly always has one, is short, may have stops inside),
and the pairs of words around a full stop (words that open sentences; pairs that stay together, as "No. 7" does).

Words are runs without white space, in lower case and without the marks around them; numbers are one word, `##`. An ending
mark may be followed by closing quotes or brackets. After an abbreviation, an initial or a number a sentence ends if the next
word is capitalised, doesn't belong to it as a collocation, and either often opens sentences or is seen in lower case and
never capitalised inside a sentence; after a number also before a word without case. ! and ? end a sentence, three dots do
unless a small letter follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkloom.functions.text import WORD_CHARS, WS, WS_CHARS, as_column, strip
from silkloom.storage import delete, stored

#: Thresholds of the paper: abbreviations, words that open sentences, collocations.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: How likely an abbreviation has its full stop.
STOPPED = 0.99
#: Closing quotes and brackets.
CLOSERS = "\"')\\]\\x{bb}\\x{2019}\\x{201d}"
#: A stretch of text up to an ending mark and the white space after it, or the rest.
STRETCH = rf"(?s).*?[.!?][{CLOSERS}]*(?:{WS}+|\z)|.+\z"
NUMBER = "##"
TINY = 1e-300


def stretches(text: Column | str) -> Column:
    return F.regexp_extract_all(as_column(text), F.lit(STRETCH), F.lit(0))


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), f"^[^{WORD_CHARS}]+|[^{WORD_CHARS}.]+$", "")


def _plain(bare: Column) -> Column:
    return F.regexp_replace(bare, r"\.+$", "")


def _type(plain: Column) -> Column:
    return F.when(plain.rlike(r"^\p{N}[\p{N}.,]*$"), NUMBER).otherwise(plain)


def word_type(word: Column) -> Column:
    """The word without its full stop; empty if it has neither letters nor digits."""
    return _type(_plain(_bare(word)))


def _stopped(bare: Column) -> Column:
    return bare.rlike(r"[^.]\.$")


def _end(word: Column) -> Column:
    return F.regexp_extract(word, f"([.!?]+)[{CLOSERS}]*$", 1)


def _mark(end: Column, stopped: Column) -> Column:
    """What ends the word: `.`, `!` (also for ?), `..` or nothing."""
    return F.when(end == "", "").when(F.contains(end, F.lit("!")) | F.contains(end, F.lit("?")), "!").when(stopped, ".").otherwise("..")


def _first(word: Column) -> Column:
    return F.regexp_extract(word, f"^[^{WORD_CHARS}]*([{WORD_CHARS}])", 1)


def _upper(first: Column) -> Column:
    return first.rlike(r"^\p{Lu}")


def _lower(first: Column) -> Column:
    return first.rlike(r"^\p{Ll}")


def _log(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(TINY)))


def abbreviation_score(stopped: Column, plain: Column, stops: Column, total: Column, kind: Column) -> Column:
    """The log-likelihood ratio of `always with a stop` against `with a stop as any word`, less for longer words and for
    each time the word stands without one, more for stops inside."""
    n, p = stopped + plain, stops / total
    ratio = -2 * (stopped * _log(p) + plain * _log(1 - p) - stopped * F.ln(F.lit(STOPPED)) - plain * F.ln(F.lit(1 - STOPPED)))
    size = F.length(F.replace(kind, F.lit("."), F.lit("")))
    inner = F.length(kind) - size + 1
    return F.when(n > 0, ratio * F.exp(-size) * inner * F.pow(size.cast("double"), -plain))


def association(a: Column, b: Column, both: Column, total: Column) -> Column:
    """Log-likelihood ratio of b being as likely after a as anywhere."""

    def fit(k: Column, n: Column, p: Column) -> Column:
        return k * _log(p) + (n - k) * _log(1 - p)

    p = b / total
    rest = total - a
    apart = (b - both) / F.greatest(rest, F.lit(1))
    found = fit(both, a, p) + fit(b - both, rest, p)
    return -2 * (found - F.when(a == both, 0.0).otherwise(fit(both, a, both / a)) - F.when(b == both, 0.0).otherwise(fit(b - both, rest, apart)))


@dataclass
class SentenceModel:
    """abbreviations (type, stopped, plain, score), starters (type, opens, n, score), collocations (type, next, n, score), and
    breaks (type, next): pairs of a word that may keep its full stop and a capitalised word that opens a sentence after it."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    breaks: DataFrame


def _keeps_stop(kind: Column, listed: Column) -> Column:
    return listed | (kind == NUMBER) | kind.rlike(r"^\p{L}$")


def _words(texts: DataFrame, text: str) -> DataFrame:
    """word, n, opening: words as written, how often, and how often as the first one of a text."""
    every = texts.select(F.explode(F.split(text, f"{WS}+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    first = texts.select(F.regexp_extract(text, f"^{WS}*([^{WS_CHARS}]+)", 1).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("opening"))
    return every.join(first, "word", "left").select("word", "n", F.coalesce("opening", F.lit(0)).alias("opening"))


def _digest(text: Column | str) -> Column:
    return F.unhex(F.md5(text))


def _borders(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, h, at, word, after: the words on either side of each ending mark that white space follows."""
    cut = texts.select(F.col(key).alias("key"), _digest(text).alias("h"), stretches(text).alias("s"))
    but_one = F.greatest(F.size("s") - 1, F.lit(0))  # no filter on the size: it would cut every text twice
    two = F.arrays_zip(F.slice("s", F.lit(1), but_one).alias("a"), F.slice("s", F.lit(2), but_one).alias("b"))
    at = cut.select("key", "h", F.posexplode(two).alias("at", "p"))
    word = F.regexp_extract("p.a", f"(?s)^(?:.*{WS})?([^{WS_CHARS}]+){WS}*\\z", 1)
    after = F.regexp_extract("p.b", f"^{WS}*([^{WS_CHARS}]+)", 1)
    # Never null, as Spark can tell: a join on them would else extract them twice, to drop nulls.
    return at.select("key", "h", "at", F.coalesce(word, F.lit("")).alias("word"), F.coalesce(after, F.lit("")).alias("after"))


def _typed(pairs: DataFrame) -> DataFrame:
    """pairs (word, after) with mark, type, next, upper and lower, as the rules read them; `word` is always set off by its mark."""
    # In steps: what several of them read is worked out once a pair.
    words = pairs.select("*", _bare(F.col("word")).alias("b"), _end(F.col("word")).alias("e"), _bare(F.col("after")).alias("nb"), _first(F.col("after")).alias("f"))
    words = words.select("*", _stopped(F.col("b")).alias("s"), _plain(F.col("b")).alias("p"), _plain(F.col("nb")).alias("np"))
    marked = words.select("*", _mark(F.col("e"), F.col("s")).alias("mark"))
    kind = F.when(F.col("mark") == ".", _type(F.col("p"))).otherwise("")
    return marked.select(*pairs.columns, "mark", kind.alias("type"), _type(F.col("np")).alias("next"), _upper(F.col("f")).alias("upper"), _lower(F.col("f")).alias("lower"))


def learn(texts: DataFrame, text: str = "text") -> SentenceModel:
    """Words, and pairs around ending marks, are counted as written, before the shuffle; all the rest, marks and types included,
    works on the distinct ones."""
    keyed = texts.select(F.lit(0).alias("key"), F.col(text).alias("text"))
    return _learn(texts, text, _typed_pairs(_borders(keyed, "key", "text"))[0])


def _typed_pairs(borders: DataFrame) -> tuple[DataFrame, str]:
    """Distinct pairs with their number m, typed once and stored, and the path."""
    return stored(_typed(borders.groupBy("word", "after").agg(F.count("*").alias("m"))))


def _learn(texts: DataFrame, text: str, pairs: DataFrame) -> SentenceModel:
    word = F.col("word")
    ended = pairs.groupBy(F.col("after").alias("word")).agg(F.sum("m").alias("ended"))
    raw = _words(texts, text).join(ended, "word", "left").withColumn("inside", F.col("n") - F.col("opening") - F.coalesce("ended", F.lit(0)))
    number = lambda c, of: F.coalesce(F.sum(F.when(c, F.col(of))), F.lit(0))
    raw = raw.select("n", "inside", _bare(word).alias("b"), _first(word).alias("f")).select("n", "inside", "f", _stopped(F.col("b")).alias("s"), _plain(F.col("b")).alias("p"))
    raw = raw.select("n", "inside", "s", _type(F.col("p")).alias("type"), _lower(F.col("f")).alias("l"), _upper(F.col("f")).alias("u"))
    types = raw.groupBy("type").agg(F.sum("n").alias("n"), number(F.col("s"), "n").alias("stopped"), number(F.col("l"), "n").alias("lower"), number(F.col("u"), "inside").alias("inner_upper"))
    # Filtered when it is stored: before, the filter would move below both counts, to every word of the texts.
    types = stored(types)[0].where("type <> ''")
    around = pairs.where("next <> '' and mark <> '..'").groupBy("mark", "type", "next", "upper").agg(F.sum("m").alias("n"))
    totals = types.agg(F.sum("n").alias("total"), F.sum("stopped").alias("stops"))  # one row
    plain = F.col("n") - F.col("stopped")
    scored = types.where((F.col("stopped") > 0) & (F.col("type") != NUMBER)).crossJoin(totals)
    scored = scored.select("type", "stopped", plain.alias("plain"), abbreviation_score(F.col("stopped"), plain, F.col("stops"), F.col("total"), F.col("type")).alias("score"))
    abbreviations, _ = stored(scored.where(F.col("score") >= ABBREVIATION))
    listed = abbreviations.select("type", F.lit(True).alias("listed"))
    keeps, _ = stored(around.join(listed, "type", "left").withColumn("keeps", (F.col("mark") == ".") & _keeps_stop(F.col("type"), F.coalesce("listed", F.lit(False)))).drop("listed"))
    ends = keeps.where("not keeps").groupBy(F.col("next").alias("type")).agg(F.sum("n").alias("opens"))
    all_ends = ends.agg(F.sum("opens").alias("ends"))  # one row
    starters = ends.join(types, "type").crossJoin(totals).crossJoin(all_ends).where(F.col("type") != NUMBER)
    starters = starters.withColumn("score", association(F.col("ends"), F.col("n"), F.col("opens"), F.col("total")))
    starters = starters.where((F.col("score") >= STARTER) & (F.col("opens") * F.col("total") > F.col("n") * F.col("ends"))).select("type", "opens", "n", "score")
    kept = keeps.where("keeps").groupBy("type", "next").agg(F.sum("n").alias("both"), F.bool_or("upper").alias("upper"))
    facts = types.select(F.col("type").alias("next"), F.col("n").alias("nb"), "lower", "inner_upper")
    kept = kept.join(types.select("type", F.col("n").alias("na")), "type").join(facts, "next").crossJoin(totals)
    kept = kept.withColumn("score", association(F.col("na"), F.col("nb"), F.col("both"), F.col("total")))
    together = (F.col("both") > 1) & (F.col("score") >= COLLOCATION) & (F.col("both") * F.col("total") > F.col("na") * F.col("nb"))
    kept, _ = stored(kept.withColumn("together", together))
    opens = kept.join(starters.select(F.col("type").alias("next"), F.lit(True).alias("starter")), "next", "left")
    breaks = opens.where(F.col("upper") & ~F.col("together") & (F.coalesce("starter", F.lit(False)) | (F.col("lower") > 0) & (F.col("inner_upper") == 0)))
    return SentenceModel(abbreviations, starters, kept.where("together").select("type", "next", F.col("both").alias("n"), "score"), stored(breaks.select("type", "next"))[0])


def _stays(pairs: DataFrame, model: SentenceModel) -> DataFrame:
    """word, after: the typed pairs whose mark does not end a sentence."""
    typed = pairs.where("mark <> '!'")
    listed = model.abbreviations.select("type", F.lit(True).alias("listed"))
    known = typed.where("mark = '.'").join(listed, "type", "left").where(_keeps_stop(F.col("type"), F.coalesce("listed", F.lit(False))))
    known = known.join(model.breaks.withColumn("open", F.lit(True)), ["type", "next"], "left")
    ends = F.when(F.col("upper"), F.coalesce("open", F.lit(False))).otherwise((F.col("type") == NUMBER) & ~F.col("lower"))
    return known.where(~ends).select("word", "after").unionByName(typed.where("mark = '..' and lower").select("word", "after"))


def learned_sentences(texts: DataFrame, key: str = "doc_id", text: str = "text", model: SentenceModel | None = None, least: int = 10, most: int = 1000) -> DataFrame:
    """key, pos, sentence: stripped sentences of least to most characters, by a model learned from the same texts if none is
    given. Whether a mark ends a sentence is worked out once for each distinct pair of words around it; only the places where it
    does not are sent back to their texts. Rows of equal key and text stay apart."""
    at = _borders(texts, key, text)  # read from the texts twice: less than it would take to store
    pairs, at_pairs = _typed_pairs(at)
    stays, _ = stored(_stays(pairs, model or _learn(texts, text, pairs)))
    delete(texts.sparkSession, at_pairs)
    on = at.join(stays, ["word", "after"])
    joined = on.groupBy(F.col("key").alias("of"), F.col("h").alias("text")).agg(F.collect_set("at").alias("on"))
    cut = texts.select(F.col(key).alias("key"), _digest(text).alias("h"), stretches(text).alias("s"))
    both = cut.join(joined, F.col("key").eqNullSafe(F.col("of")) & (F.col("h") == F.col("text")), "left").select("key", "s", F.coalesce("on", F.array().cast("array<int>")).alias("on"))
    stops = F.when(F.size("s") > 0, F.array_except(F.sequence(F.lit(0), F.size("s") - 1), "on")).otherwise(F.array().cast("array<int>"))
    both = both.select("key", "s", stops.alias("stop"))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice("stop", F.lit(1), F.greatest(F.size("stop") - 1, F.lit(0))), lambda x: x + 1))
    whole = F.transform(F.arrays_zip(starts.alias("a"), F.col("stop").alias("b")), lambda z: strip(F.array_join(F.slice("s", z["a"] + 1, z["b"] - z["a"] + 1), "")))
    return both.select(F.col("key").alias(key), F.posexplode(F.filter(whole, lambda x: F.length(x).between(least, most))).alias("pos", "sentence"))


def abbreviations_sql(table: str = "documents") -> str:
    """`learn` up to the abbreviations, and all that the rest of it reads, as a WITH list."""
    bare = lambda w: f"regexp_replace(lower({w}), '^[^{WORD_CHARS}]+|[^{WORD_CHARS}.]+$', '', 'g')"
    closers = CLOSERS.replace("'", "''")
    kind = lambda w: f"(case when regexp_matches(regexp_replace({bare(w)}, '\\.+$', ''), '^\\p{{N}}[\\p{{N}}.,]*$') then '{NUMBER}' else regexp_replace({bare(w)}, '\\.+$', '') end)"
    first = lambda w: f"regexp_extract({w}, '^[^{WORD_CHARS}]*([{WORD_CHARS}])', 1)"
    end = lambda w: f"regexp_extract({w}, '([.!?]+)[{closers}]*$', 1)"
    stopped = lambda w: f"regexp_matches({bare(w)}, '[^.]\\.$')"
    facts = lambda w, p: f"{kind(w)} as {p}type, {stopped(w)} as {p}stopped, regexp_matches({first(w)}, '^\\p{{Lu}}') as {p}upper, regexp_matches({first(w)}, '^\\p{{Ll}}') as {p}lower, case when {end(w)} = '' then '' when regexp_matches({end(w)}, '[!?]') then '!' when {stopped(w)} then '.' else '..' end as {p}mark, regexp_matches({w}, '[.!?][{closers}]*$') as {p}ended"
    return f"""
t as (select list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> '') as w from {table}),
p as (select unnest(w) as word, unnest(list_prepend(null, w[:-2])) as before from t where len(w) > 0),
q as (select {facts("word", "")}, {facts("before", "b_")}, before is null as opening from p),
types as materialized (select type, count(*) as n, count(*) filter (stopped) as stopped, count(*) filter (lower) as lower, count(*) filter (upper and not opening and not b_ended) as inner_upper from q where type <> '' group by type),
around as materialized (select b_mark as mark, case when b_mark = '.' then b_type else '' end as type, type as next, upper, count(*) as n from q where not opening and b_mark in ('.', '!') and type <> '' group by all),
totals as (select sum(n) as total, sum(stopped) as stops from types),
scored as (select type, stopped, n - stopped as plain, length(replace(type, '.', '')) as size,
  -2 * (stopped * ln(greatest(stops / total, {TINY})) + (n - stopped) * ln(greatest(1 - stops / total, {TINY})) - stopped * ln({STOPPED}) - (n - stopped) * ln(1 - {STOPPED}::double)) as ratio from types, totals where stopped > 0 and type <> '{NUMBER}'),
abbreviations as materialized (select type, stopped, plain, score from (select *, ratio * exp(-size) * (length(type) - size + 1) * pow(size::double, -plain) as score from scored) where score >= {ABBREVIATION})"""


def _association_sql(a: str, b: str, both: str) -> str:
    log = lambda x: f"ln(greatest({x}, {TINY}))"
    fit = lambda k, n, p: f"(({k}) * {log(p)} + (({n}) - ({k})) * {log(f'1 - ({p})')})"
    p, rest = f"({b} / total)", f"(total - {a})"
    apart = f"(({b} - {both}) / greatest({rest}, 1))"
    return f"-2 * ({fit(both, a, p)} + {fit(f'{b} - {both}', rest, p)} - case when {a} = {both} then 0 else {fit(both, a, f'({both} / {a})')} end - case when {b} = {both} then 0 else {fit(f'{b} - {both}', rest, apart)} end)"


def model_sql(table: str = "documents") -> str:
    """All of `learn` as a WITH list."""
    return abbreviations_sql(table) + f""",
keeps as (select a.*, mark = '.' and (b.type is not null or a.type = '{NUMBER}' or regexp_matches(a.type, '^\\p{{L}}$')) as keeps from around a left join abbreviations b on a.type = b.type),
ends as (select next as type, sum(n) as opens from keeps where not keeps group by next),
starters as materialized (select type, opens, n, score from (select e.type, opens, n, total, ends, {_association_sql("ends", "n", "opens")} as score from ends e join types using (type), totals, (select sum(opens) as ends from ends) where e.type <> '{NUMBER}') where score >= {STARTER} and opens * total > n * ends),
kept as (select type, next, sum(n) as both_n, bool_or(upper) as upper from keeps where keeps group by type, next),
linked as materialized (select *, both_n > 1 and score >= {COLLOCATION} and both_n * total > na * nb as together from (select k.*, a.n as na, b.n as nb, b.lower, b.inner_upper, total, {_association_sql("a.n", "b.n", "both_n")} as score from kept k join types a on k.type = a.type join types b on k.next = b.type, totals)),
breaks as (select l.type, l.next from linked l left join starters s on l.next = s.type where l.upper and not together and (s.type is not null or lower > 0 and inner_upper = 0))"""


def sentences_sql(table: str = "documents", key: str = "doc_id", least: int = 10, most: int = 1000) -> str:
    closers = CLOSERS.replace("'", "''")
    bare = lambda w: f"regexp_replace(lower({w}), '^[^{WORD_CHARS}]+|[^{WORD_CHARS}.]+$', '', 'g')"
    kind = lambda w: f"(case when regexp_matches(regexp_replace({bare(w)}, '\\.+$', ''), '^\\p{{N}}[\\p{{N}}.,]*$') then '{NUMBER}' else regexp_replace({bare(w)}, '\\.+$', '') end)"
    first = lambda w: f"regexp_extract({w}, '^[^{WORD_CHARS}]*([{WORD_CHARS}])', 1)"
    end = lambda w: f"regexp_extract({w}, '([.!?]+)[{closers}]*$', 1)"
    return f"""with {model_sql(table)},
s as (select {key}, regexp_extract_all(text, '{STRETCH.replace(CLOSERS, closers)}') as s from {table}),
x as (select {key}, unnest(s) as stretch, generate_subscripts(s, 1) as k from s),
y as (select *, regexp_extract(stretch, '([^{WS_CHARS}]+){WS}*$', 1) as word, regexp_extract(lead(stretch) over (partition by {key} order by k), '^{WS}*([^{WS_CHARS}]+)', 1) as after from x),
z as (select {key}, k, stretch, after is null as last, case when regexp_matches({end("word")}, '[!?]') then '!' when regexp_matches({bare("word")}, '[^.]\\.$') then '.' else '..' end as mark, {kind("word")} as type, {kind("after")} as next, regexp_matches({first("after")}, '^\\p{{Lu}}') as upper, regexp_matches({first("after")}, '^\\p{{Ll}}') as lower from y),
e as (select z.*, last or case when mark = '!' then true when mark = '..' then not lower when a.type is null and z.type <> '{NUMBER}' and not regexp_matches(z.type, '^\\p{{L}}$') then true when upper then b.type is not null else z.type = '{NUMBER}' and not lower end as stop
  from z left join abbreviations a on z.type = a.type left join breaks b on z.type = b.type and z.next = b.next),
g as (select *, coalesce(sum(stop::int) over (partition by {key} order by k rows between unbounded preceding and 1 preceding), 0) as g from e),
w as (select {key}, g, regexp_replace(string_agg(stretch, '' order by k), '^{WS}+|{WS}+$', '', 'g') as sentence from g group by {key}, g)
select {key}, (row_number() over (partition by {key} order by g) - 1)::int as pos, sentence from w where length(sentence) between {least} and {most}"""
