"""Named queries over the test tables, each with the DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkloom.cache import AnswerCache
from silkloom.functions import responses, thai
from silkloom.functions import text as txt
from silkloom.operators import augment, entities, graph, metrics, neighbours, segment, sentence_ends, similarity, spelling, validate
from silkloom.plans import documents
from silkloom.sources import files, remote
from silkloom.sources.sinks import save_array, with_quality
from silkloom.storage import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("article"))
    told = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("summary"))
    return asked.join(told, ["conv_id", "turn"])


# SQL of the shared pieces.
TURNS = "select a.conv_id, a.turn, a.text as article, b.text as summary from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'"
LABELLED = "select doc_id, text, quality as label from documents join labels using (doc_id)"
U = "('0x' || substr(md5({}), 1, 8))::ubigint / 4294967296.0"


def words_sql(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '{txt.WS}+'), lambda w: w <> '')"


# Corpus.


@query(f"""
with w as (select unnest({words_sql('lower(text)')}) as word from documents),
c as (select word, count(*) as n from w group by word),
v as (select count(*) as vocabulary_size, sum(n)::bigint as total_words, count(*) filter (n = 1) as hapax_legomena from c),
l as (select avg(len({words_sql('text')})) as a, stddev_pop(len({words_sql('text')})) as s from documents)
select vocabulary_size, total_words, round(vocabulary_size / total_words, 6) as type_token_ratio, hapax_legomena,
  round(a, 6) as avg_sentence_length, round(s, 6) as std_sentence_length from v, l""")
def corpus_metrics(spark, sf_dir):
    return rounded(metrics.corpus_metrics(table(spark, sf_dir, "documents")))


@query(f"""
with w as (select unnest({words_sql('text')}) as word from documents)
select (select count(*) from documents) as n_samples, count(distinct word) as vocab_size,
  round(count(*) / (select count(*) from documents), 6) as avg_length from w""")
def corpus_metadata(spark, sf_dir):
    return rounded(metrics.corpus_metadata(table(spark, sf_dir, "documents")))


@query(f"with w as (select unnest({words_sql('lower(text)')}) as word from documents) select word, count(*) as n from w group by word order by n desc, word limit 20")
def top_words(spark, sf_dir):
    return metrics.top_words(table(spark, sf_dir, "documents"))


@query(f"with w as (select unnest({words_sql('lower(text)')}) as word from documents) select word, count(*) as n from w group by word")
def word_frequencies(spark, sf_dir):
    return metrics.top_words(table(spark, sf_dir, "documents"), k=None)


@query(f"""
with l as (select len({words_sql('text')}) as x from documents), s as (select min(x) as lo, max(x) as hi from l)
select (case when hi = lo then 0 else least(floor((x - lo) * 30 / (hi - lo)), 29) end)::int as bin, count(*) as n from l, s group by bin""")
def length_histogram(spark, sf_dir):
    return metrics.length_histogram(table(spark, sf_dir, "documents"))


@query(f"""
with w as (select unnest({words_sql('text')}) as word from documents), v as (select count(distinct word) as vs, count(*) as tw from w),
l as (select length(text) as len, row_number() over (order by length(text)) - 1 as k, count(*) over () as n from documents),
d as (select count(*) as tc, count(distinct text) as uc, min(length(text)) as mi, max(length(text)) as ma, avg(length(text)) as me, stddev_pop(length(text)) as sd from documents)
select tc as text_count, uc as unique_text_count, vs as vocabulary_size, tw as total_words, mi::bigint as length_min, ma::bigint as length_max,
  round(me, 6) as length_mean, round(sd, 6) as length_std, (select len from l where k = n // 2)::bigint as length_median,
  round(uc / tc, 6) as uniqueness_ratio, round(vs / tw, 6) as type_token_ratio from d, v""")
def text_diversity(spark, sf_dir):
    return long(rounded(metrics.text_diversity(table(spark, sf_dir, "documents"))), "length_min", "length_max", "length_median")


@query("""
with c as (select quality::varchar as label, count(*) as n from labels where quality is not null group by 1), p as (select *, n / sum(n) over () as p from c)
select count(*) as n_classes, round(-sum(p * log2(p)) + 0.0, 6) as entropy, round(1 - sum(p * p), 6) as gini_impurity, round(min(p) / max(p), 6) as min_max_ratio,
  round(case when count(*) > 1 then -sum(p * log2(p)) / log2(count(*)) else 1.0 end, 6) as balance_score from p""")
def class_balance(spark, sf_dir):
    return rounded(metrics.class_balance(table(spark, sf_dir, "labels"), "quality"))


@query("""
with c as (select quality::varchar as label, count(*) as n from labels where quality is not null group by 1),
p as (select n / sum(n) over () as p, count(*) over () as k from c)
select count(*) as number_of_classes, round(max(abs(p - 1 / k)), 6) as max_class_deviation, max(abs(p - 1 / k)) < 0.1 as is_balanced from p""")
def class_deviation(spark, sf_dir):
    return rounded(metrics.class_deviation(table(spark, sf_dir, "labels"), "quality"))


@query("with c as (select source as label, count(*) as n from documents where source is not null group by 1) select label, n, round(n / sum(n) over (), 6) as frequency from c")
def class_distribution(spark, sf_dir):
    return rounded(metrics.class_counts(table(spark, sf_dir, "documents"), "source"))


@query("select count(distinct text) as distinct_texts, count(*) - count(distinct text) as copies from documents")
def exact_duplicates(spark, sf_dir):
    by_text = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("m"))
    return by_text.agg(F.count("*").alias("distinct_texts"), F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("copies"))


# Near duplicates. The plain join on terms is the check of the prefix filter.

STOPWORDS = similarity.ENGLISH
_PAIRS = f"""
with t as (select doc_id, list_sort(list_filter(regexp_extract_all(strip_accents(lower(text)), '[{txt.WORD_CHARS}]{{2,}}'), lambda w: w not in ({", ".join(f"'{w}'" for w in STOPWORDS)}))) as t from documents),
c as (select min(doc_id) as id, count(*) as m, t from t where len(t) > 0 group by t),
tf as (select id, m, term, count(*) as tf from (select id, m, unnest(t) as term from c) group by all),
df as (select term, sum(m) as df from tf group by term),
w as (select id, m, term, tf * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as w from tf join df using (term)),
u as (select id, m, term, w / sqrt(sum(w * w) over (partition by id)) as w from w),
p as (select a.id as i, b.id as j, sum(a.w * b.w) as similarity, (a.m * b.m)::bigint as n_pairs from u a join u b on a.term = b.term and a.id < b.id group by a.id, b.id, a.m, b.m having sum(a.w * b.w) > 0.9
  union all select id, id, 1.0, (m * (m - 1) // 2)::bigint from c where m > 1)"""


@query(f"{_PAIRS} select i, j, round(similarity, 6) as similarity, n_pairs from p")
def near_duplicate_pairs(spark, sf_dir):
    return rounded(similarity.near_duplicates(table(spark, sf_dir, "documents"), stopwords=STOPWORDS))


@query(f"{_PAIRS} select coalesce(sum(n_pairs), 0)::bigint as near_duplicate_pairs, round(coalesce(sum(n_pairs), 0) / ((select count(*) from documents) * ((select count(*) from documents) - 1) / 2), 9) as redundancy_rate from p")
def redundancy_rate(spark, sf_dir):
    return rounded(similarity.redundancy(table(spark, sf_dir, "documents"), stopwords=STOPWORDS), 9)


# Cleaning and splitting.

_LINKLESS = f"regexp_replace(text, '{txt.URL}', '', 'g')"
_PLAIN = f"regexp_replace({_LINKLESS}, '{txt.SPECIAL}', ' ', 'g')"
_TIGHT = f"regexp_replace({_PLAIN}, '{txt.WS}+', ' ', 'g')"


@query(f"""
select doc_id, trim({_TIGHT}) as clean_text, length(text)::bigint as original_length, len(regexp_extract_all(text, '{txt.URL}'))::bigint as urls_removed,
  len(regexp_extract_all({_LINKLESS}, '{txt.SPECIAL}'))::bigint as special_chars_removed, (length({_PLAIN}) - length({_TIGHT}))::bigint as spaces_normalized,
  length(trim({_TIGHT}))::bigint as final_length, round(1 - length(trim({_TIGHT})) / nullif(length(text), 0), 6) as reduction_ratio from documents""")
def clean_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rounded(docs.select("doc_id", txt.clean_text("text").alias("clean_text"), txt.clean_stats("text").alias("s")).select("doc_id", "clean_text", "s.*"))


@query(f"select page_id, len(regexp_extract_all(html, '{txt.URL}'))::bigint as urls_removed, trim(regexp_replace(regexp_replace(regexp_replace(html, '{txt.URL}', '', 'g'), '{txt.SPECIAL}', ' ', 'g'), '{txt.WS}+', ' ', 'g')) as clean_text from pages")
def clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", txt.clean_stats("html")["urls_removed"].alias("urls_removed"), txt.clean_text("html").alias("clean_text"))


@query(f"select doc_id, coalesce(trim(regexp_replace(regexp_replace({_LINKLESS}, '{txt.NOT_THAI_OR_ASCII}', ' ', 'g'), '{txt.WS}+', ' ', 'g')), '') as clean_text from documents")
def clean_thai_charset(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", thai.clean_thai("text").alias("clean_text"))


def _stretches_sql(column: str) -> str:
    """Texts cut after the white space that follows an ending mark; that white space goes."""
    return f"list_transform(regexp_extract_all({column}, '(?s).*?[.!?]{txt.WS}+|.+\\z'), lambda s: regexp_replace(s, '([.!?]){txt.WS}+$', '\\1'))"


@query(f"""
with s as (select doc_id, unnest({_stretches_sql("text")}) as s, generate_subscripts({_stretches_sql("text")}, 1) as k from documents)
select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as pos, regexp_replace(s, '^{txt.WS}+|{txt.WS}+$', '', 'g') as sentence from s where length(s) between 10 and 1000""")
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(txt.sentences("text")).alias("pos", "sentence"))


@query("""
with recursive c as (
  select doc_id, text, length(text) as n, 0 as start, 0 as stop, -1 as pos from documents where length(text) > 1000
  union all
  select doc_id, text, n, s, case when s + 1000 < n and back > 0 then s + back else least(s + 1000, n) end, pos + 1
  from (select *, length(regexp_replace(substr(text, s + 1, 1001), '[^ ]*$', '', 's')) - 1 as back
    from (select *, case when pos < 0 then 0 when stop - 100 > start then stop - 100 else stop end as s from c where pos < 0 or stop < n)))
select doc_id, pos::int as pos, regexp_replace(substr(text, start + 1, stop - start), '^[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}]+|[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}]+$', '', 'g') as chunk from c where pos >= 0
union all select doc_id, 0, text from documents where length(text) <= 1000""".replace("\\\\", "\\"))
def chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(txt.chunks("text")).alias("pos", "chunk"))


def _section_sql(name: str) -> str:
    """The first match, whose lookahead may as well be read."""
    opens, ends = (p.replace(r"\s", txt.WS).replace(rf"[\.{txt.WS}]", rf"[\.{txt.WS_CHARS}]") for p in txt.SECTIONS[name])
    return f"regexp_replace(regexp_extract(text, '(?is)(?:{opens}){txt.WS}+(.+?)\n{txt.WS}*(?:{ends}|$)', 1), '^{txt.WS}+|{txt.WS}+$', '', 'g') as {name}"


@query(f"select doc_id, {', '.join(map(_section_sql, txt.SECTIONS))} from documents")
def sections(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", txt.sections("text").alias("s")).select("doc_id", "s.abstract", "s.introduction", "s.method", "s.results", "s.conclusion")


@query(f"select doc_id, len(regexp_extract_all(text, '[{txt.WORD_CHARS}]+|[^{txt.WORD_CHARS}{txt.WS_CHARS}]'))::bigint as words from documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", txt.word_count("text").alias("words"))


@query(f"""
with c as (select doc_id, trim({_TIGHT}) as t, text from documents), s as (select doc_id, unnest({_stretches_sql("t")}) as s from c),
n as (select doc_id, count(*) as n from s where length(s) between 10 and 1000 group by doc_id)
select doc_id, t as clean_text, len(regexp_extract_all(t, '[{txt.WORD_CHARS}]+|[^{txt.WORD_CHARS}{txt.WS_CHARS}]'))::bigint as word_count, coalesce(n, 0)::bigint as sentence_count from c left join n using (doc_id)""")
def process_text(spark, sf_dir):
    done = documents.process_text(table(spark, sf_dir, "documents").select("doc_id", "text"), thai_text=True)
    return done.select("doc_id", "clean_text", "stats.word_count", "stats.sentence_count")


@query(f"select distinct unnest(({words_sql('text')})[1:3]) as concept from documents")
def key_concepts(spark, sf_dir):
    return graph.key_concepts(table(spark, sf_dir, "documents"))


@query("select doc_id, text from documents order by md5(doc_id::varchar || '|sample'), doc_id limit 50")
def sample_n(spark, sf_dir):
    return augment.sample_rows(table(spark, sf_dir, "documents"), 50).select("doc_id", "text")


_NAV = "regexp_replace(html, '(?is)<(?:script\\b.*?</script\\s*|style\\b.*?</style\\s*|iframe\\b.*?</iframe\\s*|nav\\b.*?</nav\\s*)>|<!--.*?-->|<!doctype[^>]*>', '', 'g')"
_NODE = "n"
for _name, _char in txt.ENTITIES.items():
    _NODE = f"replace({_NODE}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(f"select page_id, list_aggregate(list_transform(string_split_regex({_NAV}, '<[^>]*>'), lambda n: regexp_replace({_NODE}, '^{txt.WS}+|{txt.WS}+$', '', 'g')), 'string_agg', '') as text from pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", txt.html_text("html").alias("text"))


# Learned from the corpus: sentence ends, spelling, words without spaces, names, the graph of concepts.


@query(f"with {sentence_ends.abbreviations_sql()} select type, stopped::bigint as stopped, plain::bigint as plain, round(score, 6) as score from abbreviations")
def sentence_abbreviations(spark, sf_dir):
    return rounded(sentence_ends.learn(table(spark, sf_dir, "documents")).abbreviations)


@query(sentence_ends.sentences_sql())
def learned_sentences(spark, sf_dir):
    return sentence_ends.learned_sentences(table(spark, sf_dir, "documents"))


#: DuckDB's distance counts bytes: for it, the small letters of the Latin-1 block become single bytes.
_ONE_BYTE = "translate({}, '" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7) + "', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&(')"
_ERRORS = "case when length(word) < 3 then 0 when length(word) < 8 then 1 else 2 end"


@query(f"""
with w as (select unnest(regexp_extract_all(lower(text), '[{txt.WORD_CHARS}]+')) as word from documents), c as (select word, count(*) as n from w group by word),
r as (select word, n, {_ERRORS} as errors from c where n <= 2), f as (select word as known, n as n_known from c where n >= 50),
p as (select word, n, known, n_known, levenshtein({_ONE_BYTE.format("word")}, {_ONE_BYTE.format("known")}) as distance from r join f on abs(length(word) - length(known)) <= errors where distance <= errors)
select word, n, known as suggestion, distance::int as distance, n_known as n_suggestion from p qualify row_number() over (partition by word order by distance, n_known desc, known) = 1""")
def spelling_suggestions(spark, sf_dir):
    return spelling.suggest(table(spark, sf_dir, "documents"))


def _names(spark, sf_dir) -> DataFrame:
    """Names to look for: the first word and the first two words of each benchmark passage."""
    first = F.regexp_extract_all("text", F.lit(f"^[{txt.WORD_CHARS}]+|^[{txt.WORD_CHARS}]+ [{txt.WORD_CHARS}]+"), F.lit(0))
    two = F.regexp_extract("text", f"^[{txt.WORD_CHARS}]+ [{txt.WORD_CHARS}]+", 0)
    both = F.array(F.struct(F.get(first, 0).alias("name"), F.lit("one").alias("type")), F.struct(two.alias("name"), F.lit("two").alias("type")))
    return table(spark, sf_dir, "benchmark").select(F.inline(both)).where("name <> ''").distinct()


@query(f"""
with names as (select distinct regexp_extract(text, '^[{txt.WORD_CHARS}]+') as name, 1 as k from benchmark union select distinct regexp_extract(text, '^[{txt.WORD_CHARS}]+ [{txt.WORD_CHARS}]+'), 2 from benchmark),
p as (select doc_id, regexp_extract_all(text, '[{txt.WORD_CHARS}]+|[^{txt.WORD_CHARS}]+') as p from documents),
t as (select doc_id, unnest(p) as t, generate_subscripts(p, 1) as i from p),
q as (select doc_id, i, t, t || lead(t) over w || lead(t, 2) over w as three, sum(length(t)) over w - length(t) as start from t window w as (partition by doc_id order by i)),
s as (select doc_id, start, start + length(name) as stop from q join names on k = 1 and name = t and name <> '' union all select doc_id, start, start + length(name) from q join names on k = 2 and name = three and name <> ''),
o as (select *, max(stop) over (partition by doc_id order by start, stop rows between unbounded preceding and 1 preceding) as reached from s),
c as (select doc_id, count(*) as spans, sum(greatest(0, stop - greatest(start, coalesce(reached, 0)))) as covered from o group by doc_id)
select d.doc_id, coalesce(spans, 0)::int as spans, round(coalesce(covered / length(text), 0.0), 6) as coverage from documents d left join c on d.doc_id = c.doc_id""")
def name_coverage(spark, sf_dir):
    found = entities.find_entities(table(spark, sf_dir, "documents"), _names(spark, sf_dir))
    return rounded(found.select("doc_id", F.size("entities").alias("spans"), "coverage"))


@query(neighbours.neighbours_sql())
def word_neighbours(spark, sf_dir):
    return neighbours.neighbours(table(spark, sf_dir, "documents"))


#: Words of the dictionary that the query below segments by: the most frequent ones.
DICTIONARY = 50_000


@query()
def segmented_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = docs.withColumn("text", F.regexp_replace(F.lower("text"), f"{txt.WS}+", ""))
    found = segment.segment(joined, metrics.top_words(docs, k=DICTIONARY))
    return found.select("doc_id", F.size("words").alias("words"), "unknown", F.md5(segment.spaced("words")).alias("text_md5"))


@query(f"""
with recursive w as (select ({words_sql('text')})[1:3] as w from documents),
e as (select distinct source, target from (select unnest(w[:-2]) as source, unnest(w[2:]) as target from w) where source <> target),
seeds as (select ({words_sql('text')})[1] as concept from documents where doc_id = (select min(doc_id) from documents where len({words_sql('text')}) > 0)),
r as (select distinct concept, 0 as depth from seeds union select target, depth + 1 from r join e on concept = source where depth < 3)
select concept, min(depth) as depth from r group by concept""")
def concept_reach(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = docs.where(F.size(txt.tokens("text")) > 0).agg(F.min_by(F.get(txt.tokens("text"), 0), "doc_id").alias("concept"))
    return graph.reach(graph.concept_edges(docs), first, 3)


# Validation.


def _case(cases: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when {c} then '{r}'" for c, r in cases) + " end"


def _found(field: str, name: str | None) -> list[tuple[str, str]]:
    return [(f"regexp_matches({field}, '(?i){p}')", validate.FOUND.format(p) if name is None else validate.FOUND_IN.format(validate.NAMES[name], p)) for p in validate.SUSPICIOUS]


def _both(one: str, two: str, names: tuple[str, str], task: str) -> str:
    length = [(f"length({c}) not between 10 and 1000", validate.LENGTH.format(validate.NAMES[n], 10, 1000)) for c, n in ((one, names[0]), (two, names[1]))]
    found = [x for pair in zip(_found(one, names[0]), _found(two, names[1])) for x in pair]
    return _case([(f"coalesce({one}, '') = '' or coalesce({two}, '') = ''", validate.MISSING[task]), *length, *found])


_CLASSIFIED = _case([("coalesce(text, '') = '' or label is null or label = 0", validate.MISSING["text_classification"]), ("length(text) not between 10 and 1000", validate.LENGTH.format(validate.NAMES["text"], 10, 1000)), *_found("text", None)])


def _reasons(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "v.is_valid", "v.reason")


@query(f"select doc_id, {_CLASSIFIED} is null as is_valid, coalesce({_CLASSIFIED}, '{validate.OK}') as reason from ({LABELLED})")
def validate_classification(spark, sf_dir):
    return _reasons(labelled(spark, sf_dir).withColumn("v", validate.validate_sample("text_classification")), "doc_id")


@query(f"""
with v as (select {_CLASSIFIED} is null as ok from ({LABELLED}))
select count(*) as total_samples, count(*) filter (ok) as valid_samples, count(*) filter (not ok) as invalid_samples,
  round(count(*) filter (ok) / count(*), 6) as validity_ratio, count(*) filter (ok) / count(*) >= 0.8 as passed from v""")
def validation_report(spark, sf_dir):
    return rounded(validate.validate_dataset(labelled(spark, sf_dir), "text_classification"))


@query(f"select doc_id, {_CLASSIFIED} as reason from ({LABELLED}) where {_CLASSIFIED} is not null")
def validation_issues(spark, sf_dir):
    return validate.invalid_samples(labelled(spark, sf_dir), "text_classification", "doc_id")


_SUMMARY = _both("article", "summary", ("article", "summary"), "summarization")
_TRANSLATION = _both("article", "summary", ("source", "target"), "translation")


@query(f"select conv_id, turn, {_SUMMARY} is null as is_valid, coalesce({_SUMMARY}, '{validate.OK}') as reason from ({TURNS})")
def validate_summarization(spark, sf_dir):
    return _reasons(turns(spark, sf_dir).withColumn("v", validate.validate_sample("summarization")), "conv_id", "turn")


@query(f"select conv_id, turn, {_TRANSLATION} is null as is_valid, coalesce({_TRANSLATION}, '{validate.OK}') as reason from ({TURNS})")
def validate_translation(spark, sf_dir):
    return _reasons(turns(spark, sf_dir).withColumn("v", validate.validate_sample("translation", source="article", target="summary")), "conv_id", "turn")


_QUESTION = _case([("coalesce(article, '') = '' or coalesce(summary, '') = ''", validate.MISSING["question"]), ("length(article) not between 10 and 1000", validate.LENGTH.format(validate.NAMES["question"], 10, 1000)), *[x for pair in zip(_found("article", "question"), _found("summary", "answer")) for x in pair]])


@query(f"""
with q as (select conv_id, turn, {_QUESTION} as reason from ({TURNS})), r as (select conv_id, arg_min(reason, turn) filter (reason is not null) as reason from q group by conv_id)
select conv_id, reason is null as is_valid, coalesce(reason, '{validate.OK}') as reason from r""")
def validate_qa(spark, sf_dir):
    asked = turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("article").alias("question"), F.col("summary").alias("answer")))).alias("questions"))
    return _reasons(asked.withColumn("context", F.lit("conversation")).withColumn("v", validate.validate_sample("question_answering")), "conv_id")


@query(f"""
with l as ({LABELLED})
select round(count(distinct text) / count(*), 6) as unique_text_ratio, min(length(text))::bigint as length_min, max(length(text))::bigint as length_max, round(avg(length(text)), 6) as length_mean, round(stddev_pop(length(text)), 6) as length_std from l""")
def dataset_diversity(spark, sf_dir):
    return long(rounded(metrics.dataset_diversity(labelled(spark, sf_dir))), "length_min", "length_max")


@query("with c as (select quality::varchar as label, count(*) as n from labels where quality is not null group by 1), p as (select label, n, n / sum(n) over () as p from c) select label, n, round(p, 6) as frequency, round(sum(p * p) over (), 6) as class_balance from p")
def label_balance(spark, sf_dir):
    return rounded(metrics.label_balance(table(spark, sf_dir, "labels"), "quality"))


_OVERLAP = f"case when len(list_distinct({words_sql('lower(summary)')})) > 0 then len(list_intersect(list_distinct({words_sql('lower(article)')}), list_distinct({words_sql('lower(summary)')}))) / len(list_distinct({words_sql('lower(summary)')})) else 0.0 end"


@query(f"""
with m as (select case when length(article) > 0 then length(summary) / length(article) else 0.0 end as c, contains(article, summary) as sub, {_OVERLAP} as o from ({TURNS}))
select count(*) as pairs, round(avg(c), 6) as compression_mean, round(min(c), 6) as compression_min, round(max(c), 6) as compression_max,
  round(avg(o), 6) as overlap_mean, round(min(o), 6) as overlap_min, round(max(o), 6) as overlap_max, round(avg(sub::int), 6) as substring_ratio from m""")
def summarization_quality(spark, sf_dir):
    return rounded(metrics.summarization_quality(turns(spark, sf_dir)))


_TAGGED = _case([("coalesce(text, '') = '' or n < 1 or n_tags < 1", validate.MISSING["ner"]), ("n <> n_tags", validate.UNEQUAL), *_found("text", None)])


@query(f"""
with r as (select conv_id, turn, text, len(list_filter(string_split(text, ' '), lambda w: w <> '')) as n from conversations), s as (select *, case when turn % 4 = 3 then greatest(n - 1, 0) else n end as n_tags from r)
select conv_id, turn, {_TAGGED} is null as is_valid, coalesce({_TAGGED}, '{validate.OK}') as reason from s""")
def validate_ner(spark, sf_dir):
    """Turns as tagged samples: a tag a word, one short in every fourth turn, and one entity."""
    tokens = F.filter(F.split("text", " "), lambda w: w != "")
    tags = F.transform(F.slice(tokens, F.lit(1), F.when(F.col("turn") % 4 == 3, F.greatest(F.size(tokens) - 1, F.lit(0))).otherwise(F.size(tokens))), lambda w: F.lit("O"))
    entity = F.array(F.struct(F.lit("x").alias("entity"), F.lit("y").alias("type"), F.lit(0).alias("start"), F.lit(1).alias("end")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", tokens.alias("tokens"), tags.alias("tags"), entity.alias("entities"))
    return _reasons(rows.withColumn("v", validate.validate_sample("token_classification")), "conv_id", "turn")


@query("""
select page_id, regexp_replace(html, '<[^>]*>', '', 'g') as snippet from pages""")
def search_snippets(spark, sf_dir):
    """Page texts marked up as search results mark their words, and unmarked."""
    plain = F.regexp_replace("html", "<[^>]*>", "")
    marked = F.regexp_replace(plain, "(a+)", '<span class="searchmatch">$1</span>')
    return table(spark, sf_dir, "pages").select("page_id", txt.strip_search_tags(marked).alias("snippet"))


@query("select conv_id, turn, md5(case turn % 3 when 0 then text when 1 then 'article ' || text else role end) as text from conversations")
def picked_texts(spark, sf_dir):
    kind = F.col("turn") % 3
    fields = [F.when(kind == 0, F.col("text")), F.when(kind == 1, F.concat(F.lit("article "), "text")), F.col("role")]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(txt.pick_text(*fields)).alias("text"))


@query(f"select count(*) filter (not ok) = 0 as is_valid from (select len(list_filter(string_split(text, chr(10)), lambda l: len({words_sql('l')}) = 1)) = 0 as ok from documents where text is not null)")
def valid_conll(spark, sf_dir):
    return files.validate(table(spark, sf_dir, "documents").where("text is not null"), "conll")


@query("select conv_id, turn, turn % 2 = 0 and turn % 3 = 0 as is_complete from conversations")
def complete_answers(spark, sf_dir):
    """Answers of which every second has a label and every third a number."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.when(F.col("turn") % 2 == 0, "x").alias("label"), F.when(F.col("turn") % 3 == 0, 1).alias("label_id"))
    return said.select("conv_id", "turn", validate.complete_response().alias("is_complete"))


# Augmentation.

#: A small synonym table for the queries.
SYNONYMS = {"the": ["a", "this"], "of": ["from"], "and": ["plus", "with"], "de": ["du", "des"], "la": ["une"], "der": ["ein", "dieser"]}
_SYN = "map {" + ", ".join(f"'{w}': [{', '.join(repr(s) for s in ss)}]" for w, ss in SYNONYMS.items()) + "}"
_ROW_WORDS = f"select conv_id || '-' || turn as id, {words_sql('text')} as w from conversations"


def _utterances(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")


@query(f"""
with c as ({_ROW_WORDS}), k as (select id, w, list_filter(w, lambda x, i: {U.format("id || '|del|0|' || (i - 1)")} >= 0.1) as kept from c)
select id, case when len(kept) > 0 then array_to_string(kept, ' ') else coalesce(w[1 + floor({U.format("id || '|del|0|keep'")} * len(w))::int], '') end as text from k""")
def augment_delete(spark, sf_dir):
    return _utterances(spark, sf_dir).select("id", augment.delete_words("id", "text", 0.1).alias("text"))


@query(f"""
with c as ({_ROW_WORDS})
select id, array_to_string(list_transform(w, lambda x, i: case when {U.format("id || '|syn|0|' || (i - 1)")} < 0.3 then coalesce({_SYN}[x][1 + floor({U.format("id || '|syn|0|' || (i - 1) || '|pick'")} * len({_SYN}[x]))::int], x) else x end), ' ') as text from c""")
def augment_synonym(spark, sf_dir):
    return _utterances(spark, sf_dir).select("id", augment.replace_synonyms("id", "text", 0.3, SYNONYMS).alias("text"))


_DELETED, _REPLACED = SQL["augment_delete"], SQL["augment_synonym"]
#: Places drawn in order; each step changes the list that the one before left.
_INSERTED = f"""
with recursive c as ({_ROW_WORDS}),
p as (select id, w, unnest(range(0, len(w))) as i from c),
q as (select id, i, w[1 + floor({U.format("id || '|ins|0|' || i || '|word'")} * len(w))::int] as word from p where {U.format("id || '|ins|0|' || i")} < 0.1),
r as (select id, i, {_SYN}[word][1 + floor({U.format("id || '|ins|0|' || i || '|pick'")} * len({_SYN}[word]))::int] as new from q),
n as (select id, i, new, row_number() over (partition by id order by i) as k from r where new is not null),
g as (select id, w, 1 as k from c union all select g.id, list_concat(list_append(w[1:n.i], n.new), w[n.i + 1:]), g.k + 1 from g join n on g.id = n.id and g.k = n.k)
select id, array_to_string(arg_max(w, k), ' ') as text from g group by id"""
_SWAPPED = f"""
with recursive c as ({_ROW_WORDS}),
p as (select id, w, unnest(range(0, len(w) - 1)) as i from c where len(w) > 1),
n as (select id, i, floor({U.format("id || '|swap|0|' || i || '|to'")} * len(w))::int as j, row_number() over (partition by id order by i) as k from p where {U.format("id || '|swap|0|' || i")} < 0.1),
g as (select id, w, 1 as k from c union all select g.id, list_transform(w, lambda x, spot: case when spot - 1 = n.i then w[n.j + 1] when spot - 1 = n.j then w[n.i + 1] else x end), g.k + 1 from g join n on g.id = n.id and g.k = n.k)
select id, array_to_string(arg_max(w, k), ' ') as text from g group by id"""


@query(_INSERTED)
def augment_insert(spark, sf_dir):
    return _utterances(spark, sf_dir).select("id", augment.insert_words("id", "text", 0.1, SYNONYMS).alias("text"))


@query(_SWAPPED)
def augment_swap(spark, sf_dir):
    return _utterances(spark, sf_dir).select("id", augment.swap_words("id", "text", 0.1).alias("text"))


@query(f"select id, text from ({_DELETED}) union select id, text from ({_REPLACED}) union select id, text from ({_INSERTED}) union select id, text from ({_SWAPPED})")
def augment_all(spark, sf_dir):
    return augment.augment(_utterances(spark, sf_dir), SYNONYMS, key="id")


# Sources.

_ENTRY = "select 'feed' || (page_id % 2) as feed, (row_number() over (partition by page_id % 2 order by page_id) - 1)::int as pos, url as title, html as description, url as link from pages"


@query(f"select feed, pos, title, link from ({_ENTRY}) where pos < 40 and (contains(lower(title), 'th') or contains(lower(description), 'th')) order by feed, pos limit 40")
def news_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(F.col("page_id") % 2).orderBy("page_id")) - 1
    entries = pages.select(F.concat(F.lit("feed"), F.col("page_id") % 2).alias("feed"), at.alias("pos"), F.col("url").alias("title"), F.col("html").alias("description"), F.col("url").alias("link"))
    return remote.filter_entries(entries, "TH", 40).select("feed", "pos", "title", "link")


@query("select page_id, 'news_' || md5(url) as paper_id from pages")
def news_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", remote.news_id(F.col("url")).alias("paper_id"))


@query("""
with h as (select page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) as h from pages)
select page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr(h, 17, 1))::int % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as paper_id from h""")
def url_uuids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.url_uuid(F.col("url")).alias("paper_id"))


def _stored(lines: DataFrame, separator: str) -> str:
    """The path of text files of these lines in the shared folder."""
    path = f"{ensure_checkpoint_dir(lines.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    lines.write.text(path, lineSep=separator)
    return path


@query(f"""
with w as (select {words_sql('text')} as w from documents)
select md5(array_to_string(list_transform(w, lambda x, i: x || ' T' || (i - 1) % 5), chr(10))) as block, len(w)::bigint as n_lines from w where len(w) > 0
union all select md5('A DT' || chr(10) || 'b NN'), 2 union all select md5('last NN'), 1""")
def conll_blocks(spark, sf_dir):
    """Documents written as CoNLL files, a word a line, and read back; two blocks more with stray blanks."""
    tagged = F.transform(txt.tokens("text"), lambda w, i: F.concat(w, F.lit(" T"), (i % 5).cast("string")))
    lines = table(spark, sf_dir, "documents").select(F.array_join(tagged, "\n").alias("value"))
    lines = lines.union(spark.createDataFrame([("\n \nA DT \n  b NN\n\t\nlast NN",)], "value string"))
    read = files.load_text(spark, _stored(lines, "\n\n"), "conll")
    return read.select(F.md5("text").alias("block"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query("select conv_id, turn, role, md5(text) as text from conversations")
def json_array(spark, sf_dir):
    """Conversations written as one JSON array in one file and read back by many tasks."""
    turns = table(spark, sf_dir, "conversations")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}.json"
    items = files.load_text(spark, save_array(turns.orderBy("conv_id", "turn"), path), "array")
    read = items.select(F.from_json("text", turns.schema).alias("r")).select("r.*")
    return read.select("conv_id", "turn", "role", F.md5("text").alias("text"))


@query("""
select conv_id || '-' || turn as key, case when turn % 3 = 0 then 'new ' || md5(text) when turn % 3 = 1 then md5(text) end as value from conversations""")
def kept_answers(spark, sf_dir):
    """Answers kept for a part of the turns, some of them twice, the table compacted, and every turn looked up in it."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "turn", F.md5("text").alias("value"))
    ensure_checkpoint_dir(spark)
    cache = AnswerCache(spark, f"kept_answers_{uuid.uuid4().hex}")
    at = lambda day: F.lit(day).cast("timestamp")
    cache.put(turns.where("turn % 3 < 2").withColumn("timestamp", at("2020-01-01")))
    cache.put(turns.where("turn % 3 = 0").select("key", F.concat(F.lit("new "), "value").alias("value"), at("2021-01-01").alias("timestamp")))
    cache.compact()
    found = cache.probe(turns.select("key")).checkpoint()
    spark.sql(f"drop table {cache.name}")
    return found


@query("""
select conv_id || '-' || turn as id, unnest([0, 1, 2]) as pos, unnest([role, turn::varchar, '{"k":' || conv_id || '}']) as item from conversations
union all select * from (values ('a', 0, 'a'), ('a', 1, '1'), ('a', 2, '{"k":2}'), ('b', 0, 'x'), ('b', 1, 'true'), ('c', 0, '7')) t(id, pos, item)""")
def json_items(spark, sf_dir):
    rows = spark.createDataFrame([("a", '["a", 1, {"k": 2}]'), ("b", '{"p": "x", "q": true}'), ("c", "7"), ("d", "not json")], "id string, c string")
    said = F.format_string('["%s", %d, {"k": %d}]', "role", "turn", "conv_id")
    rows = rows.union(table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn"), said))
    return rows.select("id", F.posexplode(files.json_items(F.col("c"))).alias("pos", "item"))


@query("select doc_id, text, split, case when split = 'train' then 0.9::double end as quality_score from (select doc_id, text, case when doc_id % 10 = 0 then 'test' else 'train' end as split from documents)")
def quality_columns(spark, sf_dir):
    split = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    return with_quality(table(spark, sf_dir, "documents").select("doc_id", "text", split.alias("split")), {"score": 0.9, "none": None})


# Thai text, entities and model answers: rows given here, and rows that Spark derives from whole tables, which hold no Thai.

THAI = {1: "ค่า น้ำ ตา", 2: "ก่้๊ข", 3: "คุณ ครับ ดี มาก", 4: "ประเทษ ของ เรา เสรจ แล้ว", 5: "ดี ๆ ใช้Sparkดี !", 6: "ก่อน​ ๑๒ ทำ", 7: "", 8: "plain words only"}


#: Words and letters that turn the documents into Thai letters, tone marks and markers.
_WORDS = {" the ": " ครับ ", " and ": " คุณ ", " of ": " ท่าน ", " de ": " ไหม ", " la ": " เสรจ ", " der ": " ประเทษ ", " die ": " จ้า ", " et ": " นะคะ "}
_LATIN, _LETTERS = "abcdefghijklmnopqrstuvwxyz", "าบคด่ฟงหิจ๋ลมน้ปำรสกุ๊วๆย๑"


def _values(rows: dict[int, str]) -> str:
    said = "text"
    for a, b in _WORDS.items():
        said = f"replace({said}, '{a}', '{b}')"
    return "(select * from (values " + ", ".join(f"({k}, '{v}')" for k, v in rows.items()) + f") union all select -1 - doc_id, translate({said}, '{_LATIN}', '{_LETTERS}') from documents) t(id, text)"


def _thai(spark, sf_dir) -> DataFrame:
    said = F.col("text")
    for a, b in _WORDS.items():
        said = F.replace(said, F.lit(a), F.lit(b))
    derived = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("id"), F.translate(said, _LATIN, _LETTERS).alias("text"))
    return spark.createDataFrame(list(THAI.items()), "id long, text string").union(derived)


def _count(c: str) -> str:
    return f"(length(text) - length(replace(text, '{c}', '')))::bigint"


def _markers(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(text, '{w}')::int" for w in words) + ")::bigint"


_N = f"len({words_sql('text')})"


@query(f"""select id, {", ".join(f"{_count(t)} as tone_{i}" for i, t in enumerate(thai.TONES, 1))},
  len(list_filter({words_sql('text')}, lambda w: not regexp_matches(w, '[{"".join(thai.TONES)}]')))::bigint as no_tone_words,
  {", ".join(f"round(case when {_N} > 0 then {_count(t)} / {_N} else 0.0 end, 6) as tone_{i}_ratio" for i, t in enumerate(thai.TONES, 1))},
  round(case when {_N} > 0 then 4 / {_N} else 0.0 end, 6) as tonal_complexity_score from {_values(THAI)}""")
def thai_tonal(spark, sf_dir):
    return rounded(_thai(spark, sf_dir).select("id", thai.tonal_metrics("text").alias("s")).select("id", "s.*"))


_WRONG = [(v, c) for c, vs in thai.MISSPELLINGS.items() for v in vs]


@query(f"""select id, array_to_string(list_filter([{", ".join(f"case when contains(text, '{v}') then '{v}>{c}' end" for v, c in _WRONG)}], lambda x: x is not null), ',') as misspellings,
  coalesce(list_sum(list_transform(regexp_extract_all(text, '[{"".join(thai.TONES)}]{{2,}}'), lambda r: length(r) - 1)), 0)::bigint as double_tones,
  round(case when text = '' then 1.0 else 1 - ({_markers(tuple(v for v, _ in _WRONG))}) / nullif({_N}, 0) end, 6) as orthographic_score from {_values(THAI)}""")
def thai_orthography(spark, sf_dir):
    rows = _thai(spark, sf_dir).select("id", thai.orthography("text").alias("s"))
    said = F.array_join(F.transform("s.misspellings", lambda m: F.concat_ws(">", m["incorrect"], m["correct"])), ",")
    return rounded(rows.select("id", said.alias("misspellings"), F.size("s.double_tone_instances").cast("long").alias("double_tones"), "s.orthographic_score"))


_ALL_MARKERS = " + ".join(_markers(ms) for ms in thai.FORMALITY.values())


@query(f"""select id, {", ".join(f"{_markers(ms)} as {c}" for c, ms in thai.FORMALITY.items())}, round(case when {_N} > 0 then ({_ALL_MARKERS}) / {_N} else 0.0 end, 6) as formality_score,
  round(case when {_N} > 0 then ({_ALL_MARKERS}) / {_N} else 0.0 end, 6) as formal_word_ratio from {_values(THAI)}""")
def thai_formality(spark, sf_dir):
    return rounded(_thai(spark, sf_dir).select("id", thai.formality("text").alias("s")).select("id", "s.*"))


@query(f"""select {", ".join(f"count(*) filter ({_markers(ms)} > 0) as {s}_count" for s, ms in thai.STYLES.items())},
  {", ".join(f"round(count(*) filter ({_markers(ms)} > 0) / count(*), 6) as {s}_ratio" for s, ms in thai.STYLES.items())}, round(count(distinct text) / count(*), 6) as semantic_diversity_score from {_values(THAI)}""")
def thai_clusters(spark, sf_dir):
    return rounded(metrics.style_clusters(_thai(spark, sf_dir)))


@query(rf"""select id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '({txt.NOT_WS}) ๆ', '\1ๆ', 'g'), ' ([.,!?])', '\1', 'g'), '([ก-๙])([a-zA-Z])', '\1 \2', 'g'), '([a-zA-Z])([ก-๙])', '\1 \2', 'g'), '^{txt.WS}+|{txt.WS}+$', '', 'g') as fixed,
  replace(translate(text, '{thai.THAI_DIGITS}' || chr(8203) || chr(8288) || chr(65279), '0123456789'), chr(3635), chr(3632) || chr(3632)) as normal from {_values(THAI)}""")
def thai_fixups(spark, sf_dir):
    return _thai(spark, sf_dir).select("id", thai.fix_common_errors("text").alias("fixed"), thai.fix_unicode("text").alias("normal"))


_SPANS = {1: (10, [(0, 3), (2, 5), (8, 12)]), 2: (4, []), 3: (6, [(1, 6), (0, 1)]), 4: (5, [(3, 3), (-1, 2)])}


@query("""
select * from (values ('1', 0.5::double), ('2', 0.0), ('3', 1.0), ('4', 0.0)) t(id, coverage)
union all select conv_id || '-' || turn, round(case when length(text) = 0 then 0.0 when length(text) < 4 then least(turn + 1, length(text)) / length(text) else least(turn + 1 + 3, length(text)) / length(text) end, 6) from conversations""")
def entity_coverage(spark, sf_dir):
    """Spans given here; and of each turn the first turn + 1 characters, and from there three more, found twice."""
    rows = spark.createDataFrame([(str(i), n, [(s, e) for s, e in spans]) for i, (n, spans) in _SPANS.items()], "id string, n int, entities array<struct<start:int,end:int>>")
    n, at = F.length("text"), (F.col("turn") + 1).cast("int")
    span = lambda a, b: F.struct(a.alias("start"), F.least(b, n).alias("end"))
    three = F.when(n >= 4, F.array(span(at, at + 3), span(at - 1, at + 2))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    rows = rows.union(table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn"), n, F.concat(F.array(span(F.lit(0), at)), three)))
    return rounded(rows.select("id", metrics.entity_coverage(F.col("entities"), F.col("n")).alias("coverage")))


_ANSWERS = {1: ("คะแนน: 0.9\nคะแนน: x\nควรปรับปรุง ภาษา", "ความรุนแรง: 2\nปัญหา: สั้น"), 2: (None, None), 3: ("no score", "ความรุนแรง: 4"), 4: ("คะแนน: 0.95", "ความรุนแรง: 1")}
_SAID = "select conv_id || '-' || turn as id, (turn % 10) / 10 as quality, (conv_id % 5 + 1)::double as severity from conversations"
_SCORES = f"""select * from (values ('1', 0.84::double, 0.9::double, 2.0::double, 'ควรปรับปรุง ภาษา', 'ปัญหา: สั้น', false), ('2', 0.0, 0.0, 5.0, '', '', true), ('3', 0.1, 0.0, 4.0, '', '', true), ('4', 0.97, 0.95, 1.0, '', '', false)) t(id, score, quality, severity, suggestions, issues, needs_revision)
union all select id, round(0.6 * quality + 0.4 * (1 - (severity - 1) / 4), 6), quality, severity, 'แนะนำ: ' || id, 'ปัญหา: ' || id, 0.6 * quality + 0.4 * (1 - (severity - 1) / 4) < {validate.REVISION_BELOW} from ({_SAID})"""


def _answers(spark, sf_dir) -> DataFrame:
    """Answers given here, and one for each turn with scores made of its numbers."""
    rows = spark.createDataFrame([(str(i), g, c) for i, (g, c) in _ANSWERS.items()], "id string, generator_response string, critic_response string")
    key = F.concat_ws("-", "conv_id", "turn")
    good = F.concat(F.lit("คะแนน: 0."), (F.col("turn") % 10).cast("string"), F.lit("\nแนะนำ: "), key)
    bad = F.concat(F.lit("ความรุนแรง: "), (F.col("conv_id") % 5 + 1).cast("string"), F.lit("\n ปัญหา: "), key)
    return rows.union(table(spark, sf_dir, "conversations").select(key, good, bad))


@query(_SCORES)
def dual_scores(spark, sf_dir):
    d = validate.dual_validation(_answers(spark, sf_dir))
    return rounded(d.select("id", F.col("combined_score").alias("score"), F.col("quality_score").alias("quality"), F.col("severity_score").alias("severity"), F.array_join("suggestions", ";").alias("suggestions"), F.array_join("issues", ";").alias("issues"), "needs_revision"))


@query(f"""
with s as ({_SCORES})
select round(avg(score), 6) as average_score, min(score) as min_score, max(score) as max_score, round(stddev_pop(score), 6) as std_score, count(*) filter (needs_revision) as samples_needing_revision, round(count(*) filter (needs_revision) / count(*), 6) as revision_ratio from s""")
def overall_scores(spark, sf_dir):
    return rounded(validate.overall_scores(validate.dual_validation(_answers(spark, sf_dir))))


@query("""
select * from (values ('1', '{"a": 1}'), ('2', '{"b": {"c": 2}}'), ('3', '{}'), ('4', '{}'), ('5', '{}')) t(id, json)
union all select conv_id || '-' || turn, case turn % 3 when 0 then '{"turn": ' || turn || '}' when 1 then '{"role": {"is": "' || role || '"}}' else '{}' end from conversations""")
def parse_json(spark, sf_dir):
    said = {"1": 'text ```json\n{"a": 1}\n``` more {"z": 0}', "2": 'so: {"b": {"c": 2}} end', "3": "none", "4": "{broken", "5": "{not: json}"}
    fenced = F.format_string('```json\n{"turn": %d}\n```\n{', "turn")
    bare = F.format_string('sure: {"role": {"is": "%s"}} ', "role")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn"), F.concat(F.translate("text", "{}", ""), F.lit("\n"), F.when(F.col("turn") % 3 == 0, fenced).when(F.col("turn") % 3 == 1, bare).otherwise("{none")))
    return spark.createDataFrame(list(said.items()), "id string, r string").union(turns).select("id", responses.json_part("r").alias("json"))


@query("""
select * from (values ('a', 0, 'is_a', 'animal'), ('a', 1, 'is_a', 'pet: small'), ('a', 2, 'part_of', 'household')) t(id, pos, type, concept)
union all select conv_id || '-' || turn, unnest([0, 1]), unnest(['part_of', 'related_to']), unnest(['conversation ' || conv_id, role]) from conversations""")
def relations(spark, sf_dir):
    said = "intro: ignored\nis_a: animal\n - another: pet: small\n\nPART_OF: household\nno colon"
    rows = spark.createDataFrame([("a", said)], "id string, r string")
    rows = rows.union(table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn"), F.format_string("Part_of: conversation %d\nnothing\n  related_to:%s ", "conv_id", "role")))
    return rows.select("id", F.posexplode(responses.relations("r")).alias("pos", "x")).select("id", "pos", "x.type", "x.concept")


_TYPE = "['is_a', 'part_of', 'has_property', 'related_to', 'similar_to', 'opposite_of', 'unknown'][1 + length(source || target) % 7]"


@query(f"""
with w as (select ({words_sql('text')})[1:3] as w from documents),
p as (select unnest(w[:-2]) as source, unnest(w[2:]) as target from w),
n as (select distinct concept from (select unnest(w) as concept from w)),
e as (select distinct source, target, {_TYPE} as type from p), k as (select * from e where type <> 'unknown'),
c as (select (select count(*) from n) as nodes, (select sum(length(concept) % 3) from n) as examples, count(*) as edges, {", ".join(f"count(*) filter (type = '{r}') as {r}" for r in responses.RELATIONS)} from k)
select nodes as total_nodes, edges as total_relations, examples::bigint as total_examples, {", ".join(responses.RELATIONS)}, round(edges / nodes, 6) as average_relations_per_node, round(examples / nodes, 6) as average_examples_per_node from c""")
def graph_coverage(spark, sf_dir):
    """The graph of the documents' first words: typed edges added, those of unknown type or without nodes dropped, counted."""
    docs = table(spark, sf_dir, "documents")
    examples = F.slice(F.array(F.lit("x"), F.lit("y")), F.lit(1), F.length("concept") % 3)
    nodes = graph.key_concepts(docs).select("concept", F.lit(0).alias("depth"), examples.alias("examples"), F.create_map().cast("map<string,string>").alias("metadata"))
    kinds = F.array(*map(F.lit, (*responses.RELATIONS, "unknown")))
    new = graph.concept_edges(docs).withColumn("type", F.get(kinds, F.length(F.concat("source", "target")) % 7))
    stray = spark.createDataFrame([("no such\n", "node\n", "is_a")], graph.EDGES)
    return rounded(graph.coverage(nodes, graph.add_edges(nodes, spark.createDataFrame([], graph.EDGES), new.union(stray))))


@query(f"""
with v as (select count(*) filter ({_CLASSIFIED} is null) / count(*) as validity, count(distinct text) / count(*) as uniqueness from ({LABELLED}))
select round((validity + uniqueness) / 2, 6) as overall_quality_score, (validity + uniqueness) / 2 >= 0.8 as meets_quality_threshold, round(1 - (validity + uniqueness) / 2, 6) as error_rate from v""")
def quality_summary(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    both = validate.validate_dataset(rows, "text_classification").crossJoin(metrics.dataset_diversity(rows))  # one row each
    return rounded(both.select(*metrics.quality_summary(F.col("validity_ratio"), F.lit(None), F.col("unique_text_ratio"))))
