"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells (source, language, topic). The cells' token counts are raked: in turn, each dimension's
sums are scaled to its target shares, round after round, until all three marginals fit at once. A cell's rate is
its raked share over its own share of the tokens; a document is sampled with the probability rate / largest rate,
so expected tokens have the target shares and the scarcest cell is kept whole. The decision is a hash of the id
below the probability: the same on every run and every partitioning.

A target is an exponent t (each value's share is proportional to its token share to the power t; 1 keeps the shares,
0 evens them out) or a dict of shares (values that are not in it get none). Marginals that cannot be met together,
because cells are missing, end at the fit of the last dimension.

Only the cells, one row for each combination of values, are raked. Up to MAX_CELLS cells stand in one partition, where
the sums over a value are window sums without a shuffle. Beyond, they stay dealt out: each sum is an aggregation, joined
back to the cells by its value. Totals are one-row aggregations on either path. After each stretch of ROUNDS rounds the
cells are stored and the residual is taken; it ends the raking at RESIDUAL or when a stretch no longer lowers it by a tenth
(targets that cannot be met together). Up to BROADCAST_CELLS cells are sent to the documents; beyond, they are joined.

A null value of a dimension is a value of its own, apart from the empty string; null text has no tokens. Documents of a
cell without tokens carry no weight and are kept. Rows with equal ids share their fate. An empty table gives an empty
result. Columns whose names clash with the results (RESULTS) are replaced, all others passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silkloom.llm.common import WORD, materialise

DIMENSIONS = ("source", "lang", "topic")
TARGETS = {"source": 0.8, "lang": 0.8, "topic": 0.95}
ROUNDS, MAX_CELLS, BROADCAST_CELLS = 12, 200_000, 10_000
#: Tokens' share by which the marginals of a dimension may be off in all, and the stretches of rounds that may be tried for it.
RESIDUAL, STRETCHES = 1e-6, 20
RESULTS = ("topic", "n_tokens", "weight", "probability", "kept")


def topic_of(text: Column) -> Column:
    """A coarse topic by surface marks: tabular (5 or more bars), legal (names a licence), contact (an @), prose."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(bars >= 5, "tabular").when(text.contains("icense"), "legal").when(text.contains("@"), "contact").otherwise("prose")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _with_sum(cells: DataFrame, column: str, dim: str, dealt: bool) -> DataFrame:
    """cells with __own, the sum of a column over the cells of the same value."""
    if not dealt:
        return cells.withColumn("__own", F.sum(column).over(Window.partitionBy(dim)))
    return cells.join(cells.groupBy(dim).agg(F.sum(column).alias("__own")), dim)


def residual(cells: DataFrame, dims: tuple[str, ...]) -> float:
    """The greatest sum over a dimension's values of what their weights are off their targets."""
    off = lambda d: cells.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"t_{d}")).alias("off")).agg(F.sum("off")).first()[0]
    return max(off(d) for d in dims)


def rake(cells: DataFrame, targets: dict[str, float | dict[str, float]], rounds: int = ROUNDS) -> DataFrame:
    """Stored cells (dimensions, tokens) -> dimensions, weight (the raked share) and probability, for cells with tokens."""
    cells = cells.where("tokens > 0")
    n, total = cells.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return cells.select(*targets, F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability"))
    dealt = n > MAX_CELLS
    share = (cells if dealt else cells.coalesce(1)).withColumn("w", F.col("tokens") / F.lit(float(total)))
    for dim, target in targets.items():
        if isinstance(target, dict):
            wanted = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for v, part in target.items() for x in (_held(F.lit(v)), float(part))]), F.col(dim)), F.lit(0.0))
        else:
            wanted = F.pow("__own", F.lit(float(target)))
        values = share.groupBy(dim).agg(F.sum("w").alias("__own")).select(dim, wanted.alias("__want"))
        whole = values.agg(F.sum("__want")).first()[0] or 1.0
        share = _with_sum(share, "w", dim, dealt).withColumn(f"t_{dim}", wanted / F.lit(float(whole))).drop("__own")
    share, before = share.withColumn("weight", F.col("w")), None
    for _ in range(STRETCHES):
        for _ in range(rounds):
            for dim in targets:
                share = _with_sum(share, "weight", dim, dealt)
                share = share.withColumn("weight", F.coalesce(F.col("weight") * F.col(f"t_{dim}") / F.when(F.col("__own") > 0, F.col("__own")), F.lit(0.0))).drop("__own")
            share = materialise(share) if dealt else share
        share = materialise(share)
        off = residual(share, tuple(targets))
        if off <= RESIDUAL or before is not None and off > 0.9 * before:
            break
        before, share = off, share if dealt else share.coalesce(1)
    top = share.agg(F.max(F.col("weight") / F.col("w"))).first()[0]
    return share.select(*targets, F.round("weight", 9).alias("weight"), F.round(F.col("weight") / F.col("w") / F.lit(top or 1.0), 9).alias("probability"))


def _held(value: Column) -> Column:
    """A value as text in which null, as the empty string, is apart from the empty string."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", topic: Column | None = None, targets: dict | None = None, rounds: int = ROUNDS, salt: str = "mix", dimensions: dict[str, str] | None = None) -> DataFrame:
    """docs with topic, n_tokens, weight (of the cell), probability and kept. `dimensions` names the columns of targets
    whose column has another name."""
    targets = TARGETS if targets is None else targets
    rows = docs.drop(*RESULTS).withColumn("topic", topic_of(F.col(text)) if topic is None else topic)
    rows = rows.withColumn("n_tokens", n_tokens(F.col(text)))
    held = {d: _held(F.col((dimensions or {}).get(d, d))) for d in targets}
    cells = materialise(rows.select(*(c.alias(d) for d, c in held.items()), "n_tokens").groupBy(*targets).agg(F.sum("n_tokens").alias("tokens")))
    raked = materialise(rake(cells, targets, rounds))
    n = raked.count()
    raked = raked.select(*(F.col(d).alias(f"__{d}") for d in targets), "weight", "probability")
    on = [c == F.col(f"__{d}") for d, c in held.items()]
    joined = rows.join(F.broadcast(raked) if n <= BROADCAST_CELLS else raked, on, "left").drop(*(f"__{d}" for d in targets))
    joined = joined.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return joined.withColumn("kept", uniform(F.col(key), salt) < F.col("probability"))


def oracle_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of mix() over documents, with the default targets."""
    steps, last = [], "r0"
    for i in range(rounds * len(DIMENSIONS)):
        d = DIMENSIONS[i % len(DIMENSIONS)]
        steps.append(f"r{i + 1} as (select * replace (weight * t_{d} / sum(weight) over (partition by {d}) as weight) from {last})")
        last = f"r{i + 1}"
    wanted = ", ".join(f"pow(sum(w) over (partition by {d}), {TARGETS[d]}) as p_{d}, sum(w) over (partition by {d}) as o_{d}" for d in DIMENSIONS)
    scaled = ", ".join(f"p_{d} / sum(p_{d} * w / o_{d}) over () as t_{d}" for d in DIMENSIONS)
    return f"""
with docs as (
  select doc_id, source, lang,
    case when length(text) - length(replace(text, '|', '')) >= 5 then 'tabular' when contains(text, 'icense') then 'legal'
      when contains(text, '@') then 'contact' else 'prose' end as topic,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens,
    ('0x' || substr(md5(doc_id::varchar || '|mix'), 1, 8))::ubigint / 4294967296.0 as u
  from documents),
cells as (select source, lang, topic, sum(n_tokens)::double as tokens from docs group by all having sum(n_tokens) > 0),
shares as (select *, tokens / sum(tokens) over () as w from cells),
powers as (select *, {wanted} from shares),
r0 as (select *, w as weight, {scaled} from powers),
{", ".join(steps)},
raked as (select source, lang, topic, round(weight, 9) as weight, round(weight / w / max(weight / w) over (), 9) as probability from {last})
select doc_id, d.source, d.lang, d.topic, n_tokens, coalesce(weight, 0.0) as weight, coalesce(probability, 1.0) as probability,
  u < coalesce(probability, 1.0) as kept
from docs d left join raked r on d.source is not distinct from r.source and d.lang is not distinct from r.lang and d.topic = r.topic"""
