"""Repair of the structure of conversations, solved once for each distinct signature.

A conversation's rows have faults; each row's first one counts: blank (no character but ASCII white space), duplicate (role
and text stand earlier in the conversation), truncated (its last character that isn't white space is none of . ! ?). It is
repaired when the initials of its roles read `(s?(ua)+)?`, by the cheapest edits: Keep (0), Rerole to user or assistant (3),
Delete (4; the one edit of blank and duplicate rows), Insert an empty user or assistant row (3); a truncated row that stays
costs 3 more. The audit is the edits' initials in order; of equally cheap ones the least in ASCII.

1. Rows: equal rows of a turn are counted before the shuffle. The first turn of each role and text comes from an aggregation
   and goes back by `hot_join`, so a text that one conversation repeats without end makes no hot task.
2. Signatures: rows, without their texts, are sorted over all tasks by conversation and turn (a long conversation spans
   tasks), and each task writes a letter a row (initial and fault); the pieces of a conversation make its signature.
3. Audits: each distinct signature is solved once. Costs come from its end backwards, as the four costs to finish from the
   states of the grammar; a memo holds each step from (letter, costs after it) on, which are few whatever the length. The
   audit is then read forwards along the cheapest edits, all states that share the audit so far at once.
4. Replay: the audits are joined back to the conversations, and each conversation's rows, in order behind its audit, are
   passed through the edits, a batch at a time. Only the signature and the audit (a byte a row) are ever held whole.

Rows are taken by turn, nulls first; those of one turn by role, then by the SHA-256 of conversation, role and text. Null roles and
texts are one space each, so the row is blank or its role has no initial that may stay; an empty role has none either. A null
conv_id is a conversation of its own. A conversation without rows gives zeros, an empty audit and the hash of the empty
string. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkloom.llm.common import hot_join, materialise

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: ASCII white space, as in a character class.
BLANK = r"\x20\x09-\x0D"
#: Letters of a signature: no fault, blank, duplicate and truncated, each for the initials s, u, a and any other.
INITIALS = "sua?"
LETTERS = "suaoSUAOwxyzWXYZ"
NEVER = 1 << 30
#: States of the grammar: 0 nothing yet, 1 after the system's row, 2 after a user's, 3 after an assistant's.
FORCED = (2, 2, 3, 2)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, n (how often the row stands): one row in 20 of each kind of damage, by a checksum."""
    none = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), none), F.lit(":"), F.coalesce(F.col(turn).cast("string"), none))
    kind = (F.crc32(F.encode(key, "UTF-8")) % 20).cast("int")
    said = F.coalesce(F.col(text), none)
    chosen = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), none).alias("role"), said.alias("text"), kind.alias("kind")).where("kind <> 0")
    return chosen.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _row_fault(text: Column) -> Column:
    """1 blank, 3 truncated, else 0."""
    last = F.regexp_extract(text, f"([^{BLANK}])[{BLANK}]*\\z", 1)
    return F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3)


def _letter(initial: Column, fault: Column) -> Column:
    return F.substr(F.lit(LETTERS), fault * len(INITIALS) + initial + 1, F.lit(1))


@functools.lru_cache(maxsize=100_000)
def _before(letter: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """(least cost, costs above it from each state before the row, costs of taking the row without inserting first)."""
    initial, fault = LETTERS.index(letter) % 4, LETTERS.index(letter) // 4
    extra = TRUNCATED if fault == 3 else 0
    take = []
    for state in range(4):
        ways = [DELETE + after[state]]
        if fault in (0, 3):
            ways.append(extra + REROLE + after[FORCED[state]])
            if (kept := _kept(state, initial)) is not None:
                ways.append(extra + after[kept])
        take.append(min(ways))
    return _least(take)


def _kept(state: int, initial: int) -> int | None:
    """The state after a row of this initial that is kept."""
    if initial == 0:
        return 1 if state == 0 else None
    return FORCED[state] if initial == FORCED[state] - 1 else None


def _least(take: list[int]) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """Costs with up to two rows inserted first; a third one would lead back to a state already met."""
    one = [min(take[s], INSERT + take[FORCED[s]]) for s in range(4)]
    costs = [min(one[s], INSERT + one[FORCED[s]]) for s in range(4)]
    low = min(costs)
    return low, tuple(c - low for c in costs), tuple(c - low for c in take)


@functools.lru_cache(maxsize=100_000)
def _edits(letter: str, after: tuple[int, ...], states: frozenset[int]) -> tuple[str, frozenset[int]]:
    """The least edits of a row from states that share the audit so far, and the states after them."""
    initial, fault = LETTERS.index(letter) % 4, LETTERS.index(letter) // 4
    extra = TRUNCATED if fault == 3 else 0
    low, costs, _ = _before(letter, after)
    said = ""
    while True:
        best = min(costs[s] for s in states)
        states = frozenset(s for s in states if costs[s] == best)
        left = low + best
        if gone := frozenset(s for s in states if DELETE + after[s] == left):
            return said + "D", gone
        if more := frozenset(FORCED[s] for s in states if INSERT + costs[FORCED[s]] == best):
            said, states = said + "I", more
            continue
        if kept := frozenset(k for s in states if fault in (0, 3) and (k := _kept(s, initial)) is not None and extra + after[k] == left):
            return said + "K", kept
        return said + "R", frozenset(FORCED[s] for s in states if extra + REROLE + after[FORCED[s]] == left)


#: The costs to finish after the last row: a conversation ends with nothing or after an assistant's row.
END = _least([0, NEVER, NEVER, 0])


def solve(signature: str) -> tuple[int, int, int, int, int, str]:
    """blank, duplicate, truncated, illegal, cost, audit."""
    counts = [sum(map(signature.count, LETTERS[4 * f : 4 * f + 4])) for f in (1, 2, 3)]
    # The other initial isn't legal beside any, itself included.
    initials = signature.translate(str.maketrans(LETTERS, "suao" * 4))
    legal = sum(initials.count(pair) for pair in ("su", "ua", "au"))
    after = [END[1]]
    total = END[0]
    for letter in reversed(signature):
        low, costs, _ = _before(letter, after[-1])
        total += low
        after.append(costs)
    cost = total + after[-1][0]
    after.pop()
    audit, states = [], frozenset({0})
    for letter in signature:
        edits, states = _edits(letter, after.pop(), states)
        audit.append(edits)
    left = min(END[1][s] for s in states)
    audit.append("I" * (left // INSERT))
    return *counts, max(0, len(signature) - 1 - legal), cost, "".join(audit)


def _solved(batches):
    for b in batches:
        found = list(zip(*map(solve, b.column("signature").to_pylist()))) or [[]] * 6
        yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), *(pa.array(c, pa.int64()) for c in found[:5]), pa.array(found[5], pa.string())], names=["digest", "n", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _pieces(batches):
    """Signatures of each task's stretch of the sorted rows, one row for each batch and conversation."""
    place = 0
    for b in batches:
        at, conv, letters = 0, b.column("conv"), b.column("letters").to_pylist()
        same = conv.to_pylist()
        convs, pieces, places = [], [], []
        for i in range(1, len(same) + 1):
            if i == len(same) or same[i] != same[at]:
                convs.append(at)
                pieces.append("".join(letters[at:i]))
                places.append(place := place + 1)
                at = i
        task = pa.array([TaskContext.get().partitionId()] * len(convs), pa.int32())
        yield pa.RecordBatch.from_arrays([conv.take(pa.array(convs, pa.int64())), task, pa.array(places, pa.int64()), pa.array(pieces, pa.string())], names=["conv", "task", "place", "piece"])


ORDER = ("turn", "role", "key")


class Replay:
    """A conversation's repaired rows as a running hash, and whole where `lines` is a list."""

    def __init__(self, audit: str, payload: bool):
        self.audit, self.at, self.made = audit, 0, 0
        self.system = (len(audit) - audit.count("D")) % 2
        self.hash = hashlib.sha256()
        self.lines: list[str] | None = [] if payload else None

    def line(self, role: str | None, text: str) -> None:
        turn = (self.made - self.system) % 2
        line = f"{('user', 'assistant')[turn] if role is None else role}:{text}"
        self.hash.update(("\n" if self.made else "").encode() + line.encode())
        self.made += 1
        if self.lines is not None:
            self.lines.append(line)

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.line(None, "")
            self.at += 1

    def row(self, role: str, text: str, n: int) -> None:
        """A row that stands n times."""
        for _ in range(n):
            self.inserts()
            edit = self.audit[self.at]
            if edit != "D":
                self.line(role if edit == "K" else None, text)
            self.at += 1


def _replayed(payload: bool):
    """Each conversation's head row, then its rows in order -> the repaired conversations."""
    told = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def done(heads: list, found: list[Replay], schema: pa.Schema):
        for r in found:
            r.inserts()
        out = [pa.array([h[c] for h in heads], schema.field(c).type) for c in told] + [pa.array([r.hash.hexdigest() for r in found], pa.string())]
        out += [pa.array(["\n".join(r.lines) for r in found], pa.string())] if payload else []
        return pa.RecordBatch.from_arrays(out, names=[*told, "repaired_sha256", *(["repaired"] if payload else [])])

    def run(batches):
        head, replay, schema = None, None, None
        for b in batches:
            heads, found, schema = [], [], b.schema
            for row in b.to_pylist():
                if not row["n"]:
                    if replay is not None:
                        heads.append(head)
                        found.append(replay)
                    head, replay = row, Replay(row["audit"], payload)
                else:
                    replay.row(row["role"], row["text"], row["n"])
            if heads:
                yield done(heads, found, schema)
        if replay is not None:
            yield done([head], [replay], schema)

    return run


def repair(rows: DataFrame, payload: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of damaged rows
    (conv, turn, role, text, n; a null n for a conversation without rows); with payload also the repaired text."""
    kind = rows.schema["conv"].dataType.simpleString()
    key = F.unhex(F.sha2(F.to_json(F.struct("conv", "role", "text")), 256))
    there = rows.where("n is not null").withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    counted = there.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    counted = materialise(counted.withColumns({"key": key, "fault": _row_fault(F.col("text")), "initial": F.when(F.substr("role", F.lit(1), F.lit(1)) == "s", 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)}))
    narrow = counted.select("conv", "turn", "role", "key", "n", "fault", "initial")
    turn = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    firsts = materialise(narrow.groupBy("key").agg(F.min(turn).alias("first"), F.count("*").alias("m")))
    marked = hot_join(narrow, firsts, "key", "m", how="inner")
    first = F.col("turn").eqNullSafe(F.col("first.turn"))
    later = _letter(F.col("initial"), F.when(F.col("fault") == 1, 1).otherwise(2))
    letters = F.concat(F.when(first, _letter(F.col("initial"), F.col("fault"))).otherwise(later), F.repeat(later, (F.col("n") - 1).cast("int")))
    marked = materialise(marked.select("conv", *ORDER, letters.alias("letters")))
    ordered = marked.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    pieces = ordered.select("conv", "letters").mapInArrow(_pieces, f"conv {kind}, task int, place long, piece string")
    turns = narrow.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count("turn").alias("k"))
    wide = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1 - F.col("k")
    gaps = turns.select("conv", F.coalesce(wide, F.lit(0)).alias("gaps"))
    none = rows.select("conv").distinct()
    told = pieces.select("conv", F.struct("task", "place", "piece").alias("p"), F.lit(None).cast("decimal(22,0)").alias("gaps"))
    told = told.unionByName(gaps.select("conv", F.lit(None).cast(told.schema["p"].dataType).alias("p"), F.col("gaps").cast("decimal(22,0)").alias("gaps")))
    told = told.unionByName(none, allowMissingColumns=True)
    whole = told.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("signature"), F.least(F.coalesce(F.max("gaps"), F.lit(0)), F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long").alias("gaps"))
    whole = materialise(whole.withColumn("digest", F.unhex(F.sha2("signature", 256))))
    solved = whole.groupBy("digest", "signature").agg(F.count("*").alias("n")).mapInArrow(_solved, "digest binary, n long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    heads = hot_join(whole.select("conv", "gaps", "digest"), materialise(solved), "digest", "n", how="inner").drop("digest")
    parts = heads.unionByName(counted.select("conv", *ORDER, "text", "n"), allowMissingColumns=True)
    parts = parts.withColumn("n", F.coalesce("n", F.lit(0))).repartition("conv").sortWithinPartitions("conv", (F.col("n") > 0), *ORDER)
    told = parts.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "role", "text", "n")
    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return told.mapInArrow(_replayed(payload), schema + (", repaired string" if payload else "")).withColumnRenamed("conv", "conv_id")


def damage_and_repair(rows: DataFrame, payload: bool = False) -> DataFrame:
    """`repair` of the damaged rows, with every conversation that the table had before."""
    return repair(damage(rows).unionByName(rows.select(F.col("conv_id").alias("conv")).distinct(), allowMissingColumns=True), payload)


def _crc_table() -> list[int]:
    """CRC-32 of each byte, by its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


def _step(state: int) -> str:
    """SQL of the cheapest edits from a state when a row is taken next: delete, keep or rerole it."""
    extra = f"(case when fault = 3 then {TRUNCATED} else 0 end)"
    keeps = "when " + " when ".join(f"initial = '{'sua'[i]}' and fault in (0, 3) then {{c: {extra} + f{k}.c, a: 'K' || f{k}.a}}" for i in range(3) if (k := _kept(state, i)) is not None)
    rerole = f"case when fault in (0, 3) then {{c: {extra} + {REROLE} + f{FORCED[state]}.c, a: 'R' || f{FORCED[state]}.a}} end"
    return f"list_min([{{c: {DELETE} + f{state}.c, a: 'D' || f{state}.a}}, case {keeps} end, {rerole}]) as g{state}"


def _with_inserts(state: int) -> str:
    one, two = FORCED[state], FORCED[FORCED[state]]
    return f"list_min([g{state}, {{c: {INSERT} + g{one}.c, a: 'I' || g{one}.a}}, {{c: {2 * INSERT} + g{two}.c, a: 'II' || g{two}.a}}]) as f{state}"


def oracle_sql() -> str:
    """Each conversation by itself, from its last row backwards with whole audits; no turn there has two different rows."""
    steps, inserts = ", ".join(map(_step, range(4))), ", ".join(map(_with_inserts, range(4)))
    nothing = ", ".join(f"{{c: {NEVER if s in (1, 2) else 0}, a: ''}} as g{s}" for s in range(4))
    return f"""
with recursive k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
h as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)), lambda c, b: xor({_crc_table()}[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 as kind from k),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy from h where kind <> 0),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen from d),
r as (select conv_id, turn, role, text, i, case when role[1] in ('s', 'u', 'a') then role[1] else '?' end as initial,
  case when not regexp_matches(text, '[^{BLANK}]') then 1 when seen > 1 then 2 when regexp_extract(text, '([^{BLANK}])[{BLANK}]*\\z', 1) in ('.', '!', '?') then 0 else 3 end as fault from n),
z as (select conv_id, max(i) as last from r group by conv_id),
e as (select {nothing}),
f as (select conv_id, last as i, f0, f1, f2, f3 from z, (select {inserts} from e)
  union all select conv_id, i - 1, {inserts} from (select f.conv_id, f.i, {steps} from f join r on f.conv_id is not distinct from r.conv_id and f.i = r.i)),
s as (select conv_id, f0.c::bigint as cost, f0.a as audit from f where i = 0),
x as (select conv_id, j, audit[j] as edit, j - length(replace(audit[1:j], 'I', '')) as inserted, length(replace(audit[1:j], 'D', '')) as made, (length(replace(audit, 'D', '')) % 2) as system from (select *, unnest(range(1, length(audit) + 1)) as j from s)),
l as (select x.conv_id, x.made, case when edit = 'K' then r.role when (x.made - system) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else r.text end as line
  from x left join r on x.conv_id is not distinct from r.conv_id and r.i = x.j - x.inserted where edit <> 'D'),
t as (select conv_id, string_agg(line, chr(10) order by made) as repaired from l group by conv_id),
p as (select *, lag(initial) over (partition by conv_id order by i) || initial as pair from r),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from p group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join c on o.conv_id is not distinct from c.conv_id left join s on o.conv_id is not distinct from s.conv_id left join t on o.conv_id is not distinct from t.conv_id"""
