"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is SQL over the text and named measures. A measure is bound once, as a lambda variable, where
it is first needed, so the whole cascade is one expression however the planner moves it: a filter on the
verdict holds one copy of each measure, and CASE stops at the first rule that a row fails, before the
measures of later rules are formed. ``cascade`` takes a sample, estimates every rule's cost and selectivity
on it and orders the rules by rejection per cost. The verdict is the conjunction of all rules, so it doesn't
depend on the order or the sample; only the name of the first failed rule does, and costs count in powers
of four, so that timing noise seldom changes it.

Defined cases: a null text has no words and fails ``few_words``; an empty table gives an empty result;
repeated rows are judged alike; an input column named like the struct ``out`` gives way to it, other columns
are kept, whatever their names; texts of 2**27 words or more raise an error (positions are packed).
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

BLANKS = " \t\n\x0b\x0c\r"
#: Positions take the low bits of a packed key, a hash of the window the others.
POSITION_BITS = 27


@dataclass(frozen=True)
class Rule:
    """fails: SQL over text and the measures, true where a text is to be rejected."""

    name: str
    fails: str


BASE_RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
)
RULES = (
    Rule("symbols", "100 * n_symbols > 40 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
    Rule("shouting", "100 * n_capitals > 50 * (n_letters + 1)"),
    Rule("exclamation", "100 * (length(text) - length(replace(text, '!', ''))) > 50 * n_words"),
    Rule("letters", "100 * n_letters < 40 * word_chars"),
)

_LOW = (1 << POSITION_BITS) - 1
_SAME = f"shiftright(k, {POSITION_BITS}) = shiftright(get(keys, i %s 1), {POSITION_BITS})"
_WORD = f"get(words, cast(p & {_LOW} as int) + %d)"
_KEY = f"shiftleft(xxhash64(get(words, cast(i as int)), get(words, cast(i as int) + 1), get(words, cast(i as int) + 2)), {POSITION_BITS}) | i"
#: Measures by name, each over the text and those before it. Repeated windows of three words are found by sorting
#: packed (hash, position) keys (repeat_keys) and then confirmed on the words themselves (spans, twice).
MEASURES = {
    "words": f"if(btrim(text, '{BLANKS}') = '', cast(array() as array<string>), split(btrim(text, '{BLANKS}'), '[\\\\x20\\\\x09-\\\\x0D]+'))",
    "lines": "filter(split(text, '\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')",
    "keys": f"if(size(words) < 4, cast(array() as array<bigint>), if(size(words) > {_LOW}, raise_error('too many words'), sort_array(transform(sequence(0L, cast(size(words) - 3 as bigint)), i -> {_KEY}))))",
    "repeat_keys": f"filter(keys, (k, i) -> coalesce({_SAME % '-'}, false) or coalesce({_SAME % '+'}, false))",
    "spans": f"if(size(repeat_keys) = 0, cast(array() as array<struct<g:string,p:bigint>>), array_sort(transform(repeat_keys, p -> struct(concat_ws(' ', {_WORD % 0}, {_WORD % 1}, {_WORD % 2}) as g, p & {_LOW} as p))))",
    "twice": "array_sort(transform(filter(spans, (s, i) -> coalesce(get(spans, i - 1).g = s.g, false) or coalesce(get(spans, i + 1).g = s.g, false)), s -> s.p))",
    "n_words": "cast(size(words) as bigint)",
    "word_chars": "cast(length(array_join(words, '')) as bigint)",
    "n_symbols": "cast(regexp_count(text, '[#*$%&|<>]') as bigint)",
    "n_lines": "cast(size(lines) as bigint)",
    "n_dup_lines": "cast(size(lines) - size(array_distinct(lines)) as bigint)",
    "n_letters": "cast(length(regexp_replace(text, '\\\\P{L}+', '')) as bigint)",
    "n_capitals": "cast(length(regexp_replace(text, '\\\\P{Lu}+', '')) as bigint)",
    "n_repeat_words": "if(size(twice) = 0, 0L, aggregate(twice, struct(-3L as last, 0L as n), (a, p) -> struct(p as last, a.n + least(3L, p - a.last) as n), a -> a.n))",
}
SHOWN = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with value bound to the name once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _needs(sql: str, known: frozenset[str]) -> list[str]:
    """Measures that the SQL stands on and aren't known, in the order of MEASURES."""
    found, new = set(), {sql}
    while new:
        names = {m for s in new for m in MEASURES if m not in known and m not in found and re.search(rf"\b{m}\b", s)}
        found |= names
        new = {MEASURES[m] for m in names}
    return [m for m in MEASURES if m in found]


def _bound(sql: str, known: frozenset[str] = frozenset()) -> str:
    """The SQL with all measures that it stands on bound around it."""
    for m in reversed(_needs(sql, known)):
        sql = _let(m, MEASURES[m], sql)
    return sql


def _over(text: str, sql: str) -> Column:
    """SQL over the variable ``text`` as a column of a table with the text column of that name."""
    return F.expr(_let("text", f"coalesce(cast(`{text}` as string), '')", sql))


def _first_failed(rules, known: frozenset[str]) -> str:
    return "case " + " ".join(f"when {_bound(r.fails, known)} then '{r.name}'" for r in rules) + " end"


def text_metrics(text: str = "text") -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of a text column.

    n_lines counts \\n-split lines with a word, n_dup_lines those of them equal to an earlier one,
    n_repeat_words the words inside 3-word windows that occur twice or more in the text.
    """
    return _over(text, _bound(f"named_struct({', '.join(f"'{m}', {m}" for m in SHOWN)})"))


def take_sample(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """About ``rows`` texts from all over the table, twice as many at most, none over 20,000 bytes."""
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    total = max(1, docs.count())
    return texts.where("text is null or octet_length(text) <= 20000").sample(min(1.0, rows / total), seed=17).limit(2 * rows)


def estimate(sample: DataFrame, rules: tuple[Rule, ...], copies: int = 4) -> list[tuple[Rule, float, float]]:
    """(rule, microseconds a row, share of rows that fail), over a small table of texts.

    Each rule runs over the sample ``copies`` times within one job; a run that only cuts the words is
    subtracted, and the better of two runs counts.
    """
    known = frozenset({"words"})
    cut = lambda sql: _over("text", _let("words", MEASURES["words"], sql))
    many = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    plain = cut("size(words) < 0")

    def seconds(fails: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            many.agg(F.count_if(fails)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    verdicts = [cut(_bound(r.fails, known)) for r in rules]
    row = sample.agg(F.count("*"), *[F.avg(F.coalesce(v, F.lit(False)).cast("double")) for v in verdicts]).first()
    base = seconds(plain)
    per_row = 1e6 / (copies * max(1, row[0]))
    return [(r, max(0.0, seconds(v) - base) * per_row, row[k + 1] or 0.0) for k, (r, v) in enumerate(zip(rules, verdicts))]


def cascade_order(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejection per cost first, costs in powers of four microseconds; ties by name."""
    step = lambda cost: next(k for k in range(64) if cost <= 4.0**k)
    return [r for r, cost, share in sorted(measured, key=lambda x: (-x[2] / 4.0 ** step(x[1]), x[0].name))]


def ordered_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 500) -> list[Rule]:
    """The rules in the order that a sample of about ``sample_rows`` rows (a documented bound) suggests."""
    scratch = Scratch(docs.sparkSession, "quality-sample")
    found = cascade_order(estimate(scratch.put(take_sample(docs, text, sample_rows), "sample"), rules))
    scratch.close()
    return found


def cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES, sample_rows: int = 500, out: str = "m") -> DataFrame:
    """Add the struct ``out``: the measures, failed_rule (null if none), base_failed and kept.

    The base rules come first in any case, the others as ``ordered_rules`` says.
    """
    order = [*base, *ordered_rules(docs, text, rules, sample_rows)]
    names = ", ".join(f"'{r.name}'" for r in base)
    shown = ", ".join(f"'{m}', {m}" for m in SHOWN)
    fields = f"named_struct({shown}, 'failed_rule', failed, 'base_failed', coalesce(failed in ({names}), false), 'kept', failed is null)"
    measured = _needs(shown, frozenset())
    sql = _let("failed", _first_failed(order, frozenset(measured)), fields)
    for m in reversed(measured):
        sql = _let(m, MEASURES[m], sql)
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()], _over(text, sql).alias(out))


def reject_low_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES, sample_rows: int = 500) -> DataFrame:
    """The documents that pass every rule, with their own columns; nothing is measured for a row behind the rule it fails."""
    order = [*base, *ordered_rules(docs, text, rules, sample_rows)]
    known = frozenset({"words"})
    return docs.where(_over(text, _let("words", MEASURES["words"], f"{_first_failed(order, known)} is null")))


def op8_quality_cascade(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = cascade(docs)
    return m.select("doc_id", *[f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


OP8_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
g as (
  select *, len(ws) as n, [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] as tri from w),
p as (
  select doc_id, any_value(rid) as rid, list(pos order by pos) as ps from (
    select rid, doc_id, unnest(tri) as x, unnest(range(1, len(tri) + 1)) as pos from (select *, row_number() over () as rid from g))
  group by doc_id, rid, x having count(*) > 1),
c as (
  select rid, count(distinct q) as covered from (select rid, unnest(ps) as pos from p), range(0, 3) r(k), lateral (select pos + k as q) group by rid),
m as (
  select doc_id, t, n as n_words, len(array_to_string(ws, '')) as word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(covered, 0) as n_repeat_words
  from (select *, row_number() over () as rid from g) left join c using (rid)),
v as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    len(regexp_replace(t, '[^\p{L}]', '', 'g')) as letters, len(regexp_replace(t, '[^\p{Lu}]', '', 'g')) as capitals,
    len(regexp_replace(t, '[^!]', '', 'g')) as bangs from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and 100 * n_symbols <= 40 * n_words and 100 * n_dup_lines <= 50 * n_lines
    and word_chars >= 2 * n_words and word_chars <= 25 * n_words and 100 * capitals <= 50 * (letters + 1)
    and 100 * bangs <= 50 * n_words and 100 * letters >= 40 * word_chars as kept
from v
"""
