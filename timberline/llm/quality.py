"""Short-circuit cascade of quality rules, in DataFrame functions only.

A rule rejects a text by a condition on measures. The rules' costs (seconds on a bounded sample) and selectivities (share
of the sample that they reject) are estimated, and the rules are ordered by rejection per cost. A measure is only taken
of texts that no earlier rule has rejected. The verdict (every rule passes) is the same in any order.

Words are ``[^\\x20\\x09-\\x0D]+``. Repeated words come from the hashes of all eight-word windows of a text: if all are
distinct, none repeats; else the windows are sorted with their places and the places that repeated windows cover are
counted. Nothing is exploded or shuffled.

Defined results: null text has no words (all measures 0) and fails the base. Ids, extra columns and repeated rows pass
through unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import pin, unpin

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _words() -> Column:
    return F.array_remove(F.split("q_text", GAP), "")


def _windows() -> Column:
    n = F.size("q_words")
    each = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("q_words", i, WINDOW)))
    return F.when(n > WINDOW, each)


def _repeated() -> Column:
    """Places covered by windows whose hash occurs twice or more."""
    placed = F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def cover(acc: Column, p: Column) -> Column:
        return F.struct((acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"), (p + WINDOW).alias("end"))

    # The sorted windows are bound to a lambda variable, so that they are made once.
    def covered(whole: Column) -> Column:
        def again(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(whole, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(whole, k + 1)["h"] == x["h"], F.lit(False))

        places = F.sort_array(F.transform(F.filter(whole, again), lambda x: x["i"]))
        return F.aggregate(places, first, cover)["n"]

    any_twice = F.size(F.array_distinct("q_windows")) < F.size("q_windows")
    return F.when(any_twice, F.transform(F.array(placed), covered)[0]).otherwise(0)


def _symbols() -> Column:
    left = F.col("q_text")
    for c in SYMBOLS:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.length("q_text") - F.length(left)


def _dup_lines() -> Column:
    # Lines with a word; a line that is left holds more than white space.
    lines = F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.when(F.instr("q_text", "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0)


#: Measure -> what it needs, and its expression.
MEASURES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "q_words": ((), _words),
    "q_n_words": (("q_words",), lambda: F.size("q_words")),
    "q_word_chars": (("q_words",), lambda: F.length(F.array_join("q_words", ""))),
    "q_n_symbols": ((), _symbols),
    "q_n_dup_lines": ((), _dup_lines),
    "q_windows": (("q_words",), _windows),
    "q_n_repeat_words": (("q_windows",), lambda: F.coalesce(_repeated(), F.lit(0))),
    "q_shouts": ((), lambda: F.col("q_text").rlike("[A-Z]") & ~F.col("q_text").rlike("[a-z]")),
}


#: The measures that ``judge`` gives for every text.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: str  # SQL condition on measures


BASE_RULES = (
    Rule("few_words", ("q_n_words",), "q_n_words < 20"),
    Rule("repeated_words", ("q_n_words", "q_n_repeat_words"), "100 * q_n_repeat_words > 30 * q_n_words"),
)
RULES = (
    Rule("symbols", ("q_n_symbols", "q_n_words"), "2 * q_n_symbols > q_n_words"),
    Rule("shouting", ("q_shouts",), "q_shouts"),
    Rule("long_words", ("q_word_chars", "q_n_words"), "q_word_chars > 15 * q_n_words"),
    Rule("short_words", ("q_word_chars", "q_n_words"), "10 * q_word_chars < 15 * q_n_words"),
    Rule("repeated_lines", ("q_n_dup_lines",), "q_n_dup_lines > 20"),
)


def _with(df: DataFrame, needs: tuple[str, ...], guard: Column | None) -> DataFrame:
    for name in needs:
        if name not in df.columns:
            before, make = MEASURES[name]
            df = _with(df, before, guard)
            df = df.withColumn(name, make() if guard is None else F.when(guard, make()))
    return df


def ordered(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = 1000, known: tuple[str, ...] = ()) -> list[Rule]:
    """The rules by estimated rejection per cost, from a sample of at most ``sample_rows`` rows.

    Measures in ``known`` are taken anyway and cost a rule nothing.
    """
    sample = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("q_text"))
    sample = pin(_with(sample.where(F.pmod(F.xxhash64("q_text"), F.lit(7)) == 0).limit(sample_rows).coalesce(1), known, None))

    def spent(job: DataFrame) -> tuple[float, float]:
        began = time.perf_counter()
        share = job.first()[0]
        return time.perf_counter() - began, share or 0.0

    spent(sample.agg(F.avg(F.length("q_text"))))
    empty = spent(sample.agg(F.avg(F.length("q_text"))))[0]
    found = []
    for k, rule in enumerate(rules):
        measured = _with(sample, rule.needs, None).agg(F.avg(F.expr(rule.rejects).cast("double")))
        cost, share = spent(measured)
        found.append((-(share + 1e-6) / max(cost - empty, 1e-3), k, rule))
    unpin(sample)
    return [rule for _, _, rule in sorted(found)]


def cascade(docs: DataFrame, rules: list[Rule], text_col: str = "text", shown: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the measures taken and ``rejected_by``: the first rule in the given order that rejects, or null.

    The measures in ``shown`` are taken of every text, the others only of texts that no earlier rule has rejected.
    """
    df = docs.withColumn("q_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = _with(df, shown, None)
    df = df.withColumn("rejected_by", F.lit(None).cast("string"))
    for rule in rules:
        df = _with(df, rule.needs, F.col("rejected_by").isNull())
        hit = F.when(F.expr(rule.rejects), F.lit(rule.name))
        df = df.withColumn("rejected_by", F.coalesce("rejected_by", hit))
    return df


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, the four measures, base_failed, kept.

    The measures that a row shows are taken of every text; the cascade spares the others.
    """
    docs = docs.select("doc_id", "text")
    shown = tuple(f"q_{c}" for c in SHOWN)
    df = cascade(docs, ordered(docs, BASE_RULES + RULES, known=shown), shown=shown)
    base_failed = F.expr(" or ".join(f"({r.rejects})" for r in BASE_RULES))
    return df.select(
        "doc_id",
        *(F.col(f"q_{c}").cast("long").alias(c) for c in SHOWN),
        base_failed.alias("base_failed"),
        (~base_failed & F.col("rejected_by").isNull()).alias("kept"),
    )


def kept(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their own columns; measures are taken only as far as needed."""
    own = docs.columns
    rules = ordered(docs, BASE_RULES + RULES)
    inner = docs.select(F.struct(*own).alias("q_row"), F.col("text"))
    # Spark would push a filter on the verdict below the measures and so repeat all of them inside it. Exploding an array
    # that is null for rejected rows keeps the same rows and leaves each measure in its place.
    passed = F.when(F.col("rejected_by").isNull(), F.array("q_row"))
    return cascade(inner, rules).select(F.explode(passed).alias("q_row")).select("q_row.*")


#: The measures and verdict of ``judge`` in DuckDB's SQL.
SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), wins as (
  select doc_id, unnest(range(0, len(ws) - 7)) as i, ws from w where len(ws) >= 8
), keyed as (
  select doc_id, i, array_to_string(ws[i + 1 : i + 8], ' ') as k from wins
), twice as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, k) as c from keyed) where c > 1
), covered as (
  select doc_id, count(distinct i + j) as n from twice, range(0, 8) r(j) group by doc_id
), lines as (
  select doc_id, count(*) - count(distinct line) as n
  from (select doc_id, unnest(string_split(t, chr(10))) as line from w)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), m as (
  select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(lines.n, 0) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words,
    regexp_matches(t, '[A-Z]') and not regexp_matches(t, '[a-z]') as shouts
  from w left join lines using (doc_id) left join covered using (doc_id)
), b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (2 * n_symbols > n_words or shouts or word_chars > 15 * n_words
    or 10 * word_chars < 15 * n_words or n_dup_lines > 20) as kept
from b
"""
