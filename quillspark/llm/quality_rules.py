"""Quality rules as a short-circuit cascade, in native expressions only.

A rule is an expression on a text that says why the text goes. On a random sample of about
``SAMPLE_ROWS`` rows of the whole table each rule's running time and rejection share are
measured; the cascade asks the rules in the order of rejection per cost, and a ``CASE``
evaluates no rule after one that rejects. A rule's time is the least of ``TRIALS`` runs less
that of a run without a rule. The verdict is the same in any order; only the work differs.
Repeated windows of words are told by a 64-bit hash.

Defined cases: null text is empty. An empty text has no words and is rejected
(``too_short``). Every input row gives one output row, repeated and null ids included.
Input columns other than the named ones are ignored. Empty table: empty result.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch

#: Rows of the sample on which cost and selectivity are measured.
SAMPLE_ROWS, TRIALS = 1000, 3
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Rule limits.
MIN_WORDS, REPEAT_PERCENT, SYMBOL_PERCENT, DUP_LINE_PERCENT, UPPER_PERCENT = 10, 20, 50, 30, 70
MAX_MEAN_WORD = 25


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: a lambda's variable holds it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(h: Column, width: int) -> Column:
    """Words in windows whose hash comes twice or more; ``h``: the windows' hashes in order."""

    def repeated(s: Column) -> Column:
        again = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ranked, lambda s: let(repeated(s), total)))


def n_repeat_words(text: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words found at least twice in the text."""

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) > width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))

    return let(words(text), lambda w: let(hashes(w), lambda h: _covered(h, width))).cast("long")


def default_rules(text: Column, known: dict[str, Column] | None = None) -> dict[str, Column]:
    """Name to rejecting condition. ``too_short`` and ``repeated_words`` are the base rules.
    ``known``: counts that are at hand already, by the names of this module's functions."""
    known = known or {}
    count = known.get("n_words", n_words(text))
    chars = known.get("word_chars", word_chars(text))
    marks = known.get("n_symbols", n_symbols(text))
    if "n_repeat_words" in known:
        repeated = F.lit(100) * known["n_repeat_words"] > F.lit(REPEAT_PERCENT) * count
    else:
        repeated = let(words(text), lambda w: F.lit(100) * n_repeat_words(text) > F.lit(REPEAT_PERCENT) * F.size(w))
    return {
        "too_short": count < MIN_WORDS,
        "repeated_words": repeated,
        "symbols": F.lit(100) * marks > F.lit(SYMBOL_PERCENT) * count,
        "duplicate_lines": let(lines(text), lambda x: F.lit(100) * (F.size(x) - F.size(F.array_distinct(x))) > F.lit(DUP_LINE_PERCENT) * F.size(x)),
        "long_words": chars > F.lit(MAX_MEAN_WORD) * count,
        "shouting": F.lit(100) * (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))) > F.lit(UPPER_PERCENT) * chars,
    }


def plan_cascade(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a row, rejected share) in the order to ask; ``docs`` has ``text``.

    The sample is kept in the shared folder and each rule runs over it alone, in one task. A
    rule that rejects nothing comes after those that do, the cheaper first.
    """
    every = max(1, docs.select(F.lit(1)).count())
    sample = scratch.stage(docs.select("text").sample(min(1.0, sample_rows / every), 7).coalesce(1), "sample")
    n = max(1, sample.count())

    def timed(rule: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hit = sample.agg(F.sum(F.when(rule, 1).otherwise(0))).first()[0] or 0
        return time.perf_counter() - began, hit

    idle = min(timed(F.length("text") < 0)[0] for _ in range(TRIALS))
    found = []
    for name, rule in rules.items():
        runs = [timed(rule) for _ in range(TRIALS)]
        found.append((name, max(1e-9, min(x[0] for x in runs) - idle) / n, runs[0][1] / n))
    return sorted(found, key=lambda x: (-x[2] / max(x[1], 1e-9), x[1]))


def cascade(rules: dict[str, Column], order: Sequence[str]) -> Column:
    """The first rule in ``order`` that rejects, else null."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(rules[name], F.lit(name)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, text: str = "text", rules=default_rules, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with one more column, ``rejected_by``: the rule that rejects a row, or null."""
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    order = [x[0] for x in plan_cascade(docs.select(t.alias("text")), rules(F.col("text")), sample_rows)]
    name = "rejected_by"
    while name in docs.columns:
        name = "_" + name
    return docs.withColumn(name, cascade(rules(t), order))


def rule_report(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Each row's base counts and verdicts, with ``rejected_by``. The counts are wanted for
    every row, so the cascade takes them as they are and computes only what is left."""
    t = F.col("text")
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [x[0] for x in plan_cascade(d, default_rules(t), sample_rows)]
    counts = {f.__name__: f(t) for f in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)}
    d = d.select("doc_id", "text", *(c.alias(k) for k, c in counts.items()))
    named = {k: F.col(k) for k in counts}
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    d = d.select("doc_id", *counts, cascade(default_rules(t, named), order).alias("rejected_by"), failed.alias("base_failed"))
    return d.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return rule_report(scratch.table(spark, sf_dir, "documents")).drop("rejected_by")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM
  (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(ls) AS n_lines, length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS upper_chars
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars > 25 * n_words
  OR 100 * upper_chars > 70 * word_chars) AS kept FROM b"""
