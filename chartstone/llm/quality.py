"""Quality rules as a short-circuit cascade. DataFrame functions only.

Base figures of a text (whitespace words ``[^\\x20\\x09-\\x0D]+``): n_words, word_chars, n_symbols,
n_dup_lines and n_repeat_words. The repeated words are found inside the row: the 5-word windows are
hashed to 64 bits, and only for texts in which a hash comes twice are windows sorted and the words
under the repeated ones counted. Nothing is shuffled.

The cascade: every rule, the base rules too, is run by itself over a sample of SAMPLE_ROWS documents, as often as it takes to
stand out from the time of an empty run; that gives its seconds a document (cost). The rules' verdicts on the sample are counted by
their combinations, and the rule with the most rejections per cost among what the rules before it leave comes next: selectivity is
conditional. A CASE evaluates the rules in that order and stops at the first that rejects; a rule holds the expressions of its own
figures, so a figure is computed only where the cascade reaches a rule that needs it. The order changes the time, never the verdict.

``quality_table`` must return the base figures of every document; there only the rules beyond them are spared by the cascade.
``keep_quality`` returns documents, and spares figures as well.

Defined results: a null text has no words and fails the base rules, as does an empty one; an empty table
gives no rows; repeated rows get the same verdict each; rules that tie in rejections per cost stand in the order of cost, then of
the list; a very long text is judged whole, inside its row; other columns pass through ``keep_quality`` untouched,
whatever their names (there are no work columns).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents in the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 1000
#: A rule is run until it takes so many times the seconds of an empty run, or MOST_TIMES over the sample.
STANDS_OUT, MOST_TIMES = 2.0, 16
SPACE = r"[\x20\x09-\x0D]"
WINDOW = 5
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the values named in ``uses``, ``sql`` the same in DuckDB. ``base``: given by contract."""

    name: str
    uses: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]
    sql: str
    base: bool = False


def _left(text: Column, others: str) -> Column:
    """Characters of text that are left when those matching ``others`` are gone."""
    return F.char_length(F.regexp_replace(text, others, ""))


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda v: v["n_words"] < 10, "n_words < 10", True),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda v: 100 * v["n_repeat_words"] > 20 * v["n_words"], "100 * n_repeat_words > 20 * n_words", True),
)
RULES = (
    Rule("symbols", ("n_words", "n_symbols"), lambda v: 10 * v["n_symbols"] > v["n_words"], "10 * n_symbols > n_words"),
    Rule("short_words", ("n_words", "word_chars"), lambda v: v["word_chars"] < 3 * v["n_words"], "word_chars < 3 * n_words"),
    Rule("long_words", ("n_words", "word_chars"), lambda v: v["word_chars"] > 10 * v["n_words"], "word_chars > 10 * n_words"),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda v: 10 * v["n_dup_lines"] > 3 * v["n_lines"], "10 * n_dup_lines > 3 * n_lines"),
    Rule("upper_case", ("text", "word_chars"), lambda v: 10 * _left(v["text"], "[^A-Z]+") > 4 * v["word_chars"], "10 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 4 * word_chars"),
    Rule("digits", ("text", "word_chars"), lambda v: 10 * _left(v["text"], "[^0-9]+") > 4 * v["word_chars"], "10 * length(regexp_replace(text, '[^0-9]+', '', 'g')) > 4 * word_chars"),
    Rule(
        "ellipsis_lines",
        ("text", "n_lines"),
        lambda v: 10 * F.size(F.regexp_extract_all(v["text"], F.lit("([.][.][.]|\u2026)[ \\t\\r]*(\\n|$)"), F.lit(0))) > 3 * v["n_lines"],
        "10 * len(regexp_extract_all(text, '([.][.][.]|\\x{2026})[ \\t\\r]*(\\n|$)')) > 3 * n_lines",
    ),
)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) as one expression that evaluates ``value`` once."""
    return F.get(F.transform(F.array(value), f), 0)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def lines_of(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))


def repeated_words(words: Column) -> Column:
    """Words under 5-word windows that stand there twice or more."""
    n = F.size(words)

    def windows() -> Column:
        return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - i, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def repeated(p: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(p, lambda x, j: (F.when(j > 0, same(x, j - 1)).otherwise(F.lit(False))) | same(x, j + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(pairs, repeated)).otherwise(F.lit(0))

    return F.when(n >= WINDOW, let(windows(), count)).otherwise(F.lit(0))


#: How each value comes from others: those it needs, and its expression.
VALUES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "words": ("text", words_of),
    "lines": ("text", lines_of),
    "n_words": ("words", lambda w: F.size(w).cast("long")),
    "word_chars": ("words", lambda w: F.char_length(F.array_join(w, "")).cast("long")),
    "n_symbols": ("text", lambda t: _left(t, r"[^#*$%&|<>]+").cast("long")),
    "n_lines": ("lines", lambda x: F.size(x).cast("long")),
    "n_dup_lines": ("lines", lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    "n_repeat_words": ("words", lambda w: repeated_words(w).cast("long")),
}


def with_values(names: tuple[str, ...], have: dict[str, Column], then: Callable[[dict[str, Column]], Column]) -> Column:
    """``then`` over ``have`` and the values ``names``, each bound once and only where this expression is evaluated."""
    for name in names:
        if name in have:
            continue
        source, make = VALUES[name]
        if source not in have:
            return with_values((source, *names), have, then)
        return let(make(have[source]), lambda x: with_values(names, {**have, name: x}, then))
    return then(have)


def cascade(order, have: dict[str, Column]) -> Column:
    """True if no rule rejects, a null never does; the rules behind the first rejection, and what only they need, are not evaluated."""
    if not order:
        return F.lit(True)
    rule, *rest = order

    def judged(v: dict[str, Column]) -> Column:
        return F.when(F.coalesce(rule.rejects(v), F.lit(False)), F.lit(False)).otherwise(cascade(rest, v))

    return with_values(rule.uses, have, judged)


def sample_of(df: DataFrame, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` documents, all if there are fewer; which ones can only change the order of the rules."""
    text = df.select(F.col(text_col).alias("text"))
    total = text.count()
    return text if total <= rows else text.sample(rows / total, seed=42)


def estimate(df: DataFrame, text_col: str = "text", rules=BASE_RULES + RULES, rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a document, share it rejects of what the rules before it leave) on a sample, in the order of the cascade."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sample = sample_of(df, text_col, rows).select(text.alias("text")).withColumn("words", words_of(F.col("text"))).coalesce(1).cache()
    have = {"text": F.col("text"), "words": F.col("words")}
    empty: dict[int, float] = {}

    def seconds(passes: Column, times: int) -> float:
        again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(times))))
        began = time.perf_counter()
        again.agg(F.count_if(~passes)).collect()
        return time.perf_counter() - began

    def cost(rule: Rule) -> float:
        passes, times = cascade([rule], have), 1
        while True:
            if times not in empty:
                empty[times] = min(seconds(F.col("_again") > 0, times) for _ in range(2))
            took = seconds(passes, times)
            if took >= STANDS_OUT * empty[times] or times >= MOST_TIMES:
                return max(took - empty[times], 1e-6) / times
            times *= 4

    try:
        n = max(1, sample.count())
        seconds(cascade(rules, have), 1)  # code and cache are warm for all rules alike
        costs = {r.name: cost(r) / n for r in rules}
        verdicts = F.array(*[~cascade([r], have) for r in rules])
        # a row for each combination of verdicts
        combined = [(r.v, r.n) for r in sample.groupBy(verdicts.alias("v")).agg(F.count("*").alias("n")).collect()]
    finally:
        sample.unpersist()
    found, left = [], list(range(len(rules)))
    while left:
        total = max(1, sum(m for _, m in combined))
        hits = {i: sum(m for v, m in combined if v[i]) for i in left}
        i = min(left, key=lambda i: (-hits[i] / costs[rules[i].name], costs[rules[i].name], i))
        found.append((rules[i], costs[rules[i].name], hits[i] / total))
        combined = [(v, m) for v, m in combined if not v[i]]
        left.remove(i)
    return found


def quality_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(doc_id, base figures, base_failed, kept) for each document."""
    order = [r for r, _, _ in estimate(df, text_col, BASE_RULES + tuple(rules)) if not r.base]
    names = (*FIGURES, "n_lines")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = out.select("doc_id", text.alias("text"), with_values(names, {"text": text}, lambda v: F.struct(*[v[n].alias(n) for n in names])).alias("f"))
    have = {"text": F.col("text"), **{n: F.col("f")[n] for n in names}}
    failed = F.lit(False)
    for r in BASE_RULES:
        failed = failed | r.rejects(have)
    kept = F.when(failed, F.lit(False)).otherwise(cascade(order, have))
    return out.select("doc_id", *[have[n].alias(n) for n in FIGURES], failed.alias("base_failed"), kept.alias("kept"))


def keep_quality(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The documents that pass, with the columns of df: one filter, whose expression computes what the cascade reaches."""
    order = [r for r, _, _ in estimate(df, text_col, BASE_RULES + tuple(rules))]
    return df.filter(cascade(order, {"text": F.coalesce(F.col(text_col), F.lit(""))}))


def figures_sql(source: str = "documents") -> str:
    """DuckDB: the figures and the verdict for each row of ``source``, as a chain of CTEs that ends in q_verdict."""
    duck = " OR ".join(f"coalesce({r.sql}, false)" for r in RULES)
    failed = " OR ".join(r.sql for r in BASE_RULES)
    return rf"""
q_words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM {source}),
q_lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM q_words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
q_win AS (SELECT doc_id, i, words[i:i+4] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM q_words WHERE len(words) >= 5)),
q_twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM q_win) WHERE c > 1),
q_cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM q_twice, range(5) AS r(k) GROUP BY doc_id),
q_fig AS (SELECT w.doc_id, text, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM q_words w LEFT JOIN q_lines USING (doc_id) LEFT JOIN q_cover USING (doc_id)),
q_base AS (SELECT *, ({failed}) AS base_failed FROM q_fig),
q_verdict AS (SELECT *, NOT base_failed AND NOT ({duck}) AS kept FROM q_base)"""


def oracle() -> str:
    return f"WITH {figures_sql().strip()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_verdict"
