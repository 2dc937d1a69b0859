"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A rule is a test over features of the text, and each feature is one expression that is evaluated where it's asked for. On
a sample every rule is run by itself, several times: the least time above that of an empty run is its cost, rounded to a
power of two so that the order is steady, and the share of rows that it rejects its selectivity. Rules then run in falling
order of rejections per cost, and a row that one rejects meets no later one. The order never changes a verdict, only
``rejected_by``, which is the first rule in that order that rejects the row.

Defined results: null or blank text has no words, counts of zero and fails the base rule; repeated rows are judged alike
and all returned; an empty table gives an empty result (rules then keep their given order); other columns pass through,
but ``quality_rules`` replaces those that have the name of a column it adds.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_CLASS, discard, materialize, scratch, table, words_of

#: Least number of words, and the most percent of them that may stand in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: Rows on which costs and selectivities are estimated (they decide the order of rules only), and bytes of their texts at
#: most (one text at least). They're the first rows, so only a few partitions are read, and they go through the driver.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 8 << 20
#: Timed runs of each rule, and the least seconds that are told apart.
RUNS, TICK = 3, 0.004

#: Words in 3-word windows found twice or more, of the array ``{w}``: windows are hashed to 64 bits, and only where one
#: repeats they are sorted with their places and neighbours compared. Inner aggregates give a value a name.
_REPEATS = """
aggregate(array({w}), 0L, (u, w) -> aggregate(array(if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))), 0L, (z, t) ->
  if(size(array_distinct(t)) = size(t), 0L, aggregate(array(sort_array(transform(t, (h, i) -> struct(h, i)))), 0L, (y, s) ->
    aggregate(array(sort_array(filter(transform(s, (x, k) -> if(get(s, k - 1).h <=> x.h or get(s, k + 1).h <=> x.h, x.i, null)), i -> i is not null))), 0L, (v, p) ->
      aggregate(transform(p, (i, k) -> least(3, coalesce(get(p, k + 1), i + 3) - i)), 0L, (a, n) -> a + n))))))
"""


def _words(text: Column) -> Column:
    """The words, in a column that isn't deterministic, as filters above a projection with such a column stay above it and
    the words aren't made anew for each use."""
    return F.when(F.spark_partition_id() >= 0, words_of(text))


class Features:
    """Expressions of a text's features, over the text and the array of its words."""

    def __init__(self, text: Column, words: str):
        t, w = F.coalesce(text, F.lit("")), f"`{words}`"
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD_CLASS))
        self.n_words = F.size(F.col(w)).cast("long")
        self.word_chars = F.length(F.array_join(F.col(w), "")).cast("long")
        self.n_symbols = F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long")
        self.n_lines = F.size(lines).cast("long")
        self.n_dup_lines = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
        self.n_repeat_words = F.expr(_REPEATS.format(w=w)).cast("long")
        self.n_exclamations = F.regexp_count(t, F.lit("!"))
        self.n_capitals = F.regexp_count(t, F.lit(r"\p{Lu}"))


#: Features that ``features`` adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes the test of a rule, never null, of the features."""

    name: str
    rejects: Callable[[Features], Column]


def base_failed(f: Features) -> Column:
    return (f.n_words < MIN_WORDS) | (f.n_repeat_words * 100 > f.n_words * MAX_REPEAT_PCT)


def default_rules() -> list[Rule]:
    """``few_words`` and ``repetition`` together reject whatever fails the base rule."""
    return [
        Rule("few_words", lambda f: f.n_words < MIN_WORDS),
        Rule("symbols", lambda f: f.n_symbols * 10 > f.n_words),
        Rule("word_length", lambda f: (f.word_chars < f.n_words * 2) | (f.word_chars > f.n_words * 20)),
        Rule("duplicate_lines", lambda f: f.n_dup_lines * 10 > f.n_lines * 4),
        Rule("repetition", lambda f: f.n_repeat_words * 10 > f.n_words * 4),
        Rule("exclamations", lambda f: f.n_exclamations * 10 > f.n_words),
        Rule("capitals", lambda f: f.n_capitals * 2 > f.word_chars),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by falling rejections per cost, both measured on at most ``sample_rows`` rows."""
    texts, total, n = docs.select(F.col(f"`{text_col}`").alias("text")), 0, 0
    for r in texts.select(F.coalesce(F.octet_length("text"), F.lit(0))).take(sample_rows):
        total += r[0]
        n += not n or total <= SAMPLE_BYTES
    first = docs.sparkSession.createDataFrame(texts.take(n), "text string").coalesce(1)
    held = materialize(first.select("text", words_of(F.col("text")).alias("words")), "rule-sample")
    f = Features(F.col("text"), "words")

    def run(test: Column) -> tuple[int, int, float]:
        counted, best = held.agg(F.count("*"), F.count_if(test)), math.inf
        for _ in range(RUNS + 1):  # the first run compiles
            began = time.perf_counter()
            n, rejected = counted.first()
            best = min(best, time.perf_counter() - began)
        return n, rejected, best

    n, _, idle = run(F.size("words") < 0)
    if not n:
        discard(held)
        return list(rules)
    scored = []
    for i, r in enumerate(rules):
        _, rejected, took = run(r.rejects(f))
        cost = 2.0 ** round(math.log2(max(took - idle, TICK) / TICK))
        scored.append((-(rejected / n) / cost, i, r))
    discard(held)
    return [r for *_, r in sorted(scored, key=lambda x: x[:2])]


def cascade(rules: list[Rule], f: Features) -> Column:
    """Name of the first rule that rejects the row, else null; later rules aren't evaluated for it."""
    out = F
    for r in rules:
        out = out.when(r.rejects(f), r.name)
    return out.otherwise(None).cast("string") if rules else F.lit(None).cast("string")


class _Held:
    """Features that are columns already; the others as ``Features`` has them."""

    def __init__(self, f: Features):
        self.f = f

    def __getattr__(self, name: str) -> Column:
        return F.col(name) if name in ADDED else getattr(self.f, name)


def quality_rules(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the feature columns, ``base_failed``, ``rejected_by`` and ``kept``; every row gets all features."""
    added = {*ADDED, "base_failed", "rejected_by", "kept"} - {text_col}
    clean = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    ordered = order_rules(clean, default_rules() if rules is None else rules, text_col, sample_rows)
    (w,) = scratch(docs, "words")
    f = Features(F.col(f"`{text_col}`"), w)
    held = _Held(f)
    columns = [F.col(f"`{c}`") for c in clean.columns]
    out = clean.withColumn(w, _words(F.col(f"`{text_col}`"))).select("*", *[getattr(f, c).alias(c) for c in ADDED])
    out = out.select(*columns, *ADDED, base_failed(held).alias("base_failed"), cascade(ordered, held).alias("rejected_by"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def kept_rows(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects; a row's features are made only for the rules that it comes to."""
    ordered = order_rules(docs, default_rules() if rules is None else rules, text_col, sample_rows)
    w, by = scratch(docs, "words", "by")
    text = F.col(f"`{text_col}`")
    out = docs.withColumn(w, _words(text)).withColumn(by, cascade(ordered, Features(text, w)))
    return out.where(F.col(by).isNull()).drop(w, by)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule keeps, with their columns."""
    return kept_rows(docs)


#: Statements over {docs} for the features and the verdict; the pipeline's SQL uses them too.
FEATURES_SQL = r"""
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  length(regexp_replace(t, '[^!]', '', 'g')) AS n_excl, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper, w
FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {docs})
"""

OP3_SQL = (
    "WITH f AS (" + FEATURES_SQL.replace("{docs}", "documents") + r"""),
wins AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM f WHERE len(w) > 2)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1
), rep AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS r FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id
), x AS (
  SELECT f.*, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words FROM f LEFT JOIN rep USING (doc_id)
), y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < n_words * 2 OR word_chars > n_words * 20 OR n_dup_lines * 10 > n_lines * 4
    OR n_repeat_words * 10 > n_words * 4 OR n_excl * 10 > n_words OR n_upper * 2 > word_chars) AS kept
FROM y
"""
)
