"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to in is that it for with as was on be at by "
    "le la les de des et en un une que qui est pour dans "
    "der die das und ist von zu mit den ein eine nicht sich auf "
    "el los las del se una con por su para es y "
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails where ``top / bottom`` lies outside low..high (a bound of None is open; bottom 0 passes)."""

    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None


#: The base rules of the contract, in words: at least 50 words, at most half of them in repeated three-word windows.
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50

RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols per word", "n_symbols", "n_words", None, 0.3),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.4),
    Rule("repeated windows", "n_repeat_words", "n_words", None, 0.4),
    Rule("distinct stop words", "n_stop_words", "one", 2.0, None),
    Rule("lines with bars", "n_bar_lines", "n_lines", None, 0.5),
    Rule("capital letters", "n_capitals", "word_chars", None, 0.5),
)


#: Columns that the measures and verdicts take.
MEASURES = [f"q_{c}" for c in "words lines windows n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_bar_lines n_stop_words n_capitals one base_failed kept".split()]


def _deleted(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the rules compare, as columns with the prefix ``q_`` (null text: as empty).

    Three-word windows are compared by a 64-bit hash with their place, sorted
    within the document; nothing leaves its row, so there is no shuffle and a
    hot source or a long text only costs its own row.
    """
    docs = docs.drop(*MEASURES)
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.withColumn("q_words", F.array_remove(F.split(t, WHITE_RUN), "")).withColumn("q_lines", F.filter(F.split(t, "\n"), lambda x: F.length(_deleted(x, WHITE)) > 0))
    n = F.size("q_words")

    def window(i: Column) -> Column:
        word = lambda k: F.get("q_words", i + k)
        return F.struct(F.xxhash64(word(0), word(1), word(2)).alias("h"), i.alias("i"))

    a = a.withColumn("q_windows", F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window))))
    repeated = F.filter("q_windows", lambda x, k: (x["h"] == F.get("q_windows", k - 1)["h"]) | (x["h"] == F.get("q_windows", k + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    long = lambda c: c.cast("long")
    return a.select(
        *[c for c in docs.columns],
        long(n).alias("q_n_words"),
        long(F.length(_deleted(t, WHITE))).alias("q_word_chars"),
        long(F.length(t) - F.length(_deleted(t, SYMBOLS))).alias("q_n_symbols"),
        long(F.size("q_lines") - F.size(F.array_distinct("q_lines"))).alias("q_n_dup_lines"),
        long(F.coalesce(F.size(covered), F.lit(0))).alias("q_n_repeat_words"),
        long(F.size("q_lines")).alias("q_n_lines"),
        long(F.size(F.filter("q_lines", lambda x: x.contains("|")))).alias("q_n_bar_lines"),
        long(F.size(F.array_intersect("q_words", F.array(*[F.lit(w) for w in STOP_WORDS])))).alias("q_n_stop_words"),
        long(F.length(t) - F.length(_deleted(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("q_n_capitals"),
        F.lit(1).cast("long").alias("q_one"),
    )


def passes(rules=RULES) -> Column:
    """The table as one condition over the measures."""
    ok = F.lit(True)
    for r in rules:
        ratio = F.try_divide(F.col(f"q_{r.top}").cast("double"), F.col(f"q_{r.bottom}").cast("double"))
        for bound, inside in ((r.low, lambda x, b: x >= b), (r.high, lambda x, b: x <= b)):
            if bound is not None:
                ok = ok & F.coalesce(inside(ratio, F.lit(float(bound))), F.lit(True))
    return ok


def quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents' columns, then measures with the prefix ``q_`` and the booleans q_base_failed and q_kept.

    Null and empty texts have no words and fail; an empty table gives no
    rows; repeated rows are judged each by itself; input columns with the
    names of measures are replaced.
    """
    failed = (F.col("q_n_words") < BASE_MIN_WORDS) | (100 * F.col("q_n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("q_n_words"))
    # a row number in this projection keeps Spark from pushing a later filter through it, where each use of a measure would be computed again
    fixed = F.monotonically_increasing_id() >= 0
    return with_measures(docs, text).withColumn("q_base_failed", failed).withColumn("q_kept", F.when(fixed, ~failed & passes(rules)))


def accepted(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that the rules keep, with their own columns, whatever their names."""
    judged = quality(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), "text", rules)
    return judged.where("q_kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality(docs).select("doc_id", *[F.col(f"q_{n}").alias(n) for n in names])


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: DuckDB's text of the whole query.  Its rule part repeats RULES.
OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS lines
  FROM d),
g AS (
  SELECT r, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS h
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM g) WHERE c > 1),
cover AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS p FROM dup) GROUP BY r),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(lines, lambda x: contains(x, '|'))) AS n_bar_lines,
         len(list_distinct(list_intersect(words, [{_STOPS}]))) AS n_stop_words,
         length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals
  FROM w LEFT JOIN cover USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND coalesce(word_chars::DOUBLE / nullif(n_words, 0) BETWEEN 2.0 AND 15.0, true)
       AND coalesce(n_symbols::DOUBLE / nullif(n_words, 0) <= 0.3, true)
       AND coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0) <= 0.4, true)
       AND coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0) <= 0.4, true)
       AND n_stop_words >= 2
       AND coalesce(n_bar_lines::DOUBLE / nullif(n_lines, 0) <= 0.5, true)
       AND coalesce(n_capitals::DOUBLE / nullif(word_chars, 0) <= 0.5, true) AS kept
FROM b
"""
