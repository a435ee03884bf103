"""Quality rules with host verdicts, in Spark's own functions throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.llm.common import SPACES, as_table, documents, word_list

WINDOW = 8
#: A document fails the base rules with fewer words than this ...
MIN_WORDS = 20
#: ... or with more than this share of its words in repeated windows (per cent).
MAX_REPEATED = 30
#: Further rules that count against a host only: shares of all characters in
#: words that are symbols, and of all words per repeated line (per cent).
MAX_SYMBOLS = 10
MAX_DUP_LINES = 10
#: A host whose shrunk failure rate is above this loses its documents.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more in the array, first included.

    Hashes of the windows show which documents have a repeat at all: equal
    windows have equal hashes. Only those compare the windows themselves.
    """
    starts = F.sequence(F.lit(0), F.size(words) - window)
    gram = lambda i: F.slice(words, i + 1, window)
    hashed = F.transform(starts, lambda i: F.struct(F.xxhash64(gram(i)).alias("h"), i.alias("i")))

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (gram(x["i"]) == gram(y["i"]))

    def covered(s: Column) -> Column:
        before, after = lambda k: F.get(s, k - 1), lambda k: F.get(s, k + 1)
        hit = lambda x, k: F.coalesce(same(x, before(k)), F.lit(False)) | F.coalesce(same(x, after(k)), F.lit(False))
        spots = F.array_sort(F.transform(F.filter(s, hit), lambda x: x["i"]))
        return F.aggregate(
            spots,
            F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def count(s: Column) -> Column:
        some = F.size(F.array_distinct(F.transform(s, lambda x: x["h"]))) < F.size(s)
        return F.when(some, let(F.array_sort(s), covered)).otherwise(0)

    return F.when(F.size(words) <= window, 0).otherwise(let(hashed, count)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A narrow row per document: id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda line: F.trim(line, F.lit(SPACES)) != ""
    lines = F.filter(F.split(text, "\n", -1), has_word)
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).cast("string").alias("text")).withColumn("words", word_list(F.col("text")))
    return rows.select(
        "id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, rate): each host's share of rows that fail a rule, shrunk.

    The prior is Beta(m * w, (1 - m) * w): m is the mean over all rows and w
    comes from the spread of the hosts' own rates (method of moments), within
    PRIOR_WEIGHT. Sums are per host and added up before the shuffle. A null
    host is a host of its own.
    """
    failed = (
        F.col("base_failed")
        | (100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_words"))
    )
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(failed.cast("long")).alias("k"))
    p = F.col("k") / F.col("n")
    total = hosts.agg(
        (F.sum("k") / F.sum("n")).alias("m"),
        (F.sum(F.col("n") * p * p) / F.sum("n")).alias("q"),
        (F.sum(F.lit(1.0)) / F.sum("n")).alias("inv"),
    )
    m, q, inv = total.first()
    weight = PRIOR_WEIGHT[0]
    if m and m < 1:
        # Var(k/n) = m(1-m) * (inv + (1 - inv) / (w + 1)), averaged with weight n.
        share = max(1e-9, (q - m * m) / (m * (1 - m)) - inv) / max(1e-9, 1 - inv)
        weight = min(PRIOR_WEIGHT[1], max(PRIOR_WEIGHT[0], 1 / share - 1))
    return hosts.select("host", ((F.col("k") + (m or 0.0) * weight) / (F.col("n") + weight)).alias("rate"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document with its measures, base_failed, host_rate and kept.

    kept: the base rules hold and the host's shrunk failure rate is at most
    MAX_HOST_RATE. A null text has no words and fails; a null host is judged as
    one host; repeated rows count and return each time; an empty table gives an
    empty result. Columns besides the three named are ignored. The texts are
    read once; what follows works on the narrow measures.
    """
    rows = as_table(measures(docs, id_col, text_col, host_col), "measures")
    rates = host_rates(rows).withColumnRenamed("host", "rated")
    # Hosts have no size bound, so the plan is left to choose the join by size.
    out = rows.join(rates, F.col("host").eqNullSafe(F.col("rated")))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rate") <= MAX_HOST_RATE)).alias("kept"),
        F.round("rate", 6).alias("host_rate"),
    )


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT *, list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: array_to_string(w[i:i+{WINDOW - 1}], ' ')) AS grams,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), b AS (
  SELECT row_number() OVER () AS r, * FROM g
), e AS (
  SELECT r, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS p FROM b
), h AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS c FROM e) WHERE c > 1
), c AS (
  SELECT r, sum(least({WINDOW}, p - coalesce(prev, p - {WINDOW})))::BIGINT AS n_repeat_words
  FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS prev FROM h) GROUP BY r
), m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM b LEFT JOIN c USING (r)
), f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m
), hosts AS (
  SELECT source, count(*) AS n,
         sum((base_failed OR 100 * n_symbols > {MAX_SYMBOLS} * word_chars OR 100 * n_dup_lines > {MAX_DUP_LINES} * n_words)::INT)::BIGINT AS k
  FROM f GROUP BY source
), total AS (
  SELECT sum(k)::DOUBLE / sum(n) AS m, sum(n * (k / n) * (k / n)) / sum(n) AS q, count(*)::DOUBLE / sum(n) AS inv FROM hosts
), prior AS (
  SELECT m, CASE WHEN m > 0 AND m < 1 THEN least({PRIOR_WEIGHT[1]}, greatest({PRIOR_WEIGHT[0]},
    1 / (greatest(1e-9, (q - m * m) / (m * (1 - m)) - inv) / greatest(1e-9, 1 - inv)) - 1)) ELSE {PRIOR_WEIGHT[0]} END AS w
  FROM total
), rates AS (
  SELECT source, (k + m * w) / (n + w) AS rate FROM hosts, prior
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= {MAX_HOST_RATE} AS kept, round(rate, 6) AS host_rate
FROM f JOIN rates ON f.source IS NOT DISTINCT FROM rates.source
"""
