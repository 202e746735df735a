"""Quality rules by host.

Every document is measured against a few rules; failures are summed by host (the domain, or whatever
column names the origin); each host's failure rate is shrunk towards the corpus with a beta prior fitted
to the hosts themselves; hosts whose shrunk rate passes a limit are rejected; and the verdict is joined
back to their documents.

Defined results: a null text has no words and fails the length rule; a null host is a host of its own;
repeated rows count as often as they occur; an empty table gives an empty result; other columns of the
input are carried through only if asked for and never clash, as the measures are computed before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, join_small, table, words_of, written

MIN_WORDS = 50
#: A host is rejected when the shrunk rate of any rule passes this.
HOST_LIMIT = 0.5
RULES = ("short", "repeats", "symbols", "lines")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words (long) to docs.

    n_repeat_words: 3-word windows are hashed, sorted with their positions, and equal neighbours are
    repeats; words covered are counted from the sorted positions.  All of it stays in the row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w = docs.withColumn("__w", words_of(t)).withColumn("__l", F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    n = F.size("__w")
    grams = F.when(n < 3, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("p")))
    )
    w = w.withColumn("__n", n.cast("long")).withColumn("__g", F.array_sort(grams))
    twice = F.filter("__g", lambda x, i: F.coalesce(x["h"] == F.get("__g", i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("__g", i - 1)["h"], F.lit(False)))
    w = w.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["p"])))
    covered = F.aggregate(F.transform("__p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__p", i + 1) - p, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        w.withColumn("n_words", F.col("__n"))
        .withColumn("word_chars", F.length(F.translate(t, SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
        .withColumn("n_lines", F.size("__l").cast("long"))
        .withColumn("n_repeat_words", covered)
        .drop("__w", "__l", "__g", "__p", "__n")
    )


def failures(m: DataFrame) -> DataFrame:
    """Adds a boolean for each of RULES."""
    return (
        m.withColumn("short", F.col("n_words") < MIN_WORDS)
        .withColumn("repeats", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        .withColumn("symbols", 10 * F.col("n_symbols") > F.col("word_chars"))
        .withColumn("lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))
    )


def host_verdicts(failed: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """A row per host: n, the shrunk rate of each rule, host_ok.

    Prior of a rule: beta with the mean and variance of the hosts' rates, weighted by documents (method
    of moments); hosts that do not differ give a prior as strong as 1e6 documents.
    """
    hosts = failed.groupBy(host).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(f"x_{r}") for r in RULES])
    n = F.sum("n").cast("double")
    moments = hosts.agg(*[x for r in RULES for x in ((F.sum(f"x_{r}") / n).alias(f"m_{r}"), (F.sum(F.pow(F.col(f"x_{r}"), 2) / F.col("n")) / n).alias(f"s_{r}"))])
    hosts = hosts.join(F.broadcast(moments))  # one row
    rates = []
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"s_{r}") - F.pow(F.col(f"m_{r}"), 2)
        k = F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.when(v > 1e-12, m * (1 - m) / v - 1).otherwise(F.lit(1e6))))
        rates.append(((F.col(f"x_{r}") + m * k) / (F.col("n") + k)).alias(f"rate_{r}"))
    out = hosts.select(host, F.col("n").alias("host_docs"), *rates)
    return out.withColumn("host_ok", ~F.greatest(*[F.col(f"rate_{r}") > limit for r in RULES]))


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per document: carry, host, the measures, the rules failed, the host's rates and host_ok."""
    narrow = docs.select(*[F.col(c) for c in carry], F.col(host).alias("host"), F.col(text).alias("text"))
    m = written(failures(measures(narrow)).drop("text"), "quality")
    return join_small(m, host_verdicts(m, "host", limit), ["host"], carry[0])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules(table(spark, sf_dir, "documents"))
    base = F.col("short") | F.col("repeats")
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("host_ok")).alias("kept"))


OP1_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, unnest(generate_series(1, len(w) - 2)) AS p, w FROM w WHERE len(w) >= 3
), gg AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, w[p], w[p + 1], w[p + 2]) AS c FROM g
), cov AS (
  SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM gg WHERE c > 1) GROUP BY r
), l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT w.r, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (r) LEFT JOIN l USING (r)
), f AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > word_chars AS f3, 100 * n_dup_lines > 30 * n_lines AS f4 FROM m
), h AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(x::INT)::DOUBLE AS x FROM
    (SELECT source, unnest([1, 2, 3, 4]) AS rule, unnest([f1, f2, f3, f4]) AS x FROM f) GROUP BY ALL
), mo AS (SELECT rule, sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) - (sum(x) / sum(n)) ** 2 AS v FROM h GROUP BY rule),
k AS (SELECT rule, mean, least(1e6, greatest(1.0, CASE WHEN v > 1e-12 THEN mean * (1 - mean) / v - 1 ELSE 1e6 END)) AS k FROM mo),
ok AS (SELECT source, bool_and((x + mean * k) / (n + k) <= 0.5) AS host_ok FROM h JOIN k USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND host_ok AS kept
FROM f JOIN ok ON f.source IS NOT DISTINCT FROM ok.source
"""
