"""Stupid-backoff language-model scores by counting joins.

Documents are dealt to blocks by a hash of the row.  A block sends the distinct words and word pairs it holds,
with its counts, to the partition of their hash; there the counts of all blocks are summed (the n-gram count
tables, partitioned by hash) and joined back to the n-grams that asked; the block then looks up each position
of each document and sums the logarithms.  No n-gram is a row of its own on the way: the n-grams of a block and
a partition travel as one packed row.

Score of a word w after v, with all counts c taken without the document itself:
c(v w) / c(v) if c(v w) > 0, else 0.4 * max(c(w), 1) / N; the first word of a document has max(c(w), 1) / N.
N: words of the other documents, 1 at least.

Defined results: a text without words has n_words 0 and score 0; every row is a document of its own, so repeated
rows count for each other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table
from .words import bounds, expand, ngrams, pack, squeeze, unpack, word_hashes

BACKOFF = 0.4


def _hashed(texts) -> tuple[list[np.ndarray], list[np.ndarray]]:
    words = [word_hashes(t) for t in texts]
    return words, [ngrams(h, 2) for h in words]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *parts])


def block_counts(docs: DataFrame, parts: int) -> DataFrame:
    """part, block, and the block's words and pairs of that partition with their counts, packed.  All columns of
    docs go in, so that the exchange by block is the one that lm_scores reads too."""
    cuts = bounds(parts)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block, cols = int(pdf["__block"].iloc[0]), []
        for grams in _hashed(pdf["__text"]):
            keys, counts = np.unique(_joined(grams), return_counts=True)
            at = np.append(np.searchsorted(keys, cuts), len(keys))
            cols += [[pack(keys[a:b]) for a, b in zip(at, at[1:])], [squeeze(counts[a:b].astype("<u4")) for a, b in zip(at, at[1:])]]
        rows = [(p, block, *r) for p, r in enumerate(zip(*cols)) if r[0] or r[2]]
        return pd.DataFrame(rows, columns=["part", "block", "keys1", "counts1", "keys2", "counts2"])

    return docs.groupBy("__block").applyInPandas(run, "part int, block int, keys1 binary, counts1 binary, keys2 binary, counts2 binary")


def summed(sent: DataFrame) -> DataFrame:
    """block, part, counts1, counts2: of all blocks, for the keys that the block sent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"block": pdf["block"], "part": pdf["part"]}
        for n in (1, 2):
            keys = [unpack(k) for k in pdf[f"keys{n}"]]
            every, at = np.unique(_joined(keys), return_inverse=True)
            counts = np.concatenate([np.empty(0, "<u4"), *[expand(c, "<u4") for c in pdf[f"counts{n}"]]])
            sums = np.bincount(at, weights=counts, minlength=len(every)).astype("<u8")
            ends = np.cumsum([0, *map(len, keys)])
            out[f"counts{n}"] = [squeeze(sums[at[x:y]]) for x, y in zip(ends, ends[1:])]
        return pd.DataFrame(out)

    return sent.groupBy("part").applyInPandas(run, "block int, part int, counts1 binary, counts2 binary")


def lm_scores(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), backoff: float = BACKOFF) -> DataFrame:
    """carry, n_words, n_backoff (positions scored by the word alone), log_score (natural logarithm)."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select(*carry, F.col(text).alias("__text"))
    d = d.withColumn("__block", F.pmod(F.xxhash64(*carry, "__text"), F.lit(parts * 2)).cast("int")).repartition(parts, "__block")
    counted = summed(block_counts(d, parts))
    everything = float(docs.agg(F.sum(F.regexp_count(F.col(text), F.lit(WORD)))).first()[0] or 0)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[*carry, "n_words", "n_backoff", "log_score"])
        words, pairs = _hashed(left["__text"])
        place, count = [], []
        right = right.sort_values("part")
        for n, grams in enumerate((words, pairs), 1):
            count.append(np.concatenate([np.empty(0, "<u8"), *[expand(c, "<u8") for c in right[f"counts{n}"]]]).astype(float))
            place.append(np.unique(_joined(grams), return_inverse=True)[1])
        n_words, n_backoff, scores = [], [], []
        a = b = 0
        for h in words:
            n = len(h)
            w = place[0][a : a + n]
            p = place[1][b : b + max(0, n - 1)]
            a, b = a + n, b + max(0, n - 1)
            n_words.append(n)
            if not n:
                n_backoff.append(0)
                scores.append(0.0)
                continue
            _, i, c = np.unique(w, return_inverse=True, return_counts=True)
            cw = count[0][w] - c[i]
            rest = max(1.0, everything - n)
            alone = np.maximum(cw, 1.0) / rest
            if n == 1:
                n_backoff.append(0)
                scores.append(float(np.log(alone[0])))
                continue
            _, i, c = np.unique(p, return_inverse=True, return_counts=True)
            cp = count[1][p] - c[i]
            seen = cp > 0
            s = np.where(seen, cp / np.where(seen, cw[:-1], 1.0), backoff * alone[1:])
            n_backoff.append(int((~seen).sum()))
            scores.append(float(np.log(alone[0]) + np.log(s).sum()))
        return left[list(carry)].assign(n_words=n_words, n_backoff=n_backoff, log_score=scores)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return d.groupBy("__block").cogroup(counted.groupBy("block")).applyInPandas(run, f"{kinds}, n_words long, n_backoff long, log_score double")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lm_scores(table(spark, sf_dir, "documents"))
    return s.withColumn("log_score", F.round("log_score", 4))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT r, doc_id, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS v FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM d)
), c AS (
  SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY r, w) AS cw,
         count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY r, v, w) AS cp,
         greatest(1, count(*) OVER () - count(*) OVER (PARTITION BY r)) AS n FROM p
), x AS (
  SELECT *, lag(cw) OVER (PARTITION BY r ORDER BY i) AS cv FROM c
), s AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (i > 1 AND cp = 0) AS n_backoff,
         sum(ln(CASE WHEN i = 1 THEN greatest(cw, 1)::DOUBLE / n WHEN cp > 0 THEN cp::DOUBLE / cv ELSE 0.4::DOUBLE * (greatest(cw, 1)::DOUBLE / n) END)) AS log_score FROM x GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(coalesce(log_score, 0), 4) AS log_score FROM d LEFT JOIN s USING (r)
"""
