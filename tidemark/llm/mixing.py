"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words; target / size is what each of its documents is expected to be
taken.  The whole copies of that are certain.  The rest is an inclusion probability p; a document gets a
random u from its id, and documents are taken in the order of their odds u / (1 - u) divided by the
inclusion odds p / (1 - p), as many as bring the source's words nearest to its target.

The place where a source stops is found by descending a histogram of the order, 12 bits at a time: each
level sums words by (source, bin) before it shuffles, so a source of any size is spread over all tasks.  Rows of
one id and text share a place; where a source stops among them, they are told apart by their place in the table,
and a second histogram finds how many are taken.  So a source ends within one row of its target.

Defined results: null texts have size 0; a null source is a source of its own, sorted last; rows that share an id
(null ids, too) have places of their own unless they share the text, too; sources whose caps tie are taken in code
point order; columns of any names stay apart; an empty table gives an empty result; a corpus without words has
targets of 0.  Reruns give the same rows; of rows equal in id and text it is open which ones are taken.  docs must
be a stored table, as rows are told apart by their place in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, forget, join_small, table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BITS, LEVELS = 12, 4
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: a row per source (source, source_size).  Adds target.

    Sources in code point order, null last, weigh weights, repeating.  The fixed point of "cap, reshare the
    excess by weight" is min(cap, level * weight) for one level: with sources sorted by cap / weight, it is
    the first level that does not pass the next cap.  The table has a row per source, not per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(most))
    by_cap = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("__all", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("__level", (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after))
    s = s.withColumn("__n", F.row_number().over(by_cap))
    s = s.withColumn("__at", F.min(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct("__n", "__level"))).over(everything)["__level"])
    return s.select("source", "source_size", F.least(F.col("__cap"), F.coalesce(F.col("__at") * F.col("__w"), F.col("__cap"))).alias("target"))


def _random(doc: str, text: str) -> F.Column:
    """u: a number in (0, 1) from a row's id and text."""
    own = F.concat(F.lit(SEED + ":"), F.coalesce(F.col(doc).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(F.col(text)), F.lit("null")))
    return (F.conv(F.substring(F.md5(own), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _tie() -> F.Column:
    """Tells rows of one place apart, by their place in the stored table."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS * LEVELS)


def _order(u: str, p: str) -> F.Column:
    """The place in the order as a 48-bit number: odds o = u/(1-u) / (p/(1-p)), as o / (1 + o)."""
    odds = (F.col(u) / (1 - F.col(u))) / (F.col(p) / (1 - F.col(p)))
    return F.when(F.col(p) > 0, F.floor(odds / (1 + odds) * F.lit(float(2 ** (BITS * LEVELS)))).cast("long")).otherwise(F.lit(2 ** (BITS * LEVELS)).cast("long"))


def _stops(rows: DataFrame, state: DataFrame, by: str) -> DataFrame:
    """state (source, rest, base, ...) with at, step: the number in column `by` at which the running sum of a source's
    words, from base on, first passes its rest, and that number's words; base becomes the words before it.  A source
    that never passes its rest gets a number beyond all."""
    kept = [c for c in state.columns if c not in ("base", "at", "step")]
    state = state.withColumn("at", F.lit(0).cast("long")).withColumn("step", F.lit(0).cast("long"))
    last = None
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        here = join_small(rows.select("source", "size", F.shiftright(by, shift).alias("b"), F.col(by).alias("__by")), state.select("source", "at"), ["source"], "__by").where(F.shiftright("b", BITS) == F.col("at"))
        sums = here.groupBy("source", "b").agg(F.sum("size").alias("words"))
        lists = sums.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("b", "words"))).alias("bins"))
        new = join_small(state, lists, ["source"], "source")
        start = F.struct(F.col("base").alias("base"), F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("step"))

        def walk(acc, x):
            stop = acc["at"].isNull() & (acc["base"] + x["words"] > F.col("rest"))
            return F.struct(
                F.when(acc["at"].isNull() & ~stop, acc["base"] + x["words"]).otherwise(acc["base"]).alias("base"),
                F.when(stop, x["b"]).otherwise(acc["at"]).alias("at"),
                F.when(stop, x["words"]).otherwise(acc["step"]).alias("step"),
            )

        new = new.withColumn("__f", F.aggregate(F.coalesce("bins", F.array().cast("array<struct<b:bigint,words:bigint>>")), start, walk))
        # a source that never passes its rest takes all: its open range lies beyond the last bin
        new = new.select(*kept, F.col("__f.base").alias("base"), F.coalesce("__f.at", F.lit(2 ** (BITS * (level + 1))).cast("long")).alias("at"), F.col("__f.step").alias("step"))
        state = written(new, "mix-state")
        if last is not None:
            forget(rows.sparkSession, last)
        last = state
    return state


def _sized(docs: DataFrame, source: str, text: str, doc: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), _random(doc, text).alias("u"), _tie().alias("tie"))


def mix_plan(docs: DataFrame, source: str = "source", text: str = "text", doc: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """The sizes (doc_id, source, size, u, tie) and a row per source: source_size, target, whole (certain copies), p
    (probability of one more), end, end_tie and nearer (where in the order the source stops, and whether the row
    there is taken too)."""
    spark = docs.sparkSession
    sized = written(_sized(docs, source, text, doc), "mix-sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(ratio + 1e-12), F.lit(int(most)).cast("long"))
    goal = goal.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), ratio - whole)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    start = written(goal.withColumn("base", F.lit(0).cast("long")), "mix-state")
    rows = written(join_small(sized, start.select("source", "p"), ["source"], "tie").where("p > 0").select("source", "size", "tie", _order("u", "p").alias("place")), "mix-rows")
    state = _stops(rows, start, "place")
    # the last step is one place; the rows there, alike in all but the tie, are gone through in turn
    ends = state.withColumnRenamed("at", "end").drop("step")
    tied = written(join_small(rows, ends.select("source", "end"), ["source"], "tie").where("place = end").select("source", "size", "tie"), "mix-tied")
    last = _stops(tied, ends, "tie")
    nearer = (F.col("step") > 0) & (F.col("base") + F.col("step") - F.col("rest") < F.col("rest") - F.col("base"))
    plan = written(last.select("source", "source_size", "target", "whole", "p", "end", F.col("at").alias("end_tie"), nearer.alias("nearer")), "mix-plan")
    for t in (start, rows, state, tied, last):
        forget(spark, t)
    return sized, plan


def with_copies(rows: DataFrame, plan: DataFrame, source: str = "source", u: str = "u", tie: str = "tie") -> DataFrame:
    """rows with source_size, target and copies.  Decided row by row; rows are not shuffled unless sources are
    too many to be broadcast."""
    named = plan.select(F.col("source").alias(source), *[F.col(c).alias(f"__{c}") for c in plan.columns if c != "source"])
    out = join_small(rows, named, [source], tie).withColumn("__place", _order(u, "__p"))
    at = (F.col("__place") == F.col("__end")) & ((F.col(tie) < F.col("__end_tie")) | ((F.col(tie) == F.col("__end_tie")) & F.col("__nearer")))
    more = (F.col("__p") > 0) & ((F.col("__place") < F.col("__end")) | at)
    return out.select(*rows.columns, F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__whole") + more.cast("long")).alias("copies"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies (how often it is taken)."""
    sized, plan = mix_plan(docs, source, text, doc, weights, share, most)
    return with_copies(sized, plan)


def mixed_rows(docs: DataFrame, source: str = "source", text: str = "text", doc: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of docs, each as often as it is taken."""
    sized, plan = mix_plan(docs, source, text, doc, weights, share, most)
    forget(docs.sparkSession, sized)
    own = docs.select(*[F.col(c).alias(f"__d_{c}") for c in docs.columns], _random(doc, text).alias("__u"), _tie().alias("__tie"))
    taken = with_copies(own, plan, f"__d_{source}", "__u", "__tie").where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select([F.col(f"__d_{c}").alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(text) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS n FROM s
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lev, n) FROM l WHERE lev * w <= cap) * w, cap))::DOUBLE AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t
), g AS (
  SELECT *, least(floor(ratio + 1e-12), 2)::BIGINT AS whole, greatest(0, ratio - least(floor(ratio + 1e-12), 2)) AS p,
         greatest(0, target - least(floor(ratio + 1e-12), 2) * source_size) AS rest FROM r
), u AS (
  SELECT d.doc_id, d.size, g.*, ((('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || coalesce(d.h, 'null')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), o AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM u
), pl AS (
  SELECT *, CASE WHEN p > 0 THEN floor(odds / (1 + odds) * 281474976710656.0::DOUBLE)::BIGINT ELSE 281474976710656 END AS place FROM o
), k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) AS n FROM pl
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k
), e AS (SELECT source AS es, min(n) AS stop FROM c WHERE upto > rest GROUP BY source)
SELECT doc_id, size, source_size, target,
       (whole + CASE WHEN p > 0 AND (stop IS NULL OR n < stop OR (n = stop AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END) * size AS taken
FROM c LEFT JOIN e ON c.source IS NOT DISTINCT FROM e.es
"""
