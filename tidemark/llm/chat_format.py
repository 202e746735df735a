"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns of the two is rendered once as the prompt; what follows it on either side
is rendered as that side's completion, with spans of characters that take part in the loss: the text and end
mark of assistant turns.  Turns are gathered once, by pair.

Defined results: turns are ordered by turn, then role, then text, nulls last, and repeated rows stay; a null
role is rendered as "unknown", a null text as empty; a missing side is an empty conversation; identical
conversations have empty completions; rows without a conversation id are the chosen side of the null pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"
_TURN = "array<struct<turn:bigint,role:string,text:string>>"


def _render(turns: F.Column) -> F.Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(BREAK), t["text"], F.lit(END))), "")


def _mask(turns: F.Column) -> F.Column:
    """Spans [start, stop) of code points of _render(turns) that take part in the loss."""
    head = len(START) + len(BREAK)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def step(acc, t):
        first = acc["at"] + head + F.length(t["role"])
        stop = first + F.length(t["text"]) + len(END)
        span = F.array(F.struct(first.cast("long").alias("start"), stop.cast("long").alias("stop")))
        return F.struct(stop.cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(turns: DataFrame) -> DataFrame:
    """turns: pair_id, chosen (boolean), turn, role, text.  A row per pair: pair_id, n_prompt_turns, prompt,
    chosen, rejected, and chosen_mask, rejected_mask as arrays of spans."""
    # nulls last: Spark's array order has them first
    t = F.struct(
        F.coalesce(F.col("turn").cast("long"), F.lit(2**63 - 1)).alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    side = lambda is_chosen: F.array_sort(F.collect_list(F.when(F.coalesce(F.col("chosen"), F.lit(False)) == is_chosen, t)).cast(_TURN))
    g = turns.groupBy("pair_id").agg(side(True).alias("__c"), side(False).alias("__r"))
    same = F.zip_with("__c", "__r", lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, F.lit(False)).cast("int")
    g = g.withColumn("__n", F.when(first > 0, first - 1).otherwise(F.size("__c")))
    rest = lambda c: F.slice(c, F.col("__n") + 1, F.greatest(F.size(c) - F.col("__n"), F.lit(0)))
    g = g.withColumn("__p", F.slice("__c", F.lit(1), F.col("__n"))).withColumn("__cr", rest("__c")).withColumn("__rr", rest("__r"))
    return g.select(
        "pair_id", F.col("__n").cast("long").alias("n_prompt_turns"), _render(F.col("__p")).alias("prompt"),
        _render(F.col("__cr")).alias("chosen"), _render(F.col("__rr")).alias("rejected"),
        _mask(F.col("__cr")).alias("chosen_mask"), _mask(F.col("__rr")).alias("rejected_mask"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no preferences, so conversations 2k (chosen) and 2k + 1 (rejected) are pair k."""
    c = table(spark, sf_dir, "conversations")
    turns = c.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), (F.coalesce(F.pmod("conv_id", F.lit(2)), F.lit(0)) == 0).alias("chosen"), "turn", "role", "text")
    f = format_pairs(turns)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return f.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", spans(F.col("chosen_mask")).alias("chosen_mask"), spans(F.col("rejected_mask")).alias("rejected_mask"))


OP3_SQL = r"""
WITH t AS (
  SELECT floor(conv_id / 2)::BIGINT AS pair_id, coalesce(conv_id % 2, 0) AS side, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) AS i FROM conversations
), m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i, a.role IS NOT NULL AND b.role IS NOT NULL AND a.role = b.role AND a.text = b.text AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id IS NOT DISTINCT FROM b.pair_id AND a.i = b.i
), n AS (
  SELECT pair_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS n FROM m GROUP BY pair_id
), r AS (
  SELECT t.*, n.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM t JOIN n ON t.pair_id IS NOT DISTINCT FROM n.pair_id
), o AS (
  SELECT *, sum(length(s)) OVER (PARTITION BY pair_id, side, i <= n ORDER BY i) AS e FROM r
)
SELECT pair_id, any_value(n)::BIGINT AS n_prompt_turns,
       coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i <= n), '') AS prompt,
       coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i > n), '') AS chosen,
       coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 1 AND i > n), '') AS rejected,
       coalesce(string_agg((e - length(text) - 11)::BIGINT::VARCHAR || '-' || e::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (side = 0 AND i > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((e - length(text) - 11)::BIGINT::VARCHAR || '-' || e::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (side = 1 AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY pair_id
"""
