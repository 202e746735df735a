"""Queries composed of several operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import money, tokens
from ..operators import joins, result, transform
from ..timed import TimedFrame
from .registry import query
from .tables import E, edges, edges_sql, events, lineitem

CUTOFF = "1998-09-02 00:00:00"


@query(
    "scan_filter_agg",
    f"""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price
        FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUTOFF}' GROUP BY 1, 2""",
)
def scan_filter_agg(spark, sf_dir):
    """The flagship: scan, filter, group, sum."""
    d = lineitem(spark, sf_dir).where(F.col("l_shipdate") < F.expr(f"TIMESTAMP_NTZ '{CUTOFF}'"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"))


@query("map_chain_20", "SELECT count(*)::BIGINT AS n, sum(l_orderkey + 20)::BIGINT AS total FROM lineitem")
def map_chain_20(spark, sf_dir):
    d = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("v"))
    return transform.map_chain(d, "v", [lambda v: v + 1] * 20).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("multi_epoch_filter", f"WITH {E} SELECT epoch % 16 AS epoch, seq FROM e WHERE seq > (SELECT max(seq) FROM e) // 2")
def multi_epoch_filter(spark, sf_dir):
    d = events(spark, sf_dir).df.select((F.col("epoch") % 16).alias("epoch"), "seq")
    half = d.agg(F.floor(F.max("seq") / 2).alias("half"))  # one row
    return d.join(F.broadcast(half), F.col("seq") > F.col("half")).select("epoch", "seq")


@query("small_pipeline", "SELECT (i + 1) * 2 - 1 AS v FROM range(100) t(i)")
def small_pipeline(spark, sf_dir):
    return transform.map_chain(spark.range(100).withColumnRenamed("id", "v"), "v", [lambda v: v + 1, lambda v: v * 2, lambda v: v - 1])


@query("small_filter", "SELECT i AS v FROM range(500) t(i) WHERE i > 275")
def small_filter(spark, sf_dir):
    return spark.range(500).withColumnRenamed("id", "v").where("v > 275")


@query(
    "join_revenue_by_key",
    f"""WITH l AS (SELECT l_orderkey AS k, l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2) AS revenue FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUTOFF}'),
        r AS (SELECT l_orderkey AS k FROM lineitem WHERE l_quantity >= 25)
        SELECT k, sum(revenue)::DOUBLE AS revenue, count(*)::BIGINT AS n FROM l JOIN r USING (k) GROUP BY 1""",
)
def join_revenue_by_key(spark, sf_dir):
    """A multiset join: both sides are first summed by key, so the join never multiplies rows."""
    d = lineitem(spark, sf_dir)
    l = d.where(F.col("l_shipdate") < F.expr(f"TIMESTAMP_NTZ '{CUTOFF}'")).groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")).alias("s"), F.count(F.lit(1)).alias("a"))
    r = d.where("l_quantity >= 25").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return l.join(r, "k").select("k", (F.col("s") * F.col("b")).cast("double").alias("revenue"), (F.col("a") * F.col("b")).alias("n"))


@query("hash_join_users_orders", "SELECT o_custkey AS k, greatest(c_nationkey, o_orderkey % 30)::BIGINT AS epoch, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def hash_join_users_orders(spark, sf_dir):
    c = TimedFrame(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("epoch"), "c_name"))
    o = TimedFrame(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 30).alias("epoch"), "o_orderkey"))
    return c.join(o, ["k"]).df


@query("two_hop_paths", f"WITH {edges_sql(1000)}, d AS (SELECT DISTINCT src, dst FROM g) SELECT a.src AS a, b.dst AS c, count(*)::BIGINT AS n, min(a.dst) AS low, max(a.dst) AS high FROM d a JOIN d b ON a.dst = b.src GROUP BY 1, 2")
def two_hop_paths(spark, sf_dir):
    """The self-join over all edges; its paths are gathered by their ends, as a list of them grows with the square
    of the edges."""
    d = edges(spark, sf_dir, 1000).distinct()
    return joins.two_hops(d).groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("low"), F.max("b").alias("high"))


@query("join_per_epoch", f"WITH {E} SELECT a.epoch, a.user_id, a.seq AS click, b.seq AS purchase FROM e a JOIN e b ON a.epoch = b.epoch AND a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def join_per_epoch(spark, sf_dir):
    f = events(spark, sf_dir)
    side = lambda t, n: f.over(f.df.where(F.col("event_type") == t).select("epoch", "user_id", F.col("seq").alias(n)), seq=None)
    return side("click", "click").join_epoch(side("purchase", "purchase"), ["user_id"]).df


@query("interval_join_extra", f"WITH {E} SELECT a.seq AS click, b.seq AS purchase FROM e a JOIN e b ON a.user_id = b.user_id AND b.epoch BETWEEN a.epoch - 1 AND a.epoch + 2 WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def interval_join_extra(spark, sf_dir):
    d = events(spark, sf_dir).df
    a = d.where("event_type = 'click'").select("user_id", "epoch", F.col("seq").alias("click"))
    b = d.where("event_type = 'purchase'").select("user_id", "epoch", F.col("seq").alias("purchase"))
    return joins.interval(a, b, ["user_id"], "epoch", 1, 2).select("click", "purchase")


_WORDS = r"SELECT doc_id % 10 AS epoch, doc_id AS seq, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS word FROM documents"


def _words(spark, sf_dir) -> TimedFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 10).alias("epoch"), F.col("doc_id").alias("seq"), "text")
    return TimedFrame(d, seq="seq").flat_map(tokens("text"), "word")


@query("wordcount_epoch", f"WITH w AS ({_WORDS}) SELECT epoch, word, count(*)::BIGINT AS n FROM w GROUP BY 1, 2")
def wordcount_epoch(spark, sf_dir):
    return _words(spark, sf_dir).count(by=["word"]).df


@query("notify_wordcount", f"WITH w AS ({_WORDS}) SELECT epoch, count(DISTINCT word)::BIGINT AS words, max(n)::BIGINT AS most FROM (SELECT epoch, word, count(*) AS n FROM w GROUP BY 1, 2) GROUP BY 1")
def notify_wordcount(spark, sf_dir):
    """Words are dealt to workers; each tells, an epoch, of its distinct words and their counts, as they come in batches.
    What the workers told of an epoch is summed."""
    def told(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
        words = most = 0
        for p in batches:
            epoch, words, most = p["epoch"].iloc[0], words + len(p), max(most, p["n"].max())
        return pd.DataFrame({"epoch": [epoch], "words": [words], "most": [most]})

    f = _words(spark, sf_dir).count(by=["word"])
    f = f.over(f.df.select("epoch", F.pmod(F.hash("word"), F.lit(32)).alias("worker"), "n"))
    shares = f.unary_notify(told, "epoch long, words long, most long", by=["worker"], batches=True)
    return shares.aggregate(F.sum("words").alias("words"), F.max("most").alias("most")).df


@query("running_counts", f"WITH {E} SELECT event_type, seq, row_number() OVER (PARTITION BY event_type ORDER BY epoch, seq) AS n FROM e")
def running_counts(spark, sf_dir):
    """The n-th occurrence of each key.  A key's rows are numbered within an epoch and shifted by the counts of the
    epochs before, so a hot key is spread over its epochs."""
    d = events(spark, sf_dir).df.select("epoch", "event_type", "seq")
    per = d.groupBy("event_type", "epoch").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("event_type").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("event_type", "epoch", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"))
    own = d.withColumn("i", F.row_number().over(Window.partitionBy("event_type", "epoch").orderBy("seq")))
    return own.join(before, ["event_type", "epoch"]).select("event_type", "seq", (F.col("i") + F.col("before")).alias("n"))


@query("epoch_keyed_sum", f"WITH {E} SELECT epoch, user_id, sum(cents)::BIGINT AS total FROM e GROUP BY 1, 2")
def epoch_keyed_sum(spark, sf_dir):
    return events(spark, sf_dir).aggregate(F.sum("cents").alias("total"), by=["user_id"]).df


@query("filter_aggregate", f"WITH {E} SELECT epoch, sum(cents)::BIGINT AS total FROM e WHERE cents > 5000 GROUP BY 1")
def filter_aggregate(spark, sf_dir):
    return events(spark, sf_dir).filter("cents > 5000").aggregate(F.sum("cents").alias("total")).df


@query("branch_merge_sum", f"WITH {E} SELECT epoch, sum(CASE WHEN user_id % 2 = 0 THEN user_id * 2 ELSE user_id * 3 END)::BIGINT AS total FROM e GROUP BY 1")
def branch_merge_sum(spark, sf_dir):
    even, odd = events(spark, sf_dir).branch("user_id % 2 = 0")
    return even.map(v="user_id * 2").merge(odd.map(v="user_id * 3")).aggregate(F.sum("v").alias("total")).df


@query("delayed_sum", f"WITH {E} SELECT epoch + 5 AS epoch, sum(cents)::BIGINT AS total FROM e GROUP BY 1")
def delayed_sum(spark, sf_dir):
    return events(spark, sf_dir).delay_batch("epoch + 5").aggregate(F.sum("cents").alias("total")).df


@query("sensor_alerts", f"WITH {E} SELECT (epoch // 7 + 1) * 7 AS epoch, seq, 'ALERT: sensor ' || user_id || ' at ' || cents AS alert FROM e WHERE value > 450")
def sensor_alerts(spark, sf_dir):
    return events(spark, sf_dir).filter("value > 450").tumbling(7).map(alert=F.format_string("ALERT: sensor %d at %d", "user_id", "cents")).df


@query("result_pipeline", f"WITH {E}, t AS (SELECT epoch, seq, user_id, trunc((user_id - 20) * 9 / 5)::BIGINT + 32 AS f FROM e) SELECT epoch, seq, CASE WHEN user_id % 5 = 0 THEN 'offline ' || user_id ELSE f::VARCHAR END AS v FROM t WHERE user_id % 5 = 0 OR f BETWEEN 32 AND 100")
def result_pipeline(spark, sf_dir):
    from ..functions import div

    bad = F.col("user_id") % 5 == 0
    f = events(spark, sf_dir).map(r=result.result(F.col("user_id") - 20, ~bad, F.concat(F.lit("offline "), F.col("user_id").cast("string"))))
    ok, err = f.map_ok(lambda c: div(c * 9, 5) + 32).filter_ok(lambda v: v.between(32, 100)).branch_result()
    return ok.map(v="cast(ok as string)").concat(err.map(v="err")).df


@query("validate_audit", f"WITH {E}, v AS (SELECT epoch, seq, user_id - 75 AS x FROM e) SELECT epoch, seq, CASE WHEN x > 0 THEN 'accepted ' || (x * x) ELSE 'rejected invalid: ' || x END AS audit FROM v")
def validate_audit(spark, sf_dir):
    x = F.col("user_id") - 75
    f = events(spark, sf_dir).map(r=result.result(x, x > 0, F.concat(F.lit("invalid: "), x.cast("string"))))
    ok, err = f.branch_result()
    return ok.map(audit=F.concat(F.lit("accepted "), (F.col("ok") * F.col("ok")).cast("string"))).concat(err.map(audit=F.concat(F.lit("rejected "), F.col("err")))).df


@query("multi_stage_pipeline", f"WITH {E} SELECT epoch, (user_id * user_id)::VARCHAR AS v, count(*)::BIGINT AS n FROM e GROUP BY 1, 2")
def multi_stage_pipeline(spark, sf_dir):
    f = events(spark, sf_dir).map(s="cast(user_id as string)").exchange("s", to=4).map(x="cast(s as bigint)").map(x="x * x")
    return f.exchange("x", to=2).map(v="cast(x as string)").count(by=["v"]).df


@query("fan_out_fan_in", f"WITH {E} SELECT epoch, seq, user_id * 2 + 1 AS v FROM e")
def fan_out_fan_in(spark, sf_dir):
    return events(spark, sf_dir).map(v="user_id * 2").exchange("v", to=4).map(v="v + 1").df
