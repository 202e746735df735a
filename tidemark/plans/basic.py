"""Queries of single operators."""

from __future__ import annotations

import pandas as pd
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cents, day_epoch, tokens
from ..operators import aggregate, exchange, flow, result, temporal
from ..operators.iterate import shared_dir
from ..sources import FrameFolder, from_epochs, stream_from_dir
from ..streaming import epoch_aggregate
from ..timed import TimedFrame
from .registry import query
from .tables import E, events


@query("source_epochs", "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT), (0, 2), (1, 3), (3, 4), (3, 4)) t(epoch, x)")
def source_epochs(spark, sf_dir):
    return from_epochs(spark, [(0, [1, 2]), (1, [3]), (2, []), (3, [4, 4])], seq=False).df


@query("input_passthrough", f"WITH {E} SELECT epoch, seq, user_id, cents FROM e")
def input_passthrough(spark, sf_dir):
    return events(spark, sf_dir).map(user_id="user_id", cents="cents").df


class _Counts(AccumulatorParam):
    def zero(self, value):
        return {}

    def addInPlace(self, a, b):
        for k, n in b.items():
            a[k] = a.get(k, 0) + n
        return a


@query("foreach_sink_counts", f"WITH {E} SELECT epoch, count(*)::BIGINT AS delivered FROM e GROUP BY 1")
def foreach_sink_counts(spark, sf_dir):
    """What a terminal sink has been given, told by an accumulator of a number an epoch."""
    total = spark.sparkContext.accumulator({}, _Counts())

    def sink(rows):
        seen: dict = {}
        for r in rows:
            seen[r["epoch"]] = seen.get(r["epoch"], 0) + 1
        total.add(seen)

    f = events(spark, sf_dir)
    f.over(f.df.select("epoch"), seq=None).for_each_batch(sink)
    return spark.createDataFrame(sorted(total.value.items()), "epoch long, delivered long")


@query("inspect_rows", f"WITH {E} SELECT epoch, seq, cents FROM e WHERE cents > 10000")
def inspect_rows(spark, sf_dir):
    """Taps of rows and of batches change nothing."""
    def whole(row):
        if row["cents"] <= 10000:
            raise ValueError("filtered")

    f = events(spark, sf_dir).filter("cents > 10000")
    f = f.over(f.df.select("epoch", "seq", "cents"))
    return f.inspect_rows(whole).inspect_batch(lambda batch: batch["cents"].sum()).df


@query("notify_at_epochs", f"WITH {E} SELECT epoch, count(*)::BIGINT AS n FROM e GROUP BY 1 UNION ALL SELECT t.epoch, 0 FROM (VALUES (-1::BIGINT), (100000::BIGINT)) t(epoch)")
def notify_at_epochs(spark, sf_dir):
    """Notifications asked for at epochs that have no rows come with those of the epochs that have."""
    f = events(spark, sf_dir)
    return f.over(f.df.select("epoch"), seq=None).notify_at(lambda epoch, rows: pd.DataFrame({"epoch": [epoch], "n": [len(rows)]}), "epoch long, n long", [-1, 100_000]).df


@query("output_receiver", f"WITH {E} SELECT epoch, count(*)::BIGINT AS n FROM e GROUP BY 1")
def output_receiver(spark, sf_dir):
    """Rows as they come out of a flow, a row an epoch."""
    from ..runtime import Flow

    flow = Flow(spark)
    flow.output("counts", events(spark, sf_dir).count().with_capacity(8))
    out = flow.take_output("counts")
    return spark.createDataFrame([tuple(r) for r in out], "epoch long, n long")


@query("partition_strategies", f"WITH {E} SELECT s.s AS strategy, count(*) * s.k AS n FROM e, (VALUES ('broadcast', 3::BIGINT), ('exchange', 1::BIGINT), ('gather', 1::BIGINT), ('pipeline', 1::BIGINT), ('rebalance', 1::BIGINT)) s(s, k) GROUP BY s.s, s.k")
def partition_strategies(spark, sf_dir):
    f = events(spark, sf_dir)
    f = f.over(f.df.select("epoch", "user_id"), seq=None)
    every = [f.partitioned(x, *(["user_id"] if x is exchange.PartitionStrategy.EXCHANGE else []), to=3).df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(x.value).alias("strategy"), "n") for x in exchange.PartitionStrategy]
    return flow.concat(every)


@query("inspect_observe", f"WITH {E} SELECT count(*)::BIGINT AS n, sum(cents)::BIGINT AS total, max(epoch) AS last FROM e")
def inspect_observe(spark, sf_dir):
    frame, seen = events(spark, sf_dir).inspect(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total"), F.max("epoch").alias("last"))
    frame.df.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["n"], got["total"], got["last"])], "n long, total long, last long")


@query("probe_frontier", f"WITH {E} SELECT epoch, true AS done FROM e GROUP BY 1")
def probe_frontier(spark, sf_dir):
    from ..runtime import Engine

    run = Engine(spark).spawn("probe", events(spark, sf_dir).count(), action=DataFrame.collect)
    rows = run.join()
    return spark.createDataFrame([(r["epoch"], run.probe.done_with(r["epoch"])) for r in rows], "epoch long, done boolean")


@query("map_project", f"WITH {E} SELECT epoch, seq, user_id * 2 + 1 AS u, upper(event_type) AS kind FROM e")
def map_project(spark, sf_dir):
    return events(spark, sf_dir).map(u="user_id * 2 + 1", kind="upper(event_type)").df


@query("filter_predicate", f"WITH {E} SELECT epoch, seq, value FROM e WHERE value > 100 AND event_type <> 'click'")
def filter_predicate(spark, sf_dir):
    return events(spark, sf_dir).filter("value > 100 AND event_type <> 'click'").df.select("epoch", "seq", "value")


@query("flat_map_split", r"SELECT doc_id % 10 AS epoch, doc_id AS seq, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS word FROM documents")
def flat_map_split(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 10).alias("epoch"), F.col("doc_id").alias("seq"), "text")
    return TimedFrame(d, seq="seq").flat_map(tokens("text"), "word").df


@query("flat_map_repeat", f"WITH {E} SELECT epoch, seq, v FROM (SELECT epoch, seq, unnest(CASE WHEN v < 0 THEN [] WHEN v = 0 THEN [0] ELSE list_transform(generate_series(1, v), lambda i: v) END)::BIGINT AS v FROM (SELECT epoch, seq, user_id % 7 - 3 AS v FROM e))")
def flat_map_repeat(spark, sf_dir):
    v = F.col("user_id") % 7 - 3
    copies = F.when(v < 0, F.array().cast("array<bigint>")).when(v == 0, F.array(v)).otherwise(F.array_repeat(v, v.cast("int")))
    return events(spark, sf_dir).flat_map(copies, "v").df


@query("try_flat_map_strict", f"WITH {E} SELECT epoch, seq, unnest([user_id, user_id + 1]) AS v FROM e")
def try_flat_map_strict(spark, sf_dir):
    return events(spark, sf_dir).try_flat_map("array(user_id, user_id + 1)", "user_id >= 0", "v").df


@query("map_batch_sort", f"WITH {E} SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY cents, seq) AS place, cents FROM e")
def map_batch_sort(spark, sf_dir):
    def sort(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["cents", "seq"])
        return pd.DataFrame({"epoch": p["epoch"], "place": range(1, len(p) + 1), "cents": p["cents"]})

    f = events(spark, sf_dir)
    return f.over(f.df.select("epoch", "seq", "cents")).map_batch(sort, "epoch long, place long, cents long").df


@query("try_map_batch", f"WITH {E} SELECT epoch, seq, cents // 100 AS whole FROM e WHERE cents >= 0")
def try_map_batch(spark, sf_dir):
    def whole(p: pd.DataFrame) -> pd.DataFrame:
        if (p["cents"] < 0).any():
            raise ValueError("negative amount")
        return pd.DataFrame({"epoch": p["epoch"], "seq": p["seq"], "whole": p["cents"] // 100})

    f = events(spark, sf_dir).filter("cents >= 0")
    return f.over(f.df.select("epoch", "seq", "cents")).try_map_batch(whole, "epoch long, seq long, whole long", per_epoch=False).df


@query("take_first_n", f"WITH {E} SELECT epoch, seq, user_id FROM e ORDER BY epoch, seq LIMIT 100")
def take_first_n(spark, sf_dir):
    return events(spark, sf_dir).map(user_id="user_id").take(100).df


@query("take_while_prefix", f"WITH {E} SELECT epoch, seq, value FROM e WHERE (epoch, seq) < coalesce((SELECT min((epoch, seq)) FROM e WHERE NOT (value < 400)), (1000000000, 0))")
def take_while_prefix(spark, sf_dir):
    return events(spark, sf_dir).take_while("value < 400").df.select("epoch", "seq", "value")


@query("reduce_sum_epoch", f"WITH {E} SELECT epoch, sum(cents)::BIGINT AS cents FROM e GROUP BY 1")
def reduce_sum_epoch(spark, sf_dir):
    return events(spark, sf_dir).aggregate(F.sum("cents").alias("cents")).df


@query("reduce_ordered_epoch", f"WITH {E} SELECT epoch, list_reduce(list(cents ORDER BY seq), lambda a, x: (a * 31 + x) % 1000003)::BIGINT AS cents FROM e GROUP BY 1")
def reduce_ordered_epoch(spark, sf_dir):
    return events(spark, sf_dir).reduce(lambda a, x: (a * 31 + x) % 1000003, "cents").df


@query("reduce_associative_epoch", f"WITH {E} SELECT epoch, string_agg(user_id::VARCHAR, ',' ORDER BY seq) AS users FROM e WHERE cents > 20000 GROUP BY 1")
def reduce_associative_epoch(spark, sf_dir):
    """A reduction that depends on order but not on how it is bracketed."""
    f = events(spark, sf_dir).filter("cents > 20000").map(users="cast(user_id as string)")
    return f.reduce(lambda a, x: F.concat(a, F.lit(","), x), "users", associative=True).df


@query("fold_collect_sorted", f"WITH {E} SELECT epoch, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS users FROM e GROUP BY 1")
def fold_collect_sorted(spark, sf_dir):
    return events(spark, sf_dir).aggregate(F.array_join(F.array_sort(F.collect_set(F.col("user_id").cast("string"))), ",").alias("users")).df


@query("fold_product", f"WITH {E} SELECT epoch, list_reduce(list_prepend(1::BIGINT, list(user_id + 1 ORDER BY seq)), lambda a, x: a * x % 1000003)::BIGINT AS product FROM e GROUP BY 1")
def fold_product(spark, sf_dir):
    f = events(spark, sf_dir)
    return f.over(f.df.withColumn("u", F.col("user_id") + 1)).fold(F.lit(1).cast("long"), lambda a, x: a * x % 1000003, "u", "product", merge=lambda a, b: a * b % 1000003).df


@query("distinct_per_epoch", f"WITH {E} SELECT epoch, event_type, user_id % 10 AS u, min(seq) AS seq FROM e GROUP BY ALL")
def distinct_per_epoch(spark, sf_dir):
    return events(spark, sf_dir).map(event_type="event_type", u="user_id % 10").distinct().df


@query("count_per_epoch", f"WITH {E} SELECT epoch, count(*)::BIGINT AS n FROM e GROUP BY 1")
def count_per_epoch(spark, sf_dir):
    return events(spark, sf_dir).count().df


@query("gather_reduce_global", f"WITH {E} SELECT epoch, max(cents) AS top, sum(cents)::BIGINT AS total FROM e GROUP BY 1")
def gather_reduce_global(spark, sf_dir):
    # partial sums come before the exchange, so gathering the rows themselves would only be slower
    return events(spark, sf_dir).aggregate(F.max("cents").alias("top"), F.sum("cents").alias("total")).df


@query("reduce_partial_by_worker", f"WITH {E} SELECT epoch, (user_id % 4)::INT AS worker, sum(cents)::BIGINT AS total FROM e GROUP BY 1, 2")
def reduce_partial_by_worker(spark, sf_dir):
    return aggregate.by_worker(events(spark, sf_dir).df, ["epoch"], F.col("user_id"), 4, F.sum("cents").alias("total"))


@query("delay_by_priority", f"WITH {E} SELECT epoch + CASE WHEN value > 400 THEN 0 WHEN value > 100 THEN 5 ELSE 10 END AS epoch, seq, value FROM e")
def delay_by_priority(spark, sf_dir):
    return events(spark, sf_dir).delay("epoch + CASE WHEN value > 400 THEN 0 WHEN value > 100 THEN 5 ELSE 10 END").df.select("epoch", "seq", "value")


@query("delay_batch_shift", f"WITH {E} SELECT epoch + 10 AS epoch, seq, cents FROM e")
def delay_batch_shift(spark, sf_dir):
    return events(spark, sf_dir).delay_batch("epoch + 10").df.select("epoch", "seq", "cents")


@query("delay_window_count", f"WITH {E} SELECT (epoch // 10 + 1) * 10 AS epoch, count(*)::BIGINT AS n FROM e GROUP BY 1")
def delay_window_count(spark, sf_dir):
    return events(spark, sf_dir).tumbling(10).count().df


@query("tumbling_sum_5", f"WITH {E} SELECT (epoch // 5 + 1) * 5 AS epoch, sum(cents)::BIGINT AS total FROM e GROUP BY 1")
def tumbling_sum_5(spark, sf_dir):
    return events(spark, sf_dir).tumbling(5).aggregate(F.sum("cents").alias("total")).df


@query("tumbling_avg_100", f"WITH {E} SELECT ((seq // 100) + 1) * 100 AS epoch, round(sum(cents)::BIGINT / count(*), 6) AS mean FROM e GROUP BY 1")
def tumbling_avg_100(spark, sf_dir):
    d = events(spark, sf_dir).df.select(F.col("seq").alias("epoch"), "cents")
    return TimedFrame(d).tumbling(100).aggregate(F.round(F.sum("cents") / F.count(F.lit(1)), 6).alias("mean")).df


@query("sliding_window_extra", f"WITH {E} SELECT w * 2 AS window_start, count(*)::BIGINT AS n FROM (SELECT unnest(generate_series(floor((epoch - 6) / 2.0)::BIGINT + 1, epoch // 2)) AS w FROM e) GROUP BY 1")
def sliding_window_extra(spark, sf_dir):
    return temporal.sliding(events(spark, sf_dir).df.select("epoch"), "epoch", 6, 2).groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))


@query("notify_epoch_stats", f"WITH {E} SELECT epoch, count(*)::BIGINT AS n, sum(cents)::BIGINT AS total, min(cents) AS low, max(cents) AS high, round(sum(cents)::BIGINT / count(*), 6) AS mean FROM e GROUP BY 1")
def notify_epoch_stats(spark, sf_dir):
    return events(spark, sf_dir).aggregate(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total"), F.min("cents").alias("low"), F.max("cents").alias("high"), F.round(F.sum("cents") / F.count(F.lit(1)), 6).alias("mean")).df


@query("branch_even_odd", f"WITH {E} SELECT epoch, user_id % 2 = 0 AS even, count(*)::BIGINT AS n FROM e GROUP BY 1, 2")
def branch_even_odd(spark, sf_dir):
    even, odd = events(spark, sf_dir).branch("user_id % 2 = 0")
    side = lambda f, v: f.map(even=F.lit(v)).count(by=["even"])
    return side(even, True).concat(side(odd, False)).df


@query("fork_two_aggs", f"WITH {E} SELECT epoch, 'n' AS what, count(*)::BIGINT AS v FROM e GROUP BY 1 UNION ALL SELECT epoch, 'top', max(cents) FROM e GROUP BY 1")
def fork_two_aggs(spark, sf_dir):
    a, b = events(spark, sf_dir).fork()
    return a.count(name="v").map(what=F.lit("n"), v="v").concat(b.aggregate(F.max("cents").alias("v")).map(what=F.lit("top"), v="v")).df


@query("branching_pipeline", f"WITH {E} SELECT kind, count(*)::BIGINT AS n, sum(v)::BIGINT AS total FROM (SELECT 'double' AS kind, cents * 2 AS v FROM e UNION ALL SELECT 'even', cents FROM e WHERE cents % 2 = 0 UNION ALL SELECT 'big', cents FROM e WHERE cents > 10000) GROUP BY 1")
def branching_pipeline(spark, sf_dir):
    f = events(spark, sf_dir)
    parts = [f.map(kind=F.lit("double"), v="cents * 2"), f.filter("cents % 2 = 0").map(kind=F.lit("even"), v="cents"), f.filter("cents > 10000").map(kind=F.lit("big"), v="cents")]
    return parts[0].concat(*parts[1:]).df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


_R = "CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id - 20 END"


def _results(spark, sf_dir) -> TimedFrame:
    f = events(spark, sf_dir)
    bad = F.col("user_id") % 5 == 0
    return f.map(r=result.result(F.col("user_id") - 20, ~bad, F.concat(F.lit("bad "), F.col("user_id").cast("string"))))


@query("result_map_ok", f"WITH {E} SELECT epoch, seq, trunc(({_R}) * 9 / 5)::BIGINT + 32 AS ok, CASE WHEN user_id % 5 = 0 THEN 'bad ' || user_id END AS err FROM e")
def result_map_ok(spark, sf_dir):
    from ..functions import div

    return _results(spark, sf_dir).map_ok(lambda v: div(v * 9, 5) + 32).df.select("epoch", "seq", "r.ok", "r.err")


@query("result_filter_ok", f"WITH {E} SELECT epoch, seq, {_R} AS ok, CASE WHEN user_id % 5 = 0 THEN 'bad ' || user_id END AS err FROM e WHERE user_id % 5 = 0 OR user_id - 20 BETWEEN 0 AND 50")
def result_filter_ok(spark, sf_dir):
    return _results(spark, sf_dir).filter_ok(lambda v: v.between(0, 50)).df.select("epoch", "seq", "r.ok", "r.err")


@query("result_and_then", f"WITH {E} SELECT epoch, seq, CASE WHEN user_id % 5 <> 0 AND user_id >= 20 THEN (user_id - 20) * 2 END AS ok, CASE WHEN user_id % 5 = 0 THEN 'bad ' || user_id WHEN user_id < 20 THEN 'negative' END AS err FROM e")
def result_and_then(spark, sf_dir):
    return _results(spark, sf_dir).and_then(lambda v: result.result(v * 2, v >= 0, F.lit("negative"))).df.select("epoch", "seq", "r.ok", "r.err")


@query("result_branch", f"WITH {E} SELECT epoch, count(*) FILTER (user_id % 5 <> 0)::BIGINT AS good, count(*) FILTER (user_id % 5 = 0)::BIGINT AS bad FROM e GROUP BY 1")
def result_branch(spark, sf_dir):
    ok, err = _results(spark, sf_dir).branch_result()
    both = ok.map(good=F.lit(1), bad=F.lit(0)).concat(err.map(good=F.lit(0), bad=F.lit(1)))
    return both.aggregate(F.sum("good").alias("good"), F.sum("bad").alias("bad")).df


@query("merge_union_all", f"WITH {E} SELECT epoch, user_id FROM e WHERE value > 300 UNION ALL SELECT epoch, user_id FROM e WHERE value < 50")
def merge_union_all(spark, sf_dir):
    f = events(spark, sf_dir)
    return f.filter("value > 300").merge(f.filter("value < 50")).df.select("epoch", "user_id")


@query("concat_three", f"WITH {E} SELECT epoch, user_id * 10 AS v FROM e WHERE user_id < 50 UNION ALL SELECT epoch, user_id * 100 FROM e WHERE user_id >= 50 AND user_id < 100 UNION ALL SELECT epoch, user_id * 1000 FROM e WHERE user_id >= 100")
def concat_three(spark, sf_dir):
    f = events(spark, sf_dir)
    a, b, c = f.filter("user_id < 50").map(v="user_id * 10"), f.filter("user_id >= 50 AND user_id < 100").map(v="user_id * 100"), f.filter("user_id >= 100").map(v="user_id * 1000")
    return a.concat(b, c).df.select("epoch", "v")


@query("zip_streams", f"WITH {E}, a AS (SELECT epoch, user_id, row_number() OVER (PARTITION BY epoch ORDER BY seq) AS i FROM e WHERE event_type = 'click'), b AS (SELECT epoch, cents, row_number() OVER (PARTITION BY epoch ORDER BY seq) AS i FROM e WHERE event_type = 'purchase') SELECT epoch, i::BIGINT AS i, user_id, cents FROM a JOIN b USING (epoch, i)")
def zip_streams(spark, sf_dir):
    f = events(spark, sf_dir)
    return f.filter("event_type = 'click'").map(user_id="user_id").zip(f.filter("event_type = 'purchase'").map(cents="cents")).df


@query("exchange_by_key", f"WITH {E} SELECT user_id, count(*)::BIGINT AS n, 1::BIGINT AS partitions FROM e GROUP BY 1")
def exchange_by_key(spark, sf_dir):
    d = events(spark, sf_dir).exchange("user_id", to=8).df.withColumn("p", F.spark_partition_id())
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("partitions"))


@query("exchange_mod_routing", f"WITH {E} SELECT (user_id % 4)::INT AS worker, count(*)::BIGINT AS n FROM e GROUP BY 1")
def exchange_mod_routing(spark, sf_dir):
    d = events(spark, sf_dir).exchange_by_hash("user_id", to=4).df
    return d.withColumn("worker", F.spark_partition_id()).groupBy("worker").agg(F.count(F.lit(1)).alias("n"))


@query("stage_parallelism", f"WITH {E} SELECT 4::BIGINT AS first, 2::BIGINT AS second, count(*)::BIGINT AS n FROM e")
def stage_parallelism(spark, sf_dir):
    a = events(spark, sf_dir).exchange_by_hash("user_id", to=4).df.withColumn("p", F.spark_partition_id())
    b = a.repartitionById(2, (F.col("p") % 2).cast("int")).withColumn("q", F.spark_partition_id())
    return b.agg(F.count_distinct("p").alias("first"), F.count_distinct("q").alias("second"), F.count(F.lit(1)).alias("n"))


@query("gather_single", f"WITH {E} SELECT 1::BIGINT AS partitions, count(*)::BIGINT AS n FROM e WHERE value > 20")
def gather_single(spark, sf_dir):
    d = events(spark, sf_dir).filter("value > 20").gather().df.withColumn("p", F.spark_partition_id())
    return d.agg(F.count_distinct("p").alias("partitions"), F.count(F.lit(1)).alias("n"))


@query("rebalance_preserves", f"WITH {E} SELECT epoch, count(*)::BIGINT AS n, sum(cents)::BIGINT AS total FROM e GROUP BY 1")
def rebalance_preserves(spark, sf_dir):
    return events(spark, sf_dir).rebalance(4).aggregate(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total")).df


@query("broadcast_multiplies", f"WITH {E} SELECT worker::INT AS worker, count(*)::BIGINT AS n FROM e, generate_series(0, 2) t(worker) GROUP BY 1")
def broadcast_multiplies(spark, sf_dir):
    return events(spark, sf_dir).broadcast_copy(3).df.groupBy("worker").agg(F.count(F.lit(1)).alias("n"))


@query("broadcast_lookup_join", "SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def broadcast_lookup_join(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("k"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), "n_name")
    return exchange.lookup(c, n, ["k"]).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("unary_running_sum", f"WITH {E} SELECT user_id, seq, sum(cents) OVER (PARTITION BY user_id ORDER BY epoch, seq)::BIGINT AS running FROM e")
def unary_running_sum(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("epoch", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf_dir).df.select("user_id", "seq", F.sum("cents").over(w).alias("running"))


@query("running_sum_global", f"WITH {E} SELECT seq, sum(cents) OVER (ORDER BY epoch, seq)::BIGINT AS running FROM e")
def running_sum_global(spark, sf_dir):
    """A prefix sum over all rows without one task for all: sums of epochs first, then within each epoch."""
    from pyspark.sql import Window

    d = events(spark, sf_dir).df
    per = d.groupBy("epoch").agg(F.sum("cents").alias("s"))  # a row per epoch
    before = per.select("epoch", F.coalesce(F.sum("s").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("cents").over(Window.partitionBy("epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return exchange.lookup(d.select("epoch", "seq", own.alias("own")), before, ["epoch"]).select("seq", (F.col("own") + F.col("before")).alias("running"))


@query("unary_stateless_batches", f"WITH {E} SELECT seq, cents * 3 AS v FROM e WHERE cents % 2 = 0")
def unary_stateless_batches(spark, sf_dir):
    def run(parts):
        for p in parts:
            p = p[p["cents"] % 2 == 0]
            yield pd.DataFrame({"seq": p["seq"], "v": p["cents"] * 3})

    f = events(spark, sf_dir)
    return f.over(f.df.select("seq", "cents")).unary(run, "seq long, v long").df


@query("async_enrich", f"WITH {E} SELECT seq, event_type || '/' || user_id AS tag FROM e")
def async_enrich(spark, sf_dir):
    def enrich(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"seq": p["seq"], "tag": p["event_type"] + "/" + p["user_id"].astype(str)})

    f = events(spark, sf_dir)
    return f.over(f.df.select("seq", "event_type", "user_id")).unary_async(enrich, "seq long, tag string", 4).df


@query("cogroup_custom", f"WITH {E} SELECT user_id, count(*) FILTER (event_type = 'click')::BIGINT AS clicks, count(*) FILTER (event_type = 'purchase')::BIGINT AS purchases FROM e WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def cogroup_custom(spark, sf_dir):
    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [(a if len(a) else b)["user_id"].iloc[0]], "clicks": [len(a)], "purchases": [len(b)]})

    f = events(spark, sf_dir)
    side = lambda t: f.over(f.df.where(F.col("event_type") == t).select("user_id"), seq=None)
    return side("click").binary(side("purchase"), ["user_id"], both, "user_id long, clicks long, purchases long").df


@query("context_threshold", f"WITH {E} SELECT epoch, count(*)::BIGINT AS n FROM e WHERE cents > 25000 GROUP BY 1")
def context_threshold(spark, sf_dir):
    from dataclasses import dataclass

    from ..runtime import Flow

    @dataclass
    class Limits:
        cents: int

    flow = Flow(spark).with_context(Limits(25_000))  # shared settings become literals of the plan
    return flow.input("events", events(spark, sf_dir)).filter(F.col("cents") > flow.get_context(Limits).cents).count().df


@query("chunk_500", f"WITH {E} SELECT epoch, (i // 500)::BIGINT AS chunk, count(*)::BIGINT AS n FROM (SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY seq) - 1 AS i FROM e) GROUP BY 1, 2")
def chunk_500(spark, sf_dir):
    d = flow.numbered(events(spark, sf_dir).df.select("epoch", "seq"), ["epoch", "seq"], ["epoch"])
    return d.groupBy("epoch", F.floor((F.col("i") - 1) / 500).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query("numbered_global", f"WITH {E} SELECT seq, row_number() OVER (ORDER BY seq) AS i FROM e")
def numbered_global(spark, sf_dir):
    return flow.numbered(events(spark, sf_dir).df.select("seq"), ["seq"])


@query("distinct_global_first", f"WITH {E} SELECT user_id, min(epoch) AS epoch, arg_min(seq, (epoch, seq)) AS seq FROM e GROUP BY 1")
def distinct_global_first(spark, sf_dir):
    return events(spark, sf_dir).map(user_id="user_id").distinct_ever("user_id").df


def _shared(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _streamed(spark, agg, mode: str):
    """The last snapshot of an aggregation over a stream of what is there."""
    at = _shared(spark, "stream")
    q = agg.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")


def _stream_of(spark, sf_dir, name: str):
    """A table as a stream, whether it is one file or a folder of them.  A file's path is given as a pattern, as a stream's
    plain path must be a folder."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if folder else f"{sf_dir}/{name}.parque[t]")


@query("stream_epoch_stats", f"WITH {E} SELECT epoch, count(*)::BIGINT AS n, sum(cents)::BIGINT AS total FROM e GROUP BY 1")
def stream_epoch_stats(spark, sf_dir):
    """The aggregation as a stream that takes what is there, without a watermark, in complete mode."""
    d = _stream_of(spark, sf_dir, "events").select(day_epoch("ts").alias("epoch"), cents("value").alias("cents"))
    return _streamed(spark, d.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total")), "complete")


@query("wordcount_snapshot", r"WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS word FROM documents) SELECT word, count(*)::BIGINT AS n FROM w GROUP BY 1")
def wordcount_snapshot(spark, sf_dir):
    """Snapshots of the counts over all epochs, from a stream in complete mode; the last one is the result."""
    d = _stream_of(spark, sf_dir, "documents").select(F.explode(tokens("text")).alias("word"))
    return _streamed(spark, d.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "complete")


@query("advance_to_epochs", f"WITH {E}, m AS (SELECT max(epoch) // 2 AS half FROM e) SELECT epoch, count(*)::BIGINT AS n, sum(cents)::BIGINT AS total FROM e, m WHERE epoch < half GROUP BY 1")
def advance_to_epochs(spark, sf_dir):
    """Rows are sent to a stream, which is then advanced to half of the epochs and not closed: the epochs before are
    sealed and come out, that one, which has rows, does not."""
    d = events(spark, sf_dir).df.select("epoch", "seq", "cents")
    half = (d.agg(F.max("epoch").alias("last")).first()["last"] or 0) // 2
    at = _shared(spark, "sent")
    sender = FrameFolder(spark, f"{at}/in", "cents long")
    sender.send(d.where(F.col("epoch") <= half))
    sender.advance_to(half)
    frame = stream_from_dir(spark, f"{at}/in", "cents long", files_per_trigger=1_000)
    agg = epoch_aggregate(frame, F.count_if(~F.col("marker")).alias("n"), F.sum("cents").alias("total"))
    q = agg.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{at}/state").format("parquet").option("path", f"{at}/out").start()
    q.awaitTermination()
    return spark.read.schema(agg.schema).parquet(f"{at}/out")
