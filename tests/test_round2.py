"""Receivers, requests, taps, contexts, schedulers, several watermarks."""

import asyncio
import time

import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.test_streaming import X, run, sent
from tidemark.errors import ConfigError, DuplicateName, OperatorError
from tidemark.operators.exchange import PartitionStrategy
from tidemark.runtime import Engine, Flow, OutputReceiver, Reason, Scheduler, SpawnOptions
from tidemark.sources import AsyncSender, EpochFolder, from_epochs, stream_from_dir
from tidemark.streaming import NotifyAt, merged, sealed, sums_of


def test_receiver(spark):
    f = from_epochs(spark, [(e, [e, e + 1]) for e in range(20)])
    out = OutputReceiver(f.with_capacity(3))
    first = out.recv()
    assert first is not None and len(out.collect_data()) == 39 and out.recv() is None and out.try_recv() is None and out.is_done()
    slow = OutputReceiver(spark.range(1).repartition(1).mapInPandas(lambda it: (time.sleep(5), (yield from it))[1:], "id long"))
    with pytest.raises(TimeoutError):
        slow.recv_timeout(0.2)
    assert slow.try_recv() is None
    slow.close()
    assert asyncio.run(OutputReceiver(from_epochs(spark, [(0, [7])])).recv_async())["x"] == 7
    bad = OutputReceiver(from_epochs(spark, [(5, [1])]).delay("epoch - 1"))
    with pytest.raises(OperatorError):
        bad.recv()


def test_capacity_bounds_the_next_operators_batches(spark):
    f = from_epochs(spark, [(0, list(range(50)))])
    f = f.over(f.df.coalesce(1))
    sizes = lambda parts: (pd.DataFrame({"n": [len(p)]}) for p in parts)
    got = [r["n"] for r in f.with_capacity(8).unary(sizes, "n long").collect()]
    assert sum(got) == 50 and max(got) == 8 and max(r["n"] for r in f.unary(sizes, "n long").collect()) > 8
    assert max(r["n"] for r in f.with_capacity(8).map_batch(lambda p: pd.DataFrame({"n": [len(p)]}), "n long", per_epoch=False).collect()) == 8
    with pytest.raises(ConfigError):
        f.with_capacity(0)


def test_notify_at(spark):
    f = from_epochs(spark, [(0, [1, 2]), (3, [4])])
    got = f.notify_at(lambda e, rows: pd.DataFrame({"epoch": [e], "s": [int(rows["x"].sum())]}), "epoch long, s long", [1, 3, 9])
    assert sorted(map(tuple, got.collect())) == [(0, 3), (1, 0), (3, 4), (9, 0)]


def test_stream_notify_at_without_rows(spark, tmp_path):
    sent(tmp_path / "a", [(0, [1, 2]), (2, [5])])
    d = sealed(stream_from_dir(spark, str(tmp_path / "a"), "x long")).withColumn("k", F.lit("k"))
    f = NotifyAt(lambda k, e, vs: pd.DataFrame({"k": [k], "epoch": [e], "n": [len(vs)]}), "x", [1, 2, 4])
    q = run(d.groupBy("k").transformWithStateInPandas(f, "k string, epoch long, n long", "Append", "eventTime"), "append", "asked")
    q.stop()
    assert sorted(map(tuple, spark.table("asked").collect())) == [("k", 0, 2), ("k", 1, 0), ("k", 2, 1), ("k", 4, 0)]


def test_least_watermark_of_several_inputs(spark, tmp_path):
    a, b = sent(tmp_path / "a", [(0, [1]), (1, [2]), (9, [3])], close=False), EpochFolder(str(tmp_path / "b"), X)
    b.send(0, [10])
    d = merged(*[stream_from_dir(spark, str(tmp_path / x), "x long", 100) for x in "ab"])
    q = run(sums_of(d, "epoch", F.sum("x").alias("s")), "append", "both")
    try:
        assert spark.table("both").count() == 0  # the second input may still send to epoch 0
        b.advance_to(2)
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("both").collect())) == [(0, 11), (1, 2)]
        a.close()
        b.close()
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("both").collect())) == [(0, 11), (1, 2), (9, 3)]
    finally:
        q.stop()


def test_async_sender(spark, tmp_path):
    async def go():
        s = AsyncSender(EpochFolder(str(tmp_path / "a"), X))
        await asyncio.gather(s.send(0, [1, 2]), s.send(0, [3]))
        await s.advance_to(1)
        await s.close()

    asyncio.run(go())
    q = run(sums_of(sealed(stream_from_dir(spark, str(tmp_path / "a"), "x long")), "epoch", F.sum("x").alias("s")), "append", "sent_async")
    q.stop()
    assert [tuple(r) for r in spark.table("sent_async").collect()] == [(0, 6)]


@pytest.mark.parametrize("wait", [None, 60.0])
def test_cancelled_streams_drain_if_asked(spark, tmp_path, wait):
    folder = sent(tmp_path / "a", [(e, [1]) for e in range(12)], close=False)
    frame = stream_from_dir(spark, str(tmp_path / "a"), "x long", 1)
    w = frame.df.where("not marker").writeStream.outputMode("append").format("memory")
    run_ = Engine(spark).spawn_stream(f"drained{int(bool(wait))}", w, SpawnOptions(drain_on_cancel=wait))
    run_.cancel(Reason.USER)
    assert run_.join(30) and run_.probe.is_done() and run_.drained is (True if wait else None)
    n = spark.table(f"drained{int(bool(wait))}").count()
    assert n == 12 if wait else n <= 12
    folder.close()


def test_drain(spark, tmp_path):
    sent(tmp_path / "a", [(0, [1]), (1, [2])])
    q = stream_from_dir(spark, str(tmp_path / "a"), "x long").df.writeStream.format("memory").queryName("to_drain").start()
    assert Engine.drain(q, 60) and spark.table("to_drain").count() == 3 and not q.isActive


def test_flow_context_and_names(spark):
    flow = Flow(spark).with_context(5).with_context("five")
    assert flow.get_context(int) == 5 and flow.get_context(str) == "five"
    with pytest.raises(ConfigError):
        flow.get_context(dict)
    f = flow.input("in", from_epochs(spark, [(0, [1, 9])]))
    with pytest.raises(DuplicateName):
        flow.input("in", f)
    flow.output("out", f.filter(F.col("x") > flow.get_context(int)))
    runs = flow.run(Engine(spark), action=DataFrame.collect)
    assert [r["x"] for r in runs["out"].join(60)] == [9] and [r["x"] for r in flow.take_output("out")] == [9]


def test_errors_name_operator_and_partition(spark):
    def bad(parts):
        for _ in parts:
            raise ValueError("broken")
            yield

    f = from_epochs(spark, [(0, [1, 2])])
    with pytest.raises(OperatorError) as err:
        Engine(spark).spawn("flow", f.unary(bad, "x long", name="parser")).join(60)
    assert err.value.operator == "parser" and err.value.partition >= 0 and "broken" in str(err.value)


def test_metrics_by_operator(spark):
    e = Engine(spark)
    f = e.metrics.watch(from_epochs(spark, [(0, [1, 2, 3])]), "source")
    f = e.metrics.watch(f.filter("x > 1"), "filter")
    assert e.metrics.rows() == {}
    e.spawn("m", f).join(60)
    assert e.metrics.rows() == {"source": 3, "filter": 2} and "filter" in e.metrics.chrome_trace()


def test_scheduler_ages(spark):
    now = [0.0]
    s = Scheduler(Engine(spark), slots=1, ageing=0.1, clock=lambda: now[0])
    s.submit("old", lambda: 1, SpawnOptions(weight=0))
    now[0] = 100.0
    s.submit("heavy", lambda: 2, SpawnOptions(weight=5))
    s.submit("light", lambda: 3, SpawnOptions(weight=1))
    assert sorted(r.join() for r in s.run()) == [1, 2, 3] and s.started == ["old", "heavy", "light"]
    plain = Scheduler(Engine(spark), slots=1, ageing=0)
    for name, weight in (("a", 0), ("b", 2), ("c", 2)):
        plain.submit(name, lambda: 0, SpawnOptions(weight=weight))
    plain.run()
    assert plain.started == ["b", "c", "a"]


def test_a_flow_on_n_workers(spark, tmp_path):
    def build(session):
        return session.range(100).repartition(F.col("id")).select(F.spark_partition_id().alias("p"))

    parts = Engine(spark).spawn_workers("w", 3, build, action=lambda df: df.distinct().count()).join(60)
    assert parts == 3
    with pytest.raises(ConfigError):
        Engine(spark).spawn_workers("w", 0, build)


def test_strategies_and_ends(spark):
    f = from_epochs(spark, [(0, [1, 2, 3])])
    assert f.partitioned(PartitionStrategy.BROADCAST, to=4).df.count() == 12
    with pytest.raises(ConfigError):
        f.partitioned(PartitionStrategy.EXCHANGE)
    total = spark.sparkContext.accumulator(0)
    f.for_each(lambda r: total.add(r["x"]))
    assert total.value == 6
    seen = spark.sparkContext.accumulator(0)
    assert f.inspect_rows(lambda r: seen.add(r["x"])).inspect_batch(lambda p: seen.add(len(p))).count().collect()[0]["n"] == 3
    assert seen.value == 9


def test_associative_reduce_and_fold_keep_the_order(spark):
    f = from_epochs(spark, [(e, [f"{e}{chr(97 + k)}" for k in range(40)]) for e in range(3)], "x string")
    whole = {r["epoch"]: r["x"] for r in f.reduce(lambda a, x: F.concat(a, x), "x").collect()}
    assert {r["epoch"]: r["x"] for r in f.reduce(lambda a, x: F.concat(a, x), "x", associative=True).collect()} == whole
    init, step = F.array().cast("array<string>"), lambda a, x: F.concat(a, F.array(x))
    got = f.fold(init, step, "x", "all", merge=lambda a, b: F.concat(a, b)).collect()
    assert {r["epoch"]: "".join(r["all"]) for r in got} == whole


def test_places_within_epochs(spark):
    from tidemark.operators.flow import numbered

    f = from_epochs(spark, [(k % 2, [k]) for k in range(500)])
    got = sorted((r["epoch"], r["seq"], r["i"]) for r in numbered(f.df, ["epoch", "seq"], ["epoch"]).collect())
    assert got == [(e, 2 * i + e, i + 1) for e in (0, 1) for i in range(250)]
    assert numbered(f.df.limit(0), ["seq"]).count() == 0
