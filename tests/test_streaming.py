"""Streams over epoch folders."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.progress import Probe
from tidemark.sources import EpochFolder, PollingSource, stream_from_dir
from tidemark.streaming import NotifyEpochs, RunningSum, deduplicated, epoch_aggregate, revised, sealed

X = pa.schema([("x", pa.int64())])


def run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    return q


def sent(path, batches, close=True):
    f = EpochFolder(str(path), X)
    for e, rows in batches:
        f.send(e, rows)
    if close:
        f.close()
    return f


def test_sum_with_and_without_close(spark, tmp_path):
    batches = [(0, [1, 2]), (1, [3]), (1, [10]), (2, [5])]
    f = sent(tmp_path / "a", batches, close=False)
    q = run(epoch_aggregate(stream_from_dir(spark, str(tmp_path / "a"), "x long"), F.sum("x").alias("s")), "append", "sums")
    try:
        assert sorted(map(tuple, spark.table("sums").collect())) == [(0, 3), (1, 13)]
        probe = Probe(q)
        assert probe.done_with(0) and not probe.done_with(2)
        f.close()
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("sums").collect())) == [(0, 3), (1, 13), (2, 5)]
    finally:
        q.stop()


def test_advance_seals(spark, tmp_path):
    f = sent(tmp_path / "a", [(0, [1, 2]), (0, [3, 4, 5])], close=False)
    q = run(epoch_aggregate(stream_from_dir(spark, str(tmp_path / "a"), "x long"), F.sum("x").alias("s")), "append", "advanced")
    try:
        assert spark.table("advanced").count() == 0
        f.advance_to(2)
        q.processAllAvailable()
        assert [tuple(r) for r in spark.table("advanced").collect()] == [(0, 15)]
        f.advance_to(1)  # ignored
    finally:
        q.stop()


def test_late_rows_revise(spark, tmp_path):
    sent(tmp_path / "a", [(0, [1]), (5, [3]), (0, [100])])
    q = run(revised(stream_from_dir(spark, str(tmp_path / "a"), "x long"), F.sum("x").alias("s")), "update", "late")
    q.stop()
    assert [tuple(r) for r in spark.table("late").collect()] == [(0, 1), (5, 3), (0, 101)]


def test_distinct(spark, tmp_path):
    sent(tmp_path / "a", [(0, [1, 1, 2]), (0, [2, 3]), (1, [1])])
    q = run(deduplicated(stream_from_dir(spark, str(tmp_path / "a"), "x long")), "append", "once")
    q.stop()
    assert sorted(map(tuple, spark.table("once").collect())) == [(0, 1), (0, 2), (0, 3), (1, 1)]


def test_notify(spark, tmp_path):
    sent(tmp_path / "a", [(0, [1, 2]), (1, [3]), (1, [10]), (2, [5])])
    d = sealed(stream_from_dir(spark, str(tmp_path / "a"), "x long"))
    f = NotifyEpochs(lambda e, vs: pd.DataFrame({"epoch": [e], "s": [sum(vs)]}), "x")
    q = run(d.groupBy("epoch").transformWithStateInPandas(f, "epoch long, s long", "Append", "eventTime"), "append", "notified")
    q.stop()
    assert sorted(map(tuple, spark.table("notified").collect())) == [(0, 3), (1, 13), (2, 5)]


def test_running_sum(spark, tmp_path):
    sent(tmp_path / "a", [(0, [1, 2]), (1, [3])])
    d = stream_from_dir(spark, str(tmp_path / "a"), "x long").df.where("not marker").withColumn("k", F.lit(7).cast("long"))
    q = run(d.groupBy("k").transformWithStateInPandas(RunningSum("x", "k"), "k long, running long", "Update", "None"), "update", "running")
    q.stop()
    assert sorted(map(tuple, spark.table("running").collect())) == [(7, 1), (7, 3), (7, 6)]


def test_polling_source(spark):
    def poll(at):
        rows = [(i, i * i) for i in range(at, min(at + 3, 7))]
        return rows, at + len(rows)

    spark.dataSource.register(PollingSource("squares", "i long, v long", poll))
    q = run(spark.readStream.format("squares").load(), "append", "polled")
    q.stop()
    assert sorted(r["v"] for r in spark.table("polled").collect())[:3] == [0, 1, 4]


def test_closed_input(tmp_path):
    f = sent(tmp_path / "a", [(0, [1])])
    with pytest.raises(ConfigError):
        f.send(1, [2])
