"""Spawning, cancelling, progress."""

import json
import time

import pytest
from pyspark.sql import DataFrame

from tidemark.errors import Cancelled, DuplicateName, OperatorError
from tidemark.progress import Antichain, MutableAntichain, Summary, less_equal
from tidemark.runtime import CancellationToken, Engine, Flow, SpawnOptions, to_dot
from tidemark.sources import from_epochs


def test_spawn_join_metrics(spark):
    e = Engine(spark)
    run = e.spawn("count", from_epochs(spark, [(0, [1, 2])]).count(), SpawnOptions(priority="high"), DataFrame.collect)
    assert [tuple(r) for r in run.join(60)] == [(0, 2)]
    assert run.probe.is_done() and run.probe.done_with(10) and run.probe.frontier() is None
    assert e.metrics.seconds()["count"] > 0 and json.loads(e.metrics.chrome_trace())["traceEvents"]


def test_errors_carry_the_operator(spark):
    e = Engine(spark)
    bad = from_epochs(spark, [(5, [1])]).delay("epoch - 1")
    with pytest.raises(OperatorError) as err:
        e.spawn("delays", bad).join(60)
    assert err.value.operator == "delays"
    assert e.spawn("delays", bad, SpawnOptions(error_policy="ignore")).join(60) is None


def test_cancel(spark):
    e = Engine(spark)
    run = e.spawn("slow", spark.range(8).repartition(4).mapInPandas(lambda it: (time.sleep(30), (yield from it))[1:], "id long"))
    time.sleep(1)
    run.cancel()
    with pytest.raises(Cancelled):
        run.join(30)


def test_tokens():
    parent = CancellationToken()
    child, seen = parent.child(), []
    child.on_cancel(lambda: seen.append(1))
    parent.cancel("shutdown")
    assert child.is_cancelled() and child.reason == "shutdown" and seen == [1] and parent.child().is_cancelled()


def test_antichains():
    a = Antichain([(2, 3), (3, 2), (3, 3)])
    assert len(a) == 2 and a.less_equal((3, 3)) and not a.less_equal((1, 5)) and a.less_than((4, 4))
    assert less_equal(((1, 2), 3), ((1, 4), 3)) and not less_equal((1, 5), (2, 4))
    m = MutableAntichain()
    assert m.update(1, 1) and not m.update(2, 1) and m.update(1, -1) and m.frontier() == Antichain([2])
    assert Summary(2).followed_by(Summary(3)).results_in(1) == 6 and Summary(1, 5).results_in(5) is None


def test_outputs_and_dot(spark):
    o, f = Flow(spark), from_epochs(spark, [(0, [1])])
    o.output("a", f)
    with pytest.raises(DuplicateName):
        o.output("a", f)
    assert to_dot(f.count().df).startswith("digraph")
