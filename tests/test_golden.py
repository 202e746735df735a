"""Small inputs with known outputs."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, DuplicateName, NotConverged
from tidemark.functions import collatz, div
from tidemark.operators import flow, graph, iterate, result
from tidemark.operators.iterate import Step
from tidemark.sources import from_epochs, named_inputs
from tidemark.timed import TimedFrame


def rows(frame, *cols):
    df = frame.df if isinstance(frame, TimedFrame) else frame
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def values(frame, c="x"):
    return sorted((r[0] for r in (frame.df if isinstance(frame, TimedFrame) else frame).select(c).collect()), key=lambda v: (v is None, v))


@pytest.fixture
def ints(spark):
    return lambda *batches: from_epochs(spark, list(batches))


def test_flat_map_variable(ints):
    f = ints((0, [-5, -1, 0, 1, 2, 3]))
    x = F.col("x")
    a = F.when(x < 0, F.array().cast("array<bigint>")).when(x == 0, F.array(x)).otherwise(F.array_repeat(x, x.cast("int")))
    assert values(f.flat_map(a, "x")) == [0, 1, 2, 2, 3, 3, 3]


def test_deep_pipeline(ints):
    f = ints((0, [0]))
    for _ in range(50):
        f = f.map(x="x + 1")
    assert rows(f, "epoch", "x") == [(0, 50)]


def test_filter_all_and_sparse_epochs(ints):
    assert rows(ints((0, [1, 2]), (1, [6])).filter("false").count()) == []
    assert rows(ints(*((t, [t]) for t in range(0, 20, 2))).count()) == [(t, 1) for t in range(0, 20, 2)]


def test_null_predicate_drops_and_branches_away(spark):
    f = from_epochs(spark, [(0, [1, None, 3])])
    assert values(f.filter("x > 0")) == [1, 3]
    yes, no = f.branch("x > 1")
    assert values(yes) == [3] and values(no) == [1, None]


def test_branch_concat(ints):
    yes, no = ints((0, range(1, 11))).branch("x % 2 = 0")
    assert values(yes) == [2, 4, 6, 8, 10] and values(no) == [1, 3, 5, 7, 9]
    assert rows(yes.reduce(lambda a, b: a + b, "x")) == [(0, 30)]
    a, b, c = ints((0, [1, 2])).map(x="x * 10"), ints((0, [3])).map(x="x * 100"), ints((0, [4])).map(x="x * 1000")
    assert values(a.concat(b, c)) == [10, 20, 300, 4000]
    with pytest.raises(ConfigError):
        flow.concat([])


def test_per_epoch(ints):
    f = ints((0, [1, 1, 2, 2, 3]), (1, [1, 1, 1]), (2, [5, 5, 6]))
    assert values(f.distinct()) == [1, 1, 2, 3, 5, 6]
    assert rows(f.count()) == [(0, 5), (1, 3), (2, 3)]
    assert rows(f.distinct_ever("x"), "epoch", "x") == [(0, 1), (0, 2), (0, 3), (2, 5), (2, 6)]
    assert rows(ints((0, [2, 3, 5])).fold(F.lit(1).cast("long"), lambda a, x: a * x, "x", "p")) == [(0, 30)]
    assert rows(ints((0, [3, 1, 2])).reduce(lambda a, x: a * 10 + x, "x")) == [(0, 312)]


def test_epoch_stats(ints):
    f = ints((0, [10, 20, 30]), (0, [40, 50]), (1, [5, 15]), (1, [25]), (1, [35, 45]), (2, [100, 200, 300, 400]))
    x = F.col("x")
    got = rows(f.aggregate(F.count(x), F.sum(x), F.min(x), F.max(x), F.avg(x)))
    assert got == [(0, 5, 150, 10, 50, 30.0), (1, 5, 125, 5, 45, 25.0), (2, 4, 1000, 100, 400, 250.0)]


def test_order_is_required(spark):
    f = from_epochs(spark, [(0, [1])], seq=False)
    for op in (lambda: f.take(1), lambda: f.take_while("true"), lambda: f.reduce(lambda a, b: a + b, "x")):
        with pytest.raises(ConfigError):
            op()


def test_take(ints):
    f = ints((0, [5, 6]), (1, [1, 9]), (2, [2]))
    assert values(f.take(3)) == [1, 5, 6]
    assert values(f.take_while("x <> 9")) == [1, 5, 6]
    assert values(f.take_while("x < 100")) == [1, 2, 5, 6, 9]
    assert values(f.take_while("x > 5")) == []
    assert values(f.take(0)) == []


def test_delay(ints):
    assert rows(ints((0, [1, 2]), (5, [3, 4])).delay("epoch + 10"), "epoch", "x") == [(10, 1), (10, 2), (15, 3), (15, 4)]
    w = ints((0, [1]), (3, [2]), (7, [3]), (12, [4]), (15, [5]), (25, [6])).tumbling(10)
    assert rows(w.count()) == [(10, 3), (20, 2), (30, 1)]
    assert rows(ints(*((t, [t + 1]) for t in range(20))).tumbling(5).reduce(lambda a, b: a + b, "x")) == [(5, 15), (10, 40), (15, 65), (20, 90)]
    assert rows(ints((0, [50, 200, 75, 300])).delay("CASE WHEN x > 100 THEN epoch + 10 ELSE epoch END"), "epoch", "x") == [(0, 50), (0, 75), (10, 200), (10, 300)]
    with pytest.raises(Exception, match="delay"):
        ints((5, [1])).delay("epoch - 1").collect()


def test_results(spark):
    batch = [(22, None), (45, None), (None, "sensor offline"), (38, None), (-5, None), (None, "timeout"), (25, None)]
    f = from_epochs(spark, [(0, batch)], "ok int, err string").map(r="struct(ok, err)")
    ok, err = f.map_ok(lambda c: div(c * 9, 5) + 32).filter_ok(lambda v: v.between(32, 100)).branch_result()
    assert values(ok, "ok") == [71, 77, 100] and values(err, "err") == ["sensor offline", "timeout"]
    then = f.and_then(lambda v: result.result(v * 2, v >= 0, F.lit("cold")))
    good, bad = then.branch_result()
    assert values(good, "ok") == [44, 50, 76, 90] and values(bad, "err") == ["cold", "sensor offline", "timeout"]


def test_joins(spark):
    l = from_epochs(spark, [(0, [(1, "alice"), (2, "bob"), (3, "carol")])], "k long, name string", seq=False)
    r = from_epochs(spark, [(0, [(1, 100), (2, 200), (4, 400)])], "k long, v long", seq=False)
    assert rows(l.join_epoch(r, ["k"]), "k", "name", "v") == [(1, "alice", 100), (2, "bob", 200)]
    u = from_epochs(spark, [(0, [(1, "Alice"), (2, "Bob")]), (1, [(3, "Carol")])], "k long, name string", seq=False)
    o = from_epochs(spark, [(0, [(1, "Widget"), (2, "Gadget")]), (1, [(1, "Sprocket"), (3, "Thingamajig")])], "k long, item string", seq=False)
    assert rows(u.join(o, ["k"]), "epoch", "name", "item") == [(0, "Alice", "Widget"), (0, "Bob", "Gadget"), (1, "Alice", "Sprocket"), (1, "Carol", "Thingamajig")]


def test_zip(spark):
    a, b = from_epochs(spark, [(0, ["Alice", "Bob"])], "n string"), from_epochs(spark, [(0, [95, 87, 1])], "s long")
    assert rows(a.zip(b), "n", "s") == [("Alice", 95), ("Bob", 87)]


def test_distribution(spark, ints):
    f = ints(*((e, range(100)) for e in range(5)))
    routed = f.exchange_by_hash("x", to=4).df.withColumn("p", F.spark_partition_id())
    assert routed.where("p <> x % 4").count() == 0 and routed.count() == 500
    assert ints((0, [1, 2])).broadcast_copy(3).df.count() == 6
    assert f.rebalance(2).df.rdd.getNumPartitions() == 2
    for bad in (lambda: f.exchange("x", to=0), lambda: f.broadcast_copy(0), lambda: f.with_capacity(0), lambda: f.tumbling(0)):
        with pytest.raises(ConfigError):
            bad()


def test_custom(ints):
    f = ints((0, [3, 1]), (1, [2]))
    sort = lambda p: pd.DataFrame({"epoch": p["epoch"], "x": sorted(p["x"])})
    assert rows(f.map_batch(sort, "epoch long, x long")) == [(0, 1), (0, 3), (1, 2)]
    stats = f.unary_notify(lambda p: pd.DataFrame({"epoch": [p["epoch"].iloc[0]], "n": [len(p)]}), "epoch long, n long")
    assert rows(stats) == [(0, 2), (1, 1)]
    assert values(f.unary_async(lambda p: p[["x"]] * 2, "x long", 2)) == [2, 4, 6]
    with pytest.raises(Exception, match="boom"):
        f.map_batch(lambda p: (_ for _ in ()).throw(ValueError("boom")), "x long").collect()


def double(limit):
    return lambda now: Step(now.withColumn("x", F.col("x") * 2).where(F.col("x") < limit), now.withColumn("x", F.col("x") * 2).where(F.col("x") >= limit))


def test_loops(spark, ints):
    assert values(ints((0, [1, 3, 7, 25])).iterate(double(100))) == [100, 112, 128, 192]
    d = ints((0, [1, 2, 3, 5, 10, 50])).df
    assert values(iterate.fused(d, "x", lambda v: v * 2, lambda v: v >= 100)) == [100, 128, 128, 160, 160, 192]
    assert values(iterate.fused(ints((0, [6, 7, 12])).df, "x", collatz, lambda v: v == 1)) == [1, 1, 1]
    assert values(iterate.fused(ints((0, [1])).df, "x", collatz, lambda v: v == 1, steps="k"), "k") == [3]
    with pytest.raises(NotConverged):
        ints((0, [1])).iterate(lambda now: Step(now, now.limit(0)), max_rounds=3)
    with pytest.raises(Exception, match="feedback"):
        iterate.fused(ints((0, [0])).df, "x", lambda v: v, lambda v: v > 0, 5).collect()


def test_loop_counters(ints):
    def body(now):
        return Step(now.withColumn("x", F.col("x") * 2).where("x < 100"), now.withColumn("x", F.col("x") * 2).where("x >= 100"))

    assert rows(ints((0, [5]), (1, [50])).iterate(body), "epoch", "x", "iter") == [(0, 160, 4), (1, 100, 0)]


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src long, dst long, seq long")


def test_graphs(spark):
    e = edges(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 7), (6, 7), (6, 8), (8, 9)])
    seed = spark.createDataFrame([(0,)], "node long")
    assert rows(graph.bfs_levels(e, seed)) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 6), (7, 5), (8, 7), (9, 8)]
    pairs = [(0, 1), (1, 2), (2, 3), (0, 3), (1, 3), (4, 5), (5, 6), (4, 6)]
    u = edges(spark, pairs)
    assert rows(graph.connected_components(u)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4), (6, 4)]
    assert rows(graph.union_find_merges(u, ["seq"]), "src", "dst") == [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6)]
    exact = graph.union_find_exact(u.toPandas())
    assert list(zip(exact["src"], exact["dst"])) == [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6)]


def test_pagerank(spark):
    e = edges(spark, [(0, 1), (1, 2), (1, 4), (2, 5), (3, 0), (4, 3), (4, 5)])
    nodes = spark.range(6).withColumnRenamed("id", "node")
    spread = dict(rows(graph.pagerank(e, nodes, 10)))
    assert abs(sum(spread.values()) - 1) < 1e-12 and max(spread, key=spread.get) == 5
    lost = dict(rows(graph.pagerank(e, nodes, 21, dangling="lost")))
    assert len(lost) == 6 and sum(lost.values()) < 1 and max(lost, key=lost.get) == 5


def test_names(spark):
    with pytest.raises(DuplicateName):
        named_inputs(("a", None), ("a", None))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5)), max_size=30), st.integers(1, 4))
def test_sums_do_not_depend_on_partitions(spark, data, n):
    f = from_epochs(spark, [(e, [x]) for e, x in data])
    want = {}
    for e, x in data:
        want[e] = want.get(e, 0) + x
    assert rows(f.rebalance(n).aggregate(F.sum("x").alias("x"))) == sorted(want.items())
