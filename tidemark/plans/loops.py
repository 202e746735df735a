"""Queries with loops, and graph algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import collatz
from ..operators import graph, iterate
from ..operators.iterate import Step
from .registry import query
from .tables import E, edges, edges_sql, events


def _users(spark, sf_dir):
    return events(spark, sf_dir).df.select((F.col("user_id") + 1).alias("v")).distinct()


@query("iterate_double_until", f"WITH RECURSIVE {E}, r AS (SELECT DISTINCT user_id + 1 AS s, user_id + 1 AS v, false AS again, 0 AS k FROM e UNION ALL SELECT s, v * 2, v * 2 < 1000, k + 1 FROM r WHERE k = 0 OR again) SELECT s AS start, max(v) AS v, max(k)::BIGINT AS rounds FROM r GROUP BY 1")
def iterate_double_until(spark, sf_dir):
    d = _users(spark, sf_dir).withColumn("start", F.col("v"))
    return iterate.fused(d, "v", lambda v: v * 2, lambda v: v >= 1000, 64, "rounds")


@query("iterate_general", f"WITH RECURSIVE {E}, r AS (SELECT DISTINCT user_id + 1 AS s, user_id + 1 AS v, 0 AS k FROM e UNION ALL SELECT s, v * 3, k + 1 FROM r WHERE v < 100) SELECT s AS start, v, k::BIGINT AS iter FROM r WHERE v >= 100")
def iterate_general(spark, sf_dir):
    """The same kind of loop by whole frames; rows leave in the round in which they are done."""
    def body(now):
        return Step(now.where("v < 100").withColumn("v", F.col("v") * 3), now.where("v >= 100"))

    return iterate.iterate(_users(spark, sf_dir).withColumn("start", F.col("v")), body).select("start", "v", "iter")


@query("iterate_collatz", f"WITH RECURSIVE {E}, r AS (SELECT DISTINCT user_id + 1 AS s, user_id + 1 AS v, 0 AS k FROM e UNION ALL SELECT s, CASE WHEN v % 2 = 0 THEN v // 2 ELSE 3 * v + 1 END, k + 1 FROM r WHERE k = 0 OR v <> 1) SELECT s AS start, 1::BIGINT AS v, max(k)::BIGINT AS rounds FROM r GROUP BY 1")
def iterate_collatz(spark, sf_dir):
    d = _users(spark, sf_dir).withColumn("start", F.col("v"))
    return iterate.fused(d, "v", collatz, lambda v: v == 1, 500, "rounds")


@query("iterate_pingpong", f"WITH {E} SELECT DISTINCT user_id + 1 AS start, CASE WHEN user_id + 1 < 50 THEN 50 ELSE user_id + 2 END AS v FROM e")
def iterate_pingpong(spark, sf_dir):
    d = _users(spark, sf_dir).withColumn("start", F.col("v"))
    return iterate.fused(d, "v", lambda v: v + 1, lambda v: v >= 50, 200)


@query("iterate_barrier", "SELECT 1000::BIGINT AS v, 1000::BIGINT AS rounds")
def iterate_barrier(spark, sf_dir):
    return iterate.fused(spark.range(1).withColumnRenamed("id", "v"), "v", lambda v: v + 1, lambda v: v >= 1000, 1000, "rounds")


@query("iterate_decay", f"WITH {E} SELECT DISTINCT user_id AS k, CASE WHEN user_id % 7 > 1 THEN 1 ELSE user_id % 7 - 1 END AS v FROM e")
def iterate_decay(spark, sf_dir):
    d = events(spark, sf_dir).df.select(F.col("user_id").alias("k"), (F.col("user_id") % 7).alias("v")).distinct()
    return iterate.fused(d, "v", lambda v: v - 1, lambda v: v <= 1, 20)


@query("iterate_exchange_double", f"WITH RECURSIVE {E}, r AS (SELECT epoch, count(*)::BIGINT AS v, 0 AS k FROM e GROUP BY 1 UNION ALL SELECT epoch, v * 2, k + 1 FROM r WHERE v < 5000) SELECT epoch, v FROM r WHERE v >= 5000 AND k > 0")
def iterate_exchange_double(spark, sf_dir):
    """Doubles until the threshold, with an exchange in the loop; rows of one value and epoch meet again."""
    def body(now):
        dealt = now.withColumn("v", F.col("v") * 2).repartition("v")
        return Step(dealt.where("v < 5000"), dealt.where("v >= 5000"))

    start = events(spark, sf_dir).count(name="v").df.where("v < 5000")
    return iterate.iterate(start, body).select("epoch", "v")


@query("iterate_nested", f"WITH {E} SELECT DISTINCT user_id AS start, CASE WHEN user_id < 30 THEN 30 ELSE (user_id // 10 + 1) * 10 END AS v FROM e")
def iterate_nested(spark, sf_dir):
    """Inner loop: steps to the next multiple of 10; outer loop: until 30."""
    def inner(v):
        return F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.struct(v.alias("v"), F.lit(False).alias("end")), lambda a, _: F.when(a["end"], a).otherwise(F.struct((a["v"] + 1).alias("v"), ((a["v"] + 1) % 10 == 0).alias("end"))))["v"]

    d = events(spark, sf_dir).df.select(F.col("user_id").alias("v"), F.col("user_id").alias("start")).distinct()
    return iterate.fused(d, "v", inner, lambda v: v >= 30, 20)


_V = 1000
_D = f"{edges_sql(_V)}, d AS (SELECT DISTINCT src, dst FROM g)"


@query("recursive_series", "SELECT n_nationkey::BIGINT AS start, v::BIGINT AS v, (n_nationkey - v)::BIGINT AS depth FROM (SELECT n_nationkey, unnest(generate_series(0, n_nationkey)) AS v FROM nation)")
def recursive_series(spark, sf_dir):
    """A recursive common table expression: each key counted down to 0."""
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k")).createOrReplaceTempView("tidemark_keys")
    return iterate.recursive(spark, "r", "SELECT k AS start, k AS v, 0L AS depth FROM tidemark_keys", "SELECT start, v - 1, depth + 1 FROM r WHERE v > 0")


@query(
    "recursive_paths",
    f"""WITH {_D}, p2 AS (SELECT x.src, y.dst, count(*) AS n FROM d x JOIN d y ON x.dst = y.src GROUP BY ALL),
        p3 AS (SELECT x.src, y.dst, sum(n) AS n FROM p2 x JOIN d y ON x.dst = y.src GROUP BY ALL)
        SELECT src, dst, 1::BIGINT AS hops, 1::BIGINT AS n FROM d UNION ALL SELECT src, dst, 2, n FROM p2 UNION ALL SELECT src, dst, 3, n::BIGINT FROM p3""",
)
def recursive_paths(spark, sf_dir):
    """The number of paths of up to three edges between any two vertices.  Paths are summed by their ends in each
    round, so they are counted, not listed."""
    d = iterate.checkpoint(edges(spark, sf_dir, _V).distinct())
    now = d.withColumn("n", F.lit(1).cast("long"))
    out = now.withColumn("hops", F.lit(1).cast("long"))
    step = d.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    for hops in (2, 3):
        now = iterate.checkpoint(now.join(step, "dst").groupBy("src", F.col("to").alias("dst")).agg(F.sum("n").alias("n")))
        out = out.unionByName(now.withColumn("hops", F.lit(hops).cast("long")))
    return out.select("src", "dst", "hops", "n")


def _levels_sql(v: int, most: int) -> str:
    """Breadth-first levels as a chain of tables, one a level; most: more than the graph's diameter."""
    parts = [f"WITH {edges_sql(v)}, u AS MATERIALIZED (SELECT src, dst FROM g UNION SELECT dst, src FROM g), b0 AS MATERIALIZED (SELECT 0::BIGINT AS node, 0::BIGINT AS dist)"]
    for k in range(1, most + 1):
        parts.append(f"b{k} AS MATERIALIZED (SELECT node, min(dist) AS dist FROM (SELECT * FROM b{k - 1} UNION ALL SELECT u.dst, dist + 1 FROM b{k - 1} JOIN u ON node = u.src) GROUP BY node)")
    return ", ".join(parts) + f" SELECT node, dist FROM b{most}"


@query("bfs_levels", _levels_sql(_V, 12))
def bfs_levels(spark, sf_dir):
    return graph.bfs_levels(edges(spark, sf_dir, _V), spark.createDataFrame([(0,)], "node long"))


def _pagerank_sql(v: int, rounds: int, spread: bool) -> str:
    parts = [f"WITH {edges_sql(v)}, nd AS (SELECT range AS node FROM range({v})), o AS (SELECT src, count(*) AS deg FROM g GROUP BY 1), s AS (SELECT g.src, dst, count(*)::DOUBLE / any_value(deg) AS share FROM g JOIN o ON g.src = o.src GROUP BY g.src, dst), r0 AS (SELECT node, 1.0::DOUBLE / {v} AS rank FROM nd)"]
    for k in range(1, rounds + 1):
        lost = f" + 0.85::DOUBLE / {v} * (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM o))" if spread else ""
        parts.append(f"r{k} AS MATERIALIZED (SELECT nd.node, 0.15::DOUBLE / {v} + 0.85::DOUBLE * coalesce(got, 0){lost} AS rank FROM nd LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM r{k - 1} JOIN s ON r{k - 1}.node = s.src GROUP BY dst) ON nd.node = dst)")
    return ", ".join(parts) + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


def _pagerank(spark, sf_dir, v, rounds, dangling):
    nodes = spark.range(v).withColumnRenamed("id", "node")
    return graph.pagerank(edges(spark, sf_dir, v), nodes, rounds, 0.85, dangling).select("node", F.round("rank", 9).alias("rank"))


@query("pagerank_sink_loss", _pagerank_sql(20_000, 21, False))
def pagerank_sink_loss(spark, sf_dir):
    return _pagerank(spark, sf_dir, 20_000, 21, "lost")


@query("pagerank_dangling", _pagerank_sql(20_000, 10, True))
def pagerank_dangling(spark, sf_dir):
    return _pagerank(spark, sf_dir, 20_000, 10, "spread")


@query("pagerank_top10", f"SELECT * FROM ({_pagerank_sql(20_000, 10, True)}) ORDER BY rank DESC, node LIMIT 10")
def pagerank_top10(spark, sf_dir):
    return _pagerank(spark, sf_dir, 20_000, 10, "spread").orderBy(F.col("rank").desc(), "node").limit(10)


_CHAIN = "SELECT o_orderkey % 3000 AS src, (o_orderkey * 7 + o_custkey) % 3000 AS dst, o_orderkey AS seq FROM orders"


def _chain(spark, sf_dir):
    """All orders as edges."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select((F.col("o_orderkey") % 3000).alias("src"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 3000).alias("dst"), F.col("o_orderkey").alias("seq"))


def _components_sql(rounds: int) -> str:
    """Least labels of neighbours, then labels of labels, a table a round; rounds: more than needed."""
    parts = [f"WITH g AS ({_CHAIN}), u AS MATERIALIZED (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), l0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS label FROM u)"]
    for k in range(1, rounds + 1):
        parts.append(f"n{k} AS MATERIALIZED (SELECT a AS node, min(label) AS low FROM u JOIN l{k - 1} ON b = node GROUP BY a)")
        parts.append(f"m{k} AS MATERIALIZED (SELECT l.node, least(label, low) AS label FROM l{k - 1} l JOIN n{k} n ON l.node = n.node)")
        parts.append(f"l{k} AS MATERIALIZED (SELECT x.node, y.label FROM m{k} x JOIN m{k} y ON x.label = y.node)")
    return ", ".join(parts) + f" SELECT node, label FROM l{rounds}"


@query("connected_components", _components_sql(10))
def connected_components(spark, sf_dir):
    return graph.connected_components(_chain(spark, sf_dir).select("src", "dst"))


def _merges_sql(rounds: int, jumps: int) -> str:
    """Boruvka's rounds as tables: each label's least edge, hooks, jumps to the root, edges between roots."""
    parts = [f"WITH g AS ({_CHAIN}), e0 AS MATERIALIZED (SELECT src AS a, dst AS b, seq, src, dst FROM g WHERE src <> dst)"]
    for k in range(1, rounds + 1):
        parts.append(f"t{k} AS MATERIALIZED (SELECT x, arg_min(y, seq) AS y, min(seq) AS seq FROM (SELECT a AS x, b AS y, seq FROM e{k - 1} UNION ALL SELECT b, a, seq FROM e{k - 1}) GROUP BY x)")
        parts.append(f"h{k}_0 AS MATERIALIZED (SELECT p.x, CASE WHEN q.y = p.x AND p.x < p.y THEN p.x ELSE p.y END AS r FROM t{k} p JOIN t{k} q ON p.y = q.x)")
        for j in range(1, jumps + 1):
            parts.append(f"h{k}_{j} AS MATERIALIZED (SELECT p.x, q.r FROM h{k}_{j - 1} p JOIN h{k}_{j - 1} q ON p.r = q.x)")
        parts.append(f"e{k} AS MATERIALIZED (SELECT p.r AS a, q.r AS b, seq, src, dst FROM e{k - 1} JOIN h{k}_{jumps} p ON a = p.x JOIN h{k}_{jumps} q ON b = q.x WHERE p.r <> q.r)")
    every = " UNION ".join(f"SELECT seq FROM t{k}" for k in range(1, rounds + 1))
    return ", ".join(parts) + f" SELECT seq, src, dst FROM g WHERE seq IN ({every})"


@query("union_find_merges", _merges_sql(8, 8))
def union_find_merges(spark, sf_dir):
    return graph.union_find_merges(_chain(spark, sf_dir), ["seq"])
