"""Queries over whole tables, against brute force."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import graph
from tidemark.plans.registry import QUERIES


@pytest.fixture(scope="module")
def orders(sf_dir):
    o = pd.read_parquet(f"{sf_dir}/orders.parquet", columns=["o_orderkey", "o_custkey"]).sort_values("o_orderkey")
    return pd.DataFrame({"src": o["o_orderkey"] % 3000, "dst": (o["o_orderkey"] * 7 + o["o_custkey"]) % 3000, "seq": o["o_orderkey"]})


@pytest.fixture(scope="module")
def adjacent(sf_dir):
    """Whether there is an edge from a row's vertex to a column's, over all of lineitem."""
    l = pd.read_parquet(f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_partkey"])
    m = np.zeros((1000, 1000), np.int64)
    m[l["l_orderkey"] % 1000, l["l_partkey"] % 1000] = 1
    return m


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_merges_of_all_orders(spark, sf_dir, orders):
    want = graph.union_find_exact(orders)
    assert rows(QUERIES["union_find_merges"](spark, sf_dir), "seq", "src", "dst") == sorted(zip(want["seq"], want["src"], want["dst"]))


def test_components_of_all_orders(spark, sf_dir, orders):
    label = {v: v for v in [*orders["src"], *orders["dst"]]}
    moved = True
    while moved:
        moved = False
        for a, b in zip(orders["src"], orders["dst"]):
            low = min(label[a], label[b])
            moved |= label[a] != label[b]
            label[a] = label[b] = low
    assert rows(QUERIES["connected_components"](spark, sf_dir), "node", "label") == sorted(label.items())


def test_levels_of_all_edges(spark, sf_dir, adjacent):
    near, dist, at = (adjacent + adjacent.T) > 0, {0: 0}, [0]
    while at:
        new = sorted({int(w) for v in at for w in np.flatnonzero(near[v])} - set(dist))
        dist |= {w: dist[at[0]] + 1 for w in new}
        at = new
    assert rows(QUERIES["bfs_levels"](spark, sf_dir), "node", "dist") == sorted(dist.items())


def test_two_hops_of_all_edges(spark, sf_dir, adjacent):
    after = [np.flatnonzero(r).tolist() for r in adjacent]
    paths = {}
    for a in range(1000):
        for b in after[a]:
            for c in after[b]:
                paths.setdefault((a, c), []).append(b)
    assert rows(QUERIES["two_hop_paths"](spark, sf_dir), "a", "c", "n", "low", "high") == sorted((a, c, len(m), min(m), max(m)) for (a, c), m in paths.items())


def test_long_chains_are_contracted(spark):
    chain = spark.range(3000).selectExpr("id AS src", "id + 1 AS dst").where("src != 1700").union(spark.createDataFrame([(9000, 9000)], "src long, dst long"))
    got = dict(rows(graph.connected_components(chain), "node", "label"))
    assert got == {i: 0 if i <= 1700 else 1701 for i in range(3001)} | {9000: 9000}
    assert graph.connected_components(chain.limit(0)).count() == 0


def test_pagerank_plan_reads_the_ranks_once_a_round(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "src long, dst long")
    df = graph.pagerank(e, spark.range(4).withColumnRenamed("id", "node"), 6, cut_every=10, dangling="lost")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 6


def test_paths_of_all_edges(spark, sf_dir, adjacent):
    two = adjacent @ adjacent
    want = {(int(a), int(b), hops): int(m[a, b]) for hops, m in enumerate((adjacent, two, two @ adjacent), 1) for a, b in np.argwhere(m)}
    got = QUERIES["recursive_paths"](spark, sf_dir).toPandas()
    assert len(got) == len(want)
    assert dict(zip(zip(got["src"], got["dst"], got["hops"]), got["n"])) == want
