"""Every query with SQL gives the SQL's rows."""

import pytest

from tidemark.plans.registry import QUERIES, SQL

SLOW = {"pagerank_top10", "pagerank_sink_loss"}


@pytest.mark.parametrize("key", sorted(set(SQL) - SLOW))
def test_same_as_sql(key, same_as_sql):
    same_as_sql(QUERIES[key], SQL[key])


def test_entry_imports():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scan_reaches_the_file(spark, sf_dir):
    plan = QUERIES["scan_filter_agg"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_shipdate" in plan
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "l_comment" not in read and "l_partkey" not in read and "l_quantity" in read
    assert plan.count("Exchange") == 1


def test_map_chain_is_one_projection(spark, sf_dir):
    plan = QUERIES["map_chain_20"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1
