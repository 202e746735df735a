import glob
import os

import duckdb
import pytest

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session

    s = session(
        "tests", "local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_driver_memory="3g",
        spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")), spark_checkpoint_dir=f"file://{tmp_path_factory.mktemp('shared')}",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def normal(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return repr(v)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, sf_dir):
    """Compares a query's rows with its SQL's."""

    def check(function, sql):
        df = function(spark, sf_dir)
        cols = sorted(df.columns)
        ours = sorted(tuple(normal(r[c]) for c in cols) for r in df.collect())
        rel = duck.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        theirs = sorted(tuple(normal(r[i]) for i in at) for r in rel.fetchall())
        assert ours == theirs

    return check
