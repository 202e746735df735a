"""Cases of the third round: tables of many files, epochs in batches."""

import glob

import duckdb
import pandas as pd
import pytest

from tidemark.errors import OperatorError
from tidemark.plans.registry import QUERIES, SQL
from tidemark.runtime import Engine
from tidemark.sources import from_epochs


@pytest.mark.parametrize(("key", "table"), [("wordcount_snapshot", "documents"), ("stream_epoch_stats", "events")])
def test_streams_read_tables_of_many_files(spark, sf_dir, tmp_path, key, table):
    spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    assert len(glob.glob(f"{tmp_path}/{table}.parquet/*.parquet")) == 3
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    rel = con.sql(SQL[key])
    got = QUERIES[key](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


def test_notifications_take_an_epoch_in_batches(spark):
    def sizes(batches):
        seen = [(int(p["epoch"].iloc[0]), len(p), int(p["x"].sum())) for p in batches]
        epochs, lens, sums = zip(*seen)
        return pd.DataFrame({"epoch": [epochs[0]], "one": [len(set(epochs)) == 1], "largest": [max(lens)], "rows": [sum(lens)], "total": [sum(sums)]})

    schema, key = "epoch long, one boolean, largest long, rows long, total long", "spark.sql.execution.arrow.maxRecordsPerBatch"
    f = from_epochs(spark, [(0, list(range(2500))), (1, [7])])
    want = [(0, True, 2500, 2500 * 2499 // 2), (1, True, 1, 7)]
    before = spark.conf.get(key)
    spark.conf.set(key, "100")
    try:
        got = sorted(map(tuple, f.unary_notify(sizes, schema, batches=True).collect()))
    finally:
        spark.conf.set(key, before)
    assert [(e, one, n, s) for e, one, _, n, s in got] == want and got[0][2] == 100
    got = sorted(map(tuple, f.with_capacity(8).unary_notify(sizes, schema, batches=True).collect()))
    assert [(e, one, n, s) for e, one, _, n, s in got] == want and got[0][2] == 8
    with pytest.raises(OperatorError) as err:
        Engine(spark).spawn("n", f.unary_notify(lambda batches: 1 / 0, schema, name="teller", batches=True)).join(60)
    assert err.value.operator == "teller"


def test_word_notifications_hold_no_whole_epoch(spark, tmp_path):
    texts = [(0, " ".join(f"w{k}" for k in range(3000))), (10, "w1 W1\tw2 x"), (20, None), (3, " \n"), (7, "one"), (None, "a b a")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["notify_wordcount"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "run_batches" in plan and "worker" in plan
    assert sorted(map(tuple, df.selectExpr("coalesce(epoch, -1)", "words", "most").collect())) == [(-1, 2, 2), (0, 3001, 3), (7, 1, 1)]
