"""The tables as frames, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cents, day_epoch
from ..sources import from_parquet
from ..timed import TimedFrame

#: Events by day; e is a common table expression for the oracles.
E = """e AS (SELECT datediff('day', DATE '2024-01-01', ts)::BIGINT AS epoch, event_id AS seq, user_id, event_type, value,
       round(value * 100)::BIGINT AS cents FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> TimedFrame:
    """epoch, seq, user_id, event_type, value, cents."""
    f = from_parquet(spark, f"{sf_dir}/events.parquet", day_epoch("ts"))
    d = f.df.select("epoch", F.col("event_id").alias("seq"), "user_id", "event_type", "value", cents("value").alias("cents"))
    return TimedFrame(d, seq="seq")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def edges(spark: SparkSession, sf_dir: str, vertices: int) -> DataFrame:
    """An edge per lineitem row between vertices 0..vertices-1."""
    return lineitem(spark, sf_dir).select((F.col("l_orderkey") % vertices).alias("src"), (F.col("l_partkey") % vertices).alias("dst"))


def edges_sql(vertices: int) -> str:
    return f"g AS (SELECT l_orderkey % {vertices} AS src, l_partkey % {vertices} AS dst FROM lineitem)"
