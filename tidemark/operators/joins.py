"""Joins of timed frames.  Strategy and skew are left to the optimizer and adaptive execution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def across_epochs(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, how: str = "inner") -> DataFrame:
    """Rows of equal keys, whatever their epochs; the result's epoch is the later one."""
    r = right.withColumnRenamed(time, "__time")
    out = left.join(r, list(on), how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.withColumn(time, F.greatest(time, "__time")).drop("__time")


def per_epoch(left: DataFrame, right: DataFrame, on: Sequence[str], time: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of equal keys and the same epoch."""
    return left.join(right, [*time, *on], how)


def interval(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, before: int, after: int) -> DataFrame:
    """Rows of equal keys whose right time lies in [left - before, left + after].

    Right rows are put into the buckets of time that they can meet, so the join is by equality and one key's
    rows are spread over its buckets.
    """
    width = max(1, before + after + 1)
    l = left.withColumn("__bucket", F.floor(F.col(time) / width))
    r = right.withColumnRenamed(time, f"right_{time}")
    lo, hi = F.floor((F.col(f"right_{time}") - after) / width), F.floor((F.col(f"right_{time}") + before) / width)
    r = r.withColumn("__bucket", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    return l.join(r, [*on, "__bucket"]).where(F.col(f"right_{time}").between(F.col(time) - before, F.col(time) + after)).drop("__bucket")


def two_hops(edges: DataFrame) -> DataFrame:
    """a, b, c: each path of two edges (src, dst)."""
    x, y = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), edges.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return x.join(y, "b").select("a", "b", "c")
