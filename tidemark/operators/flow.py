"""Splitting, merging and watching streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..errors import ConfigError


def branch(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that fulfil the predicate, the others); a null does not fulfil it.  Each row is in exactly one if the
    predicate is deterministic; write or persist df first if it is not."""
    p = F.coalesce(predicate, F.lit(False))
    return df.where(p), df.where(~p)


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    if not frames:
        raise ConfigError("nothing to concatenate")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ranged(df: DataFrame, by: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds the number of a range of a numeric column, 0 to parts - 1, of about as many rows each; in its order.

    Ranges are cut by value, as the partitions of a range exchange need not be the same when a plan runs again."""
    n = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.stat.approxQuantile([by], [k / n for k in range(1, n)], 0.01)[0] if n > 1 else []
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + (F.col(by) > F.lit(c)).cast("int")
    return df.withColumn(name, F.coalesce(part, F.lit(0)))


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "i") -> DataFrame:
    """Adds the place in arrival order, from 1: within `by`, or over all rows.

    Rows are cut into ranges of the first numeric order column beside `by`, numbered within range, and shifted by the
    counts of the ranges before: neither all rows nor all rows of an epoch meet in one task.  Without such a column
    a window over `by` does it.
    """
    by = list(by)
    at = next((c for c in order if c not in by and isinstance(df.schema[c].dataType, NumericType)), None)
    if at is None and by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    if at is None or [c for c in order if c not in by][0] != at:
        raise ConfigError("the first order column is numeric")
    dealt = ranged(df, at, "__part")
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = dealt.groupBy(*by, "__part").count().withColumn("__before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    own = dealt.withColumn("__i", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)))
    return own.join(before, [*by, "__part"]).withColumn(name, (F.col("__i") + F.col("__before")).cast("long")).drop("__part", "__i", "__before")


def zip_streams(left: DataFrame, left_order: Sequence[str], right: DataFrame, right_order: Sequence[str], time: Sequence[str]) -> DataFrame:
    """Pairs the i-th row of either side within each epoch; the longer side's rest is left out."""
    a = numbered(left, left_order, time)
    b = numbered(right, right_order, time)
    keep = [c for c in a.columns if c not in left_order and c != "i"]
    own = [c for c in b.columns if c not in right_order and c != "i"]
    return a.join(b, [*time, "i"]).select(*time, "i", *[a[c] for c in keep], *[b[c] for c in own])


def inspect(frame, name: str, metrics: list[Column]):
    """(frame, Observation)."""
    seen = Observation(name)
    return frame.over(frame.df.observe(seen, *(metrics or [F.count(F.lit(1)).alias("rows")]))), seen
