"""Epochs on Spark's watermark.

An epoch e is event time e + SHIFT seconds.  Time 0 would be late against the watermark that a query starts with,
hence the shift; the delay of one second keeps an epoch open until a later one is seen.  Marker rows of an
EpochFolder move the watermark and are removed after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..timed import TimedFrame

SHIFT = 86_400


def close_time(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch + F.lit(SHIFT))


def _epoch(event_time: Column) -> Column:
    return F.unix_seconds(event_time) - F.lit(SHIFT)


def sealed(frame: TimedFrame) -> DataFrame:
    """The rows with the watermarked column event_time, markers included."""
    return frame.df.withColumn("event_time", close_time(F.col(frame.time[0]))).withWatermark("event_time", "1 second")


def epoch_aggregate(frame: TimedFrame, *aggs: Column, by: Sequence[str] = ()) -> DataFrame:
    """A row per epoch (and key) once it is sealed; append mode.  aggs must give null or 0 counts for markers, which
    have null payloads; epochs of markers alone are left out.  Late rows are dropped."""
    return sums_of(sealed(frame), frame.time[0], *aggs, by=by)


def revised(frame: TimedFrame, *aggs: Column, by: Sequence[str] = ()) -> DataFrame:
    """The same without a watermark, for update or complete mode: late rows revise their epoch's result.  State
    grows with the number of epochs."""
    return frame.df.where("not marker").groupBy(*frame.time, *by).agg(*aggs)


def deduplicated(frame: TimedFrame) -> DataFrame:
    """Each value once an epoch, emitted at once; state goes when its epoch is sealed."""
    d = sealed(frame)
    keys = ["event_time", "marker", *[c for c in frame.payload if c != "marker"]]
    out = d.dropDuplicates(keys).where("not marker")
    return out.select(*frame.time, *[c for c in frame.payload if c != "marker"])



def merged(*frames: TimedFrame) -> DataFrame:
    """Several inputs as one, with the watermarked column event_time: an epoch is sealed once all inputs have passed
    it, as the watermark is the least of theirs (the policy "min", which is checked)."""
    spark = frames[0].df.sparkSession
    if spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy", "min") != "min":
        raise ConfigError("several inputs need spark.sql.streaming.multipleWatermarkPolicy=min")
    out = sealed(frames[0])
    for f in frames[1:]:
        out = out.unionByName(sealed(f))
    return out


def sums_of(d: DataFrame, time: str, *aggs: Column, by: Sequence[str] = ()) -> DataFrame:
    """epoch_aggregate over rows that sealed() or merged() gave."""
    g = d.groupBy("event_time", *by).agg(*aggs, F.count_if(~F.col("marker")).alias("__rows"))
    return g.where(F.col("__rows") > 0).select(_epoch(F.col("event_time")).alias(time), *[c for c in g.columns if c not in ("event_time", "__rows")])
