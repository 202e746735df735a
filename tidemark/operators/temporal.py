"""Moving rows in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError


def window_end(epoch: Column, width: int) -> Column:
    """The end of the tumbling window that holds epoch."""
    if width < 1:
        raise ConfigError("a window is 1 wide at least")
    return (F.floor(epoch / F.lit(width)) + 1) * F.lit(width)


def delay(df: DataFrame, time: str, to: Column) -> DataFrame:
    """Re-timestamps rows.  A time before the row's own fails the flow."""
    moved = F.when(to >= F.col(time), to).otherwise(F.raise_error(F.concat(F.lit("delay: new time lies before "), F.col(time).cast("string"))))
    return df.withColumn(time, moved.cast(df.schema[time].dataType))


def sliding(df: DataFrame, time: str, width: int, slide: int, name: str = "window_start") -> DataFrame:
    """A row for each window [k * slide, k * slide + width) that holds it."""
    if width < 1 or slide < 1:
        raise ConfigError("width and slide are 1 at least")
    last = F.floor(F.col(time) / slide)
    first = F.floor((F.col(time) - width) / slide) + 1
    return df.withColumn(name, F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn(name, F.col(name) * slide)
