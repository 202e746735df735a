"""Row-wise operators and prefixes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from .custom import cut


def project(df: DataFrame, time: Sequence[str], seq: str | None, columns: dict[str, Column]) -> DataFrame:
    """Time and arrival order stay, the rest becomes columns."""
    keep = [c for c in [*time, *([seq] if seq else [])] if c not in columns]
    return df.select(*keep, *[c.alias(k) for k, c in columns.items()])


def map_chain(df: DataFrame, name: str, steps: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """One projection per step; the optimizer folds them into one."""
    for s in steps:
        df = df.withColumn(name, s(F.col(name)))
    return df


def flat_map(df: DataFrame, array: Column, name: str, time: Sequence[str], seq: str | None) -> DataFrame:
    return df.select(*time, *([seq] if seq else []), F.explode(array).alias(name))


def try_flat_map(df: DataFrame, array: Column, valid: Column, name: str, time: Sequence[str], seq: str | None, message: Column | None) -> DataFrame:
    """flat_map whose first invalid row fails the flow."""
    said = message if message is not None else F.lit("try_flat_map: invalid record")
    return flat_map(df, F.when(F.coalesce(valid, F.lit(False)), array).otherwise(F.raise_error(said)), name, time, seq)


def map_batch(df: DataFrame, f: Callable, schema: str, time: Sequence[str] = (), capacity: int | None = None) -> DataFrame:
    """f on a whole epoch (pandas to pandas), or with no time on batches of any size (capacity at most), whose
    borders mean nothing."""
    if time:
        return df.groupBy(*time).applyInPandas(f, schema)

    def run(parts):
        for p in cut(parts, capacity):
            yield f(p)

    return df.mapInPandas(run, schema)


def take(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in arrival order: each task keeps n, which are then merged."""
    if n < 0:
        raise ConfigError("take needs a number of rows")
    return df.orderBy(*order).limit(n)


def take_while(df: DataFrame, order: Sequence[str], predicate: Column) -> DataFrame:
    """The rows before the first, in arrival order, that fails (a null fails too).

    The place of that row is one aggregate, so no window needs all rows in one task.
    """
    place = F.struct(*[F.col(c) for c in order])
    fails = ~F.coalesce(predicate, F.lit(False))
    end = df.agg(F.min(F.when(fails, place)).alias("__end"))  # one row
    return df.join(F.broadcast(end), F.col("__end").isNull() | (place < F.col("__end"))).drop("__end")
