"""Aggregation by epoch.  Native aggregates are combined before they are shuffled; reduce and fold with a function
of their own keep arrival order and so gather each group's values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flow import ranged


def _values(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    rest = [c for c in order if c not in keys]
    row = F.struct(*[F.col(c) for c in rest], F.col(value).alias("__v"))
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["__v"]).alias("__all"))


def reduce(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, f: Callable[[Column, Column], Column], associative: bool = False) -> DataFrame:
    """A left fold in arrival order from the first value.  associative: ranges of the arrival order are reduced each
    for itself and then joined in order, so that no group's values meet in one row."""
    if associative:
        at = [c for c in order if c not in keys][0]
        df = ranged(df, at, "__part")
        g = _values(df, [*keys, "__part"], order, value)
        df = g.select(*keys, "__part", F.aggregate(_rest(), F.element_at("__all", 1), f).alias(value))
        order = [*keys, "__part"]
    g = _values(df, keys, order, value)
    return g.select(*keys, F.aggregate(_rest(), F.element_at("__all", 1), f).alias(value))


def _rest() -> Column:
    return F.slice("__all", 2, F.greatest(F.size("__all") - 1, F.lit(0)))


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, init: Column, f: Callable[[Column, Column], Column], name: str, merge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """A left fold in arrival order from init.  merge joins the results of neighbouring stretches, each folded from
    init; with it ranges of the arrival order are folded each for itself."""
    if merge is None:
        return _values(df, keys, order, value).select(*keys, F.aggregate("__all", init, f).alias(name))
    at = [c for c in order if c not in keys][0]
    parts = _values(ranged(df, at, "__part"), [*keys, "__part"], order, value).select(*keys, "__part", F.aggregate("__all", init, f).alias(name))
    return reduce(parts, keys, [*keys, "__part"], name, merge)


def distinct(df: DataFrame, time: Sequence[str], payload: Sequence[str], seq: str | None = None) -> DataFrame:
    """Each value once an epoch; with seq, its first arrival."""
    keys = [*time, *payload]
    return df.groupBy(*keys).agg(F.min(seq).alias(seq)) if seq else df.dropDuplicates(keys)


def first_ever(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first arrival of each key over all epochs, with the row's other columns."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")) if rest else df.dropDuplicates(list(keys))
    return g.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns]) if rest else g


def by_worker(df: DataFrame, keys: Sequence[str], route: Column, workers: int, *aggs: Column) -> DataFrame:
    """Partial results as a fixed number of workers would give them, each for what was routed to it."""
    return df.groupBy(*keys, F.pmod(route, F.lit(workers)).cast("int").alias("worker")).agg(*aggs)
