"""Batch sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DuplicateName
from ..timed import TimedFrame


def from_epochs(spark: SparkSession, batches: Sequence[tuple[int, Sequence[Any]]], schema: str = "x long", seq: bool = True) -> TimedFrame:
    """Batches of (epoch, rows), emitted once, in order.  schema: of a row's columns; rows of one column may be
    bare values.  seq: adds the place of each row over all batches."""
    rows, n = [], 0
    for epoch, batch in batches:
        for r in batch:
            own = tuple(r) if isinstance(r, (tuple, list)) else (r,)
            rows.append((epoch, n, *own) if seq else (epoch, *own))
            n += 1
    return TimedFrame(spark.createDataFrame(rows, f"epoch long, {'seq long, ' if seq else ''}{schema}"), seq="seq" if seq else None)


def from_parquet(spark: SparkSession, path: str, epoch: Column | str, seq: str | None = None, columns: Sequence[str] | None = None) -> TimedFrame:
    """A parquet table; epoch: an expression over it.  Columns that nothing asks for are not read."""
    df = spark.read.parquet(path)
    df = df.withColumn("epoch", (F.expr(epoch) if isinstance(epoch, str) else epoch).cast("long"))
    if columns is not None:
        df = df.select("epoch", *([seq] if seq and seq not in columns else []), *columns)
    return TimedFrame(df, seq=seq)


def named_inputs(*inputs: tuple[str, DataFrame | TimedFrame]) -> Mapping[str, DataFrame | TimedFrame]:
    """Inputs by name; a name that is given twice is an error."""
    out: dict = {}
    for name, df in inputs:
        if name in out:
            raise DuplicateName(f"input {name!r} exists")
        out[name] = df
    return out
