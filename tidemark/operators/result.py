"""Row-level errors: a column struct<ok, err> of which exactly one field is not null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ok(value: Column) -> Column:
    return F.struct(value.alias("ok"), F.lit(None).cast("string").alias("err"))


def err(message: Column, kind: str) -> Column:
    return F.struct(F.lit(None).cast(kind).alias("ok"), message.alias("err"))


def result(value: Column, valid: Column, message: Column) -> Column:
    """Ok(value) where valid, else Err(message)."""
    v = F.coalesce(valid, F.lit(False))
    return F.struct(F.when(v, value).alias("ok"), F.when(~v, message).alias("err"))


def _good(r: str) -> Column:
    return F.col(f"{r}.err").isNull()


def map_ok(df: DataFrame, f: Callable[[Column], Column], r: str = "r") -> DataFrame:
    return df.withColumn(r, F.struct(F.when(_good(r), f(F.col(f"{r}.ok"))).alias("ok"), F.col(f"{r}.err").alias("err")))


def filter_ok(df: DataFrame, p: Callable[[Column], Column], r: str = "r") -> DataFrame:
    return df.where(~_good(r) | F.coalesce(p(F.col(f"{r}.ok")), F.lit(False)))


def and_then(df: DataFrame, f: Callable[[Column], Column], r: str = "r") -> DataFrame:
    """f: a column to a result."""
    step = f(F.col(f"{r}.ok"))
    return df.withColumn(r, F.struct(F.when(_good(r), step["ok"]).alias("ok"), F.when(_good(r), step["err"]).otherwise(F.col(f"{r}.err")).alias("err")))


def branch_result(df: DataFrame, r: str = "r") -> tuple[DataFrame, DataFrame]:
    """(rows with column ok, rows with column err) in place of r."""
    rest = [c for c in df.columns if c != r]
    return df.where(_good(r)).select(*rest, F.col(f"{r}.ok").alias("ok")), df.where(~_good(r)).select(*rest, F.col(f"{r}.err").alias("err"))
