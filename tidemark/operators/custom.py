"""Operators written in Python, in Arrow batches."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, as_completed, wait

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..errors import ConfigError, marked


@contextlib.contextmanager
def named(name: str):
    """Errors inside say which operator failed, and in which partition."""
    try:
        yield
    except Exception as e:
        task = TaskContext.get()
        raise RuntimeError(marked(name, task.partitionId() if task else -1, e)) from e


def cut(parts: Iterator[pd.DataFrame], capacity: int | None) -> Iterator[pd.DataFrame]:
    """Batches of so many rows at most."""
    for p in parts:
        if capacity is None or len(p) <= capacity:
            yield p
        else:
            for k in range(0, len(p), capacity):
                yield p.iloc[k : k + capacity]


def unary(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, capacity: int | None = None, name: str = "unary") -> DataFrame:
    """f maps the batches of a partition; what it remembers lasts for the partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with named(name):
            yield from f(cut(parts, capacity))

    return df.mapInPandas(run, schema)


def unary_notify(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame] | Callable[[Iterator[pd.DataFrame]], pd.DataFrame], schema: str, time: Sequence[str], by: Sequence[str] = (), name: str = "unary_notify", batches: bool = False, capacity: int | None = None) -> DataFrame:
    """f gets an epoch (and key) when it is complete, which in batch it always is: in one frame or, with batches, as an
    iterator of frames of capacity rows at most, so that no task holds a whole epoch in Python."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        with named(name):
            return f(pdf)

    def run_batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with named(name):
            yield f(cut(parts, capacity))

    return df.groupBy(*time, *by).applyInPandas(run_batches if batches else run, schema)


def notify_at(df: DataFrame, f: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str, time: str, epochs: Sequence[int], name: str = "notify_at") -> DataFrame:
    """f(epoch, rows) for each epoch that has rows, and for those of epochs that have none, each once."""
    asked = df.sparkSession.createDataFrame([(int(e),) for e in sorted(set(epochs))], f"`{time}` long")

    def run(key: tuple, rows: pd.DataFrame, _: pd.DataFrame) -> pd.DataFrame:
        with named(name):
            return f(int(key[0]), rows)

    return df.groupBy(time).cogroup(asked.groupBy(time)).applyInPandas(run, schema)


def tap(df: DataFrame, f: Callable, whole: bool, name: str) -> DataFrame:
    """Rows pass through; f sees each batch (whole) or each row, as a dict, on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            with named(name):
                for x in [p] if whole else p.to_dict("records"):
                    f(x)
            yield p

    return df.mapInPandas(run, df.schema)


def unary_async(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, max_concurrency: int = 8, capacity: int | None = None, name: str = "unary_async") -> DataFrame:
    """f on batches, so many at a time in each task; results come as they complete."""
    if max_concurrency < 1:
        raise ConfigError("concurrency must be 1 at least")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with named(name), ThreadPoolExecutor(max_concurrency) as pool:
            flying = set()
            for p in cut(parts, capacity):
                if len(flying) >= max_concurrency:
                    done, flying = wait(flying, return_when=FIRST_COMPLETED)
                    for d in done:
                        yield d.result()
                flying.add(pool.submit(f, p))
            for d in as_completed(flying):
                yield d.result()

    return df.mapInPandas(run, schema)


def binary(left: DataFrame, right: DataFrame, on: Sequence[str], f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, name: str = "binary") -> DataFrame:
    """f gets both sides' rows of a key."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        with named(name):
            return f(a, b)

    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(run, schema)
