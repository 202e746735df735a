"""TimedFrame: a DataFrame whose rows carry a logical timestamp (an epoch), and the operators on it.

The class only names columns; every operator returns a new frame over an ordinary lazy plan, so Catalyst sees
all of it.  Order-dependent operators need `seq`, the arrival order within an epoch, and say so if it is absent.
The same frame works over a batch or a streaming DataFrame as far as Spark supports the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import ConfigError
from .operators import aggregate, custom, exchange, flow, iterate, joins, result, temporal, transform


def column(x: Column | str | Any) -> Column:
    """A column, from a column, an SQL expression or a literal."""
    if isinstance(x, Column):
        return x
    return F.expr(x) if isinstance(x, str) else F.lit(x)


@dataclass(frozen=True)
class TimedFrame:
    df: DataFrame
    time: tuple[str, ...] = ("epoch",)
    seq: str | None = None
    capacity: int | None = None

    # -- basics ----------------------------------------------------------------------------------------

    @property
    def payload(self) -> list[str]:
        """Columns that are neither time nor arrival order."""
        return [c for c in self.df.columns if c not in self.time and c != self.seq]

    def over(self, df: DataFrame, seq: str | None | bool = True) -> TimedFrame:
        """The same time columns over another DataFrame; seq stays if the DataFrame has it."""
        own = (self.seq if self.seq in df.columns else None) if seq is True else (seq or None)
        return replace(self, df=df, seq=own, capacity=None)

    def ordered(self, what: str) -> list[str]:
        """Columns of the arrival order."""
        if not self.seq:
            raise ConfigError(f"{what} depends on arrival order: name a seq column")
        return [*self.time, self.seq]

    def with_capacity(self, n: int) -> TimedFrame:
        """Rows that the next edge may hold: the Python operator that comes next gets batches of so many at most."""
        if n < 1:
            raise ConfigError("capacity must be 1 at least")
        return replace(self, capacity=n)

    # -- rows ------------------------------------------------------------------------------------------

    def map(self, **columns: Column | str) -> TimedFrame:
        return self.over(transform.project(self.df, self.time, self.seq, {k: column(v) for k, v in columns.items()}))

    def filter(self, predicate: Column | str) -> TimedFrame:
        return self.over(self.df.where(column(predicate)))

    def flat_map(self, array: Column | str, name: str = "value") -> TimedFrame:
        return self.over(transform.flat_map(self.df, column(array), name, self.time, self.seq))

    def try_flat_map(self, array: Column | str, valid: Column | str, name: str = "value", message: Column | str | None = None) -> TimedFrame:
        return self.over(transform.try_flat_map(self.df, column(array), column(valid), name, self.time, self.seq, column(message) if message is not None else None))

    def map_batch(self, f: Callable, schema: str, per_epoch: bool = True) -> TimedFrame:
        return self.over(transform.map_batch(self.df, f, schema, self.time if per_epoch else (), self.capacity))

    try_map_batch = map_batch  # a function that raises fails the flow

    def take(self, n: int) -> TimedFrame:
        return self.over(transform.take(self.df, self.ordered("take"), n))

    def take_while(self, predicate: Column | str) -> TimedFrame:
        return self.over(transform.take_while(self.df, self.ordered("take_while"), column(predicate)))

    # -- per epoch -------------------------------------------------------------------------------------

    def aggregate(self, *aggs: Column, by: Sequence[str] = ()) -> TimedFrame:
        """One row per epoch (and keys) that has rows; none for others."""
        return self.over(self.df.groupBy(*self.time, *by).agg(*aggs), seq=None)

    def reduce(self, f: Callable[[Column, Column], Column], value: str, by: Sequence[str] = (), associative: bool = False) -> TimedFrame:
        return self.over(aggregate.reduce(self.df, [*self.time, *by], self.ordered("reduce"), value, f, associative), seq=None)

    def fold(self, init: Column, f: Callable[[Column, Column], Column], value: str, name: str = "value", by: Sequence[str] = (), merge: Callable[[Column, Column], Column] | None = None) -> TimedFrame:
        return self.over(aggregate.fold(self.df, [*self.time, *by], self.ordered("fold"), value, init, f, name, merge), seq=None)

    def count(self, by: Sequence[str] = (), name: str = "n") -> TimedFrame:
        return self.aggregate(F.count(F.lit(1)).alias(name), by=by)

    def distinct(self) -> TimedFrame:
        return self.over(aggregate.distinct(self.df, self.time, self.payload, self.seq))

    def distinct_ever(self, *keys: str) -> TimedFrame:
        return self.over(aggregate.first_ever(self.df, list(keys) or self.payload, self.ordered("distinct_ever")))

    # -- time ------------------------------------------------------------------------------------------

    def delay(self, to: Column | str) -> TimedFrame:
        return self.over(temporal.delay(self.df, self.time[0], column(to)))

    delay_batch = delay  # the expression may use the epoch only

    def tumbling(self, width: int) -> TimedFrame:
        return self.over(temporal.delay(self.df, self.time[0], temporal.window_end(F.col(self.time[0]), width)))

    # -- several streams -------------------------------------------------------------------------------

    def branch(self, predicate: Column | str) -> tuple[TimedFrame, TimedFrame]:
        yes, no = flow.branch(self.df, column(predicate))
        return self.over(yes), self.over(no)

    def fork(self) -> tuple[TimedFrame, TimedFrame]:
        return self, self

    def concat(self, *others: TimedFrame) -> TimedFrame:
        return self.over(flow.concat([self.df, *[o.df for o in others]]))

    merge = concat

    def zip(self, other: TimedFrame) -> TimedFrame:
        return self.over(flow.zip_streams(self.df, self.ordered("zip"), other.df, other.ordered("zip"), self.time), seq=None)

    def join(self, other: TimedFrame, on: Sequence[str], how: str = "inner") -> TimedFrame:
        return self.over(joins.across_epochs(self.df, other.df, list(on), self.time[0], how), seq=None)

    def join_epoch(self, other: TimedFrame, on: Sequence[str], how: str = "inner") -> TimedFrame:
        return self.over(joins.per_epoch(self.df, other.df, list(on), self.time, how), seq=None)

    def binary(self, other: TimedFrame, on: Sequence[str], f: Callable, schema: str, name: str = "binary") -> TimedFrame:
        return self.over(custom.binary(self.df, other.df, list(on), f, schema, name))

    # -- distribution ----------------------------------------------------------------------------------

    def exchange(self, *keys: Column | str, to: int | None = None) -> TimedFrame:
        return self.over(exchange.exchange(self.df, [column(k) for k in keys], to))

    def exchange_by_hash(self, value: Column | str, to: int | None = None) -> TimedFrame:
        return self.over(exchange.exchange_by_hash(self.df, column(value), to))

    def gather(self) -> TimedFrame:
        return self.over(exchange.gather(self.df))

    def rebalance(self, to: int | None = None) -> TimedFrame:
        return self.over(exchange.rebalance(self.df, to))

    def broadcast_copy(self, n: int, name: str = "worker") -> TimedFrame:
        return self.over(exchange.broadcast_copy(self.df, n, name))

    # -- results ---------------------------------------------------------------------------------------

    def map_ok(self, f: Callable[[Column], Column], r: str = "r") -> TimedFrame:
        return self.over(result.map_ok(self.df, f, r))

    def filter_ok(self, p: Callable[[Column], Column], r: str = "r") -> TimedFrame:
        return self.over(result.filter_ok(self.df, p, r))

    def and_then(self, f: Callable[[Column], Column], r: str = "r") -> TimedFrame:
        return self.over(result.and_then(self.df, f, r))

    def branch_result(self, r: str = "r") -> tuple[TimedFrame, TimedFrame]:
        ok, err = result.branch_result(self.df, r)
        return self.over(ok), self.over(err)

    # -- custom ----------------------------------------------------------------------------------------

    def unary(self, f: Callable, schema: str, name: str = "unary") -> TimedFrame:
        return self.over(custom.unary(self.df, f, schema, self.capacity, name))

    def unary_notify(self, f: Callable, schema: str, by: Sequence[str] = (), name: str = "unary_notify", batches: bool = False) -> TimedFrame:
        """f on each complete epoch (and key): on one frame or, with batches, on an iterator of frames."""
        return self.over(custom.unary_notify(self.df, f, schema, self.time, by, name, batches, self.capacity))

    def notify_at(self, f: Callable, schema: str, epochs: Sequence[int], name: str = "notify_at") -> TimedFrame:
        """f(epoch, rows) once for each epoch with rows, and for those asked for that have none."""
        return self.over(custom.notify_at(self.df, f, schema, self.time[0], epochs, name))

    def unary_async(self, f: Callable, schema: str, max_concurrency: int = 8, name: str = "unary_async") -> TimedFrame:
        return self.over(custom.unary_async(self.df, f, schema, max_concurrency, self.capacity, name))

    def iterate(self, body: Callable[[DataFrame], iterate.Step], max_rounds: int = 100) -> TimedFrame:
        return self.over(iterate.iterate(self.df, body, max_rounds=max_rounds))

    # -- ends ------------------------------------------------------------------------------------------

    def inspect(self, *metrics: Column, name: str = "inspect"):
        """(frame, Observation): rows pass through; the metrics can be read after an action."""
        return flow.inspect(self, name, list(metrics))

    def inspect_rows(self, f: Callable[[dict], None], name: str = "inspect") -> TimedFrame:
        """Rows pass through; f sees each, on the executors."""
        return self.over(custom.tap(self.df, f, False, name))

    def inspect_batch(self, f: Callable, name: str = "inspect_batch") -> TimedFrame:
        return self.over(custom.tap(self.df, f, True, name))

    def for_each(self, f: Callable) -> None:
        """Runs f on each row, on the executors, as an end."""
        self.df.foreach(f)

    def for_each_batch(self, f: Callable) -> None:
        """Runs f on the rows of each partition (an iterator)."""
        self.df.foreachPartition(f)

    def partitioned(self, strategy: exchange.PartitionStrategy, *keys: Column | str, to: int | None = None) -> TimedFrame:
        """Dealt by a strategy that is given as a value."""
        return self.over(exchange.partitioned(self.df, strategy, [column(k) for k in keys], to))

    def collect(self) -> list:
        return self.df.collect()
