"""Explicit distribution.  None of these changes the bag of rows, but for broadcast_copy, which multiplies it."""

from __future__ import annotations

import enum
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError

#: A lookup side is broadcast only if its counted rows times their width come to no more bytes than this.
LOOKUP_BYTES = 64 << 20


def _parallelism(df: DataFrame, to: int | None) -> int:
    if to is not None and to < 1:
        raise ConfigError("parallelism must be 1 at least")
    return to or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def exchange(df: DataFrame, keys: Sequence[Column], to: int | None = None) -> DataFrame:
    """Rows of equal keys meet in a partition."""
    return df.repartition(_parallelism(df, to), *keys)


def exchange_by_hash(df: DataFrame, value: Column, to: int | None = None) -> DataFrame:
    """A row goes to partition value mod n, exactly."""
    n = _parallelism(df, to)
    return df.repartitionById(n, F.pmod(value, F.lit(n)).cast("int"))


def gather(df: DataFrame) -> DataFrame:
    return df.repartition(1)


def rebalance(df: DataFrame, to: int | None = None) -> DataFrame:
    return df.repartition(_parallelism(df, to))


def broadcast_copy(df: DataFrame, n: int, name: str = "worker") -> DataFrame:
    """Each row once for each of n workers."""
    if n < 1:
        raise ConfigError("parallelism must be 1 at least")
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _width(df: DataFrame) -> Column:
    """Bytes of a row, about: strings and binaries as long as they are, 16 for any other column."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(16 if f.dataType.typeName() not in ("array", "map", "struct") else 1024) for f in df.schema]
    out = F.lit(16)
    for s in sizes:
        out = out + s
    return out


def lookup(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", most: int = LOOKUP_BYTES) -> DataFrame:
    """Joins a lookup table: sent to all tasks if its measured bytes allow it, else shuffled by the optimizer's
    choice."""
    size = small.agg(F.sum(_width(small)).alias("bytes")).first()["bytes"] or 0
    return df.join(F.broadcast(small) if size <= most else small, list(on), how)


class PartitionStrategy(enum.Enum):
    """How rows are dealt to the next stage's tasks."""

    PIPELINE = "pipeline"  # as they are
    EXCHANGE = "exchange"  # by keys
    REBALANCE = "rebalance"
    GATHER = "gather"
    BROADCAST = "broadcast"  # each row once a task


def partitioned(df: DataFrame, strategy: PartitionStrategy, keys: Sequence[Column] = (), to: int | None = None) -> DataFrame:
    if (strategy is PartitionStrategy.EXCHANGE) != bool(keys):
        raise ConfigError("an exchange, and only that, needs keys")
    if strategy is PartitionStrategy.EXCHANGE:
        return exchange(df, keys, to)
    if strategy is PartitionStrategy.REBALANCE:
        return rebalance(df, to)
    if strategy is PartitionStrategy.GATHER:
        return gather(df)
    return broadcast_copy(df, _parallelism(df, to)) if strategy is PartitionStrategy.BROADCAST else df
