"""Folders as streams: a sender that writes epochs, and the frame that reads them."""

from __future__ import annotations

import asyncio
import logging
import os
import uuid
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..timed import TimedFrame

log = logging.getLogger(__name__)

#: The epoch of the row that close() sends; no data may have it.
SENTINEL = 1 << 33


class EpochFolder:
    """The sending end of a stream: send(epoch, rows), advance_to(epoch), close().

    Each call writes a file; a stream over the folder takes files in the order of their times.  advance_to seals
    the epochs before it, and close all epochs, by a marker row that no output shows.
    """

    def __init__(self, path: str, schema: pa.Schema):
        self.path, self.n, self.frontier, self.closed = path, 0, 0, False
        self.schema = pa.schema([pa.field("epoch", pa.int64()), pa.field("seq", pa.int64()), *schema, pa.field("marker", pa.bool_())])
        self.sent = 0
        os.makedirs(path, exist_ok=True)

    def _write(self, rows: list[tuple]) -> None:
        t = pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(self.schema)], schema=self.schema)
        tmp = os.path.join(self.path, f".{uuid.uuid4().hex}.tmp")
        pq.write_table(t, tmp)
        os.utime(tmp, (1_600_000_000 + self.n, 1_600_000_000 + self.n))
        os.rename(tmp, os.path.join(self.path, f"{self.n:08d}.parquet"))
        self.n += 1

    def send(self, epoch: int, rows: Sequence[Any]) -> None:
        """Late rows, of epochs that are sealed, are sent as others are."""
        if self.closed:
            raise ConfigError("the input is closed")
        if not 0 <= epoch < SENTINEL:
            raise ConfigError("epoch out of range")
        if not rows:
            return
        full = [(epoch, self.sent + k, *(r if isinstance(r, tuple) else (r,)), False) for k, r in enumerate(rows)]
        self.sent += len(rows)
        self._write(full)

    def _mark(self, epoch: int) -> None:
        self._write([(epoch, None, *([None] * (len(self.schema) - 3)), True)])

    def advance_to(self, epoch: int) -> None:
        if epoch < self.frontier:
            log.warning("advance_to(%s) lies before %s and is ignored", epoch, self.frontier)
            return
        self.frontier = epoch
        self._mark(epoch)

    def close(self) -> None:
        if not self.closed:
            self._mark(SENTINEL)
            self.closed = True

    def __enter__(self) -> EpochFolder:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class FrameFolder:
    """The same sending end for whole DataFrames, written by Spark to any folder that it can reach: send(df) with the
    columns epoch, seq and those of schema, advance_to(epoch), close()."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.frontier, self.closed, self.schema = spark, path, 0, False, schema

    def _write(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def send(self, df: DataFrame) -> None:
        if self.closed:
            raise ConfigError("the input is closed")
        empty = self.spark.createDataFrame([], f"epoch long, seq long, {self.schema}, marker boolean")
        self._write(empty.unionByName(df.withColumn("marker", F.lit(False))))

    def _mark(self, epoch: int) -> None:
        self._write(self.spark.createDataFrame([(epoch, True)], "epoch long, marker boolean"))

    def advance_to(self, epoch: int) -> None:
        if epoch < self.frontier:
            log.warning("advance_to(%s) lies before %s and is ignored", epoch, self.frontier)
            return
        self.frontier = epoch
        self._mark(epoch)

    def close(self) -> None:
        if not self.closed:
            self._mark(SENTINEL)
            self.closed = True


class AsyncSender:
    """An EpochFolder for coroutines: its calls are awaited and made in a thread, one after another."""

    def __init__(self, folder: EpochFolder):
        self.folder, self._turn = folder, asyncio.Lock()

    async def _call(self, f, *args) -> None:
        async with self._turn:
            await asyncio.to_thread(f, *args)

    async def send(self, epoch: int, rows: Sequence[Any]) -> None:
        await self._call(self.folder.send, epoch, rows)

    async def advance_to(self, epoch: int) -> None:
        await self._call(self.folder.advance_to, epoch)

    async def close(self) -> None:
        await self._call(self.folder.close)


def stream_from_dir(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> TimedFrame:
    """A streaming frame over an EpochFolder; the marker rows are still in it (streaming.sealed removes them)."""
    if files_per_trigger < 1:
        raise ConfigError("capacity must be 1 at least")
    df = spark.readStream.schema(f"epoch long, seq long, {schema}, marker boolean").option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return TimedFrame(df, seq="seq")
