"""Loops.

iterate() runs a body over whole frames until its feedback is dry; each round is cut from its lineage by a
table in the cluster's shared folder, so an executor's loss repeats one round.  fused() is for
bodies that look at one row only: the whole loop becomes one expression, without rounds or shuffles.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, NotConverged


@dataclass
class Step:
    """What a round gives: rows for the next round, rows that leave."""

    feedback: DataFrame
    output: DataFrame


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "tidemark")).rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back.  Unlike DataFrame.checkpoint() this forgets the optimizer's
    estimates, too: a join's is the product of its sides', so in a loop its digits double from round to round."""
    path = f"{shared_dir(df.sparkSession)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table made by checkpoint() that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def iterate(df: DataFrame, body: Callable[[DataFrame], Step], max_rounds: int = 100, counter: str = "iter") -> DataFrame:
    """Rows enter with counter 0; all rounds' outputs are the result, with the counter of their round."""
    if max_rounds < 1:
        raise ConfigError("a loop has one round at least")
    now, out = df.withColumn(counter, F.lit(0).cast("long")), None
    for _ in range(max_rounds):
        step = body(now)
        # one pass decides both sides, and both read what it wrote
        both = checkpoint(step.output.withColumn("__out", F.lit(True)).unionByName(step.feedback.withColumn("__out", F.lit(False))))
        left = both.where("__out").drop("__out")
        out = left if out is None else out.unionByName(left)
        back = both.where("not __out").drop("__out")
        if back.isEmpty():
            return out
        now = back.withColumn(counter, F.col(counter) + 1)
    raise NotConverged(f"feedback after {max_rounds} rounds")


def fused(df: DataFrame, value: str, step: Callable[[Column], Column], done: Callable[[Column], Column], max_rounds: int = 100, steps: str | None = None) -> DataFrame:
    """value becomes step(value) at least once and until done(value); steps: a column for the number of rounds.
    A row that is not done after max_rounds fails the flow."""
    start = F.struct(F.col(value).alias("v"), F.lit(0).cast("long").alias("k"), F.lit(False).alias("end"))
    kind = df.schema[value].dataType

    def once(acc, _):
        new = step(acc["v"]).cast(kind)
        return F.when(acc["end"], acc).otherwise(F.struct(new.alias("v"), (acc["k"] + 1).alias("k"), F.coalesce(done(new), F.lit(False)).alias("end")))

    f = df.withColumn("__loop", F.aggregate(F.sequence(F.lit(1), F.lit(max_rounds)), start, once))
    end = F.when(F.col("__loop.end"), F.col("__loop.v")).otherwise(F.raise_error(F.lit(f"feedback after {max_rounds} rounds")).cast(kind))
    f = f.withColumn(value, end)
    if steps:
        f = f.withColumn(steps, F.col("__loop.k"))
    return f.drop("__loop")


def rounds(start: DataFrame, body: Callable[[DataFrame], DataFrame], n: int, cut_every: int = 5) -> DataFrame:
    """Applies body n times; lineage is cut every so many rounds, and the table of the cut before goes."""
    now, last = start, None
    for k in range(1, n + 1):
        now = body(now)
        if k % cut_every == 0 and k < n:
            now = checkpoint(now)
            if last is not None:
                forget(last)
            last = now
    return now


def recursive(spark: SparkSession, name: str, anchor: str, step: str, result: str | None = None, max_depth: int = 100) -> DataFrame:
    """WITH RECURSIVE of an anchor and a step without aggregates, up to max_depth levels."""
    return spark.sql(f"WITH RECURSIVE {name} MAX RECURSION LEVEL {int(max_depth)} AS ({anchor} UNION ALL {step}) {result or f'SELECT * FROM {name}'}")
