"""What the operators share: table reading, written cuts of lineage, checked broadcasts."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only after its rows were counted and found not to exceed this.
BROADCAST_ROWS = 2_000
#: Beyond that, the small side is copied to so many salts and the large side is dealt over them.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the cluster names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "tidemark")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and is not computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """What is run inside sends so many rows at a time to Python; for rows of long texts or large sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: How long release() waits for Spark's events.
EVENTS_MS = 10_000


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of frames that are out of use.  It follows the driver's garbage
    collection, which by itself may come long after the disks are full.

    Spark's event queues hold their last event until the next one, and with it the plan and the shuffle files of the
    query that ended last; so a statement without jobs comes between."""
    gc.collect()
    spark.sql("SELECT 1").collect()
    with contextlib.suppress(Py4JJavaError):  # events that take longer only leave files to the next release
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(EVENTS_MS)
    spark.sparkContext._jvm.System.gc()


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table made by written() that nothing will read again."""
    files = df.inputFiles()
    if not files:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The most bits of a filter of keys: 8 MB, whatever the number of keys.
FILTER_BITS = 1 << 26


def maybe_in(df: DataFrame, key: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of df whose 64-bit key may be in keys (a column of the same name): all that are, and some that are
    not.  Keeps wide rows that a join would drop out of its exchange.  how="left_anti": the other rows.

    keys become an array of bits, one a key, of bounded size, which is broadcast.  With more keys than bits it
    drops little, and the join gives the same rows all the same."""
    n = keys.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (8 * n).bit_length()))
    at = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(bits))
    set_ = keys.select(F.shiftright(at, 6).alias("i"), (at % 64).cast("int").alias("b")).select("i", F.expr("shiftleft(1L, b)").alias("w"))
    every = df.sparkSession.range(bits // 64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
    words = set_.groupBy("i").agg(F.bit_or("w").alias("w")).union(every).groupBy("i").agg(F.bit_or("w").alias("w"))
    filter_ = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("__words"))
    got = F.get(F.col("__words"), F.shiftright(F.col("__at"), 6).cast("int"))
    hit = got.bitwiseAND(F.expr("shiftleft(1L, cast(__at % 64 as int))"))
    return df.withColumn("__at", at).join(F.broadcast(filter_), hit != 0, how).drop("__at")


def join_small(big: DataFrame, small: DataFrame, keys: list[str], spread: str, how: str = "left") -> DataFrame:
    """Joins on null-safe keys.  small is broadcast if its counted rows are few, else copied to SALTS
    salts so that a hot key of big is dealt over as many tasks; spread names a column of big to deal by.
    small's key columns are dropped."""
    renamed = small.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [big[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys]
    drop = [f"__k_{k}" for k in keys]
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(renamed), on, how).drop(*drop)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = renamed.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = [salted[k].eqNullSafe(copies[f"__k_{k}"]) for k in keys] + [salted["__salt"] == copies["__salt2"]]
    return salted.join(copies, on, how).drop(*drop, "__salt", "__salt2")


def words_of(text) -> "F.Column":
    """The words of a text column as an array; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))
