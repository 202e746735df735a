"""A Spark session with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, RocksDB state.  conf: further settings, with _ for . in their names."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.scheduler.mode": "FAIR",
    }
    settings.update({k.replace("_", "."): v for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
