"""Session set-up: UTC, adaptive execution, skew handling."""

from __future__ import annotations

from pyspark.sql import SparkSession

UTC = "UTC"

# Settings that hold at any size. Executor counts, memory and the number of shuffle
# partitions belong to the cluster and are left to spark-submit.
DEFAULTS = {
    "spark.sql.session.timeZone": UTC,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword pairs override them."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Days, hours and periods are all UTC; a session built elsewhere must agree."""
    if spark.conf.get("spark.sql.session.timeZone") != UTC:
        spark.conf.set("spark.sql.session.timeZone", UTC)


def streaming_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A sibling session for streaming jobs, so the caller's settings stay untouched.

    State lives in RocksDB (off heap, spills to disk). The number of state partitions is
    fixed for the life of a checkpoint. Name it on a cluster that grows and shrinks; else it
    follows the cores seen now.
    """
    sibling = spark.newSession()
    sibling.conf.set("spark.sql.session.timeZone", UTC)
    sibling.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Commit the changes of a batch, not the whole state.
    sibling.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    partitions = state_partitions or spark.sparkContext.defaultParallelism
    sibling.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return sibling
