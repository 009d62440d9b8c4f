"""Session settings the library relies on, and the shared folder it writes scratch tables to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession

# Settings that can be changed on a running session.
RUNTIME_CONF = {
    # A day is a UTC day and a minute is a UTC minute, for counts and uniques alike.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Repeated keys inside `properties` keep the last value instead of failing the line.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Sketch aggregation holds one buffer (about 16 KB) per (name, day) of a task; the default of
    # 128 groups would fall back to sorting the raw rows.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "2048",
    # "First N of each group" filters rows before the shuffle for N up to this bound.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    # Lists of ids up to this length go down to the Parquet scan, which skips pages without them.
    "spark.sql.parquet.pushdown.inFilterThreshold": "100",
    # Ids of all history live on local disk, not on the JVM heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def conf_for_input(total_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a batch job over `total_bytes` of input.

    Read and shuffle partitions of about `partition_bytes` fit an executor core's share of memory.
    The number of shuffle partitions is an upper limit: adaptive execution joins small ones up to
    the advisory size and splits skewed ones.
    """
    partitions = max(-(-total_bytes // partition_bytes), 200)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "minutemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the runtime settings applied; `conf` keys use `__` for the dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Tasks of a micro-batch: at most so many for each core, but not fewer than STREAM_TASKS on a cluster that has yet to grow.
TASKS_PER_CORE, STREAM_TASKS = 2, 32


@contextmanager
def stream_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside deal their state and their batches to a number of tasks that follows the cores.

    `spark.sql.shuffle.partitions` follows the size of whole tables. A micro-batch is bounded and is not coalesced by
    adaptive execution, so with that number each batch would open, commit and report a state store for every
    partition, and both batches and partitions would grow with the input. A stream keeps its number in its
    checkpoint, so one that was started before goes on with the one it has.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    most = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, STREAM_TASKS)
    spark.conf.set(key, str(min(int(before), most)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="run-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of the cluster (`spark.checkpoint.dir`).

    Executors and a restarted driver must all see it, so a machine-local folder is used in local
    mode only, where the setting is usually absent.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
