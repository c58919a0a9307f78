"""Session set-up and the few settings the library relies on."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


#: partitions of streaming state; unset: the session's shuffle partitions
STATE_PARTITIONS = "spark.zonelytics.statePartitions"


def local_session(app: str = "zonelytics", cores: str | int = "*", shuffle: int = 8, extra: dict[str, str] | None = None) -> SparkSession:
    """A session for tests and the bench. On a cluster use the session you are given."""
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .config(map=extra or {})
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(STATE_PARTITIONS, str(shuffle))
        .getOrCreate()
    )


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan here assumes; all are safe to set on a live session.

    Nothing forces a broadcast: lookups reach a broadcast join only through
    ``autoBroadcastJoinThreshold`` or AQE's runtime size, and fall back to a
    sort-merge join with skew splitting beyond it.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for streaming checkpoints and cut lineage.

    It lies under ``spark.checkpoint.dir``, the shared folder named by the
    cluster, or, where that is unset, beside the tables of the warehouse. Each
    application has one root there, ``zonelytics-<application id>``, which its
    owner can drop when it has ended.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    return f"{base.rstrip('/')}/zonelytics-{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def cut(df, purpose: str):
    """Write an intermediate result to the shared folder and continue from there.

    For small results of a large pass that several later steps read: the pass
    runs once, and a lost executor costs a re-read instead of a recomputation.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def sized_state(spark: SparkSession):
    """While a stream starts: as many state partitions as ``STATE_PARTITIONS`` says.

    The number is fixed for the life of a checkpoint.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get(STATE_PARTITIONS, before))
    try:
        yield
    finally:
        spark.conf.set(name, before)
