"""Streaming sources, routing and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonelytics import schemas
from zonelytics.session import ROCKSDB_PROVIDER
from zonelytics.sources.manifest import new_folder, read_manifest, replace_manifest
from zonelytics.sources.readers import of_kind, typed_messages

DEFAULT_DELAY = "2 minutes"


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB: it spills to disk, so many keys do not press on executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Messages as text in ``value`` (needs the Kafka connector on the class path)."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return source.load().select(F.col("value").cast("string").alias("value"), "timestamp")


def event_time(df: DataFrame, ts: str = "timestamp", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Watermarked stream; a zone-less timestamp is read as UTC first."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def write_files(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None, mode: str = "append"):
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start()


def write_batches(df: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    return df.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save_snapshot(path: str) -> Callable[[DataFrame, int], None]:
    """Complete-mode sink: every batch writes the whole (small) view to a folder of its own, which the manifest then names; replays do so again."""

    def save(batch: DataFrame, batch_id: int) -> None:
        folder = new_folder(path, f"batch-{batch_id}")
        batch.write.parquet(folder)
        replace_manifest(batch.sparkSession, path, {"batch": batch_id, "folder": folder})

    return save


def newest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The view as of the last batch; older ones are not listed."""
    return spark.read.parquet(read_manifest(spark, path)["folder"])


def route_to_tables(root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: mixed JSON messages, parsed once and written once, partitioned by kind.

    A replayed batch overwrites its own sub-folder, so the result is exactly once. ``routed_table`` reads a kind.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        typed_messages(batch).write.mode("overwrite").partitionBy("kind").parquet(f"{root}/batch={batch_id:08d}")

    return save


def routed_table(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The routed messages of one kind; only its folders and its columns are read."""
    made = [T.StructField(name, schema) for name, schema in schemas.EVENT_TYPES.items()]
    stored = T.StructType([T.StructField("value", T.StringType()), *made, T.StructField("kind", T.StringType()), T.StructField("batch", T.StringType())])
    return of_kind(spark.read.schema(stored).option("basePath", root).parquet(root), kind)
