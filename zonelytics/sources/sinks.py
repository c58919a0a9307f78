"""Tables, files and message sinks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonelytics.functions.timebins import span_col


def overwrite_table(df: DataFrame, table: str, partition_by: str | None = None) -> None:
    """Full reload including the schema."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.partitionBy(partition_by) if partition_by else writer).saveAsTable(table)


def append_table(df: DataFrame, table: str) -> None:
    df.write.mode("append").format("parquet").saveAsTable(table)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Idempotent increment: only the partitions present in ``df`` are rewritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def derive_date(df: DataFrame) -> DataFrame:
    """Partition date from ``timestamp``, else ``date``, else ``ship_date``."""
    for name in ("timestamp", "date", "ship_date"):
        if name in df.columns:
            return df.withColumn("date", F.to_date(name))
    raise ValueError("no column to derive a date from")


def write_partitioned(df: DataFrame, path: str, mode: str = "append", files_per_partition: int = 1) -> None:
    """Parquet by site and date (date alone when there is no site column).

    A spread column keeps a hot partition from landing in a single task: with
    ``files_per_partition`` > 1 its rows are divided by hash over that many writers.
    """
    dated = derive_date(df)
    keys = (["greenhouse_id"] if "greenhouse_id" in df.columns else []) + ["date"]
    if files_per_partition > 1:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]), F.lit(files_per_partition))
        dated = dated.withColumn("_spread", salt).repartition(*keys, "_spread").drop("_spread")
    dated.write.mode(mode).partitionBy(*keys).parquet(path)


def write_hashed(df: DataFrame, table: str, key: str = "greenhouse_id", buckets: int = 16, sort_by: str = "timestamp") -> None:
    """Hash-bucketed table: joins and aggregates on ``key`` need no exchange, filters on it prune buckets."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(sort_by).saveAsTable(table)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def to_messages(df: DataFrame, event_type: str) -> DataFrame:
    """Rows as JSON text with the ``event_type`` envelope, ready for a file or Kafka sink."""
    body = df.withColumn("event_type", F.lit(event_type))
    return body.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


def publish(df: DataFrame, event_type: str, path: str | None = None) -> int:
    """Append messages as text files and return their number; without a path only count (dry run)."""
    messages = to_messages(df, event_type)
    if path is None:
        return df.count()
    from pyspark.sql import Observation

    seen = Observation()
    messages.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").text(path)
    return seen.get["n"]


def create_table(spark: SparkSession, table: str, schema: T.StructType, partition_by: str | None = None) -> None:
    """An empty table of the given schema."""
    overwrite_table(spark.createDataFrame([], schema), table, partition_by)


def merge_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Create-or-merge evolution: declared columns are added, extra ones are never dropped."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    out = df.withColumns(missing) if missing else df
    return out.select(*schema.fieldNames(), *[c for c in df.columns if c not in schema.fieldNames()])


def table_rows(spark: SparkSession, table: str) -> int:
    """Row count of the written table: a scan without columns, not the plan again."""
    return spark.table(table).count()


def retained(df: DataFrame, as_of: datetime | str, days: int = 730, ts: str = "timestamp") -> DataFrame:
    """Rows within the retention period; the date column, when there is one, prunes partitions."""
    limit = F.lit(as_of).cast("timestamp") - span_col(timedelta(days=days))
    kept = df.filter(F.col(ts) >= limit)
    return kept.filter(F.col("date") >= F.to_date(limit)) if "date" in df.columns else kept


def write_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def enrich(df: DataFrame, config: DataFrame) -> DataFrame:
    """Enrichment on ingest: configuration columns added, its duplicates of the key columns dropped."""
    from zonelytics.operators.joins import lookup

    return lookup(df, config, "zone_id")
