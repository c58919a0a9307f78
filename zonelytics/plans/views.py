"""The four maintained views; the same function serves batch rebuild and streaming input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelytics.sources.manifest import new_folder, read_manifest, replace_manifest
from zonelytics.functions.timebins import binned, seconds
from zonelytics.operators.latest import latest_per_key

HOUR, DAY = 3600, 86400

# --- fixed values: averaged channel and its name in the hourly view ----------
HOURLY_AVERAGES = {
    "air_temperature": "avg_temp",
    "air_humidity": "avg_humidity",
    "co2_level": "avg_co2",
    "par_light": "avg_par",
    "vpd": "avg_vpd",
    "substrate_temperature": "avg_substrate_temp",
    "substrate_moisture": "avg_substrate_moisture",
    "substrate_ec": "avg_ec",
    "substrate_ph": "avg_ph",
    "water_flow_rate": "avg_water_flow",
}


def zone_hourly_summary(telemetry: DataFrame, step: int = HOUR) -> DataFrame:
    aggs = [F.avg(c).alias(n) for c, n in HOURLY_AVERAGES.items()]
    aggs += [F.min("air_temperature").alias("min_temp"), F.max("air_temperature").alias("max_temp")]
    return binned(telemetry, ["zone_id", "greenhouse_id"], step, *aggs, F.count(F.lit(1)).alias("reading_count"))


def zone_latest_reading(telemetry: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    return latest_per_key(telemetry, ["zone_id"], tie=tie)


def equipment_latest_state(equipment: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    return latest_per_key(equipment, ["zone_id"], tie=tie)


def daily_alert_summary(alerts: DataFrame) -> DataFrame:
    return binned(
        alerts,
        ["greenhouse_id", "severity", "alert_type"],
        DAY,
        F.count(F.lit(1)).alias("alert_count"),
        F.avg("anomaly_score").alias("avg_anomaly_score"),
        F.count_if("acknowledged").alias("acknowledged_count"),
    )


def hourly_partials(telemetry: DataFrame, step: int = HOUR) -> DataFrame:
    """Mergeable form of the hourly view: sums and counts instead of averages."""
    aggs: list[Column] = []
    for c, n in HOURLY_AVERAGES.items():
        aggs += [F.sum(c).alias(f"sum_{n[4:]}"), F.count(c).alias(f"n_{n[4:]}")]
    aggs += [F.min("air_temperature").alias("min_temp"), F.max("air_temperature").alias("max_temp")]
    return binned(telemetry, ["zone_id", "greenhouse_id"], step, *aggs, F.count(F.lit(1)).alias("reading_count"))


def merge_partials(*parts: DataFrame) -> DataFrame:
    """Combine partials of a backfill and later increments; late bins add to existing ones."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    sums = [c for c in both.columns if c.startswith(("sum_", "n_"))] + ["reading_count"]
    return both.groupBy("zone_id", "greenhouse_id", "timestamp").agg(
        *[F.sum(c).alias(c) for c in sums], F.min("min_temp").alias("min_temp"), F.max("max_temp").alias("max_temp")
    )


def finish_partials(merged: DataFrame) -> DataFrame:
    averages = [
        F.try_divide(F.col(f"sum_{n[4:]}"), F.col(f"n_{n[4:]}")).alias(n) for n in HOURLY_AVERAGES.values()
    ]
    return merged.select("zone_id", "greenhouse_id", *averages, "min_temp", "max_temp", "reading_count", "timestamp")


def widen(partials: DataFrame, step: int) -> DataFrame:
    """Roll partials up to a coarser bin without reading the raw rows again."""
    coarse = F.window("timestamp", f"{seconds(step)} seconds")["start"]
    return merge_partials(partials.withColumn("timestamp", coarse))


def store_batch(partials: DataFrame, path: str, batch: int) -> None:
    """Add a batch of partials (the backfill is one, too) to a stored view; storing it again replaces it.

    The batch is written to a folder of its own and counts from the moment the manifest names it. A batch
    that a compaction has merged already is there, and is left out when it arrives again.
    """
    spark = partials.sparkSession
    known = read_manifest(spark, path) or {"batches": {}, "merged": []}
    if any(first <= batch <= last for first, last in known["merged"]):
        return
    folder = new_folder(path, f"batch-{batch}")
    partials.write.parquet(folder)
    replace_manifest(spark, path, {**known, "batches": {**known["batches"], str(batch): folder}})


def stored_partials(spark: SparkSession, path: str) -> DataFrame:
    """All partials the manifest names; folders of attempts that died are not read."""
    return spark.read.parquet(*read_manifest(spark, path)["batches"].values())


def stored_view(spark: SparkSession, path: str) -> DataFrame:
    """The view as of its stored batches: bins that several batches touch are merged on reading."""
    return finish_partials(merge_partials(stored_partials(spark, path)))


def compact_batches(spark: SparkSession, path: str) -> None:
    """One merged folder in place of all batches, for when small batches have piled up. Readers see the batches or it, never both."""
    known = read_manifest(spark, path)
    ids = sorted({*map(int, known["batches"])} - {-1})
    ranges = sorted([*known["merged"], *([i, i] for i in ids)])
    merged: list[list[int]] = []
    for first, last in ranges:
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    folder = new_folder(path, "compacted")
    merge_partials(stored_partials(spark, path)).write.parquet(folder)
    replace_manifest(spark, path, {"batches": {"-1": folder}, "merged": merged})
