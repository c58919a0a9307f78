"""Streaming twins of the maintained views and of cleaning steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelytics.operators.joins import lookup
from zonelytics.operators.latest import latest_incremental
from zonelytics.plans import views
from zonelytics.streaming.ingest import DEFAULT_DELAY, event_time


def hourly_summary(telemetry: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Append-mode hourly view: an hour is emitted once the watermark has passed its end."""
    return views.zone_hourly_summary(event_time(telemetry, delay=delay))


def daily_alerts(alerts: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    return views.daily_alert_summary(event_time(alerts, delay=delay))


def latest(df: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """Newest row per zone; run in complete or update mode (state: one row per zone)."""
    return latest_incremental(df, ["zone_id"], tie=tie)


def deduplicated(df: DataFrame, keys: list[str], ts: str = "timestamp", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Drops repeats that arrive within the delay; state is dropped behind the watermark."""
    return event_time(df, ts, delay).dropDuplicatesWithinWatermark(keys)


def enriched(telemetry: DataFrame, config: DataFrame) -> DataFrame:
    return lookup(telemetry, config, "zone_id")


def equipment_with_readings(equipment: DataFrame, telemetry: DataFrame, seconds: int = 30, delay: str = DEFAULT_DELAY, how: str = "inner") -> DataFrame:
    """Stream-stream join of rows of one zone less than ``seconds`` apart; the time bounds let Spark expire state on both sides.

    The equi-key is (zone, bin): a reading stands in its own bin and in both
    neighbours, and the bounds decide, so each pair is met once. ``how="left"``: equipment rows
    without a reading follow once the watermark has passed. ``reading_time`` is the reading's.
    """
    slot = F.floor(F.unix_seconds("timestamp") / seconds)
    e = event_time(equipment, delay=delay).withColumn("_bin", slot).alias("e")
    s = event_time(telemetry, delay=delay).withColumn("_bin", F.explode(F.array(slot - 1, slot, slot + 1))).alias("s")
    near = F.expr(f"s.timestamp > e.timestamp - INTERVAL {seconds} SECONDS AND s.timestamp < e.timestamp + INTERVAL {seconds} SECONDS")
    on = (F.col("e.zone_id") == F.col("s.zone_id")) & (F.col("e._bin") == F.col("s._bin")) & near
    picked = [F.col("s.air_temperature"), F.col("s.substrate_moisture"), F.unix_micros("s.timestamp").alias("reading_us"), F.col("s.event_id").alias("reading_id")]
    return e.join(s, on, how).select("e.*", *picked).drop("_bin")


#: order of readings around an equipment row: the nearest, then the earlier, last
NEAREST = ("_near", "_before", "_first")


def equipment_for_rule(equipment: DataFrame, telemetry: DataFrame, config: DataFrame, seconds: int = 30, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Input of the equipment rule: every equipment row with each reading near it, or none, and the set-points.

    The rule's own reduction to the last row of an interval also takes the nearest reading, by ``NEAREST`` behind the row's tie.
    """
    both = lookup(equipment_with_readings(equipment, telemetry, seconds, delay, "left"), config, "zone_id", "left")
    us = F.unix_micros("timestamp")
    first = F.when(F.col("reading_us") <= us, F.col("reading_id")).otherwise(-F.col("reading_id"))
    return both.withColumns({"_near": -F.abs(F.col("reading_us") - us), "_before": -F.col("reading_us"), "_first": first})
