"""Raw -> cleaned -> star, as pure functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonelytics import schemas
from zonelytics.functions import formulas as fm
from zonelytics.operators.latest import first_per_key


def parsed_ts(df: DataFrame, name: str = "timestamp"):
    """A timestamp whatever the raw column holds; unreadable text becomes NULL instead of failing."""
    text = isinstance(df.schema[name].dataType, T.StringType)
    return F.try_to_timestamp(F.col(name)) if text else F.col(name).cast("timestamp")


def _stamped(df: DataFrame, hour: bool = True) -> DataFrame:
    out = df.withColumn("timestamp", parsed_ts(df)).filter(F.col("timestamp").isNotNull())
    return out.withColumns({"date": F.to_date("timestamp"), **({"hour": F.hour("timestamp")} if hour else {})})


# --- cleaned layer --------------------------------------------------------------

def clean_sensors(raw: DataFrame) -> DataFrame:
    """Valid readings, one per (timestamp, zone); the survivor of a duplicate is the smallest row."""
    valid = _stamped(raw).filter(fm.valid_reading())
    rest = [F.col(c).asc() for c in raw.columns if c not in ("timestamp", "zone_id")]
    unique = first_per_key(valid, ["timestamp", "zone_id"], rest)
    return unique.withColumn("vpd_calculated", fm.vpd_kpa("air_temperature", "air_humidity"))


def clean_weather(raw: DataFrame) -> DataFrame:
    return _stamped(raw).withColumns(
        {
            "heat_index": fm.heat_index("outside_temperature", "outside_humidity"),
            "wind_chill": fm.wind_chill("outside_temperature", "wind_speed"),
        }
    )


def clean_equipment(raw: DataFrame) -> DataFrame:
    return _stamped(raw, hour=False).withColumns(
        {"is_heating": F.col("heating_output") > 0, "is_cooling": F.col("cooling_output") > 0, "is_ventilating": F.col("vent_position") > 5}
    )


def clean_harvests(raw: DataFrame) -> DataFrame:
    return (
        raw.withColumn("date", F.to_date("date"))
        .filter("harvest_weight_kg >= 0")
        .withColumn("total_weight_kg", F.col("harvest_weight_kg") + F.col("waste_kg"))
    )


def clean_energy(raw: DataFrame) -> DataFrame:
    """Utility rows; rows without a readable time are kept here (their date is NULL)."""
    return raw.withColumn("timestamp", parsed_ts(raw)).withColumns(
        {
            "date": F.to_date("timestamp"),
            "hour": F.hour("timestamp"),
            "water_recycling_pct": fm.recycling_pct("water_liters", "water_recycled_liters"),
        }
    )


def clean_shipments(raw: DataFrame) -> DataFrame:
    return raw.withColumn("ship_date", parsed_ts(raw, "ship_date")).withColumn("date", F.to_date("ship_date"))


# --- star layer --------------------------------------------------------------------

def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the declared columns and types of a star table; a missing column is an error."""
    schema = {**schemas.FACTS, **schemas.DIMS}[table]
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def fact_daily_harvest(clean: DataFrame) -> DataFrame:
    return conform(clean.withColumn("harvest_date", F.col("date")), "fact_daily_harvest")


def fact_zone_daily_environment(clean: DataFrame, setpoints: DataFrame, interval_seconds: int = 30) -> DataFrame:
    daily = clean.groupBy("date", "zone_id", "greenhouse_id").agg(
        F.avg("air_temperature").alias("avg_temp"), F.min("air_temperature").alias("min_temp"), F.max("air_temperature").alias("max_temp"),
        F.avg("air_humidity").alias("avg_humidity"), F.avg("co2_level").alias("avg_co2"), fm.dli("par_light", interval_seconds).alias("total_dli"),
        F.avg("vpd").alias("avg_vpd"), F.avg("substrate_ec").alias("avg_ec"), F.avg("substrate_ph").alias("avg_ph"),
    )
    targets = setpoints.select("zone_id", F.col("target_temperature").alias("_target"))
    joined = daily.join(targets, "zone_id", "left").withColumn("temp_excursion_hours", fm.excursion_hours("avg_temp", "_target"))
    return conform(joined.withColumn("hours_in_optimal_range", F.lit(24.0) - F.col("temp_excursion_hours")), "fact_zone_daily_environment")


def fact_daily_energy(clean: DataFrame, harvest: DataFrame) -> DataFrame:
    names = ("electricity_kwh", "natural_gas_m3", "water_liters", "water_recycled_liters", "co2_purchased_kg")
    daily = clean.groupBy("date", "greenhouse_id").agg(*[F.sum(c).alias(c) for c in names])
    kg = harvest.groupBy(F.col("harvest_date").alias("date"), "greenhouse_id").agg(F.sum("harvest_weight_kg").alias("_kg"))
    costed = daily.withColumn("energy_cost_usd", fm.energy_cost("electricity_kwh", "natural_gas_m3"))
    joined = costed.join(kg, ["date", "greenhouse_id"], "left")
    return conform(joined.withColumn("energy_per_kg_produce", fm.cost_per_kg("energy_cost_usd", "_kg")), "fact_daily_energy")


def fact_shipments(clean: DataFrame) -> DataFrame:
    """Order lines; the ordered quantity is 0 where the source does not carry it."""
    ordered = F.col("quantity_ordered") if "quantity_ordered" in clean.columns else F.lit(0)
    rows = clean.withColumns(
        {
            "quantity_ordered": ordered,
            "product_id": F.col("product_sku"),
            "on_time_flag": fm.on_time("delivery_status"),
            "ship_date": F.col("date"),
        }
    )
    return conform(rows, "fact_shipments")


def fact_weekly_crop_health(clean: DataFrame, config: DataFrame) -> DataFrame:
    """Weekly proxies of a growth model; the random parts are hashes of (zone, week), hence repeatable."""
    weekly = clean.groupBy(F.date_trunc("week", "date").cast("date").alias("week_start"), "zone_id", "greenhouse_id").agg(
        F.avg("air_temperature").alias("_temp"), F.avg("par_light").alias("_par")
    )
    chance = lambda salt: fm.unit_hash("zone_id", "week_start", F.lit(salt))
    rows = weekly.join(config.select("zone_id", "crop_id"), "zone_id", "left").withColumns(
        {
            "avg_plant_height_cm": F.lit(25.0) + chance("height") * 15,
            "avg_leaf_count": F.lit(8.0) + chance("leaves") * 6,
            "predicted_quality_grade": fm.climate_grade("_temp"),
            "predicted_yield_kg": F.col("_par") * 0.5 + chance("yield") * 50,
        }
    )
    return conform(rows, "fact_weekly_crop_health")


def fact_anomaly_events(history: DataFrame) -> DataFrame:
    """Anomaly events from the resolved-incident history; unknown figures stay NULL."""
    rows = history.withColumns(
        {
            "event_id": F.col("anomaly_id"),
            "end_time": F.col("resolved_time"),
            "zone_ids": F.array_join("zone_ids", ","),
            "anomaly_type": F.col("scenario"),
            "severity": F.when(F.col("severity") >= 0.7, "critical").otherwise("warning"),
            "root_cause": F.col("metadata")["root_cause"],
            "estimated_loss_usd": F.col("metadata")["estimated_loss_usd"].try_cast("double"),
            "prevented_loss_usd": F.col("metadata")["prevented_loss_usd"].try_cast("double"),
            "response_time_minutes": F.col("duration_seconds") / 60,
            "resolution_status": F.when(F.col("auto_resolved"), "auto_resolved").otherwise("resolved"),
        }
    )
    return conform(rows, "fact_anomaly_events")


def run_star(tables: dict[str, DataFrame], config: DataFrame) -> dict[str, DataFrame]:
    """All facts from the six cleaned tables (names as in the raw layout) and, where given, ``anomaly_history``."""
    harvest = fact_daily_harvest(tables["daily_harvest"])
    events = {"fact_anomaly_events": fact_anomaly_events(tables["anomaly_history"])} if "anomaly_history" in tables else {}
    return {
        "fact_daily_harvest": harvest,
        "fact_zone_daily_environment": fact_zone_daily_environment(tables["iot_telemetry"], config),
        "fact_daily_energy": fact_daily_energy(tables["energy"], harvest),
        "fact_shipments": fact_shipments(tables["shipments"]),
        "fact_weekly_crop_health": fact_weekly_crop_health(tables["iot_telemetry"], config),
        **events,
    }


CLEANERS = {
    "iot_telemetry": clean_sensors,
    "weather": clean_weather,
    "equipment": clean_equipment,
    "daily_harvest": clean_harvests,
    "energy": clean_energy,
    "shipments": clean_shipments,
}
