"""Dashboard tile queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelytics.functions import formulas as fm
from zonelytics.functions.timebins import AsOf, as_of_col, bin_start, binned, minutes_between, recent
from zonelytics.operators.joins import lookup

MIN, HOUR = timedelta(minutes=1), timedelta(hours=1)

# --- fixed values: labels shown on the tiles ---------------------------------
TEMPERATURE_LABELS = ("🟢 On Target", "🟡 Warning", "🔴 Critical")
IRRIGATION_LABELS = ("🟢 Flowing", "🔴 Pump ON / No Flow", "⚫ Off")
HEATING_ON, COOLING_ON, OFF = "🟢 Active", "🔵 Active", "⚫ Off"
LIGHT_MARK, CO2_MARK, ACK_YES, ACK_NO = "🟡 ", "🟢 ", "✅", "❌"
VPD_LABELS = ("Low — Fungal Risk", "Optimal", "High — Wilt Risk")


def shown(c, places: int) -> Column:
    """Half-up rounding of a computed mean; noise below 1e-9 must not decide a tie."""
    return F.round(F.round(c, 9), places)


def zone_heatmap(latest: DataFrame, config: DataFrame) -> DataFrame:
    deviation = F.col("air_temperature") - F.col("target_temperature")
    return lookup(latest, config, "zone_id").select(
        "zone_id", "greenhouse_id", "crop_name", F.round("air_temperature", 1).alias("air_temperature"), "target_temperature",
        F.round(deviation, 1).alias("deviation"), fm.temperature_band(deviation, TEMPERATURE_LABELS).alias("deviation_status"),
        F.round("air_humidity", 0).alias("humidity"), F.round("co2_level", 0).alias("co2"), F.round("substrate_ph", 1).alias("ph"),
        F.col("timestamp").alias("last_update"),
    ).orderBy("greenhouse_id", "zone_id")


def selected_zone(latest: DataFrame, config: DataFrame, zone: str) -> DataFrame:
    close = F.abs(F.col("air_temperature") - F.col("target_temperature")) <= 2
    gauges = {
        "temperature": ("air_temperature", 1), "humidity": ("air_humidity", 0), "co2": ("co2_level", 0),
        "ph": ("substrate_ph", 2), "ec": ("substrate_ec", 2),
    }
    value = {n: F.round(c, d).alias(n) for n, (c, d) in gauges.items()}
    return lookup(latest.filter(F.col("zone_id") == zone), config, "zone_id").select(
        "zone_id", "crop_name", value["temperature"], F.col("target_temperature").alias("temp_target"),
        F.when(close, "OK").otherwise("ALERT").alias("temp_status"), value["humidity"], F.col("target_humidity").alias("humidity_target"),
        value["co2"], F.col("target_co2").alias("co2_target"), value["ph"], F.col("target_ph").alias("ph_target"),
        value["ec"], F.col("target_ec").alias("ec_target"), F.round("par_light", 0).alias("par_light"), F.round("vpd", 2).alias("vpd"),
        F.round("substrate_moisture", 1).alias("substrate_moisture"), F.round("water_flow_rate", 1).alias("water_flow"),
        F.col("timestamp").alias("last_reading"),
    )


def temperature_series(telemetry: DataFrame, as_of: AsOf = None, lookback=4 * HOUR, step=5 * MIN) -> DataFrame:
    return binned(recent(telemetry, lookback, as_of), ["zone_id", "greenhouse_id"], step, F.avg("air_temperature").alias("avg_temp")).orderBy(
        "timestamp", "zone_id"
    )


def _whole(c: str) -> Column:
    return F.format_string("%.1f", F.round(c, 0))


def equipment_status(latest: DataFrame, config: DataFrame) -> DataFrame:
    active = lambda c, on: F.when(F.col(c) > 0, on).otherwise(OFF)
    return lookup(latest, config, "zone_id").select(
        "zone_id", "greenhouse_id", "crop_name",
        active("heating_output", HEATING_ON).alias("heating_status"), active("cooling_output", COOLING_ON).alias("cooling_status"),
        fm.irrigation_status("irrigation_pump", "irrigation_flow", IRRIGATION_LABELS).alias("irrigation_status"),
        F.when(F.col("supplemental_light"), F.concat(F.lit(LIGHT_MARK), _whole("supplemental_light_watts"), F.lit("W"))).otherwise(OFF).alias("lighting_status"),
        F.when(F.col("co2_injection_rate") > 0, F.concat(F.lit(CO2_MARK), F.format_string("%.1f", F.round("co2_injection_rate", 1)), F.lit(" g/hr")))
        .otherwise(OFF).alias("co2_status"),
        F.concat(_whole("vent_position"), F.lit("% open")).alias("vent_status"),
        F.concat(_whole("thermal_curtain"), F.lit("% closed")).alias("curtain_status"), F.col("timestamp").alias("last_update"),
    ).orderBy("greenhouse_id", "zone_id")


def alert_ticker(alerts: DataFrame, as_of: AsOf = None, n: int = 20) -> DataFrame:
    now = as_of_col(alerts, as_of)
    top = alerts.orderBy(F.col("timestamp").desc(), F.col("alert_id").desc()).limit(n)
    return top.select(
        "timestamp", minutes_between("timestamp", now).alias("time_ago_min"), "severity", "alert_type", "zone_id", "greenhouse_id",
        "message", F.round("anomaly_score", 2).alias("anomaly_score"), F.when(F.col("acknowledged"), ACK_YES).otherwise(ACK_NO).alias("acknowledged"),
    )


def indoor_outdoor(telemetry: DataFrame, weather: DataFrame, as_of: AsOf = None, lookback=8 * HOUR, step=15 * MIN) -> DataFrame:
    now = as_of_col(telemetry, as_of)
    indoor = binned(recent(telemetry, lookback, now), ["greenhouse_id"], step, F.avg("air_temperature").alias("indoor"))
    outdoor = recent(weather, lookback, now).select(
        "greenhouse_id", bin_start(step).alias("timestamp"), "outside_temperature", "solar_radiation", "wind_speed"
    )
    return indoor.join(outdoor, ["greenhouse_id", "timestamp"]).select(
        "timestamp", "greenhouse_id", shown("indoor", 1).alias("indoor_avg_temp"), F.round("outside_temperature", 1).alias("outdoor_temp"),
        shown(F.col("indoor") - F.col("outside_temperature"), 1).alias("temp_delta"), F.round("solar_radiation", 0).alias("solar_radiation"),
        F.round("wind_speed", 1).alias("wind_speed"),
    ).orderBy("timestamp", "greenhouse_id")


def co2_per_zone(latest: DataFrame, config: DataFrame) -> DataFrame:
    return lookup(latest, config, "zone_id").select(
        "zone_id", "greenhouse_id", "crop_name", F.round("co2_level", 0).alias("co2_actual"), F.col("target_co2").alias("co2_target"),
        F.round(F.col("co2_level") - F.col("target_co2"), 0).alias("co2_deviation"), fm.co2_band("co2_level", "target_co2").alias("co2_status"),
    ).orderBy("greenhouse_id", "zone_id")


def vpd_trend(telemetry: DataFrame, as_of: AsOf = None, lookback=6 * HOUR, step=10 * MIN, low=0.8, high=1.2) -> DataFrame:
    trend = binned(recent(telemetry, lookback, as_of), ["zone_id", "greenhouse_id"], step, F.avg("vpd").alias("mean_vpd"))
    return trend.select(
        "timestamp", "zone_id", "greenhouse_id", shown("mean_vpd", 2).alias("avg_vpd"), F.lit(low).alias("optimal_low"),
        F.lit(high).alias("optimal_high"), fm.vpd_status("mean_vpd", *VPD_LABELS, lo=low, hi=high).alias("vpd_status"),
    ).orderBy("timestamp", "zone_id")
