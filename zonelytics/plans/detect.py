"""Named detection queries and stored functions over the event tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelytics.functions import formulas as fm
from zonelytics.functions.timebins import AsOf, as_of_col, binned, day_of_week_sun0, recent, span_col
from zonelytics.operators.joins import asof_join, lookup
from zonelytics.operators.latest import latest_per_key
from zonelytics.operators.series import decompose_anomalies, fir, make_series, slope

MIN, HOUR, DAY = timedelta(minutes=1), timedelta(hours=1), timedelta(days=1)
SITE = ["zone_id", "greenhouse_id"]


def temperature_anomalies(telemetry: DataFrame, as_of: AsOf = None, lookback=DAY, step=5 * MIN, threshold=1.5, fill=0.0) -> DataFrame:
    series = make_series(recent(telemetry, lookback, as_of), step, F.avg("air_temperature"), "avg_temp", SITE, fill=fill)
    found = decompose_anomalies(series, "avg_temp", SITE, threshold, step=step).filter("anomaly <> 0")
    return found.select(
        "timestamp", *SITE, "avg_temp", "baseline",
        F.when(F.col("anomaly") > 0, "spike").otherwise("dip").alias("anomaly_direction"), "score",
    ).orderBy(F.abs("score").desc(), "timestamp", "zone_id")


def nutrient_drift(telemetry: DataFrame, config: DataFrame, as_of: AsOf = None, lookback=6 * HOUR, step=10 * MIN, ph_limit=0.5, ec_limit=0.3) -> DataFrame:
    means = binned(recent(telemetry, lookback, as_of), SITE, step, F.avg("substrate_ph").alias("avg_ph"), F.avg("substrate_ec").alias("avg_ec"))
    both = lookup(means, config.select("zone_id", "target_ph", "target_ec"), "zone_id").withColumns(
        {"ph_deviation": F.col("avg_ph") - F.col("target_ph"), "ec_deviation": F.col("avg_ec") - F.col("target_ec")}
    )
    drift = (F.abs("ph_deviation") > ph_limit) & (F.abs("ec_deviation") > ec_limit)
    return both.filter(drift).select(
        "timestamp", *SITE, "avg_ph", "target_ph", "ph_deviation", "avg_ec", "target_ec", "ec_deviation"
    ).orderBy(F.col("timestamp").desc(), "zone_id")


def zone_health(telemetry: DataFrame, config: DataFrame, as_of: AsOf = None, lookback=15 * MIN) -> DataFrame:
    means = recent(telemetry, lookback, as_of).groupBy(*SITE).agg(
        *[F.avg(v).alias(f"avg_{p}") for v, _, p in fm.CHANNELS]
    )
    scored = lookup(means, config, "zone_id").withColumns(
        {f"{p}_score": fm.channel_score(f"avg_{p}", t, p) for _, t, p in fm.CHANNELS}
    )
    total = sum((F.col(f"{p}_score") for _, _, p in fm.CHANNELS), F.lit(0.0))
    scored = scored.withColumn("health_score", total / F.lit(float(len(fm.CHANNELS))))
    return scored.select(
        *SITE, "crop_name", "health_score", fm.health_status("health_score").alias("status"),
        *[f"{p}_score" for _, _, p in fm.CHANNELS],
    ).orderBy("health_score", "zone_id")


def heating_offline(telemetry: DataFrame, equipment: DataFrame, config: DataFrame, as_of: AsOf = None, lookback=30 * MIN, margin=2.0, tie=()) -> DataFrame:
    """Cold readings of zones whose newest equipment row shows no heating."""
    now = as_of_col(telemetry, as_of)
    state = latest_per_key(recent(equipment, lookback, now), ["zone_id"], tie=tie).select("zone_id", "heating_output")
    cold = lookup(recent(telemetry, lookback, now), config.select("zone_id", "target_temperature"), "zone_id").filter(
        F.col("air_temperature") < F.col("target_temperature") - margin
    )
    return lookup(cold, state.filter("heating_output = 0"), "zone_id").select(
        "timestamp", *SITE, "air_temperature", "target_temperature", "heating_output",
        F.lit("HEATING_OFFLINE_WHILE_COLD").alias("alert"),
    )


def heating_offline_asof(telemetry: DataFrame, equipment: DataFrame, config: DataFrame, margin=2.0, tie=()) -> DataFrame:
    """The same condition with the equipment row in force at each reading instead of the newest one."""
    state = equipment.select("zone_id", "timestamp", "heating_output", *tie)
    matched = asof_join(telemetry.select("timestamp", *SITE, "air_temperature"), state, ["zone_id"], prefix="eq_", tie=tie)
    cold = lookup(matched, config.select("zone_id", "target_temperature"), "zone_id").filter(
        (F.col("air_temperature") < F.col("target_temperature") - margin) & (F.col("eq_heating_output") == 0)
    )
    return cold.select("timestamp", *SITE, "air_temperature", "target_temperature", F.col("eq_timestamp").alias("state_time"))


def irrigation_failure(telemetry: DataFrame, equipment: DataFrame, as_of: AsOf = None, lookback=HOUR, step=5 * MIN, limit=-2.0, mode="slope") -> DataFrame:
    """Falling moisture in zones that reported zero flow.

    ``mode="sum"`` is the literal three-term moving sum of a percentage, which
    can never be negative; ``"slope"`` measures the fall per step.
    """
    now = as_of_col(telemetry, as_of)
    series = make_series(recent(telemetry, lookback, now), step, F.avg("substrate_moisture"), "moisture", ["zone_id"])
    trend = (
        fir(series, "moisture", [1.0, 1.0, 1.0], ["zone_id"], name="moisture_trend")
        if mode == "sum"
        else slope(series, "moisture", ["zone_id"], name="moisture_trend")
    )
    dry = recent(equipment, lookback, now).filter("irrigation_flow = 0").select("zone_id").distinct()
    return trend.filter(F.col("moisture_trend") < limit).join(dry, "zone_id", "left_semi").select(
        "timestamp", "zone_id", "moisture", "moisture_trend", F.lit("IRRIGATION_FAILURE_SUSPECTED").alias("alert")
    )


def vpd_out_of_range(telemetry: DataFrame, as_of: AsOf = None, lookback=2 * HOUR, step=10 * MIN, low=0.8, high=1.2) -> DataFrame:
    stats = binned(
        recent(telemetry, lookback, as_of), SITE, step,
        F.avg("vpd").alias("avg_vpd"), F.min("vpd").alias("min_vpd"), F.max("vpd").alias("max_vpd"),
    )
    label = fm.vpd_status("avg_vpd", "TOO_LOW_FUNGAL_RISK", "OK", "TOO_HIGH_WILT_RISK", low, high)
    return stats.filter((F.col("avg_vpd") < low) | (F.col("avg_vpd") > high)).select(
        "timestamp", *SITE, "avg_vpd", "min_vpd", "max_vpd", label.alias("vpd_status")
    ).orderBy(F.col("timestamp").desc(), "zone_id")


def year_over_year(hourly: DataFrame, as_of: AsOf = None, days: int = 7) -> DataFrame:
    """Last week against the same dates one year earlier, per site and weekday (0 = Sunday).

    The mean of hourly means is deliberately unweighted.
    """
    now = as_of_col(hourly, as_of)
    start = F.date_trunc("day", now - span_col(days * DAY))
    back = F.expr("INTERVAL -1 YEAR")

    def window(lo, hi, tag):
        return (
            hourly.filter(F.col("timestamp").between(lo, hi))
            .groupBy("greenhouse_id", day_of_week_sun0("timestamp").alias("day_of_week"))
            .agg(F.avg("avg_temp").alias(f"{tag}_avg_temp"), F.sum("reading_count").alias(f"{tag}_readings"))
        )

    both = window(start, now, "current").join(window(start + back, now + back, "prior"), ["greenhouse_id", "day_of_week"])
    return both.select(
        "greenhouse_id", "day_of_week", "current_avg_temp", "prior_avg_temp",
        (F.col("current_avg_temp") - F.col("prior_avg_temp")).alias("temp_change"),
    )


def cold_chain_weather(alerts: DataFrame, weather: DataFrame, as_of: AsOf = None, lookback=DAY, step=30 * MIN, mode="binned") -> DataFrame:
    """Cold-chain alerts with the outdoor temperature of their half hour.

    ``mode="exact"`` joins the raw alert time to the bin start, which only
    matches alerts on a bin boundary; ``"binned"`` bins the alert as well.
    """
    now = as_of_col(alerts, as_of)
    outside = binned(recent(weather, lookback, now), ["greenhouse_id"], step, F.avg("outside_temperature").alias("avg_outside_temp"))
    hit = recent(alerts, lookback, now).filter("alert_type = 'cold-chain-break'")
    slot = F.col("timestamp") if mode == "exact" else F.window("timestamp", f"{int(step.total_seconds())} seconds")["start"]
    joined = hit.withColumn("_slot", slot).join(
        outside.withColumnRenamed("timestamp", "_slot"), ["greenhouse_id", "_slot"], "left"
    )
    return joined.select(
        "timestamp", "alert_id", "greenhouse_id", "zone_id", "severity", "message", "anomaly_score", "avg_outside_temp"
    ).orderBy(F.col("timestamp").desc(), "alert_id")


def alert_summary(alerts: DataFrame, as_of: AsOf = None, lookback=DAY) -> DataFrame:
    counts = recent(alerts, lookback, as_of).groupBy("greenhouse_id", "alert_type").agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("critical", "warning", "info")],
        F.count_if("acknowledged").alias("acknowledged_count"),
    )
    return counts.withColumn("unacknowledged", F.col("total_alerts") - F.col("acknowledged_count")).orderBy(
        F.col("critical_count").desc(), F.col("total_alerts").desc(), "greenhouse_id", "alert_type"
    )


# --- stored functions ---------------------------------------------------------

def zone_sensor_deviation(telemetry: DataFrame, config: DataFrame, zone: str, lookback=HOUR, as_of: AsOf = None) -> DataFrame:
    """Readings of one zone with their signed distance from each set-point."""
    now = as_of_col(telemetry, as_of)
    rows = recent(telemetry.filter(F.col("zone_id") == zone), lookback, now)
    joined = lookup(rows, config.select("zone_id", *[t for _, t, _ in fm.CHANNELS]), "zone_id").withColumns(fm.deviations())
    pairs = [c for v, _, p in fm.CHANNELS for c in (v, f"{p}_deviation")]
    return joined.select(
        "timestamp", *SITE, *pairs, "par_light", "vpd", "water_flow_rate", "substrate_temperature", "substrate_moisture"
    )


def detect_sensor_anomalies(telemetry: DataFrame, zone: str, lookback=6 * HOUR, step=5 * MIN, as_of: AsOf = None, threshold=1.5) -> DataFrame:
    """Binned means of one zone; bins where temperature, humidity or CO2 is anomalous. No gap filling."""
    now = as_of_col(telemetry, as_of)
    rows = recent(telemetry.filter(F.col("zone_id") == zone), lookback, now)
    means = binned(
        rows, ["zone_id"], step, F.avg("air_temperature").alias("avg_temp"), F.avg("air_humidity").alias("avg_humidity"),
        F.avg("co2_level").alias("avg_co2"), F.avg("vpd").alias("avg_vpd"),
    )
    for name in ("temp", "humidity", "co2"):
        means = decompose_anomalies(means, f"avg_{name}", ["zone_id"], threshold, prefix=f"{name}_")
    flags = [F.col(f"{n}_anomaly").alias(f"{n}_anomaly_flag") for n in ("temp", "humidity", "co2")]
    return means.select("timestamp", "zone_id", "avg_temp", flags[0], "avg_humidity", flags[1], "avg_co2", flags[2], "avg_vpd").filter(
        "temp_anomaly_flag <> 0 OR humidity_anomaly_flag <> 0 OR co2_anomaly_flag <> 0"
    )


def zone_status_dashboard(latest: DataFrame, config: DataFrame) -> DataFrame:
    """Newest reading per zone with absolute deviations and the 0-100 health score."""
    joined = lookup(latest, config, "zone_id").withColumns(fm.deviations(signed=False))
    joined = joined.withColumn("health_score", fm.health_from_deviations())
    triples = [c for v, t, p in fm.CHANNELS for c in (v, t, f"{p}_deviation")]
    return joined.select(
        *SITE, "crop_name", "zone_name", "timestamp", *triples, "par_light", "vpd", "water_flow_rate",
        "substrate_temperature", "substrate_moisture", "health_score",
    ).orderBy("greenhouse_id", "zone_id")


def zone_status_now(telemetry: DataFrame, config: DataFrame, as_of: AsOf = None, lookback=2 * MIN, tie=()) -> DataFrame:
    rows = latest_per_key(recent(telemetry, lookback, as_of), ["zone_id"], tie=tie)
    joined = lookup(rows, config.select("zone_id", "target_temperature"), "zone_id")
    return joined.select(
        "zone_id", "air_temperature", "target_temperature",
        F.abs(F.col("air_temperature") - F.col("target_temperature")).alias("temp_deviation"), "air_humidity", "co2_level", "vpd",
    ).orderBy(F.col("temp_deviation").desc(), "zone_id")


def active_alerts(alerts: DataFrame, as_of: AsOf = None, lookback=DAY) -> DataFrame:
    return recent(alerts, lookback, as_of).filter(~F.col("acknowledged")).select(
        "timestamp", "zone_id", "alert_type", "severity", "message"
    ).orderBy(F.col("timestamp").desc(), "zone_id")


def equipment_snapshot(equipment: DataFrame, as_of: AsOf = None, lookback=2 * MIN, tie=()) -> DataFrame:
    return latest_per_key(recent(equipment, lookback, as_of), ["zone_id"], tie=tie).select(
        "zone_id", "heating_output", "cooling_output", "vent_position", "supplemental_light", "irrigation_pump"
    )
