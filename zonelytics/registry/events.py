"""Registered detection, tile, view and series queries over the event tables."""

from datetime import timedelta

from pyspark.sql import functions as F

from zonelytics.functions import formulas as fm
from zonelytics.functions.timebins import binned, recent
from zonelytics.operators.joins import asof_join, interval_join, lookup
from zonelytics.operators.latest import first_per_key, latest_incremental, ordered_list
from zonelytics.operators.series import decompose_anomalies, fir, make_series, mv_expand, slope, to_arrays
from zonelytics.plans import detect, tiles, views
from zonelytics.registry import cols, query
from zonelytics.sources import manifest
from zonelytics.session import work_dir

MIN, HOUR, DAY = timedelta(minutes=1), timedelta(hours=1), timedelta(days=1)
TIE = ("event_id",)

NOW = "(SELECT max(timestamp) FROM telemetry)"
NOW_A = "(SELECT max(timestamp) FROM alerts)"


def decompose_sql(source: str, value: str, by: str, prefix: str = "", threshold: str = "1.5e0") -> str:
    """The decomposition contract in SQL over a relation of bins (independent window formulation)."""
    return f"""
      SELECT *, CASE WHEN abs({prefix}score) > {threshold} THEN CAST(sign({prefix}score) AS INT) ELSE 0 END AS {prefix}anomaly
      FROM (SELECT * EXCLUDE (res, n, sd), CASE WHEN n < 3 OR sd <= 1e-9 THEN 0e0 ELSE res / sd END AS {prefix}score
        FROM (SELECT *, stddev_pop(res) OVER (PARTITION BY {by}) AS sd
          FROM (SELECT * EXCLUDE (slope, icpt, i), icpt + slope * i AS {prefix}baseline, {value} - (icpt + slope * i) AS res
            FROM (SELECT *, coalesce(regr_slope({value}, i) OVER (PARTITION BY {by}), 0e0) AS slope,
                coalesce(regr_intercept({value}, i) OVER (PARTITION BY {by}), avg({value}) OVER (PARTITION BY {by})) AS icpt,
                count({value}) OVER (PARTITION BY {by}) AS n
              FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY timestamp) - 1 AS DOUBLE) AS i FROM {source})))))"""


def series_sql(rows: str, value: str, name: str, by: str, minutes: int, fill: str = "0e0") -> str:
    """Gap-filled bins through an independent calendar join."""
    on = " AND ".join(f"b.{k} = g.{k}" for k in by.split(", "))
    gby = ", ".join(f"g.{k}" for k in by.split(", "))
    return f"""(WITH b AS (SELECT {by}, time_bucket(INTERVAL '{minutes}' MINUTE, timestamp) AS timestamp, {value} AS v
        FROM {rows} r GROUP BY ALL),
      g AS (SELECT {by}, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL '{minutes}' MINUTE)) AS timestamp
        FROM b GROUP BY {by})
      SELECT {gby}, g.timestamp, coalesce(b.v, {fill}) AS {name} FROM g LEFT JOIN b ON {on} AND b.timestamp = g.timestamp)"""


def rows_since(table: str, interval: str, now: str = NOW) -> str:
    return f"(SELECT * FROM {table} WHERE timestamp > {now} - INTERVAL {interval})"


# --- detection ------------------------------------------------------------------

_dq1 = decompose_sql(series_sql(rows_since("telemetry", "24 HOUR"), "avg(air_temperature)", "avg_temp", "zone_id, greenhouse_id", 5), "avg_temp", "zone_id, greenhouse_id")


@query("dq1_temperature_anomalies", f"""
  SELECT timestamp, zone_id, greenhouse_id, avg_temp, baseline, CASE WHEN anomaly > 0 THEN 'spike' ELSE 'dip' END AS anomaly_direction, score
  FROM ({_dq1}) WHERE anomaly <> 0""", cols("avg_temp baseline score"))
def _(t):
    return detect.temperature_anomalies(t.telemetry)


@query("dq2_nutrient_drift", f"""
  SELECT m.timestamp, m.zone_id, m.greenhouse_id, avg_ph, target_ph, avg_ph - target_ph AS ph_deviation, avg_ec, target_ec, avg_ec - target_ec AS ec_deviation
  FROM (SELECT zone_id, greenhouse_id, time_bucket(INTERVAL 10 MINUTE, timestamp) AS timestamp, avg(substrate_ph) AS avg_ph, avg(substrate_ec) AS avg_ec
        FROM {rows_since('telemetry', '6 HOUR')} GROUP BY ALL) m
  JOIN zone_config c ON c.zone_id = m.zone_id WHERE abs(avg_ph - target_ph) > 0.5e0 AND abs(avg_ec - target_ec) > 0.3e0""",
       cols("avg_ph ph_deviation avg_ec ec_deviation target_ph target_ec"))
def _(t):
    return detect.nutrient_drift(t.telemetry, t.zone_config)


@query("dq3_zone_health", f"""
  WITH s AS (SELECT m.*, c.crop_name, greatest(0e0, 1e2 - abs(tp - target_temperature) * 20) AS temp_score,
      greatest(0e0, 1e2 - abs(hu - target_humidity) * 5) AS humidity_score, greatest(0e0, 1e2 - abs(co - target_co2) * 0.2e0) AS co2_score,
      greatest(0e0, 1e2 - abs(ph - target_ph) * 100) AS ph_score, greatest(0e0, 1e2 - abs(ec - target_ec) * 50) AS ec_score
    FROM (SELECT zone_id, greenhouse_id, avg(air_temperature) AS tp, avg(air_humidity) AS hu, avg(co2_level) AS co, avg(substrate_ph) AS ph, avg(substrate_ec) AS ec
      FROM {rows_since('telemetry', '15 MINUTE')} GROUP BY ALL) m JOIN zone_config c ON c.zone_id = m.zone_id),
  h AS (SELECT *, (temp_score + humidity_score + co2_score + ph_score + ec_score) / 5e0 AS health_score FROM s)
  SELECT zone_id, greenhouse_id, crop_name, health_score, CASE WHEN health_score >= 85 THEN 'Healthy' WHEN health_score >= 60 THEN 'Warning' ELSE 'Critical' END AS status,
    temp_score, humidity_score, co2_score, ph_score, ec_score FROM h""", cols("health_score temp_score humidity_score co2_score ph_score ec_score"))
def zone_health(t):
    return detect.zone_health(t.telemetry, t.zone_config)


@query("dq4_heating_offline", f"""
  SELECT s.timestamp, s.zone_id, s.greenhouse_id, s.air_temperature, c.target_temperature, e.heating_output, 'HEATING_OFFLINE_WHILE_COLD' AS alert
  FROM {rows_since('telemetry', '30 MINUTE')} s
  JOIN (SELECT zone_id, arg_max(heating_output, timestamp) AS heating_output FROM {rows_since('equipment', '30 MINUTE')} GROUP BY 1) e ON e.zone_id = s.zone_id
  JOIN zone_config c ON c.zone_id = s.zone_id WHERE s.air_temperature < c.target_temperature - 2 AND e.heating_output = 0""")
def _(t):
    return detect.heating_offline(t.telemetry, t.equipment, t.zone_config, tie=TIE)


@query("dq4_heating_offline_earlier", f"""
  SELECT s.timestamp, s.zone_id, s.greenhouse_id, s.air_temperature, c.target_temperature, e.heating_output, 'HEATING_OFFLINE_WHILE_COLD' AS alert
  FROM (SELECT * FROM telemetry WHERE timestamp > {NOW} - INTERVAL 35 MINUTE) s
  JOIN (SELECT zone_id, arg_max(heating_output, timestamp) AS heating_output FROM equipment WHERE timestamp > {NOW} - INTERVAL 35 MINUTE AND timestamp <= {NOW} - INTERVAL 5 MINUTE GROUP BY 1) e ON e.zone_id = s.zone_id
  JOIN zone_config c ON c.zone_id = s.zone_id WHERE s.air_temperature < c.target_temperature - 2 AND e.heating_output = 0""")
def _(t):
    """The same detection as seen five minutes before the end of the log."""
    now = t.telemetry.agg(F.max("timestamp").alias("t")).scalar() - F.expr("INTERVAL 5 MINUTE")
    known = t.equipment.filter(F.col("timestamp") <= now)
    return detect.heating_offline(t.telemetry, known, t.zone_config, as_of=now, tie=TIE)


@query("jn16_heating_offline_asof", """
  SELECT s.timestamp, s.zone_id, s.greenhouse_id, s.air_temperature, c.target_temperature, e.timestamp AS state_time
  FROM telemetry s ASOF JOIN equipment e ON e.zone_id = s.zone_id AND s.timestamp >= e.timestamp
  JOIN zone_config c ON c.zone_id = s.zone_id WHERE s.air_temperature < c.target_temperature - 2 AND e.heating_output = 0""")
def _(t):
    return detect.heating_offline_asof(t.telemetry, t.equipment, t.zone_config, tie=TIE)


_moisture = series_sql(rows_since("telemetry", "1 HOUR"), "avg(substrate_moisture)", "moisture", "zone_id", 5)
_dry = f"(SELECT DISTINCT zone_id FROM {rows_since('equipment', '1 HOUR')} WHERE irrigation_flow = 0)"


@query("dq5_irrigation_failure", f"""
  SELECT timestamp, zone_id, moisture, moisture_trend, 'IRRIGATION_FAILURE_SUSPECTED' AS alert
  FROM (SELECT *, (moisture - lag(moisture, 2) OVER (PARTITION BY zone_id ORDER BY timestamp)) / 2e0 AS moisture_trend FROM {_moisture})
  WHERE moisture_trend < -2 AND zone_id IN (SELECT zone_id FROM {_dry})""", cols("moisture moisture_trend"))
def _(t):
    return detect.irrigation_failure(t.telemetry, t.equipment)


@query("dq5_irrigation_failure_sum", f"""
  SELECT timestamp, zone_id, moisture, moisture_trend, 'IRRIGATION_FAILURE_SUSPECTED' AS alert
  FROM (SELECT *, moisture + coalesce(lag(moisture, 1) OVER w, 0e0) + coalesce(lag(moisture, 2) OVER w, 0e0) AS moisture_trend FROM {_moisture} WINDOW w AS (PARTITION BY zone_id ORDER BY timestamp))
  WHERE moisture_trend < -2 AND zone_id IN (SELECT zone_id FROM {_dry})""", cols("moisture moisture_trend"))
def _(t):
    return detect.irrigation_failure(t.telemetry, t.equipment, mode="sum")


@query("dq6_vpd_out_of_range", f"""
  SELECT *, CASE WHEN avg_vpd < 0.8e0 THEN 'TOO_LOW_FUNGAL_RISK' ELSE 'TOO_HIGH_WILT_RISK' END AS vpd_status
  FROM (SELECT time_bucket(INTERVAL 10 MINUTE, timestamp) AS timestamp, zone_id, greenhouse_id, avg(vpd) AS avg_vpd, min(vpd) AS min_vpd, max(vpd) AS max_vpd
    FROM {rows_since('telemetry', '2 HOUR')} GROUP BY ALL) WHERE avg_vpd < 0.8e0 OR avg_vpd > 1.2e0""", cols("avg_vpd"))
def _(t):
    return detect.vpd_out_of_range(t.telemetry)


@query("dq6_vpd_narrow_band", f"""
  SELECT *, CASE WHEN avg_vpd < 1.02e0 THEN 'TOO_LOW_FUNGAL_RISK' ELSE 'TOO_HIGH_WILT_RISK' END AS vpd_status
  FROM (SELECT time_bucket(INTERVAL 10 MINUTE, timestamp) AS timestamp, zone_id, greenhouse_id, avg(vpd) AS avg_vpd, min(vpd) AS min_vpd, max(vpd) AS max_vpd
    FROM {rows_since('telemetry', '2 HOUR')} GROUP BY ALL) WHERE avg_vpd < 1.02e0 OR avg_vpd > 1.06e0""", cols("avg_vpd"))
def _(t):
    return detect.vpd_out_of_range(t.telemetry, low=1.02, high=1.06)


# The telemetry spans days, so the year-over-year query reads an hourly view made from order times.
_hourly_orders = """(SELECT greenhouse_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS timestamp, avg(electricity_kwh) AS avg_temp, count(*) AS reading_count FROM energy GROUP BY ALL)"""


@query("dq7_year_over_year", f"""
  WITH v AS (SELECT *, (SELECT max(timestamp) FROM {_hourly_orders}) AS now FROM {_hourly_orders}),
  cur AS (SELECT greenhouse_id, CAST(dayofweek(timestamp) AS INT) AS day_of_week, avg(avg_temp) AS current_avg_temp FROM v
    WHERE timestamp BETWEEN date_trunc('day', now - INTERVAL 7 DAY) AND now GROUP BY ALL),
  pri AS (SELECT greenhouse_id, CAST(dayofweek(timestamp) AS INT) AS day_of_week, avg(avg_temp) AS prior_avg_temp FROM v
    WHERE timestamp BETWEEN date_trunc('day', now - INTERVAL 7 DAY) - INTERVAL 1 YEAR AND now - INTERVAL 1 YEAR GROUP BY ALL)
  SELECT greenhouse_id, day_of_week, current_avg_temp, prior_avg_temp, current_avg_temp - prior_avg_temp AS temp_change FROM cur JOIN pri USING (greenhouse_id, day_of_week)""",
       cols("current_avg_temp prior_avg_temp temp_change"))
def _(t):
    hourly = binned(t.energy, ["greenhouse_id"], HOUR, F.avg("electricity_kwh").alias("avg_temp"), F.count(F.lit(1)).alias("reading_count"))
    return detect.year_over_year(hourly)


def _cold_sql(slot):
    return f"""
  SELECT a.timestamp, alert_id, a.greenhouse_id, zone_id, severity, message, anomaly_score, avg_outside_temp
  FROM {rows_since('alerts', '24 HOUR', NOW_A)} a
  LEFT JOIN (SELECT greenhouse_id, time_bucket(INTERVAL 30 MINUTE, timestamp) AS slot, avg(outside_temperature) AS avg_outside_temp
    FROM {rows_since('weather', '24 HOUR', NOW_A)} GROUP BY ALL) w ON w.greenhouse_id = a.greenhouse_id AND w.slot = {slot}
  WHERE alert_type = 'cold-chain-break'"""


@query("dq8_cold_chain_weather", _cold_sql("time_bucket(INTERVAL 30 MINUTE, a.timestamp)"), cols("avg_outside_temp anomaly_score"))
def _(t):
    return detect.cold_chain_weather(t.alerts, t.weather)


@query("dq8_cold_chain_weather_exact", _cold_sql("a.timestamp"), cols("avg_outside_temp anomaly_score"))
def _(t):
    return detect.cold_chain_weather(t.alerts, t.weather, mode="exact")


# All alert history against all weather: the two spans overlap there.
@query("jn3_alerts_weather_all", """
  SELECT a.timestamp, alert_id, a.greenhouse_id, zone_id, severity, message, anomaly_score, avg_outside_temp FROM alerts a
  LEFT JOIN (SELECT greenhouse_id, time_bucket(INTERVAL 30 MINUTE, timestamp) AS slot, avg(outside_temperature) AS avg_outside_temp
    FROM weather GROUP BY ALL) w ON w.greenhouse_id = a.greenhouse_id AND w.slot = time_bucket(INTERVAL 30 MINUTE, a.timestamp)
  WHERE alert_type = 'cold-chain-break'""", cols("avg_outside_temp anomaly_score"))
def _(t):
    return detect.cold_chain_weather(t.alerts, t.weather, lookback=timedelta(days=36500))


@query("dq9_alert_summary", f"""
  SELECT *, total_alerts - acknowledged_count AS unacknowledged FROM (
    SELECT greenhouse_id, alert_type, count(*) AS total_alerts, count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'warning') AS warning_count,
      count(*) FILTER (severity = 'info') AS info_count, count(*) FILTER (acknowledged) AS acknowledged_count
    FROM {rows_since('alerts', '24 HOUR', NOW_A)} GROUP BY ALL)""")
def _(t):
    return detect.alert_summary(t.alerts)


# --- tiles ------------------------------------------------------------------------

LATEST = "(SELECT * FROM telemetry QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY timestamp DESC, event_id DESC) = 1)"
LATEST_EQ = "(SELECT * FROM equipment QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY timestamp DESC, event_id DESC) = 1)"


def _latest(t):
    return views.zone_latest_reading(t.telemetry, TIE)


@query("tl1_zone_heatmap", f"""
  SELECT l.zone_id, l.greenhouse_id, crop_name, round(air_temperature, 1) AS air_temperature, target_temperature, round(air_temperature - target_temperature, 1) AS deviation,
    CASE WHEN abs(air_temperature - target_temperature) <= 1 THEN '🟢 On Target' WHEN abs(air_temperature - target_temperature) <= 3 THEN '🟡 Warning' ELSE '🔴 Critical' END AS deviation_status,
    round(air_humidity, 0) AS humidity, round(co2_level, 0) AS co2, round(substrate_ph, 1) AS ph, timestamp AS last_update
  FROM {LATEST} l JOIN zone_config c ON c.zone_id = l.zone_id""")
def _(t):
    return tiles.zone_heatmap(_latest(t), t.zone_config)


@query("tl2_selected_zone", f"""
  SELECT l.zone_id, crop_name, round(air_temperature, 1) AS temperature, target_temperature AS temp_target,
    CASE WHEN abs(air_temperature - target_temperature) <= 2 THEN 'OK' ELSE 'ALERT' END AS temp_status, round(air_humidity, 0) AS humidity, target_humidity AS humidity_target,
    round(co2_level, 0) AS co2, target_co2 AS co2_target, round(substrate_ph, 2) AS ph, target_ph AS ph_target, round(substrate_ec, 2) AS ec, target_ec AS ec_target,
    round(par_light, 0) AS par_light, round(vpd, 2) AS vpd, round(substrate_moisture, 1) AS substrate_moisture, round(water_flow_rate, 1) AS water_flow, timestamp AS last_reading
  FROM {LATEST} l JOIN zone_config c ON c.zone_id = l.zone_id WHERE l.zone_id = 'Z05'""")
def _(t):
    return tiles.selected_zone(_latest(t), t.zone_config, "Z05")


@query("tl3_temperature_series", f"""
  SELECT zone_id, greenhouse_id, time_bucket(INTERVAL 5 MINUTE, timestamp) AS timestamp, avg(air_temperature) AS avg_temp
  FROM {rows_since('telemetry', '4 HOUR')} GROUP BY ALL""", cols("avg_temp"))
def _(t):
    return tiles.temperature_series(t.telemetry)


@query("tl4_equipment_status", f"""
  SELECT l.zone_id, l.greenhouse_id, crop_name, CASE WHEN heating_output > 0 THEN '🟢 Active' ELSE '⚫ Off' END AS heating_status,
    CASE WHEN cooling_output > 0 THEN '🔵 Active' ELSE '⚫ Off' END AS cooling_status,
    CASE WHEN irrigation_pump AND irrigation_flow > 0 THEN '🟢 Flowing' WHEN irrigation_pump AND irrigation_flow = 0 THEN '🔴 Pump ON / No Flow' ELSE '⚫ Off' END AS irrigation_status,
    CASE WHEN supplemental_light THEN concat('🟡 ', printf('%.1f', round(supplemental_light_watts, 0)), 'W') ELSE '⚫ Off' END AS lighting_status,
    CASE WHEN co2_injection_rate > 0 THEN concat('🟢 ', printf('%.1f', round(co2_injection_rate, 1)), ' g/hr') ELSE '⚫ Off' END AS co2_status,
    concat(printf('%.1f', round(vent_position, 0)), '% open') AS vent_status, concat(printf('%.1f', round(thermal_curtain, 0)), '% closed') AS curtain_status, timestamp AS last_update
  FROM {LATEST_EQ} l JOIN zone_config c ON c.zone_id = l.zone_id""")
def _(t):
    return tiles.equipment_status(views.equipment_latest_state(t.equipment, TIE), t.zone_config)


@query("tl5_alert_ticker", f"""
  SELECT timestamp, CAST(date_diff('minute', timestamp, {NOW_A}) AS BIGINT) AS time_ago_min, severity, alert_type, zone_id, greenhouse_id, message,
    round(anomaly_score, 2) AS anomaly_score, CASE WHEN acknowledged THEN '✅' ELSE '❌' END AS acknowledged
  FROM alerts ORDER BY timestamp DESC, alert_id DESC LIMIT 20""")
def _(t):
    return tiles.alert_ticker(t.alerts)


@query("tl6_indoor_outdoor", f"""
  SELECT i.timestamp, i.greenhouse_id, i.v AS indoor_avg_temp, round(outside_temperature, 1) AS outdoor_temp, i.v - outside_temperature AS temp_delta,
    round(solar_radiation, 0) AS solar_radiation, round(wind_speed, 1) AS wind_speed
  FROM (SELECT greenhouse_id, time_bucket(INTERVAL 15 MINUTE, timestamp) AS timestamp, avg(air_temperature) AS v FROM {rows_since('telemetry', '8 HOUR')} GROUP BY ALL) i
  JOIN {rows_since('weather', '8 HOUR')} w ON w.greenhouse_id = i.greenhouse_id AND time_bucket(INTERVAL 15 MINUTE, w.timestamp) = i.timestamp""", cols("indoor_avg_temp temp_delta", 1))
def _(t):
    return tiles.indoor_outdoor(t.telemetry, t.weather)


@query("tl7_co2_per_zone", f"""
  SELECT l.zone_id, l.greenhouse_id, crop_name, round(co2_level, 0) AS co2_actual, target_co2 AS co2_target, round(co2_level - target_co2, 0) AS co2_deviation,
    CASE WHEN abs(co2_level - target_co2) <= 50 THEN 'On Target' WHEN co2_level < target_co2 THEN 'Below Target' ELSE 'Above Target' END AS co2_status
  FROM {LATEST} l JOIN zone_config c ON c.zone_id = l.zone_id""")
def _(t):
    return tiles.co2_per_zone(_latest(t), t.zone_config)


@query("tl8_vpd_trend", f"""
  SELECT timestamp, zone_id, greenhouse_id, v AS avg_vpd, 0.8e0 AS optimal_low, 1.2e0 AS optimal_high,
    CASE WHEN v < 0.8e0 THEN 'Low — Fungal Risk' WHEN v > 1.2e0 THEN 'High — Wilt Risk' ELSE 'Optimal' END AS vpd_status
  FROM (SELECT time_bucket(INTERVAL 10 MINUTE, timestamp) AS timestamp, zone_id, greenhouse_id, avg(vpd) AS v FROM {rows_since('telemetry', '6 HOUR')} GROUP BY ALL)""", cols("avg_vpd", 2))
def _(t):
    return tiles.vpd_trend(t.telemetry)


# --- views -------------------------------------------------------------------------

_HOURLY_SQL = """
  SELECT zone_id, greenhouse_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS timestamp, avg(air_temperature) AS avg_temp, min(air_temperature) AS min_temp, max(air_temperature) AS max_temp,
    avg(air_humidity) AS avg_humidity, avg(co2_level) AS avg_co2, avg(par_light) AS avg_par, avg(vpd) AS avg_vpd, avg(substrate_temperature) AS avg_substrate_temp,
    avg(substrate_moisture) AS avg_substrate_moisture, avg(substrate_ec) AS avg_ec, avg(substrate_ph) AS avg_ph, avg(water_flow_rate) AS avg_water_flow, count(*) AS reading_count
  FROM telemetry GROUP BY ALL"""
_HOURLY_DIGITS = cols(" ".join(views.HOURLY_AVERAGES.values()))


@query("mv1_zone_hourly_summary", _HOURLY_SQL, _HOURLY_DIGITS)
def _(t):
    return views.zone_hourly_summary(t.telemetry)


@query("mv2_zone_latest_reading", f"SELECT * FROM {LATEST}")
def _(t):
    return _latest(t)


@query("mv2_zone_latest_aggregate", f"SELECT * FROM {LATEST}")
def _(t):
    return latest_incremental(t.telemetry, ["zone_id"], tie=TIE)


@query("mv3_equipment_latest_state", f"SELECT * FROM {LATEST_EQ}")
def _(t):
    return views.equipment_latest_state(t.equipment, TIE)


@query("mv4_daily_alert_summary", """
  SELECT greenhouse_id, severity, alert_type, time_bucket(INTERVAL 1 DAY, timestamp) AS timestamp, count(*) AS alert_count, avg(anomaly_score) AS avg_anomaly_score,
    count(*) FILTER (acknowledged) AS acknowledged_count FROM alerts GROUP BY ALL""", cols("avg_anomaly_score"))
def _(t):
    return views.daily_alert_summary(t.alerts)


@query("mv5_backfill_and_increment", _HOURLY_SQL, _HOURLY_DIGITS)
def _(t):
    """Backfill up to an instant inside an hour, then merge the later rows into it."""
    cut = F.lit("2024-01-01 00:17:30").cast("timestamp")
    old, new = t.telemetry.filter(F.col("timestamp") < cut), t.telemetry.filter(F.col("timestamp") >= cut)
    return views.finish_partials(views.merge_partials(views.hourly_partials(old), views.hourly_partials(new)))


@query("mv5_stored_view", _HOURLY_SQL, _HOURLY_DIGITS)
def _(t):
    """A backfill and two increments kept in files; the second increment arrives twice, then the batches are compacted."""
    base = work_dir(t.spark, "view")
    late, last = (F.lit(x).cast("timestamp") for x in ("2024-01-01 00:17:30", "2024-01-01 00:41:10"))
    ts = F.col("timestamp")
    for batch, rows in ((0, ts < late), (1, (ts >= late) & (ts < last)), (2, ts >= last), (2, ts >= last)):
        views.store_batch(views.hourly_partials(t.telemetry.filter(rows)), f"{base}/batches", batch)
    views.compact_batches(t.spark, f"{base}/batches")
    return views.stored_view(t.spark, f"{base}/batches")


@query("mv5_manifest", _HOURLY_SQL, _HOURLY_DIGITS)
def _(t):
    """As above, with a compaction between the increments, an old batch arriving after it, and an attempt that died before its manifest."""
    base = work_dir(t.spark, "view")
    late, last = (F.lit(x).cast("timestamp") for x in ("2024-01-01 00:17:30", "2024-01-01 00:41:10"))
    ts = F.col("timestamp")
    parts = [views.hourly_partials(t.telemetry.filter(rows)) for rows in (ts < late, (ts >= late) & (ts < last), ts >= last)]
    views.store_batch(parts[0], base, 0)
    views.store_batch(parts[1], base, 1)
    views.compact_batches(t.spark, base)
    views.store_batch(parts[1], base, 1)
    parts[2].write.parquet(manifest.new_folder(base, "batch-2"))
    views.store_batch(parts[2], base, 2)
    views.compact_batches(t.spark, base)
    return views.stored_view(t.spark, base)


@query("mv5_widen_hourly_to_day", _HOURLY_SQL.replace("1 HOUR", "1 DAY"), _HOURLY_DIGITS)
def _(t):
    return views.finish_partials(views.widen(views.hourly_partials(t.telemetry), 86400))


# --- stored functions ----------------------------------------------------------------

@query("fn1_zone_sensor_deviation", f"""
  SELECT timestamp, s.zone_id, s.greenhouse_id, air_temperature, air_temperature - target_temperature AS temp_deviation, air_humidity, air_humidity - target_humidity AS humidity_deviation,
    co2_level, co2_level - target_co2 AS co2_deviation, substrate_ph, substrate_ph - target_ph AS ph_deviation, substrate_ec, substrate_ec - target_ec AS ec_deviation,
    par_light, vpd, water_flow_rate, substrate_temperature, substrate_moisture
  FROM {rows_since('telemetry', '1 HOUR')} s JOIN zone_config c ON c.zone_id = s.zone_id WHERE s.zone_id = 'Z05'""",
       cols("temp_deviation humidity_deviation co2_deviation ph_deviation ec_deviation"))
def _(t):
    return detect.zone_sensor_deviation(t.telemetry, t.zone_config, "Z05")


_fn2_bins = f"""(SELECT zone_id, time_bucket(INTERVAL 5 MINUTE, timestamp) AS timestamp, avg(air_temperature) AS avg_temp, avg(air_humidity) AS avg_humidity, avg(co2_level) AS avg_co2,
   avg(vpd) AS avg_vpd FROM {rows_since('telemetry', '6 HOUR')} WHERE zone_id = 'Z05' GROUP BY ALL)"""
_step1 = decompose_sql(_fn2_bins, "avg_temp", "zone_id", "t_")
_step2 = decompose_sql(f"({_step1})", "avg_humidity", "zone_id", "h_")
_step3 = decompose_sql(f"({_step2})", "avg_co2", "zone_id", "c_")


@query("fn2_detect_sensor_anomalies", f"""
  SELECT timestamp, zone_id, avg_temp, t_anomaly AS temp_anomaly_flag, avg_humidity, h_anomaly AS humidity_anomaly_flag, avg_co2, c_anomaly AS co2_anomaly_flag, avg_vpd
  FROM ({_step3}) WHERE t_anomaly <> 0 OR h_anomaly <> 0 OR c_anomaly <> 0""", cols("avg_temp avg_humidity avg_co2 avg_vpd"))
def _(t):
    return detect.detect_sensor_anomalies(t.telemetry, "Z05")


@query("fn3_zone_status_dashboard", f"""
  SELECT *, greatest(0e0, 1e2 - temp_deviation * 5 - humidity_deviation - co2_deviation * 0.02e0 - ph_deviation * 20 - ec_deviation * 10) AS health_score FROM (
    SELECT l.zone_id, l.greenhouse_id, crop_name, zone_name, timestamp, air_temperature, target_temperature, abs(air_temperature - target_temperature) AS temp_deviation,
      air_humidity, target_humidity, abs(air_humidity - target_humidity) AS humidity_deviation, co2_level, target_co2, abs(co2_level - target_co2) AS co2_deviation,
      substrate_ph, target_ph, abs(substrate_ph - target_ph) AS ph_deviation, substrate_ec, target_ec, abs(substrate_ec - target_ec) AS ec_deviation,
      par_light, vpd, water_flow_rate, substrate_temperature, substrate_moisture FROM {LATEST} l JOIN zone_config c ON c.zone_id = l.zone_id)""",
       cols("temp_deviation humidity_deviation co2_deviation ph_deviation ec_deviation health_score"))
def _(t):
    return detect.zone_status_dashboard(_latest(t), t.zone_config)


@query("fn4_zone_status_now", f"""
  SELECT l.zone_id, air_temperature, target_temperature, abs(air_temperature - target_temperature) AS temp_deviation, air_humidity, co2_level, vpd
  FROM {LATEST} l JOIN zone_config c ON c.zone_id = l.zone_id WHERE timestamp > {NOW} - INTERVAL 2 MINUTE""", cols("temp_deviation"))
def _(t):
    return detect.zone_status_now(t.telemetry, t.zone_config, tie=TIE)


@query("fn4_active_alerts", f"SELECT timestamp, zone_id, alert_type, severity, message FROM {rows_since('alerts', '24 HOUR', NOW_A)} WHERE NOT acknowledged")
def _(t):
    return detect.active_alerts(t.alerts)


@query("fn4_equipment_snapshot", f"""
  SELECT zone_id, heating_output, cooling_output, vent_position, supplemental_light, irrigation_pump FROM {LATEST_EQ}
  WHERE timestamp > (SELECT max(timestamp) FROM equipment) - INTERVAL 2 MINUTE""")
def _(t):
    return detect.equipment_snapshot(t.equipment, tie=TIE)


# --- series, bins and windows on whole tables -------------------------------------------

_sparse = series_sql("telemetry_sparse", "avg(reading)", "reading", "zone_id, greenhouse_id", 60)


@query("ts1_make_series_zero", f"SELECT * FROM {_sparse}", cols("reading"))
def _(t):
    return make_series(t.telemetry_sparse, HOUR, F.avg("reading"), "reading", ["zone_id", "greenhouse_id"])


@query("ts1_make_series_ffill", f"""
  SELECT zone_id, greenhouse_id, timestamp, last_value(v IGNORE NULLS) OVER (PARTITION BY zone_id ORDER BY timestamp) AS reading
  FROM {series_sql('telemetry_sparse', 'avg(reading)', 'v', 'zone_id, greenhouse_id', 60, 'NULL')}""", cols("reading"))
def _(t):
    return make_series(t.telemetry_sparse, HOUR, F.avg("reading"), "reading", ["zone_id", "greenhouse_id"], fill="ffill")


@query("ts2_decompose_anomalies", decompose_sql(_sparse, "reading", "zone_id, greenhouse_id"), cols("reading baseline score"))
def _(t):
    by = ["zone_id", "greenhouse_id"]
    return decompose_anomalies(make_series(t.telemetry_sparse, HOUR, F.avg("reading"), "reading", by), "reading", by, step=HOUR)


@query("ts2_decompose_seasonal", f"""
  WITH s AS (SELECT *, CAST(row_number() OVER (PARTITION BY zone_id ORDER BY timestamp) - 1 AS BIGINT) AS i FROM {_sparse}),
  f AS (SELECT zone_id, regr_slope(reading, CAST(i AS DOUBLE)) AS m, regr_intercept(reading, CAST(i AS DOUBLE)) AS b, count(*) AS n FROM s GROUP BY 1),
  d AS (SELECT s.*, f.n, f.b + f.m * i AS trend FROM s JOIN f USING (zone_id)),
  p AS (SELECT zone_id, i % 24 AS ph, avg(reading - trend) AS season FROM d GROUP BY ALL),
  r AS (SELECT d.*, trend + season AS baseline, reading - trend - season AS res FROM d JOIN p ON p.zone_id = d.zone_id AND p.ph = d.i % 24),
  q AS (SELECT zone_id, stddev_pop(res) AS sd FROM r GROUP BY 1)
  SELECT r.zone_id, greenhouse_id, timestamp, reading, baseline, CASE WHEN n < 3 OR sd <= 1e-9 THEN 0e0 ELSE res / sd END AS score,
    CASE WHEN n < 3 OR sd <= 1e-9 OR abs(res / sd) <= 2.5e0 THEN 0 WHEN res > 0 THEN 1 ELSE -1 END AS anomaly FROM r JOIN q ON q.zone_id = r.zone_id""",
       cols("reading baseline score"))
def _(t):
    by = ["zone_id", "greenhouse_id"]
    return decompose_anomalies(make_series(t.telemetry_sparse, HOUR, F.avg("reading"), "reading", by), "reading", by, threshold=2.5, period=24, step=HOUR)


@query("ts2_decompose_tukey", f"""
  WITH s AS (SELECT *, CAST(row_number() OVER (PARTITION BY zone_id ORDER BY timestamp) - 1 AS DOUBLE) AS i FROM {_sparse}),
  f AS (SELECT zone_id, regr_slope(reading, i) AS m, regr_intercept(reading, i) AS b FROM s GROUP BY 1),
  r AS (SELECT s.*, b + m * i AS baseline, reading - (b + m * i) AS res FROM s JOIN f USING (zone_id)),
  q AS (SELECT zone_id, quantile_cont(res, 0.25) AS q1, quantile_cont(res, 0.75) AS q3, count(*) AS n FROM r GROUP BY 1),
  x AS (SELECT r.*, CASE WHEN n < 3 OR q3 - q1 <= 1e-9 THEN 0e0 WHEN res > q3 THEN (res - q3) / (q3 - q1) WHEN res < q1 THEN (res - q1) / (q3 - q1) ELSE 0e0 END AS score
    FROM r JOIN q ON q.zone_id = r.zone_id)
  SELECT zone_id, greenhouse_id, timestamp, reading, baseline, score, CASE WHEN abs(score) > 1.5e0 THEN CAST(sign(score) AS INT) ELSE 0 END AS anomaly FROM x""",
       cols("reading baseline score"))
def _(t):
    by = ["zone_id", "greenhouse_id"]
    return decompose_anomalies(make_series(t.telemetry_sparse, HOUR, F.avg("reading"), "reading", by), "reading", by, method="tukey", step=HOUR)


@query("ts3_fir_moving_sum", f"""
  SELECT zone_id, greenhouse_id, timestamp, reading, reading + coalesce(lag(reading, 1) OVER w, 0) + coalesce(lag(reading, 2) OVER w, 0) AS filtered
  FROM {_sparse} WINDOW w AS (PARTITION BY zone_id ORDER BY timestamp)""", cols("reading filtered"))
def _(t):
    by = ["zone_id", "greenhouse_id"]
    return fir(make_series(t.telemetry_sparse, HOUR, F.avg("reading"), "reading", by), "reading", [1, 1, 1], by)


@query("ts3_fir_normalised", f"""
  SELECT zone_id, greenhouse_id, timestamp, reading, (3 * reading + 2 * coalesce(lag(reading, 1) OVER w, 0) + coalesce(lag(reading, 2) OVER w, 0)) / 6e0 AS filtered
  FROM {_sparse} WINDOW w AS (PARTITION BY zone_id ORDER BY timestamp)""", cols("reading filtered"))
def _(t):
    by = ["zone_id", "greenhouse_id"]
    return fir(make_series(t.telemetry_sparse, HOUR, F.avg("reading"), "reading", by), "reading", [3, 2, 1], by, normalize=True)


@query("ts4_mv_expand", """
  SELECT zone_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS timestamp, avg(reading) AS reading, CAST(count(*) AS INT) AS n FROM telemetry_sparse GROUP BY ALL""", cols("reading"))
def _(t):
    bins = binned(t.telemetry_sparse, ["zone_id"], HOUR, F.avg("reading").alias("reading"), F.count(F.lit(1)).alias("n"))
    packed = to_arrays(bins, ["reading", "n"], ["zone_id"])
    return mv_expand(packed, {"timestamp": "timestamp", "reading": "double", "n": "int"})


@query("ag2_bins_all_widths", " UNION ALL ".join(
    f"SELECT {m} AS minutes, zone_id, time_bucket(INTERVAL {m} MINUTE, timestamp) AS timestamp, count(*) AS n, sum(reading) AS total FROM telemetry_sparse GROUP BY ALL"
    for m in (5, 10, 15, 30, 60, 1440)), cols("total", 4))
def _(t):
    # one scan feeds the finest bins; the coarser ones are rolled up from those
    fine = binned(t.telemetry_sparse, ["zone_id"], 5 * MIN, F.count(F.lit(1)).alias("n"), F.sum("reading").alias("total"))
    spread = fine.withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in (5, 10, 15, 30, 60, 1440)])))
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / (F.col("minutes") * 60)) * F.col("minutes") * 60)
    return spread.groupBy("minutes", "zone_id", slot.alias("timestamp")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("ag3_conditional_count", """
  SELECT zone_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (NOT acknowledged AND severity <> 'info') AS open_serious FROM alerts GROUP BY 1""")
def _(t):
    return t.alerts.groupBy("zone_id").agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(~F.col("acknowledged") & (F.col("severity") != "info")).alias("open_serious"),
    )


@query("ag4_latest_per_channel", """
  SELECT zone_id, channel, timestamp, reading FROM telemetry_sparse QUALIFY row_number() OVER (PARTITION BY zone_id, channel ORDER BY timestamp DESC, event_id DESC) = 1""")
def _(t):
    from zonelytics.operators.latest import latest_per_key

    return latest_per_key(t.telemetry_sparse, ["zone_id", "channel"], tie=TIE).select("zone_id", "channel", "timestamp", "reading")


@query("ag5_ordered_list", """
  SELECT zone_id, array_to_string(list(CAST(n AS VARCHAR) ORDER BY timestamp), ',') AS counts FROM
    (SELECT zone_id, time_bucket(INTERVAL 1 DAY, timestamp) AS timestamp, count(*) AS n FROM telemetry_sparse GROUP BY ALL) GROUP BY 1""")
def _(t):
    bins = binned(t.telemetry_sparse, ["zone_id"], DAY, F.count(F.lit(1)).cast("string").alias("n"))
    return bins.groupBy("zone_id").agg(F.concat_ws(",", ordered_list("n")).alias("counts"))


@query("jn1_readings_with_config", """
  SELECT s.event_id, s.timestamp, s.zone_id, s.greenhouse_id, crop_name, air_temperature - target_temperature AS deviation
  FROM telemetry s JOIN zone_config c ON c.zone_id = s.zone_id""", cols("deviation"))
def _(t):
    return lookup(t.telemetry, t.zone_config, "zone_id").select(
        "event_id", "timestamp", "zone_id", "greenhouse_id", "crop_name", (F.col("air_temperature") - F.col("target_temperature")).alias("deviation"))


@query("jn11_semi_join", f"SELECT event_id, zone_id FROM telemetry WHERE zone_id IN (SELECT zone_id FROM alerts WHERE severity = 'critical')")
def _(t):
    bad = t.alerts.filter("severity = 'critical'").select("zone_id").distinct()
    return t.telemetry.join(bad, "zone_id", "left_semi").select("event_id", "zone_id")


@query("jn16_asof_alert_reading", """
  SELECT a.alert_id, a.zone_id, a.timestamp, s.timestamp AS s_timestamp, s.event_id AS s_event_id, s.reading AS s_reading
  FROM alerts a ASOF LEFT JOIN (SELECT * FROM telemetry_sparse WHERE channel = 'view') s ON s.zone_id = a.zone_id AND a.timestamp >= s.timestamp""")
def _(t):
    views_only = t.telemetry_sparse.filter("channel = 'view'").select("zone_id", "timestamp", "event_id", "reading")
    return asof_join(t.alerts.select("alert_id", "zone_id", "timestamp"), views_only, ["zone_id"], prefix="s_")


@query("jn16_asof_forward", """
  SELECT a.alert_id, a.zone_id, a.timestamp, s.timestamp AS s_timestamp, s.event_id AS s_event_id
  FROM alerts a ASOF LEFT JOIN (SELECT * FROM telemetry_sparse WHERE channel = 'click') s ON s.zone_id = a.zone_id AND a.timestamp < s.timestamp""")
def _(t):
    clicks = t.telemetry_sparse.filter("channel = 'click'").select("zone_id", "timestamp", "event_id")
    return asof_join(t.alerts.select("alert_id", "zone_id", "timestamp"), clicks, ["zone_id"], direction="forward", strict=True, prefix="s_")


@query("jn17_readings_in_incidents", """
  SELECT s.event_id, s.zone_id, s.timestamp, i.anomaly_id, i.scenario FROM telemetry s
  JOIN (SELECT anomaly_id, scenario, start_time, end_time, unnest(string_split(zone_ids, ',')) AS zone_id FROM scenarios) i
    ON i.zone_id = s.zone_id AND s.timestamp >= i.start_time AND s.timestamp < i.end_time""")
def _(t):
    hits = t.scenarios.withColumn("zone_id", F.explode(F.split("zone_ids", ","))).select("anomaly_id", "scenario", "start_time", "end_time", "zone_id")
    return interval_join(t.telemetry.select("event_id", "zone_id", "timestamp"), hits, ["zone_id"]).select(
        "event_id", "zone_id", "timestamp", "anomaly_id", "scenario")


@query("flt2_recent_readings", f"SELECT event_id, zone_id, timestamp FROM {rows_since('telemetry', '1 HOUR')}")
def _(t):
    return recent(t.telemetry, HOUR).select("event_id", "zone_id", "timestamp")


@query("flt4_physical_ranges", """
  SELECT event_id, zone_id FROM telemetry WHERE air_temperature BETWEEN -10 AND 50 AND air_humidity BETWEEN 0 AND 100 AND co2_level BETWEEN 100 AND 5000 AND substrate_ph BETWEEN 3 AND 9""")
def _(t):
    return t.telemetry.filter(fm.valid_reading()).select("event_id", "zone_id")


@query("flt11_deduplicate", """
  SELECT zone_id, channel, day, event_id FROM (SELECT *, date_trunc('day', timestamp) AS day FROM telemetry_sparse)
  QUALIFY row_number() OVER (PARTITION BY zone_id, channel, day ORDER BY event_id) = 1""")
def _(t):
    days = t.telemetry_sparse.withColumn("day", F.date_trunc("day", "timestamp"))
    return first_per_key(days, ["zone_id", "channel", "day"], [F.col("event_id").asc()]).select("zone_id", "channel", "day", "event_id")


@query("flt13_scalar_bindings", """
  SELECT s.event_id, air_temperature - (SELECT target_temperature FROM zone_config WHERE zone_id = 'Z03') AS deviation FROM telemetry s WHERE zone_id = 'Z03'""", cols("deviation"))
def _(t):
    one = t.zone_config.filter("zone_id = 'Z03'").select("zone_id", "target_temperature")
    return t.telemetry.join(one, "zone_id").select("event_id", (F.col("air_temperature") - F.col("target_temperature")).alias("deviation"))


@query("ra10_sensor_clamp", """
  SELECT event_id, greatest(5e0, least(40e0, air_temperature)) AS air_temperature, greatest(20e0, least(100e0, air_humidity)) AS air_humidity,
    greatest(300e0, least(2500e0, co2_level)) AS co2_level, greatest(0e0, least(1200e0, par_light)) AS par_light, greatest(4e0, least(8.5e0, substrate_ph)) AS substrate_ph FROM telemetry""")
def _(t):
    keep = ["air_temperature", "air_humidity", "co2_level", "par_light", "substrate_ph"]
    return t.telemetry.select("event_id", *keep).withColumns(fm.clamp_sensors(keep))
