"""Views over the given TPC-H-like tables in the shapes of ``schemas.py``.

Each text runs unchanged in Spark SQL and in ANSI engines; ``{name}`` marks a
base table or another adapter. Float literals carry an exponent so that no
engine turns them into decimals.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_ZONE_OF_USER = "concat('Z', lpad(CAST(user_id % 16 AS VARCHAR(2)), 2, '0'))"
_SITE_OF_USER = "CASE WHEN user_id % 16 < 8 THEN 'G0' ELSE 'G1' END"
_ZONE_OF_SUPPLIER = "concat('Z', lpad(CAST(l_suppkey % 16 AS VARCHAR(2)), 2, '0'))"
_SITE_OF_SUPPLIER = "CASE WHEN l_suppkey % 16 < 8 THEN 'G0' ELSE 'G1' END"
_ALERT_TYPE = (
    "CASE WHEN event_id % 4 = 0 THEN 'hvac-failure' WHEN event_id % 4 = 1 THEN 'nutrient-drift' "
    "WHEN event_id % 4 = 2 THEN 'irrigation-failure' ELSE 'cold-chain-break' END"
)

ADAPTERS: dict[str, str] = {}

ADAPTERS["zone_config"] = """
SELECT concat('Z', lpad(CAST(n_nationkey AS VARCHAR(2)), 2, '0')) AS zone_id,
  CASE WHEN n_nationkey < 8 THEN 'G0' ELSE 'G1' END AS greenhouse_id,
  concat('Zone ', CAST(n_nationkey AS VARCHAR(2))) AS zone_name,
  concat('crop', CAST(n_nationkey % 8 AS VARCHAR(2))) AS crop_id,
  concat('Crop ', CAST(n_nationkey % 8 AS VARCHAR(2))) AS crop_name,
  1.8e1 + n_nationkey % 7 AS target_temperature, 6e1 + n_nationkey % 15 AS target_humidity,
  8e2 + 5e1 * (n_nationkey % 5) AS target_co2, 5.8e0 + (n_nationkey % 5) / 1e1 AS target_ph,
  1.4e0 + (n_nationkey % 8) / 5e0 AS target_ec, CASE WHEN n_nationkey < 8 THEN 25000 ELSE 31250 END AS size_sqft
FROM {nation} WHERE n_nationkey < 16"""

ADAPTERS["telemetry"] = """
SELECT e.tick_ts AS timestamp, e.event_id, c.greenhouse_id, c.zone_id,
  round(c.target_temperature + 8e0 * abs((e.tick + e.z * 15) % 240 - 120) / 1.2e2 - 3.5e0 + (e.event_id * 37 % 100) / 2e2, 3) AS air_temperature,
  round(c.target_humidity + (e.event_id * 53 % 2000) / 1e2 - 1e1, 3) AS air_humidity,
  round(c.target_co2 + (e.event_id * 11 % 300) - 1.5e2, 3) AS co2_level,
  e.value AS par_light,
  round(c.target_temperature + (e.event_id * 19 % 200) / 1e2, 3) AS substrate_temperature,
  round(4e1 + 2e1 * abs((e.tick + e.z * 9) % 160 - 80) / 8e1, 3) AS substrate_moisture,
  round(c.target_ec + 6e-1 * abs((e.tick + e.z * 5) % 200 - 100) / 1e2 - 1e-1, 3) AS substrate_ec,
  round(c.target_ph + 8e-1 * abs((e.tick + e.z * 5) % 200 - 100) / 1e2 - 1e-1, 3) AS substrate_ph,
  CASE WHEN e.tick % 20 < 4 THEN 2.5e1 ELSE 0e0 END AS water_flow_rate,
  round(6e-1 + (e.event_id * 13 % 90) / 1e2, 3) AS vpd
FROM (SELECT event_id, value, event_id % 16 AS z,
        CAST((event_id - event_id % 16) / 16 AS BIGINT) AS tick,
        TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '30' SECOND * CAST((event_id - event_id % 16) / 16 AS INT) AS tick_ts
      FROM {events}) e
JOIN {zone_config} c ON c.zone_id = concat('Z', lpad(CAST(e.z AS VARCHAR(2)), 2, '0'))"""

ADAPTERS["telemetry_sparse"] = f"""
SELECT CAST(ts AS TIMESTAMP) AS timestamp, event_id, {_SITE_OF_USER} AS greenhouse_id, {_ZONE_OF_USER} AS zone_id,
  value AS reading, event_type AS channel, props
FROM {{events}}"""

ADAPTERS["equipment"] = """
SELECT timestamp, event_id, greenhouse_id, zone_id,
  CASE WHEN extract(minute FROM timestamp) % 20 < 10 THEN 0e0 ELSE CAST(event_id * 29 % 100 + 1 AS DOUBLE) END AS heating_output,
  CASE WHEN event_id % 5 = 0 THEN CAST(event_id * 31 % 101 AS DOUBLE) ELSE 0e0 END AS cooling_output,
  CAST(event_id * 17 % 101 AS DOUBLE) AS vent_position, event_id % 3 = 0 AS supplemental_light,
  CASE WHEN event_id % 3 = 0 THEN 6e2 ELSE 0e0 END AS supplemental_light_watts,
  (event_id * 23 % 40) / 1e1 AS co2_injection_rate, CAST(event_id * 41 % 101 AS DOUBLE) AS thermal_curtain,
  event_id % 4 <> 0 AS irrigation_pump, water_flow_rate AS irrigation_flow, true AS recirc_pump
FROM {telemetry} t WHERE extract(second FROM timestamp) = 0"""

ADAPTERS["weather"] = """
SELECT timestamp, greenhouse_id, event_id * 37 % 500 / 1e1 - 1e1 AS outside_temperature,
  3e1 + event_id * 53 % 700 / 1e1 AS outside_humidity, event_id * 7 % 300 / 1e1 AS wind_speed,
  CAST(event_id * 13 % 360 AS DOUBLE) AS wind_direction, event_id * 3 % 80 / 1e1 AS precipitation,
  CAST(event_id * 19 % 800 AS DOUBLE) AS solar_radiation, 9.9e2 + event_id % 50 AS barometric_pressure,
  CAST(event_id * 11 % 101 AS DOUBLE) AS cloud_cover
FROM {telemetry} t WHERE zone_id IN ('Z00', 'Z08') AND extract(minute FROM timestamp) % 5 = 0 AND extract(second FROM timestamp) = 0"""

ADAPTERS["alerts"] = f"""
SELECT CAST(ts AS TIMESTAMP) AS timestamp, concat('A', CAST(event_id AS VARCHAR(20))) AS alert_id,
  {_SITE_OF_USER} AS greenhouse_id, {_ZONE_OF_USER} AS zone_id,
  CASE WHEN value > 1e2 THEN 'critical' WHEN value > 3e1 THEN 'warning' ELSE 'info' END AS severity,
  {_ALERT_TYPE} AS alert_type, props AS message, value / 5e2 AS anomaly_score, event_id % 3 = 0 AS acknowledged
FROM {{events}} WHERE event_type = 'error'"""

ADAPTERS["harvest"] = f"""
SELECT CAST(l_shipdate AS DATE) AS harvest_date, {_ZONE_OF_SUPPLIER} AS zone_id, {_SITE_OF_SUPPLIER} AS greenhouse_id,
  concat('crop', CAST(l_suppkey % 8 AS VARCHAR(2))) AS crop_id, l_quantity AS harvest_weight_kg,
  CAST(l_quantity * 2 AS INT) AS harvest_units, 6e1 + l_partkey % 30 AS grade_a_pct,
  (4e1 - l_partkey % 30) * 7e-1 AS grade_b_pct, (4e1 - l_partkey % 30) * 3e-1 AS grade_c_pct,
  l_quantity * l_tax AS waste_kg, l_tax * 1e2 AS waste_pct, CAST(l_partkey % 60 + 20 AS INT) AS days_to_harvest,
  l_extendedprice AS revenue_estimate_usd
FROM {{lineitem}}"""

ADAPTERS["energy"] = """
SELECT CAST(o_orderdate AS TIMESTAMP) AS timestamp, CASE WHEN o_custkey % 2 = 0 THEN 'G0' ELSE 'G1' END AS greenhouse_id,
  o_totalprice / 1e3 AS electricity_kwh, o_totalprice / 4e3 AS natural_gas_m3,
  CAST(o_orderkey * 7 % 1000 AS DOUBLE) AS water_liters, (o_orderkey * 7 % 1000) * 8e-1 AS water_recycled_liters,
  o_orderkey % 50 / 1e1 AS co2_purchased_kg
FROM {orders}"""

ADAPTERS["shipments"] = """
SELECT concat('ORD-', CAST(o.o_orderkey AS VARCHAR(20))) AS order_id, CAST(o.o_custkey AS VARCHAR(20)) AS customer_id,
  CASE WHEN l.l_suppkey % 16 < 8 THEN 'G0' ELSE 'G1' END AS greenhouse_id, CAST(l.l_partkey AS VARCHAR(20)) AS product_sku,
  concat('crop', CAST(l.l_partkey % 8 AS VARCHAR(2))) AS crop_id, CAST(l.l_quantity AS INT) AS quantity_cases,
  CAST(l.l_quantity AS INT) + CAST(l.l_linenumber AS INT) - 1 AS quantity_ordered, CAST(l.l_shipdate AS TIMESTAMP) AS ship_date,
  1e0 + l.l_tax * 7.5e1 AS cold_chain_temp, 1e0 + l.l_tax * 7.5e1 <= 5e0 AS cold_chain_compliant,
  CASE WHEN o.o_orderstatus = 'F' THEN 'delivered' WHEN o.o_orderstatus = 'P' THEN 'delayed' ELSE 'in_transit' END AS delivery_status,
  CAST(l.l_partkey % 14 AS INT) AS shelf_life_remaining_days
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey"""

ADAPTERS["anomaly_events"] = f"""
SELECT concat('ANM-', CAST(event_id AS VARCHAR(20))) AS event_id, CAST(ts AS TIMESTAMP) AS start_time,
  CAST(ts AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(8 + event_id % 30 AS INT) AS end_time, {_SITE_OF_USER} AS greenhouse_id,
  concat('Z', lpad(CAST(user_id % 16 AS VARCHAR(2)), 2, '0'), ',Z', lpad(CAST((user_id + 1) % 16 AS VARCHAR(2)), 2, '0')) AS zone_ids,
  {_ALERT_TYPE} AS anomaly_type,
  CASE WHEN value > 1e2 THEN 'critical' ELSE 'warning' END AS severity, value * 1e1 AS estimated_loss_usd,
  value * 8e0 AS prevented_loss_usd, CAST(event_id % 45 AS DOUBLE) AS response_time_minutes, 'resolved' AS resolution_status
FROM {{events}} WHERE event_type = 'purchase' AND value > 1e2"""

# Scenario intervals on the clock of the dense telemetry grid, so that they overlap it.
ADAPTERS["scenarios"] = f"""
SELECT concat('ANM-', CAST(event_id AS VARCHAR(20))) AS anomaly_id, {_ALERT_TYPE} AS scenario,
  {_SITE_OF_USER} AS greenhouse_id,
  concat('Z', lpad(CAST(user_id % 16 AS VARCHAR(2)), 2, '0'), ',Z', lpad(CAST((user_id + 1) % 16 AS VARCHAR(2)), 2, '0')) AS zone_ids,
  round(least(1e0, value / 4e2), 3) AS severity,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '30' SECOND * CAST((event_id - event_id % 16) / 16 AS INT) AS start_time,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '30' SECOND * (CAST((event_id - event_id % 16) / 16 AS INT) + CAST(16 + event_id % 60 AS INT)) AS end_time
FROM {{events}} WHERE event_type = 'purchase' AND value > 1e2"""

# Zone-by-day climate on the dates of the harvest rows (the telemetry covers other dates).
ADAPTERS["env_daily"] = f"""
SELECT d.date, d.zone_id, d.greenhouse_id, d.avg_temp, d.avg_temp - 2e0 AS min_temp, d.avg_temp + 3e0 AS max_temp,
  d.avg_humidity, d.avg_co2, d.total_dli, d.avg_vpd, d.avg_ec, d.avg_ph,
  2.4e1 - CASE WHEN abs(d.avg_temp - c.target_temperature) > 2e0 THEN abs(d.avg_temp - c.target_temperature) * 2e0 ELSE 0e0 END AS hours_in_optimal_range,
  CASE WHEN abs(d.avg_temp - c.target_temperature) > 2e0 THEN abs(d.avg_temp - c.target_temperature) * 2e0 ELSE 0e0 END AS temp_excursion_hours
FROM (SELECT s.date, s.zone_id, s.greenhouse_id, 1.8e1 + (s.q % 90) / 1e1 AS avg_temp, 5.5e1 + s.k % 30 AS avg_humidity,
        7e2 + s.q * 7 % 400 AS avg_co2, 1e1 + (s.q % 150) / 1e1 AS total_dli, 6e-1 + (s.k % 90) / 1e2 AS avg_vpd,
        1.2e0 + (s.q % 16) / 1e1 AS avg_ec, 5.5e0 + (s.k % 13) / 1e1 AS avg_ph
      FROM (SELECT CAST(l_shipdate AS DATE) AS date, {_ZONE_OF_SUPPLIER} AS zone_id, {_SITE_OF_SUPPLIER} AS greenhouse_id,
              CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, CAST(sum(l_partkey) AS BIGINT) AS k
            FROM {{lineitem}} GROUP BY 1, 2, 3) s) d
JOIN {{zone_config}} c ON c.zone_id = d.zone_id"""

ADAPTERS["graph_nodes"] = """
SELECT concat('r:', CAST(r_regionkey AS VARCHAR(20))) AS node_id, 'Region' AS label, r_name AS name FROM {region}
UNION ALL SELECT concat('n:', CAST(n_nationkey AS VARCHAR(20))), 'Nation', n_name FROM {nation}
UNION ALL SELECT concat('s:', CAST(s_suppkey AS VARCHAR(20))), 'Supplier', s_name FROM {supplier}
UNION ALL SELECT concat('c:', CAST(c_custkey AS VARCHAR(20))), 'Customer', c_name FROM {customer}"""

ADAPTERS["graph_edges"] = """
SELECT concat('r:', CAST(n_regionkey AS VARCHAR(20))) AS src, concat('n:', CAST(n_nationkey AS VARCHAR(20))) AS dst, 'contains' AS label FROM {nation}
UNION ALL SELECT concat('n:', CAST(s_nationkey AS VARCHAR(20))), concat('s:', CAST(s_suppkey AS VARCHAR(20))), 'has_supplier' FROM {supplier}
UNION ALL SELECT concat('n:', CAST(c_nationkey AS VARCHAR(20))), concat('c:', CAST(c_custkey AS VARCHAR(20))), 'has_customer' FROM {customer}
UNION ALL SELECT concat('n:', CAST(n_nationkey AS VARCHAR(20))), concat('n:', CAST(n_nationkey + 1 AS VARCHAR(20))), 'adjacent_to' FROM {nation} WHERE n_nationkey < 24
UNION ALL SELECT concat('n:', CAST(n_nationkey AS VARCHAR(20))), concat('n:', CAST(n_nationkey - 1 AS VARCHAR(20))), 'adjacent_to' FROM {nation} WHERE n_nationkey > 0"""

# Dimensions for the star join: customers and products grow with the facts.
ADAPTERS["dim_customer"] = """
SELECT CAST(c_custkey AS VARCHAR(20)) AS customer_id, c_name AS name, c_mktsegment AS region,
  CAST(c_nationkey AS VARCHAR(20)) AS country,
  CASE WHEN c_custkey % 3 = 0 THEN 'daily' WHEN c_custkey % 3 = 1 THEN '3x_weekly' ELSE 'weekly' END AS delivery_frequency
FROM {customer}"""

ADAPTERS["dim_product"] = """
SELECT CAST(p_partkey AS VARCHAR(20)) AS product_id, concat('crop', CAST(p_partkey % 8 AS VARCHAR(2))) AS crop_id,
  p_name AS product_name, p_type AS package_type, p_size / 1e1 AS package_weight_kg, p_brand AS sku
FROM {part}"""

ADAPTERS["dim_zone"] = """
SELECT zone_id, greenhouse_id, zone_name, size_sqft, crop_id AS primary_crop_id FROM {zone_config} z"""

ADAPTERS["dim_crop"] = """
SELECT concat('crop', CAST(n_nationkey AS VARCHAR(2))) AS crop_id, concat('Crop ', CAST(n_nationkey AS VARCHAR(2))) AS crop_name,
  CASE WHEN n_nationkey < 4 THEN 'leafy_green' WHEN n_nationkey < 7 THEN 'vine_crop' ELSE 'berry' END AS crop_category,
  CAST(25 + n_nationkey * 30 AS INT) AS growth_cycle_days, 1.8e1 + n_nationkey AS optimal_temp_c,
  6e1 + n_nationkey AS optimal_humidity_pct, 4e0 + n_nationkey / 2e0 AS market_price_per_kg_usd,
  CAST(5 + n_nationkey AS INT) AS shelf_life_days
FROM {nation} WHERE n_nationkey < 8"""

ADAPTERS["dim_greenhouse"] = """
SELECT greenhouse_id, concat('Site ', greenhouse_id) AS name, concat('City ', greenhouse_id) AS location_city,
  CASE WHEN greenhouse_id = 'G0' THEN 'North' ELSE 'South' END AS location_state, 'US' AS country,
  CAST(sum(size_sqft) AS INT) AS size_sqft, CAST(count(*) AS INT) AS zone_count
FROM {zone_config} z GROUP BY greenhouse_id"""

# A fixed stand-in for model output, so that the evaluation tables can be checked in SQL.
ADAPTERS["predictions"] = """
SELECT event_id,
  CASE WHEN event_id % 5 = 0 THEN 'hvac_failure' WHEN event_id % 5 = 1 THEN 'nutrient_drift'
       WHEN event_id % 5 = 2 THEN 'irrigation_failure' WHEN event_id % 5 = 3 THEN 'cold_chain_break' ELSE 'unknown' END AS actual,
  CASE WHEN value > 6e1 THEN (CASE WHEN user_id % 5 = 0 THEN 'hvac_failure' WHEN user_id % 5 = 1 THEN 'nutrient_drift'
       WHEN user_id % 5 = 2 THEN 'irrigation_failure' WHEN user_id % 5 = 3 THEN 'cold_chain_break' ELSE 'unknown' END)
       ELSE (CASE WHEN event_id % 5 = 0 THEN 'hvac_failure' WHEN event_id % 5 = 1 THEN 'nutrient_drift'
       WHEN event_id % 5 = 2 THEN 'irrigation_failure' WHEN event_id % 5 = 3 THEN 'cold_chain_break' ELSE 'unknown' END) END AS predicted
FROM {events}"""

_NAME = re.compile(r"\{(\w+)\}")


class Tables:
    """Adapter views and base tables of one data folder as DataFrame attributes.

    Each base table is opened once; adapters are planned on top of it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, **overrides: DataFrame):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = dict(overrides)

    def _expand(self, name: str, used: dict[str, DataFrame]) -> str:
        """SQL of an adapter with nested adapters inlined and base tables left as frame arguments."""

        def resolve(match: re.Match) -> str:
            inner = match.group(1)
            if inner in ADAPTERS and inner not in self._frames:
                return f"({self._expand(inner, used)})"
            used[inner] = getattr(self, inner)
            return "{" + inner + "}"

        return _NAME.sub(resolve, ADAPTERS[name])

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames", {})
        if name in frames:
            return frames[name]
        if name in ADAPTERS:
            used: dict[str, DataFrame] = {}
            text = self._expand(name, used)
            return self.spark.sql(text, **used)
        if name in BASE:
            frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return frames[name]
        raise AttributeError(name)
