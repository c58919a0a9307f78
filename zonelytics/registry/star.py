"""Registered lake-pipeline and measure queries."""

from pyspark.sql import functions as F

from zonelytics import schemas
from zonelytics.functions import formulas as fm
from zonelytics.functions.timebins import dim_date_spanning
from zonelytics.plans import measures as me
from zonelytics.plans import pipeline as pl
from zonelytics.registry import cols, query
from zonelytics.session import work_dir
from zonelytics.sources import readers, sinks
from zonelytics.sources.adapters import ADAPTERS

# SQL-only relations for the twins
# the calendar dimension spans the harvest dates; other dates are orphans with NULL attributes
ADAPTERS["o_span"] = "SELECT min(harvest_date) AS lo, max(harvest_date) AS hi FROM harvest"
ADAPTERS["o_energy"] = """
  SELECT CAST(timestamp AS DATE) AS date, greenhouse_id, sum(electricity_kwh) AS electricity_kwh, sum(natural_gas_m3) AS natural_gas_m3, sum(water_liters) AS water_liters,
    sum(water_recycled_liters) AS water_recycled_liters, sum(co2_purchased_kg) AS co2_purchased_kg, sum(electricity_kwh) * 0.12e0 + sum(natural_gas_m3) * 0.45e0 AS energy_cost_usd
  FROM energy GROUP BY ALL"""
ADAPTERS["o_shipments"] = """
  SELECT CAST(ship_date AS DATE) AS ship_date, order_id, greenhouse_id, customer_id, product_sku AS product_id, crop_id, quantity_cases, quantity_ordered, delivery_status,
    cold_chain_compliant, shelf_life_remaining_days, delivery_status = 'delivered' AS on_time_flag FROM shipments"""


def model(t) -> me.Model:
    return me.Model(
        facts={
            "fact_daily_harvest": lambda: t.harvest,
            "fact_zone_daily_environment": lambda: t.env_daily,
            "fact_daily_energy": lambda: pl.fact_daily_energy(pl.clean_energy(t.energy), t.harvest),
            "fact_shipments": lambda: pl.fact_shipments(pl.clean_shipments(t.shipments)),
            "fact_anomaly_events": lambda: t.anomaly_events,
        },
        dims={
            "dim_date": lambda: dim_date_spanning(t.harvest, "harvest_date"),
            "dim_zone": lambda: t.dim_zone,
            "dim_greenhouse": lambda: t.dim_greenhouse,
            "dim_crop": lambda: t.dim_crop,
            "dim_customer": lambda: t.dim_customer,
            "dim_product": lambda: t.dim_product,
        },
    )


# --- pipeline -----------------------------------------------------------------------------

@query("pl2_clean_sensors", """
  WITH raw AS (SELECT * FROM telemetry UNION ALL SELECT * REPLACE (air_temperature + 1e0 AS air_temperature) FROM telemetry),
  ok AS (SELECT * FROM raw WHERE air_temperature BETWEEN -10 AND 50 AND air_humidity BETWEEN 0 AND 100 AND co2_level BETWEEN 100 AND 5000 AND substrate_ph BETWEEN 3 AND 9)
  SELECT timestamp, zone_id, air_temperature, CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INT) AS hour,
    0.6108e0 * exp(17.27e0 * air_temperature / (air_temperature + 237.3e0)) * (1 - air_humidity / 1e2) AS vpd_calculated
  FROM ok QUALIFY row_number() OVER (PARTITION BY timestamp, zone_id ORDER BY event_id, greenhouse_id, air_temperature) = 1""", cols("vpd_calculated"))
def _(t):
    """Every reading arrives twice, once as ISO text with a shifted temperature; one survives."""
    raw = t.telemetry.unionByName(t.telemetry.withColumn("air_temperature", F.col("air_temperature") + 1.0))
    texts = raw.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    return pl.clean_sensors(texts).select("timestamp", "zone_id", "air_temperature", "date", "hour", "vpd_calculated")


@query("pl3_clean_weather", """
  SELECT *, CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INT) AS hour,
    CASE WHEN outside_temperature > 27 THEN -8.785e0 + 1.611e0 * outside_temperature + 2.339e0 * outside_humidity - 0.146e0 * outside_temperature * outside_humidity ELSE outside_temperature END AS heat_index,
    CASE WHEN outside_temperature < 10 THEN 13.12e0 + 0.6215e0 * outside_temperature - 11.37e0 * pow(wind_speed, 0.16e0) + 0.3965e0 * outside_temperature * pow(wind_speed, 0.16e0) ELSE outside_temperature END AS wind_chill
  FROM weather""", cols("heat_index wind_chill"))
def _(t):
    return pl.clean_weather(t.weather)


@query("pl4_clean_equipment", """
  SELECT event_id, timestamp, zone_id, CAST(timestamp AS DATE) AS date, heating_output > 0 AS is_heating, cooling_output > 0 AS is_cooling, vent_position > 5 AS is_ventilating FROM equipment""")
def _(t):
    return pl.clean_equipment(t.equipment).select("event_id", "timestamp", "zone_id", "date", "is_heating", "is_cooling", "is_ventilating")


@query("pl5_clean_harvests", """
  SELECT harvest_date AS date, zone_id, crop_id, harvest_weight_kg, waste_kg, harvest_weight_kg + waste_kg AS total_weight_kg FROM harvest WHERE harvest_weight_kg >= 0""", cols("waste_kg total_weight_kg"))
def _(t):
    raw = t.harvest.withColumnRenamed("harvest_date", "date")
    return pl.clean_harvests(raw).select("date", "zone_id", "crop_id", "harvest_weight_kg", "waste_kg", "total_weight_kg")


@query("pl6_clean_energy", """
  SELECT *, CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INT) AS hour, CASE WHEN water_liters > 0 THEN water_recycled_liters / water_liters * 100 ELSE 0e0 END AS water_recycling_pct FROM energy""",
       cols("water_recycling_pct water_recycled_liters"))
def _(t):
    return pl.clean_energy(t.energy)


@query("pl7_clean_shipments", "SELECT *, CAST(ship_date AS DATE) AS date FROM shipments", cols("cold_chain_temp"))
def _(t):
    return pl.clean_shipments(t.shipments)


@query("pl8_fact_daily_harvest", "SELECT * FROM harvest", cols("grade_b_pct grade_c_pct waste_kg waste_pct"))
def _(t):
    return pl.fact_daily_harvest(pl.clean_harvests(t.harvest.withColumnRenamed("harvest_date", "date")))


@query("pl9_fact_zone_daily_environment", """
  SELECT d.*, CASE WHEN abs(avg_temp - target_temperature) > 2 THEN abs(avg_temp - target_temperature) * 2 ELSE 0e0 END AS temp_excursion_hours,
    24 - CASE WHEN abs(avg_temp - target_temperature) > 2 THEN abs(avg_temp - target_temperature) * 2 ELSE 0e0 END AS hours_in_optimal_range
  FROM (SELECT CAST(timestamp AS DATE) AS date, zone_id, greenhouse_id, avg(air_temperature) AS avg_temp, min(air_temperature) AS min_temp, max(air_temperature) AS max_temp,
      avg(air_humidity) AS avg_humidity, avg(co2_level) AS avg_co2, sum(par_light) * 30 / 1e6 AS total_dli, avg(vpd) AS avg_vpd, avg(substrate_ec) AS avg_ec, avg(substrate_ph) AS avg_ph
    FROM telemetry GROUP BY ALL) d LEFT JOIN (SELECT zone_id, target_temperature FROM zone_config) c ON c.zone_id = d.zone_id""".replace("SELECT d.*", "SELECT d.* "),
       cols("avg_temp avg_humidity avg_co2 total_dli avg_vpd avg_ec avg_ph temp_excursion_hours hours_in_optimal_range"))
def _(t):
    return pl.fact_zone_daily_environment(pl.clean_sensors(t.telemetry), t.zone_config)


@query("pl10_fact_daily_energy", """
  SELECT e.*, CASE WHEN kg > 0 THEN energy_cost_usd / kg ELSE 0e0 END AS energy_per_kg_produce FROM o_energy e
  LEFT JOIN (SELECT harvest_date AS date, greenhouse_id, sum(harvest_weight_kg) AS kg FROM harvest GROUP BY ALL) h ON h.date = e.date AND h.greenhouse_id = e.greenhouse_id""",
       cols("electricity_kwh natural_gas_m3 water_liters water_recycled_liters co2_purchased_kg energy_cost_usd energy_per_kg_produce", 4))
def _(t):
    return pl.fact_daily_energy(pl.clean_energy(t.energy), t.harvest)


@query("pl11_fact_shipments", "SELECT * FROM o_shipments")
def _(t):
    return pl.fact_shipments(pl.clean_shipments(t.shipments))


@query("pl12_fact_weekly_crop_health", """
  SELECT w.week_start, w.zone_id, w.greenhouse_id, crop_id,
    25 + CAST(concat('0x', substr(md5(concat(w.zone_id, '|', CAST(week_start AS VARCHAR), '|height')), 1, 8)) AS BIGINT) / 4294967296e0 * 15 AS avg_plant_height_cm,
    8 + CAST(concat('0x', substr(md5(concat(w.zone_id, '|', CAST(week_start AS VARCHAR), '|leaves')), 1, 8)) AS BIGINT) / 4294967296e0 * 6 AS avg_leaf_count,
    CASE WHEN abs(t - 21) < 2 THEN 'A' WHEN abs(t - 21) < 4 THEN 'B' ELSE 'C' END AS predicted_quality_grade,
    p * 0.5e0 + CAST(concat('0x', substr(md5(concat(w.zone_id, '|', CAST(week_start AS VARCHAR), '|yield')), 1, 8)) AS BIGINT) / 4294967296e0 * 50 AS predicted_yield_kg
  FROM (SELECT CAST(date_trunc('week', timestamp) AS DATE) AS week_start, zone_id, greenhouse_id, avg(air_temperature) AS t, avg(par_light) AS p FROM telemetry GROUP BY ALL) w
  LEFT JOIN zone_config c ON c.zone_id = w.zone_id""", cols("avg_plant_height_cm avg_leaf_count predicted_yield_kg"))
def _(t):
    return pl.fact_weekly_crop_health(pl.clean_sensors(t.telemetry), t.zone_config)


@query("pl13_fact_anomaly_events", """
  SELECT anomaly_id AS event_id, start_time, end_time, greenhouse_id, zone_ids, scenario AS anomaly_type, CASE WHEN severity >= 0.7e0 THEN 'critical' ELSE 'warning' END AS severity,
    CAST(NULL AS VARCHAR) AS root_cause, CAST(NULL AS DOUBLE) AS estimated_loss_usd, severity * 100 AS prevented_loss_usd, (epoch(end_time) - epoch(start_time)) / 60 AS response_time_minutes,
    'auto_resolved' AS resolution_status FROM scenarios""", cols("response_time_minutes prevented_loss_usd"))
def _(t):
    history = t.scenarios.select(
        "anomaly_id", "scenario", "greenhouse_id", F.split("zone_ids", ",").alias("zone_ids"), "severity", "start_time", F.col("end_time").alias("resolved_time"),
        (F.unix_seconds("end_time") - F.unix_seconds("start_time")).cast("double").alias("duration_seconds"), F.lit(True).alias("auto_resolved"),
        F.create_map(F.lit("prevented_loss_usd"), (F.col("severity") * 100).cast("string")).alias("metadata"))
    return pl.fact_anomaly_events(history)


@query("src6_dim_date", """
  SELECT d AS date_key, d AS date, dayname(d) AS day_name, CAST(isodow(d) AS INT) AS day_of_week, CAST(weekofyear(d) AS INT) AS week_num, monthname(d) AS month_name, CAST(month(d) AS INT) AS month_num,
    concat('Q', quarter(d)) AS quarter, CAST(year(d) AS INT) AS year, CAST(year(d) AS INT) AS fiscal_year, isodow(d) >= 6 AS is_weekend,
    CASE WHEN month(d) IN (3, 4, 5) THEN 'Spring' WHEN month(d) IN (6, 7, 8) THEN 'Summer' WHEN month(d) IN (9, 10, 11) THEN 'Fall' ELSE 'Winter' END AS season, CAST(dayofyear(d) AS INT) AS day_of_year
  FROM (SELECT CAST(unnest(generate_series(min(harvest_date), max(harvest_date), INTERVAL 1 DAY)) AS DATE) AS d FROM harvest)""")
def _(t):
    return dim_date_spanning(t.harvest, "harvest_date")


@query("pl14_dims_joined", """
  SELECT z.zone_id, z.zone_name, z.size_sqft, g.name AS site, c.crop_name, c.crop_category, count(h.zone_id) AS harvests FROM harvest h
  LEFT JOIN dim_zone z ON z.zone_id = h.zone_id LEFT JOIN dim_greenhouse g ON g.greenhouse_id = h.greenhouse_id LEFT JOIN dim_crop c ON c.crop_id = h.crop_id GROUP BY ALL""")
def _(t):
    h = t.harvest.join(t.dim_zone.drop("greenhouse_id"), "zone_id", "left").join(t.dim_greenhouse.select("greenhouse_id", F.col("name").alias("site")), "greenhouse_id", "left")
    return h.join(t.dim_crop, "crop_id", "left").groupBy("zone_id", "zone_name", "size_sqft", "site", "crop_name", "crop_category").agg(F.count(F.lit(1)).alias("harvests"))


@query("pl15_conform_environment", "SELECT * FROM env_daily", cols("avg_temp min_temp max_temp total_dli avg_vpd avg_ec avg_ph hours_in_optimal_range temp_excursion_hours"))
def _(t):
    return pl.conform(t.env_daily.withColumn("reading_count", F.lit(1)), "fact_zone_daily_environment")


# --- sources and sinks over whole tables ---------------------------------------------------

@query("src7_json_mapping", "SELECT timestamp, zone_id, air_temperature, co2_level, vpd, CAST(NULL AS DOUBLE) AS absent FROM telemetry")
def _(t):
    messages = sinks.to_messages(t.telemetry, "sensor_telemetry")
    mapping = {"timestamp": ("$.timestamp", "timestamp"), "zone_id": ("$.zone_id", "string"), "air_temperature": ("$.air_temperature", "double"),
               "co2_level": ("$.co2_level", "double"), "vpd": ("$.vpd", "double"), "absent": ("$.absent", "double")}
    return readers.from_json_mapping(messages, mapping)[0]


@query("src7_json_rejects", "SELECT event_id, concat('reading ', CAST(user_id AS VARCHAR)) AS value FROM events WHERE event_type = 'error'")
def _(t):
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("reading "), F.col("user_id").cast("string"))).otherwise(F.col("props"))
    return readers.from_json_mapping(t.events.select("event_id", broken.alias("value")), {"k": ("$.k", "int")})[1]


@query("src7_leading_white_space", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def _(t):
    """Objects behind line breaks and tabs are objects."""
    padded = F.concat(F.element_at(F.array(F.lit("\n"), F.lit("\t "), F.lit("\r\n"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int")), F.col("props"))
    rows = t.events.select(F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").alias("k"))).alias("value"), "event_id", "props")
    first = readers.from_json_mapping(rows.select(F.concat(F.regexp_extract(padded, r"^\s*", 0), F.col("value")).alias("value")), {"event_id": ("$.event_id", "bigint"), "k": ("$.k", "int")})
    return first[0]


@query("src7_payload_field", "SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return readers.from_json_mapping(t.events, {"k": ("$.k", "int")}, value="props")[0].groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("src10_route_messages", """
  SELECT 'sensor_telemetry' AS kind, count(*) AS n FROM telemetry UNION ALL SELECT 'equipment_state', count(*) FROM equipment
  UNION ALL SELECT 'weather', count(*) FROM weather UNION ALL SELECT 'alert', count(*) FROM alerts UNION ALL SELECT 'rejected', 0""")
def _(t):
    """All kinds are counted in one pass over the messages."""
    messages = readers.typed_messages(mixed_messages(t))
    kinds = [*schemas.EVENT_TYPES, "rejected"]
    counts = messages.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])).alias("x")).select("x.*")


def mixed_messages(t, junk=False):
    """The rows of every event type as JSON text in files, with broken ones among them on request."""
    sent = {"sensor_telemetry": t.telemetry, "equipment_state": t.equipment, "weather": t.weather, "alert": t.alerts}
    mixed = None
    for kind, df in sent.items():
        one = sinks.to_messages(df, kind)
        mixed = one if mixed is None else mixed.unionByName(one)
    if junk:  # no object, text behind an object, two objects, another type
        forms = F.array(F.concat(F.lit("broken "), F.col("props")), F.concat("props", F.lit(" and more")), F.concat("props", F.lit(","), "props"), F.lit('{"event_type": "other"}'))
        mixed = mixed.unionByName(t.events.filter("event_type = 'error'").select(F.element_at(forms, (F.col("event_id") % 4 + 1).cast("int")).alias("value")))
    path = work_dir(t.spark, "messages")
    mixed.write.text(path)
    return t.spark.read.text(path)


#: every kind with its rows: time, place and three of its values
ROUTED_SQL = """
  SELECT 'sensor_telemetry' AS kind, timestamp, zone_id AS place, air_temperature AS a, substrate_ph AS b, vpd AS c FROM telemetry
  UNION ALL SELECT 'equipment_state', timestamp, zone_id, heating_output, irrigation_flow, CAST(irrigation_pump AS DOUBLE) FROM equipment
  UNION ALL SELECT 'weather', timestamp, greenhouse_id, outside_temperature, wind_speed, cloud_cover FROM weather
  UNION ALL SELECT 'alert', timestamp, alert_id, anomaly_score, CAST(acknowledged AS DOUBLE), NULL FROM alerts
  UNION ALL SELECT 'rejected', NULL, CASE event_id % 4 WHEN 0 THEN concat('broken ', props) WHEN 1 THEN concat(props, ' and more') WHEN 2 THEN concat(props, ',', props) ELSE '{"event_type": "other"}' END,
    NULL, NULL, NULL FROM events WHERE event_type = 'error'"""
ROUTED = {
    "sensor_telemetry": ("timestamp", "zone_id", "air_temperature", "substrate_ph", "vpd"), "equipment_state": ("timestamp", "zone_id", "heating_output", "irrigation_flow", "irrigation_pump"),
    "weather": ("timestamp", "greenhouse_id", "outside_temperature", "wind_speed", "cloud_cover"), "alert": ("timestamp", "alert_id", "anomaly_score", "acknowledged", None), "rejected": (None, "value", None, None, None),
}


def routed_rows(tables):
    out = None
    for kind, columns in ROUTED.items():
        types = ("timestamp", "string", "double", "double", "double")
        made = [(F.col(c) if c else F.lit(None)).cast(k).alias(n) for n, c, k in zip(("timestamp", "place", "a", "b", "c"), columns, types, strict=True)]
        one = tables[kind].select(F.lit(kind).alias("kind"), *made)
        out = one if out is None else out.unionByName(one)
    return out


@query("src10_routed_rows", ROUTED_SQL, cols("a b c"))
def _(t):
    return routed_rows(readers.route_messages(mixed_messages(t, junk=True)))


@query("snk7_merge_schema", "SELECT timestamp, zone_id, CAST(NULL AS VARCHAR) AS message, alert_id FROM alerts")
def _(t):
    old = t.alerts.drop("message")
    return sinks.merge_schema(old, schemas.ALERTS).select("timestamp", "zone_id", "message", "alert_id")


@query("snk9_retention", "SELECT order_id, ship_date FROM shipments WHERE ship_date >= TIMESTAMP '2001-06-01' - INTERVAL 730 DAY")
def _(t):
    return sinks.retained(t.shipments, "2001-06-01", ts="ship_date").select("order_id", "ship_date")


@query("snk11_enrich", """
  SELECT s.event_id, s.timestamp, s.greenhouse_id, s.zone_id, c.crop_id, c.crop_name, c.zone_name, c.size_sqft FROM telemetry s JOIN zone_config c ON c.zone_id = s.zone_id""")
def _(t):
    return sinks.enrich(t.telemetry, t.zone_config).select("event_id", "timestamp", "greenhouse_id", "zone_id", "crop_id", "crop_name", "zone_name", "size_sqft")


@query("src1_snk3_partitioned_round_trip", """
  SELECT event_id, zone_id, greenhouse_id, CAST(timestamp AS DATE) AS date, air_temperature FROM telemetry WHERE greenhouse_id = 'G1'""")
def _(t):
    """Written by site and date, read back through the folder names, pruned to one site."""
    root = work_dir(t.spark, "lake")
    sinks.write_partitioned(t.telemetry, f"{root}/iot_telemetry", files_per_partition=4)
    back = readers.with_lineage(readers.read_raw(t.spark, root, "iot_telemetry"))
    stamped = back.filter("greenhouse_id = 'G1' AND _ingested_at IS NOT NULL AND _source_file LIKE '%greenhouse_id=G1%'")
    return stamped.select("event_id", "zone_id", "greenhouse_id", "date", "air_temperature")


@query("snk4_csv_round_trip", "SELECT order_id, product_sku, quantity_cases, delivery_status FROM shipments")
def _(t):
    path = work_dir(t.spark, "csv")
    out = t.shipments.select("order_id", "product_sku", "quantity_cases", "delivery_status")
    sinks.write_csv(out, path)
    return t.spark.read.schema(out.schema).option("header", True).csv(path)


@query("snk5_published_messages", "SELECT alert_id, zone_id, severity, anomaly_score, acknowledged, timestamp FROM alerts")
def _(t):
    path = work_dir(t.spark, "messages")
    sinks.publish(t.alerts, "alert", path)
    rows = readers.route_messages(t.spark.read.text(path))["alert"]
    return rows.select("alert_id", "zone_id", "severity", "anomaly_score", "acknowledged", "timestamp")


@query("snk2_increment_by_partition", "SELECT harvest_date, count(*) AS n, sum(harvest_weight_kg) AS kg FROM harvest GROUP BY 1", {"kg": 4})
def _(t):
    """A first load in which two years have doubled weights; the increment rewrites only the partitions it carries."""
    path = work_dir(t.spark, "increment")
    rows = t.harvest.withColumn("year", F.year("harvest_date"))
    wrong = F.when(F.col("year").isin(2000, 2001), F.col("harvest_weight_kg") * 2).otherwise(F.col("harvest_weight_kg"))
    sinks.replace_partitions(rows.withColumn("harvest_weight_kg", wrong), path, ["year"])
    for year in (2000, 2001):
        sinks.replace_partitions(rows.filter(F.col("year") == year), path, ["year"])
    return t.spark.read.parquet(path).groupBy("harvest_date").agg(F.count(F.lit(1)).alias("n"), F.sum("harvest_weight_kg").alias("kg"))


@query("src8_history_round_trip", "SELECT anomaly_id, zone_ids, severity, start_time, end_time AS resolved_time FROM scenarios")
def _(t):
    path = work_dir(t.spark, "history")
    rows = t.scenarios.select("anomaly_id", "scenario", F.split("zone_ids", ",").alias("zone_ids"), "severity", "start_time", F.col("end_time").alias("resolved_time"))
    sinks.write_history(rows, path)
    back = readers.read_history(t.spark, path)
    return back.select("anomaly_id", F.array_join("zone_ids", ",").alias("zone_ids"), "severity", "start_time", "resolved_time")


def _database(t) -> str:
    """A database of its own in the shared folder."""
    path = work_dir(t.spark, "tables")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    t.spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    return name


@query("src2_pl1_ingest", """
  SELECT 'iot_telemetry' AS dataset, count(*) AS n FROM telemetry UNION ALL SELECT 'weather', count(*) FROM weather UNION ALL SELECT 'equipment', count(*) FROM equipment
  UNION ALL SELECT 'daily_harvest', NULL UNION ALL SELECT 'energy', NULL UNION ALL SELECT 'shipments', NULL""")
def _(t):
    """Three raw datasets are there, three cannot be read: the counts of the audit, NULL for those skipped."""
    root, database = work_dir(t.spark, "raw"), _database(t)
    for name, df in (("iot_telemetry", t.telemetry), ("weather", t.weather), ("equipment", t.equipment)):
        sinks.write_partitioned(df, f"{root}/{name}")
    counts, skipped = readers.ingest(t.spark, root, database)
    rows = [(k.removeprefix(f"{database}.raw_"), v) for k, v in counts.items()] + [(k, None) for k in skipped]
    return t.spark.createDataFrame(rows, "dataset string, n bigint")


@query("src4_snk8_catalogue_scan", "SELECT zone_id, count(*) AS n, min(timestamp) AS first, count(*) AS audited FROM telemetry GROUP BY 1")
def _(t):
    """A table found by name in the catalogue, with the audit count of its rows."""
    table = f"{_database(t)}.readings"
    sinks.overwrite_table(t.telemetry, table)
    whole = sinks.table_rows(t.spark, table)
    rows = t.spark.table(table).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), (F.count(F.lit(1)) + F.lit(whole) - F.lit(t.telemetry.count())).alias("audited"))
    return rows


@query("snk1_overwrite", "SELECT zone_id, timestamp, air_temperature FROM telemetry")
def _(t):
    """The second load has other columns; nothing of the first is left."""
    table = f"{_database(t)}.readings"
    sinks.overwrite_table(t.weather, table)
    sinks.overwrite_table(t.telemetry.select("zone_id", "timestamp", "air_temperature"), table)
    return t.spark.table(table)


@query("set3_append", "SELECT order_id, ship_date FROM shipments UNION ALL SELECT order_id, ship_date FROM shipments WHERE delivery_status = 'delayed'")
def _(t):
    table = f"{_database(t)}.shipments"
    rows = t.shipments.select("order_id", "ship_date")
    sinks.overwrite_table(rows, table)
    sinks.append_table(t.shipments.filter("delivery_status = 'delayed'").select("order_id", "ship_date"), table)
    return t.spark.table(table)


@query("snk6_empty_table", "SELECT timestamp, zone_id, alert_id, CAST(NULL AS VARCHAR) AS message FROM alerts")
def _(t):
    """An empty table of the declared schema takes rows later."""
    table = f"{_database(t)}.alerts"
    sinks.create_table(t.spark, table, schemas.ALERTS)
    assert t.spark.table(table).isEmpty()
    sinks.append_table(sinks.merge_schema(t.alerts.drop("message"), schemas.ALERTS).select(*schemas.ALERTS.fieldNames()), table)
    return t.spark.table(table).select("timestamp", "zone_id", "alert_id", "message")


@query("snk10_bucketed", "SELECT greenhouse_id, count(*) AS n, max(air_temperature) AS hottest FROM telemetry GROUP BY 1")
def _(t):
    table = f"{_database(t)}.readings"
    sinks.write_hashed(t.telemetry, table, buckets=4)
    return t.spark.table(table).groupBy("greenhouse_id").agg(F.count(F.lit(1)).alias("n"), F.max("air_temperature").alias("hottest"))


@query("fm27_transport_fit", """
  SELECT order_id, product_sku, cold_chain_temp BETWEEN lo AND hi AS fits FROM shipments s
  JOIN (SELECT crop_id, CASE WHEN crop_category = 'leafy_green' THEN 1e0 ELSE 0e0 END AS lo, CASE WHEN crop_category = 'vine_crop' THEN 6e0 ELSE 4e0 END AS hi FROM dim_crop) r ON r.crop_id = s.crop_id""")
def _(t):
    ranges = t.dim_crop.select("crop_id", F.when(F.col("crop_category") == "leafy_green", 1.0).otherwise(0.0).alias("lo"), F.when(F.col("crop_category") == "vine_crop", 6.0).otherwise(4.0).alias("hi"))
    return t.shipments.join(ranges, "crop_id").select("order_id", "product_sku", fm.transport_fit("cold_chain_temp", "lo", "hi").alias("fits"))


# --- one query per measure -------------------------------------------------------------------
# number, key, attribute, SQL expression, fact with its date column, digits

_H = ("harvest f", "f.harvest_date")
_E = ("o_energy f", "f.date")
_S = ("o_shipments f", "f.ship_date")
_A = ("anomaly_events f", None)
_V = ("env_daily f", "f.date")
_ZONE = ("dim_zone.zone_id", "zone_id", "f.zone_id")
_IN_SPAN = "BETWEEN (SELECT lo FROM o_span) AND (SELECT hi FROM o_span)"
_YEAR = lambda src: ("dim_date.year", "year", f"CASE WHEN {src[1]} {_IN_SPAN} THEN CAST(year({src[1]}) AS INT) END")
_CROP = ("dim_crop.crop_name", "crop_name", "concat('Crop ', substr(f.crop_id, 5))")
_SITE = ("dim_greenhouse.name", "name", "concat('Site ', f.greenhouse_id)")
_REGION = ("dim_customer.region", "region", "(SELECT c_mktsegment FROM customer WHERE CAST(c_custkey AS VARCHAR) = f.customer_id)")
_PACK = ("dim_product.package_type", "package_type", "(SELECT p_type FROM part WHERE CAST(p_partkey AS VARCHAR) = f.product_id)")

SIMPLE = [
    (1, "total_harvest_kg", _CROP, "sum(harvest_weight_kg)", _H, 4),
    (3, "grade_a_pct", _ZONE, "sum(harvest_weight_kg * grade_a_pct / 1e2) / sum(harvest_weight_kg) * 100", _H, 6),
    (5, "revenue_usd", _YEAR(_H), "sum(revenue_estimate_usd)", _H, 2),
    (6, "waste_pct", _SITE, "sum(waste_kg) / (sum(harvest_weight_kg) + sum(waste_kg)) * 100", _H, 6),
    (7, "total_units_harvested", _CROP, "CAST(sum(harvest_units) AS BIGINT)", _H, None),
    (8, "avg_cycle_length_days", _ZONE, "avg(days_to_harvest)", _H, 6),
    (9, "energy_cost_usd", _YEAR(_E), "sum(energy_cost_usd)", _E, 3),
    (12, "water_recycling_rate_pct", _SITE, "sum(water_recycled_liters) / sum(water_liters) * 100", _E, 6),
    (13, "carbon_footprint_kg", _YEAR(_E), "sum(electricity_kwh) * 0.42e0 + sum(natural_gas_m3) * 1.93e0", _E, 3),
    (14, "gas_usage_m3", _SITE, "sum(natural_gas_m3)", _E, 3),
    (15, "electricity_kwh", _SITE, "sum(electricity_kwh)", _E, 3),
    (16, "water_usage_l", _YEAR(_E), "sum(water_liters)", _E, 3),
    (17, "on_time_delivery_pct", _REGION, "count(*) FILTER (on_time_flag) / CAST(count(*) AS DOUBLE) * 100", _S, 6),
    (18, "cold_chain_compliance_pct", _PACK, "count(*) FILTER (cold_chain_compliant) / CAST(count(*) AS DOUBLE) * 100", _S, 6),
    (19, "avg_shelf_life_days", _PACK, "avg(shelf_life_remaining_days)", _S, 6),
    (20, "cases_shipped", _REGION, "CAST(sum(quantity_cases) AS BIGINT)", _S, None),
    (21, "shipment_count", _YEAR(_S), "count(*)", _S, None),
    (22, "fill_rate_pct", _YEAR(_S), "sum(quantity_cases) / CAST(sum(quantity_ordered) AS DOUBLE) * 100", _S, 6),
    (23, "prevented_loss_usd", _SITE, "sum(prevented_loss_usd)", _A, 3),
    (24, "avg_response_time_min", _SITE, "avg(response_time_minutes)", _A, 6),
    (25, "anomaly_count", _SITE, "count(*)", _A, None),
    (26, "days_since_last_anomaly", _SITE, "CAST(date_diff('day', CAST(max(start_time) AS DATE), (SELECT CAST(max(start_time) AS DATE) FROM anomaly_events)) AS INT)", _A, None),
    (27, "avg_zone_temperature_c", _ZONE, "avg(avg_temp)", _V, 6),
    (28, "optimal_hours_pct", _ZONE, "sum(hours_in_optimal_range) / (count(*) * 24) * 100", _V, 6),
    (29, "avg_dli", _YEAR(_V), "avg(total_dli)", _V, 6),
    (30, "temp_excursion_hours", _ZONE, "sum(temp_excursion_hours)", _V, 4),
]


def _register(number, key, attr, expr, source, digits):
    path, name, group = attr
    sql = f"SELECT {group} AS {name}, {expr} AS {key} FROM {source[0]} GROUP BY 1"

    @query(f"mea{number}_{key}", sql, {key: digits} if digits else None)
    def _(t):
        return me.evaluate(model(t), [key], [path])


for _row in SIMPLE:
    _register(*_row)


@query("mea2_yield_per_sqft_kg", """
  SELECT zone_id, sum(harvest_weight_kg) / (any_value(size_sqft) / 10.764e0) AS yield_per_sqft_kg FROM harvest JOIN (SELECT zone_id, size_sqft FROM dim_zone) USING (zone_id) GROUP BY 1""",
       cols("yield_per_sqft_kg"))
def _(t):
    return me.evaluate(model(t), ["yield_per_sqft_kg"], ["dim_zone.zone_id"])


@query("mea33_yield_per_sqft_by_crop", """
  SELECT concat('Crop ', substr(crop_id, 5)) AS crop_name, sum(harvest_weight_kg) / ((SELECT sum(size_sqft) FROM dim_zone) / 10.764e0) AS yield_per_sqft_kg FROM harvest GROUP BY 1""",
       cols("yield_per_sqft_kg"))
def _(t):
    """The floor area ignores the crop selection: only a zone filter reaches it."""
    return me.evaluate(model(t), ["yield_per_sqft_kg"], ["dim_crop.crop_name"])


_YOY = f"""
  WITH c AS (SELECT CAST(year(harvest_date) AS INT) AS year, sum(harvest_weight_kg) AS kg FROM harvest GROUP BY 1),
  p AS (SELECT CAST(year(harvest_date + INTERVAL 12 MONTH) AS INT) AS year, sum(harvest_weight_kg) AS kg FROM harvest WHERE CAST(harvest_date + INTERVAL 12 MONTH AS DATE) {_IN_SPAN} GROUP BY 1),
  ce AS (SELECT CASE WHEN date {_IN_SPAN} THEN CAST(year(date) AS INT) END AS year, sum(energy_cost_usd) AS cost FROM o_energy GROUP BY 1),
  pe AS (SELECT CAST(year(date + INTERVAL 12 MONTH) AS INT) AS year, sum(energy_cost_usd) AS cost FROM o_energy WHERE CAST(date + INTERVAL 12 MONTH AS DATE) {_IN_SPAN} GROUP BY 1),
  y AS (SELECT year FROM c UNION SELECT year FROM ce)"""


@query("mea4_yoy_yield_growth_pct", _YOY + """
  SELECT year, (coalesce(c.kg, 0) - p.kg) / p.kg * 100 AS yoy_yield_growth_pct FROM c FULL JOIN p USING (year)""", cols("yoy_yield_growth_pct"))
def _(t):
    return me.evaluate(model(t), ["yoy_yield_growth_pct"], ["dim_date.year"])


@query("mea4_yoy_by_crop_and_year", """
  WITH h AS (SELECT concat('Crop ', substr(crop_id, 5)) AS crop_name, harvest_date, harvest_weight_kg FROM harvest WHERE NOT (crop_id LIKE '%1' AND year(harvest_date) = 1996)),
  c AS (SELECT crop_name, CAST(year(harvest_date) AS INT) AS year, sum(harvest_weight_kg) AS kg FROM h GROUP BY ALL),
  p AS (SELECT crop_name, CAST(year(harvest_date + INTERVAL 12 MONTH) AS INT) AS year, sum(harvest_weight_kg) AS kg FROM h WHERE CAST(harvest_date + INTERVAL 12 MONTH AS DATE) """ + _IN_SPAN + """ GROUP BY ALL)
  SELECT crop_name, year, (coalesce(c.kg, 0) - p.kg) / p.kg * 100 AS yoy_yield_growth_pct FROM c FULL JOIN p USING (crop_name, year)""", cols("yoy_yield_growth_pct"))
def _(t):
    """Some crops have no harvest in one year: they show there with -100."""
    m = model(t)
    m.facts[me.HARVEST] = m.facts[me.HARVEST].filter(~(F.col("crop_id").endswith("1") & (F.year("harvest_date") == 1996)))
    return me.evaluate(m, ["yoy_yield_growth_pct"], ["dim_crop.crop_name", "dim_date.year"])


@query("mea32_yoy_by_date", """
  WITH c AS (SELECT harvest_date AS date, sum(harvest_weight_kg) AS kg FROM harvest GROUP BY 1),
  p AS (SELECT CAST(harvest_date + INTERVAL 12 MONTH AS DATE) AS date, sum(harvest_weight_kg) AS kg FROM harvest WHERE CAST(harvest_date + INTERVAL 12 MONTH AS DATE) """ + _IN_SPAN + """ GROUP BY 1)
  SELECT date, c.kg AS total_harvest_kg, (coalesce(c.kg, 0) - p.kg) / p.kg * 100 AS yoy_yield_growth_pct FROM c FULL JOIN p USING (date)""", cols("total_harvest_kg yoy_yield_growth_pct"))
def _(t):
    return me.evaluate(model(t), ["total_harvest_kg", "yoy_yield_growth_pct"], ["dim_date.date"])


@query("mea10_energy_cost_per_kg", _YOY + " SELECT y.year, cost / kg AS energy_cost_per_kg FROM y LEFT JOIN c ON c.year = y.year LEFT JOIN ce ON ce.year = y.year", cols("energy_cost_per_kg"))
def _(t):
    return me.evaluate(model(t), ["energy_cost_per_kg"], ["dim_date.year"])


@query("mea11_yoy_energy_efficiency_pct", _YOY + """
  SELECT y.year, (pe.cost / p.kg - coalesce(ce.cost / c.kg, 0)) / (pe.cost / p.kg) * 100 AS yoy_energy_efficiency_pct FROM y LEFT JOIN c ON c.year = y.year
  LEFT JOIN ce ON ce.year = y.year LEFT JOIN p ON p.year = y.year LEFT JOIN pe ON pe.year = y.year""",
       cols("yoy_energy_efficiency_pct"))
def _(t):
    return me.evaluate(model(t), ["yoy_energy_efficiency_pct"], ["dim_date.year"])


@query("mea0_unrelated_key", """
  SELECT f.zone_id, sum(harvest_weight_kg) AS total_harvest_kg, (SELECT sum(energy_cost_usd) FROM o_energy) AS energy_cost_usd FROM harvest f GROUP BY 1""", cols("total_harvest_kg energy_cost_usd", 3))
def _(t):
    """Energy has no link to zones: its total shows in every row."""
    return me.evaluate(model(t), ["total_harvest_kg", "energy_cost_usd"], ["dim_zone.zone_id"])


@query("mea0_filters", """
  SELECT CAST(year(f.harvest_date) AS INT) AS year, sum(harvest_weight_kg) AS total_harvest_kg, sum(revenue_estimate_usd) AS revenue_usd FROM harvest f
  WHERE crop_id IN ('crop1', 'crop2') AND greenhouse_id = 'G0' AND year(harvest_date) >= 1997 GROUP BY 1""", cols("total_harvest_kg revenue_usd", 3))
def _(t):
    return me.evaluate(model(t), ["total_harvest_kg", "revenue_usd"], ["dim_date.year"], {
        "dim_crop.crop_name": lambda c: c.isin("Crop 1", "Crop 2"), "dim_greenhouse.greenhouse_id": lambda c: c == "G0", "dim_date.year": lambda c: c >= 1997})


@query("mea35_date_hierarchy", """
  SELECT CAST(year(harvest_date) AS INT) AS year, concat('Q', quarter(harvest_date)) AS quarter, monthname(harvest_date) AS month_name, harvest_date AS date,
    CAST(grouping(year) + grouping(quarter) + grouping(month_name) + grouping(date) AS INT) AS grouping_level, sum(harvest_weight_kg) AS total_harvest_kg FROM
    (SELECT *, CAST(year(harvest_date) AS INT) AS year, concat('Q', quarter(harvest_date)) AS quarter, monthname(harvest_date) AS month_name, harvest_date AS date FROM harvest)
  GROUP BY ROLLUP (year, quarter, month_name, date)""".replace("SELECT CAST(year(harvest_date) AS INT) AS year, concat('Q', quarter(harvest_date)) AS quarter, monthname(harvest_date) AS month_name, harvest_date AS date,\n    CAST", "SELECT year, quarter, month_name, date,\n    CAST"),
       cols("total_harvest_kg", 4))
def _(t):
    return me.hierarchy(model(t), ["total_harvest_kg"], "date")


@query("mea35_geography_hierarchy", """
  SELECT country, location_state, location_city, CAST(grouping(country) + grouping(location_state) + grouping(location_city) AS INT) AS grouping_level, sum(energy_cost_usd) AS energy_cost_usd
  FROM o_energy f LEFT JOIN (SELECT greenhouse_id, country, location_state, location_city FROM dim_greenhouse) g USING (greenhouse_id) GROUP BY ROLLUP (country, location_state, location_city)""",
       cols("energy_cost_usd", 3))
def _(t):
    return me.hierarchy(model(t), ["energy_cost_usd"], "geography")


@query("mea34_formatted", """
  SELECT crop_name, v AS waste_pct, concat(format('{:,.1f}', floor(v * 10 + 0.5e0) / 10), '%') AS waste_pct_text FROM
    (SELECT concat('Crop ', substr(crop_id, 5)) AS crop_name, sum(waste_kg) / (sum(harvest_weight_kg) + sum(waste_kg)) * 100 AS v FROM harvest GROUP BY 1)""", cols("waste_pct"))
def _(t):
    return me.formatted(me.evaluate(model(t), ["waste_pct"], ["dim_crop.crop_name"]), ["waste_pct"])


@query("mea36_month_sort", """
  SELECT month_name, month_num, total_harvest_kg, CAST(row_number() OVER (ORDER BY month_num) AS INT) AS position FROM
    (SELECT monthname(harvest_date) AS month_name, CAST(month(harvest_date) AS INT) AS month_num, sum(harvest_weight_kg) AS total_harvest_kg FROM harvest GROUP BY 1, 2)""", cols("total_harvest_kg", 4))
def _(t):
    from pyspark.sql import Window

    rows = me.evaluate(model(t), ["total_harvest_kg"], ["dim_date.month_name", f"dim_date.{me.SORT_BY['month_name']}"])
    # twelve rows: the ordering window runs after the aggregate
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("month_num")))


@query("ag20_default_aggregates", """
  SELECT zone_id, avg(avg_temp) AS avg_temp, min(min_temp) AS min_temp, max(max_temp) AS max_temp, sum(temp_excursion_hours) AS temp_excursion_hours FROM env_daily GROUP BY 1""",
       cols("avg_temp min_temp max_temp temp_excursion_hours", 4))
def _(t):
    return me.auto(model(t), "fact_zone_daily_environment", ["avg_temp", "min_temp", "max_temp", "temp_excursion_hours"], ["dim_zone.zone_id"])


@query("jn13_star_join_orphans", """
  SELECT p.package_type, p.sku, count(*) AS lines FROM (SELECT CASE WHEN quantity_cases > 45 THEN concat(product_id, '-x') ELSE product_id END AS product_id FROM o_shipments) f
  LEFT JOIN dim_product p ON p.product_id = f.product_id GROUP BY ALL""")
def _(t):
    m = model(t)
    ship = m.facts["fact_shipments"]
    odd = F.when(F.col("quantity_cases") > 45, F.concat("product_id", F.lit("-x"))).otherwise(F.col("product_id"))
    m.facts["fact_shipments"] = ship.withColumn("product_id", odd)
    return me.evaluate(m, ["shipment_count"], ["dim_product.package_type", "dim_product.sku"]).withColumnRenamed("shipment_count", "lines")


@query("fm6_fm13_zero_guards", """
  SELECT o_orderkey, CASE WHEN o_orderkey * 7 % 1000 > 0 THEN 80e0 ELSE 0e0 END AS recycling_pct FROM orders""", cols("recycling_pct"))
def _(t):
    used = (F.col("o_orderkey") * 7 % 1000).cast("double")
    return t.orders.select("o_orderkey", fm.recycling_pct(used, used * 0.8).alias("recycling_pct"))
