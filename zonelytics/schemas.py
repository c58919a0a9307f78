"""Declared schemas of event tables, raw records and the star schema."""

from __future__ import annotations

from pyspark.sql import types as T

TS, D, S, B, I, DATE = T.TimestampType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType(), T.DateType()


def _schema(spec: str) -> T.StructType:
    """``name type`` per comma; a trailing ``!`` marks a required column."""
    kinds = {"ts": TS, "d": D, "s": S, "b": B, "i": I, "date": DATE}
    fields = []
    for part in spec.replace("\n", " ").split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


TELEMETRY = _schema(
    "timestamp ts, greenhouse_id s, zone_id s, air_temperature d, air_humidity d, co2_level d, par_light d,"
    "substrate_temperature d, substrate_moisture d, substrate_ec d, substrate_ph d, water_flow_rate d, vpd d"
)
EQUIPMENT = _schema(
    "timestamp ts, greenhouse_id s, zone_id s, heating_output d, cooling_output d, vent_position d, supplemental_light b,"
    "supplemental_light_watts d, co2_injection_rate d, thermal_curtain d, irrigation_pump b, irrigation_flow d, recirc_pump b"
)
WEATHER = _schema(
    "timestamp ts, greenhouse_id s, outside_temperature d, outside_humidity d, wind_speed d, wind_direction d,"
    "precipitation d, solar_radiation d, barometric_pressure d, cloud_cover d"
)
ALERTS = _schema(
    "timestamp ts, alert_id s, greenhouse_id s, zone_id s, severity s, alert_type s, message s, anomaly_score d, acknowledged b"
)
ZONE_CONFIG = _schema(
    "zone_id s, greenhouse_id s, zone_name s, crop_id s, crop_name s, target_temperature d, target_humidity d,"
    "target_co2 d, target_ph d, target_ec d, size_sqft i"
)
# message type -> table schema
EVENT_TYPES = {"sensor_telemetry": TELEMETRY, "equipment_state": EQUIPMENT, "weather": WEATHER, "alert": ALERTS}

ANOMALY_HISTORY = T.StructType(
    [
        T.StructField("anomaly_id", S),
        T.StructField("scenario", S),
        T.StructField("display_name", S),
        T.StructField("greenhouse_id", S),
        T.StructField("zone_ids", T.ArrayType(S)),
        T.StructField("severity", D),
        T.StructField("start_time", TS),
        T.StructField("resolved_time", TS),
        T.StructField("duration_seconds", D),
        T.StructField("auto_resolved", B),
        T.StructField("metadata", T.MapType(S, S)),
    ]
)

FACTS = {
    "fact_daily_harvest": _schema(
        "harvest_date date!, zone_id s!, greenhouse_id s!, crop_id s!, harvest_weight_kg d, harvest_units i, grade_a_pct d,"
        "grade_b_pct d, grade_c_pct d, waste_kg d, waste_pct d, days_to_harvest i, revenue_estimate_usd d"
    ),
    "fact_zone_daily_environment": _schema(
        "date date!, zone_id s!, greenhouse_id s!, avg_temp d, min_temp d, max_temp d, avg_humidity d, avg_co2 d, total_dli d,"
        "avg_vpd d, avg_ec d, avg_ph d, hours_in_optimal_range d, temp_excursion_hours d"
    ),
    "fact_daily_energy": _schema(
        "date date!, greenhouse_id s!, electricity_kwh d, natural_gas_m3 d, water_liters d, water_recycled_liters d,"
        "co2_purchased_kg d, energy_cost_usd d, energy_per_kg_produce d"
    ),
    "fact_shipments": _schema(
        "ship_date date!, order_id s!, greenhouse_id s!, customer_id s!, product_id s!, crop_id s!, quantity_cases i,"
        "quantity_ordered i, delivery_status s, cold_chain_compliant b, shelf_life_remaining_days i, on_time_flag b"
    ),
    "fact_weekly_crop_health": _schema(
        "week_start date!, zone_id s!, greenhouse_id s!, crop_id s!, avg_plant_height_cm d, avg_leaf_count d,"
        "predicted_quality_grade s, predicted_yield_kg d"
    ),
    "fact_anomaly_events": _schema(
        "event_id s!, start_time ts!, end_time ts, greenhouse_id s!, zone_ids s, anomaly_type s, severity s, root_cause s,"
        "estimated_loss_usd d, prevented_loss_usd d, response_time_minutes d, resolution_status s"
    ),
}
DIMS = {
    "dim_date": _schema(
        "date_key date!, date date!, day_name s!, day_of_week i!, week_num i!, month_name s!, month_num i!, quarter s!,"
        "year i!, fiscal_year i!, is_weekend b!, season s!, day_of_year i!"
    ),
    "dim_greenhouse": _schema(
        "greenhouse_id s!, name s!, location_city s!, location_state s!, country s!, latitude d, longitude d, size_sqft i,"
        "zone_count i, growing_method s"
    ),
    "dim_zone": _schema("zone_id s!, greenhouse_id s!, zone_name s!, size_sqft i, primary_crop_id s"),
    "dim_crop": _schema(
        "crop_id s!, crop_name s!, crop_category s!, growth_cycle_days i, optimal_temp_c d, optimal_humidity_pct d,"
        "market_price_per_kg_usd d, shelf_life_days i"
    ),
    "dim_customer": _schema("customer_id s!, name s!, region s, country s, delivery_frequency s"),
    "dim_product": _schema("product_id s!, crop_id s!, product_name s!, package_type s, package_weight_kg d, sku s"),
}
PARTITION_COLUMN = {
    "fact_daily_harvest": "harvest_date",
    "fact_zone_daily_environment": "date",
    "fact_daily_energy": "date",
    "fact_shipments": "ship_date",
    "fact_weekly_crop_health": "week_start",
}
