from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from zonelytics import schemas, seeds
from zonelytics.plans import measures as me
from zonelytics.plans import pipeline as pl
from zonelytics.session import work_dir
from zonelytics.sources import readers, sinks

GOOD = dict(greenhouse_id="g", air_temperature=20.0, air_humidity=60.0, co2_level=800.0, substrate_ph=6.0, par_light=100.0, substrate_ec=1.5, vpd=1.0)


def sensor_rows(spark, *changes):
    rows = [{**GOOD, "timestamp": "2024-01-01T00:00:00", "zone_id": f"z{i}", **c} for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, ", ".join(f"{k} {'string' if k in ('timestamp', 'zone_id', 'greenhouse_id') else 'double'}" for k in rows[0]))


def test_clean_sensors_keeps_only_valid_rows(spark):
    raw = sensor_rows(
        spark, {}, {"air_temperature": -11.0}, {"air_temperature": 51.0}, {"air_humidity": None}, {"timestamp": "not a time"}, {"air_temperature": 50.0},
        {"zone_id": "z0", "air_temperature": 21.0})
    kept = {r["zone_id"]: r["air_temperature"] for r in pl.clean_sensors(raw).collect()}
    assert kept == {"z0": 20.0, "z5": 50.0}


def test_energy_day_without_harvest_costs_zero_per_kg(spark):
    energy = spark.createDataFrame([("2024-01-01T00:00:00", "g", 10.0, 2.0, 0.0, 5.0, 1.0)], "timestamp string, greenhouse_id string, electricity_kwh double, natural_gas_m3 double, water_liters double, water_recycled_liters double, co2_purchased_kg double")
    clean = pl.clean_energy(energy)
    assert clean.first()["water_recycling_pct"] == 0.0
    harvest = spark.createDataFrame([], schemas.FACTS["fact_daily_harvest"])
    row = pl.fact_daily_energy(clean, harvest).first()
    assert row["energy_per_kg_produce"] == 0.0 and row["energy_cost_usd"] == pytest.approx(10 * 0.12 + 2 * 0.45)


def test_weekly_health_has_declared_types(spark):
    df = pl.fact_weekly_crop_health(pl.clean_sensors(sensor_rows(spark, {"zone_id": "BH-Z01"})), seeds.zone_config(spark))
    assert df.schema["week_start"].dataType.simpleString() == "date"
    assert df.columns == schemas.FACTS["fact_weekly_crop_health"].fieldNames()
    assert df.first()["week_start"] == date(2024, 1, 1) and df.first()["crop_id"] == "baby_spinach"


def test_conform_reports_missing_columns(spark):
    with pytest.raises(ValueError, match="order_id"):
        pl.conform(spark.range(1), "fact_shipments")


def test_partitioned_sink_and_ingest(spark):
    root = work_dir(spark, "raw")
    rows = [("2024-01-01T10:00:00", "g0", 1.0), ("2024-01-02T10:00:00", "g1", 2.0), ("2024-01-02T11:00:00", "g1", 3.0)]
    df = spark.createDataFrame(rows, "timestamp string, greenhouse_id string, v double")
    sinks.write_partitioned(df, f"{root}/weather")
    sinks.write_partitioned(df, f"{root}/weather", files_per_partition=4)  # appends
    back = readers.read_raw(spark, root, "weather")
    assert back.count() == 6 and set(back.columns) == {"timestamp", "v", "greenhouse_id", "date"}
    counts, skipped = readers.ingest(spark, root, prefix="t_io_")
    assert counts == {"t_io_weather": 6} and len(skipped) == 5
    table = spark.table("t_io_weather")
    assert table.filter(F.col("_source_file").contains("greenhouse_id=g1")).count() == 4
    spark.sql("DROP TABLE t_io_weather")


def test_dynamic_partition_overwrite(spark):
    path = work_dir(spark, "dyn")
    make = lambda rows: spark.createDataFrame(rows, "d string, v int")
    sinks.replace_partitions(make([("a", 1), ("b", 2)]), path, ["d"])
    sinks.replace_partitions(make([("b", 3)]), path, ["d"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("d", "v").collect()) == [("a", 1), ("b", 3)]


def test_csv_messages_and_history(spark):
    base = work_dir(spark, "sinks")
    df = spark.createDataFrame([(datetime(2024, 1, 1), "z", 1.5)], "timestamp timestamp, zone_id string, air_temperature double")
    sinks.write_csv(df, f"{base}/csv")
    assert spark.read.option("header", True).csv(f"{base}/csv").columns == df.columns
    assert sinks.publish(df, "sensor_telemetry") == 1  # dry run
    assert sinks.publish(df, "sensor_telemetry", f"{base}/msg") == 1
    routed = readers.route_messages(spark.read.text(f"{base}/msg"))
    row = routed["sensor_telemetry"].first()
    assert (row["timestamp"], row["zone_id"], row["air_temperature"], row["vpd"]) == (datetime(2024, 1, 1), "z", 1.5, None)
    assert routed["weather"].isEmpty() and routed["rejected"].isEmpty()
    history = spark.createDataFrame(
        [("a", "hvac-failure", "HVAC", "g", ["z1", "z2"], 0.9, datetime(2024, 1, 1), datetime(2024, 1, 1, 1), 3600.0, True, {"root_cause": "fuel"})], schemas.ANOMALY_HISTORY)
    sinks.write_history(history, f"{base}/history")
    event = pl.fact_anomaly_events(readers.read_history(spark, f"{base}/history")).first()
    assert (event["zone_ids"], event["severity"], event["root_cause"], event["response_time_minutes"]) == ("z1,z2", "critical", "fuel", 60.0)


def test_json_array_document(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"anomaly_id": "a", "zone_ids": ["z"]}, {"anomaly_id": "b", "zone_ids": []}]')
    assert [r["anomaly_id"] for r in readers.read_history(spark, str(tmp_path / "h.json"), array=True).collect()] == ["a", "b"]


def test_json_mapping_is_lenient_per_field_and_rejects_non_objects(spark):
    texts = ['{"a": 1, "b": {"c": "x"}}', '{"a": "no number"}', "[1]", "{broken", "5", None]
    rows, bad = readers.from_json_mapping(spark.createDataFrame([(t,) for t in texts], "value string"), {"a": ("$.a", "int"), "c": ("$.b.c", "string")})
    assert sorted((tuple(r) for r in rows.collect()), key=str) == [(1, "x"), (None, None)]
    assert bad.count() == 4


def test_bucketed_table_aggregates_without_exchange(spark):
    df = spark.createDataFrame([("g0", datetime(2024, 1, 1), 1.0), ("g1", datetime(2024, 1, 1), 2.0)], "greenhouse_id string, timestamp timestamp, v double")
    sinks.write_hashed(df, "t_io_bucketed")
    plan = spark.table("t_io_bucketed").groupBy("greenhouse_id").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE t_io_bucketed")


def test_empty_table_merge_schema_retention(spark):
    sinks.create_table(spark, "t_io_empty", schemas.FACTS["fact_shipments"], "ship_date")
    assert sinks.table_rows(spark, "t_io_empty") == 0
    spark.sql("DROP TABLE t_io_empty")
    merged = sinks.merge_schema(spark.createDataFrame([("x", 1)], "alert_id string, extra int"), schemas.ALERTS)
    assert merged.columns == [*schemas.ALERTS.fieldNames(), "extra"]
    rows = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2021, 1, 1),)], "timestamp timestamp")
    assert sinks.retained(rows, "2024-06-01").count() == 1


# --- measures ------------------------------------------------------------------------------

def tiny_model(spark, rows):
    harvest = spark.createDataFrame(rows, "harvest_date date, zone_id string, greenhouse_id string, crop_id string, harvest_weight_kg double, waste_kg double")
    from zonelytics.functions.timebins import dim_date

    return me.Model({"fact_daily_harvest": harvest}, {**seeds.dims(spark), "dim_date": dim_date(spark, "2023-01-01", "2025-12-31")})


def test_leap_day_folds_onto_the_28th(spark):
    m = tiny_model(spark, [(date(2024, 2, 28), "a", "g", "c", 1.0, 0.0), (date(2024, 2, 29), "a", "g", "c", 2.0, 0.0), (date(2025, 2, 28), "a", "g", "c", 6.0, 0.0)])
    rows = {r["date"]: r["yoy_yield_growth_pct"] for r in me.evaluate(m, ["yoy_yield_growth_pct"], ["dim_date.date"]).collect()}
    assert rows[date(2025, 2, 28)] == pytest.approx(100.0) and rows[date(2024, 2, 29)] is None


def test_zero_denominator_is_blank_and_rollup_adds_up(spark):
    m = tiny_model(spark, [(date(2024, 1, 1), "BH-Z01", "brightharvest", "c", 0.0, 0.0), (date(2024, 1, 2), "BH-Z02", "brightharvest", "c", 4.0, 1.0)])
    by_zone = {r["zone_id"]: r["waste_pct"] for r in me.evaluate(m, ["waste_pct"], ["dim_zone.zone_id"]).collect()}
    assert by_zone == {"BH-Z01": None, "BH-Z02": pytest.approx(20.0)}
    rolled = me.evaluate(m, ["total_harvest_kg"], ["dim_zone.greenhouse_id", "dim_zone.zone_id"], rollup=True).collect()
    assert {r["grouping_level"]: r["total_harvest_kg"] for r in rolled if r["grouping_level"] > 0} == {1: 4.0, 2: 4.0}


def test_measure_catalogue_is_complete():
    assert len([m for m in me.MEASURES if m != "carbon_intensity"]) == 30
    assert sum(len(v) for v in me.RELATIONSHIPS.values()) == 14
