from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from zonelytics.operators.rules import Branch, Rule, action_rows, daily_ids, fire, rule_events, spaced, throttle
from zonelytics.plans import alerting as al
from zonelytics.session import work_dir
from zonelytics.streaming import ingest
from zonelytics.streaming import rules as sr

T0 = datetime(2024, 1, 1, 5, 58)
RULE = Rule("hot", (Branch("hot", "v > 3", 120),), cooldown=900, resolve="v <= 1")


def timeline(frame, values, step=30, zone="z", start=T0):
    return frame([(zone, start + timedelta(seconds=step * i), float(v)) for i, v in enumerate(values) if v is not None], "zone_id string, timestamp timestamp, v double")


def fired(df, rule=RULE, **kw):
    return sorted((r["timestamp"] - T0).total_seconds() for r in rule_events(df, rule, **kw).filter("fired").collect())


def test_short_run_does_not_fire(frame):
    assert fired(timeline(frame, [9] * 4 + [0] * 5)) == []


def test_fires_once_on_the_fifth_reading(frame):
    # the run crosses a six-hour chunk border at 06:00
    assert fired(timeline(frame, [0, 0, 9, 9, 9, 9, 9, 9, 0])) == [60 + 120]
    assert fired(timeline(frame, [9] * 40), chunk=300) == [120]
    assert fired(timeline(frame, [9] * 40), chunk=60) == [120]  # grows to the halo


def test_a_gap_starts_a_new_run(frame):
    assert fired(timeline(frame, [9, 9, 9, None, 9, 9])) == [120]  # 60 s is still joined
    assert fired(timeline(frame, [9, 9, 9, None, None, 9, 9, 9, 9, 9])) == [150 + 120]


def test_null_is_false(frame):
    df = timeline(frame, [9] * 10).withColumn("v", F.when(F.col("timestamp") != F.lit(T0 + timedelta(seconds=90)), F.col("v")))
    assert fired(df) == [120 + 120]


def test_last_reading_of_an_interval_counts(frame):
    rows = [("z", T0 + timedelta(seconds=30 * i + d), v) for i in range(8) for d, v in ((0, 0.0), (10, 9.0))]
    assert fired(frame(rows, "zone_id string, timestamp timestamp, v double")) == [130]


def test_cooldown_and_resolution(frame):
    values = [9] * 6 + [2, 0, 0] + [9] * 6 + [0] + [9] * 60 + [0]
    alerts = fire(timeline(frame, values), RULE).orderBy("timestamp").collect()
    assert [(r["timestamp"] - T0).total_seconds() for r in alerts] == [120]  # the second run begins inside the cooldown, the third fires inside it too
    assert (alerts[0]["resolved_at"] - T0).total_seconds() == 7 * 30


def test_or_branches_keep_their_own_runs(frame):
    rule = Rule("or", (Branch("a", "v = 1", 60), Branch("b", "v = 2", 60)), cooldown=0)
    assert fired(timeline(frame, [1, 1, 2, 2, 1, 1]), rule) == []
    assert fired(timeline(frame, [1, 1, 1, 2, 2, 2]), rule) == [60, 150]


def test_shipped_rules_parse():
    assert [r.cooldown for r in al.RULES.values()] == [900, 600, 1200, 300]
    assert [b.sustain for r in al.RULES.values() for b in r.branches] == [120, 90, 60, 180, 0]
    assert al.COLD_CHAIN.resolve is None and al.COLD_CHAIN.interval == 60
    assert "==" not in al.EQUIPMENT_OFFLINE.branches[0].condition


def test_one_alert_per_kept_instant(frame):
    rows = [("z", T0 + timedelta(seconds=s), n) for s in (0, 0, 100, 300, 300, 650) for n in (2, 1)]
    got = spaced(frame(rows, "zone_id string, timestamp timestamp, n int"), ["zone_id"], "timestamp", 300, tie=("n",)).collect()
    assert sorted(((r["timestamp"] - T0).total_seconds(), r["n"]) for r in got) == [(0, 1), (300, 1), (650, 1)]


def test_equipment_meets_the_nearest_reading_across_a_bin_edge(frame):
    equipment = frame([("a", T0 + timedelta(seconds=30), 1), ("b", T0, 2)], "zone_id string, timestamp timestamp, event_id long")
    readings = frame([("a", T0 + timedelta(seconds=29), 7, 1.0, 0.0), ("a", T0 + timedelta(seconds=45), 8, 2.0, 0.0)], "zone_id string, timestamp timestamp, event_id long, air_temperature double, substrate_moisture double")
    config = frame([("a", 20.0)], "zone_id string, target_temperature double")
    got = {r["zone_id"]: (r["air_temperature"], r["target_temperature"]) for r in al.equipment_with_readings(equipment, readings, config).collect()}
    assert got == {"a": (1.0, 20.0), "b": (None, None)}


def test_throttle_limits(frame):
    rows = [(f"z{z}", datetime(2024, 1, 1, h, m), "r") for z in range(30) for h in (0, 1) for m in range(5)]
    kept = throttle(frame(rows, "zone_id string, timestamp timestamp, rule string"))
    hours = {r["h"].hour: r["n"] for r in kept.groupBy(F.date_trunc("hour", "timestamp").alias("h")).agg(F.count("*").alias("n")).collect()}
    assert hours == {0: 50, 1: 50}
    few = throttle(frame([r for r in rows if r[0] == "z1"], "zone_id string, timestamp timestamp, rule string"))
    assert few.count() == 6


def test_action_rows_and_ids(frame):
    df = timeline(frame, [9] * 6).withColumns({"air_temperature": F.col("v") + 20, "target_temperature": F.lit(20.0), "greenhouse_id": F.lit("g"), "crop_name": F.lit("c")})
    alerts = fire(df, al.TEMPERATURE, carry=("greenhouse_id", "air_temperature", "target_temperature", "crop_name"))
    rows = {r["action_type"]: r for r in action_rows(alerts, al.TEMPERATURE).collect()}
    assert rows["TeamsNotification"]["body"] == "z in g is 9.0 degrees off target"
    assert '"deviation_value":"9.0"' in rows["NotebookTrigger"]["parameters"]
    assert daily_ids(alerts, "ALR", "timestamp", ["zone_id"]).first()["id"] == "ALR-20240101-0001"


@pytest.mark.parametrize("rule", [RULE, Rule("often", (Branch("hot", "v > 3", 60),), cooldown=60, resolve="v <= 1")])
def test_stream_equals_batch_over_many_files(spark, frame, rule):
    """Five files, rows shuffled inside each, a file border inside runs, one row beyond the watermark."""
    import random

    rng = random.Random(3)
    rows = [(f"z{z}", T0 + timedelta(seconds=30 * i), float(rng.choice([0, 2, 9, 9, 9, 9, 9]))) for i in range(400) for z in range(3)]
    assert len(rows) == 1200
    rows.append(("z0", T0 + timedelta(seconds=30 * 400 + 600), 0.0))  # moves the watermark past the rest
    base = work_dir(spark, "rules-test")
    size = len(rows) // 5 + 1
    for n in range(5):
        part = list(rows[n * size : (n + 1) * size])
        rng.shuffle(part)
        frame(part, "zone_id string, timestamp timestamp, v double").coalesce(1).write.mode("append").parquet(f"{base}/in")
    ingest.use_rocksdb(spark)
    batch = spark.read.parquet(f"{base}/in")
    stream = ingest.read_files(spark, f"{base}/in", batch.schema, files_per_trigger=1)
    log = sr.rule_stream(stream, rule)
    ingest.write_files(log, f"{base}/out", f"{base}/ckpt").awaitTermination()
    got = sr.current_alerts(spark.read.schema(log.schema).parquet(f"{base}/out"), rule)
    expected = fire(batch.filter(F.col("timestamp") < F.lit(rows[1200][1])), rule).select("zone_id", "timestamp", "resolved_at")
    a, b = sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, expected.collect()), key=str)
    assert a == b and len(a) > 3
