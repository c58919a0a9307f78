"""Stream forms against batch forms, stored views through crashes, and plans that must not gather a key."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from zonelytics.operators.joins import dyadic_cover, interval_join
from zonelytics.operators.rules import Branch, Rule, escalate, fire, spaced, throttle
from zonelytics.operators.series import decompose_anomalies
from zonelytics.operators.windows import rolling_mean_days
from zonelytics.plans import measures as me
from zonelytics.plans import views
from zonelytics.session import work_dir
from zonelytics.sources import manifest, readers
from zonelytics.streaming import ingest
from zonelytics.streaming import rules as sr

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)
rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def streamed(spark, parts, schema, make, parsed=("timestamp",)):
    """What a stream over the parts, one file each in turn, has written at its end."""
    base = work_dir(spark, "stream-test")
    typed = lambda rows: spark.createDataFrame(rows, schema).withColumns({c: F.col(c).cast("timestamp") for c in parsed})
    for part in parts:
        typed(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    ingest.use_rocksdb(spark)
    out = make(ingest.read_files(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, files_per_trigger=1))
    ingest.write_files(out, f"{base}/out", f"{base}/ckpt").awaitTermination()
    return spark.read.parquet(f"{base}/in"), spark.read.schema(out.schema).parquet(f"{base}/out")


# thinning

def test_spaced_keeps_null_keys_and_gathers_nothing(frame):
    r = random.Random(2)
    rows = [(k, at(t), t) for k in ("a", None) for t in sorted(r.sample(range(3000), 900))] + [("a", None, 1)]
    out = spaced(frame(rows, "k string, timestamp timestamp, n int"), ["k"], "timestamp", 20, chunk=100)
    last, want = {}, set()
    for k, t, _ in rows[:-1]:
        if k not in last or t - last[k] >= timedelta(seconds=20):
            last[k] = t
            want.add((k, t))
    assert {(x.k, x.timestamp) for x in out.collect()} == want
    assert "collect_" not in plan_of(out)


# intervals

def test_dyadic_cover_is_small_and_exact(frame):
    r = random.Random(3)
    spans = [(i, at(a := r.randrange(-10**6, 10**6)), at(a + r.choice([0, 1, 899, 900, 10**4, 10**5]))) for i in range(60)] + [(99, T0, T0 + timedelta(days=3650))]
    cover = dyadic_cover(frame(spans, "id int, start_time timestamp, end_time timestamp")).select("id", "_level", "_slot").collect()
    slots = defaultdict(set)
    for i, level, slot in cover:
        new = set(range(slot << level, slot + 1 << level)) if i != 99 else {(level, slot)}
        assert not new & slots[i]
        slots[i] |= new
    assert len(slots[99]) < 100
    for i, a, b in spans[:-1]:
        first, last = (int((x - datetime(1970, 1, 1)) / timedelta(microseconds=1)) // 900_000_000 for x in (a, b - timedelta(microseconds=1)))
        assert slots[i] == (set(range(first, last + 1)) if b > a else set())


def test_left_interval_join_keeps_every_point(frame):
    r = random.Random(4)
    points = [(i, r.choice("ab"), at(r.randrange(50_000))) for i in range(200)]
    spans = [(f"s{i}", r.choice("ab"), at(a := r.randrange(50_000)), at(a + r.choice([60, 4000, 40_000]))) for i in range(6)]
    got = interval_join(frame(points, "id int, k string, timestamp timestamp"), frame(spans, "name string, k string, start_time timestamp, end_time timestamp"), ["k"], how="left")
    want = [(i, n) for i, k, t in points for n in ([n for n, j, a, b in spans if j == k and a <= t < b] or [None])]
    assert rows_of(got.select("id", "name")) == sorted(want, key=repr)


# series

def test_decomposition_has_no_window_over_a_series(frame):
    rows = [(k, at(3600 * i), float(i % 24 + (9 if i == 60 else 0))) for k in ("a", None) for i in range(120)]
    df = frame(rows, "k string, timestamp timestamp, v double")
    for options in ({}, {"period": 24}):
        by_step = decompose_anomalies(df, "v", ["k"], step=3600, **options)
        assert "Window" not in plan_of(by_step)
        rounded = lambda d: rows_of(d.select("k", "timestamp", F.round("score", 9), F.round("baseline", 9), "anomaly"))
        assert rounded(by_step) == rounded(decompose_anomalies(df, "v", ["k"], **options))
        assert by_step.filter("anomaly = 1 and k is null").count() >= 1


def test_rolling_means_by_day_do_not_depend_on_ties(frame):
    r = random.Random(5)
    days = {k: sorted(r.sample(range(400), 150)) for k in ("a", None)}
    value = {(k, d): r.random() for k in days for d in days[k]}
    rows = [(k, date(2024, 1, 1) + timedelta(days=d), value[k, d], c) for k in days for d in days[k] for c in range(r.choice([1, 1, 3]))]
    df = frame(rows, "k string, day date, v double, crop int")
    got = {(x.k, x.day): x.v_7d_avg for x in rolling_mean_days(df, ["v"], ["k"], "day", chunk=16).collect()}
    for k in days:
        for n, d in enumerate(days[k]):
            last = [value[k, x] for x in days[k][max(0, n - 6) : n + 1]]
            assert got[k, date(2024, 1, 1) + timedelta(days=d)] == pytest.approx(sum(last) / len(last))


# messages

def test_text_behind_an_object_is_rejected(spark):
    good = ['{"event_type": "weather", "greenhouse_id": "g"}', ' \n{"event_type": "alert", "alert_id": "a", "anomaly_score": "x"}\t']
    bad = ['{"event_type": "weather"} trailing', '{"event_type": "weather"}{"event_type": "weather"}', '{"event_type": "weather"},{"a": 1}', '{"event_type": "weather"}]', '{"event_type": "other"}', "[]", "", None]
    messages = readers.typed_messages(spark.createDataFrame([(x,) for x in good + bad], "value string"))
    assert sorted(x.kind for x in messages.collect()) == ["alert"] + ["rejected"] * len(bad) + ["weather"]
    alert = readers.of_kind(messages, "alert").first()
    assert (alert.alert_id, alert.anomaly_score) == ("a", None)
    assert sorted(x.value or "" for x in readers.of_kind(messages, "rejected").collect()) == sorted(x or "" for x in bad)


# stored views

def test_stored_view_survives_a_crash_and_late_repeats(spark, frame):
    base = work_dir(spark, "view-test")
    part = lambda s, v: views.merge_partials(views.hourly_partials(frame([("z", "g", at(s), v)], "zone_id string, greenhouse_id string, timestamp timestamp, v double").withColumns(
        {c: F.col("v") for c in views.HOURLY_AVERAGES})))
    read = lambda: [(x.reading_count, x.min_temp, x.max_temp) for x in views.stored_view(spark, base).collect()]
    views.store_batch(part(0, 1.0), base, 0)
    views.store_batch(part(60, 3.0), base, 1)
    views.store_batch(part(60, 3.0), base, 1)
    assert read() == [(2, 1.0, 3.0)]
    part(90, 9.0).write.parquet(manifest.new_folder(base, "batch-2"))  # died before its manifest
    assert read() == [(2, 1.0, 3.0)]
    views.compact_batches(spark, base)
    views.store_batch(part(60, 3.0), base, 1)
    assert read() == [(2, 1.0, 3.0)] and manifest.read_manifest(spark, base)["merged"] == [[0, 1]]
    views.store_batch(part(120, 5.0), base, 2)
    views.compact_batches(spark, base)
    assert read() == [(3, 1.0, 5.0)] and manifest.read_manifest(spark, base)["merged"] == [[0, 2]]


# measures

def test_both_years_from_one_scan(spark, frame):
    path = work_dir(spark, "fact")
    days = [date(2023, 3, 1), date(2024, 3, 1), date(2024, 3, 2)]
    frame([(days[0], "z", 10.0), (days[1], "z", 15.0), (days[2], "y", 1.0)], "harvest_date date, zone_id string, harvest_weight_kg double").write.parquet(path)
    calendar = spark.createDataFrame([(d, d, d.year) for d in days], "date_key date, date date, year int")
    model = me.Model({me.HARVEST: spark.read.parquet(path)}, {"dim_date": calendar}, {me.HARVEST: {"dim_date": ("harvest_date", "date_key")}})
    out = me.evaluate(model, ["total_harvest_kg", "yoy_yield_growth_pct"], ["dim_date.year"])
    assert rows_of(out) == [(2023, 10.0, None), (2024, 16.0, 60.0)]
    assert plan_of(out).count("Relation [harvest_date") == 1
    both = me.evaluate(model, ["total_harvest_kg"], filters={"dim_date.year": lambda c: c == 2024}, before=True)
    assert rows_of(both) == [(16.0, 10.0)] and plan_of(both).count("Relation [harvest_date") == 1
    with pytest.raises(ValueError):
        me.evaluate(model, ["yoy_yield_growth_pct"], before=True)


# streams

ALERTS = "zone_id string, timestamp timestamp, rule string, alert_id string, severity string, ack boolean"


def alerts(n, seed, acknowledged=0.4):
    r = random.Random(seed)
    rows = [(r.choice("abc"), at(r.randrange(4 * 3600)), r.choice(["r1", "r2"]), f"id{i}", r.choice(["critical", "critical", "warning"]), r.random() < acknowledged) for i in range(n)]
    rows.sort(key=lambda x: x[1])
    parts = [rows[i : i + 40] for i in range(0, n, 40)]
    for p in parts:
        r.shuffle(p)
    return parts + [[("end", at(10 * 3600), "r1", "end", "critical", True)]]


def test_stream_limits_equal_batch(spark):
    batch, got = streamed(spark, alerts(240, 1), ALERTS, lambda s: sr.throttle_stream(s, per_key=2, overall=5, delay="4 hours"))
    want = throttle(batch.filter("zone_id <> 'end'"), per_key=2, overall=5)
    assert rows_of(got.select("alert_id")) == rows_of(want.select("alert_id"))
    assert got.count() > 15


def test_stream_escalation_equals_batch_without_further_input(spark):
    def both(s):
        acks = s.filter("ack").select("zone_id", "rule", (F.col("timestamp") + F.expr("INTERVAL 20 MINUTES")).alias("ack_time"))
        return sr.escalate_stream(s, acks, delay="4 hours").select("alert_id", "timestamp", "escalated_at")

    parts = [[("lone", at(0), "r9", "lone", "critical", False)], *alerts(240, 2, 0.05)]
    batch, got = streamed(spark, parts, ALERTS, both)
    acks = batch.filter("ack").select("zone_id", "rule", (F.col("timestamp") + F.expr("INTERVAL 20 MINUTES")).alias("ack_time"))
    want = escalate(batch.filter("zone_id <> 'end'"), acks, as_of=at(6 * 3600)).select("alert_id", "timestamp", "escalated_at")
    assert rows_of(got) == rows_of(want)
    assert "lone" in {x.alert_id for x in got.collect()} and got.count() > 20


def test_open_alerts_leave_the_state(spark):
    class Kept:
        def __init__(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

    class One(Kept):
        def get(self):
            return self.rows[0]

        def update(self, row):
            self.rows = [row]

    class Map(dict):
        def containsKey(self, k):
            return k in self

        def getValue(self, k):
            return self[k]

        def updateValue(self, k, v):
            self[k] = v

        def removeKey(self, k):
            del self[k]

    import pandas as pd

    rule = Rule("r", (Branch("b", "v > 1", 0),), cooldown=60, resolve="false")
    p = sr.RuleProcessor(rule, dedup=0, keep=1)
    p.times, p.runs, p.open = One(), Map(), Kept()
    out = []
    for day in range(5):
        us = [day * 86_400_000_000 + i * 3600_000_000 for i in range(24)]
        frame = pd.DataFrame({"us": us, "conditions": [[True]] * 24, "resolved": [False] * 24})
        out += [x for part in p.handleInputRows(("z",), iter([frame]), None) for x in part.itertuples()]
        assert len(p.open.rows) <= 25
    assert len(out) == 5 * 24


def test_rule_that_never_resolves_in_batch_too(frame):
    rule = Rule("r", (Branch("b", "v > 1", 0),), cooldown=60, resolve="v < 0")
    df = frame([("z", at(300 * i), 2.0) for i in range(5)], "zone_id string, timestamp timestamp, v double")
    assert [x.resolved_at for x in fire(df, rule).collect()] == [None] * 5


def test_cross_validation_runs_folds_together_and_equals_one_by_one(spark, monkeypatch):
    import threading
    import time

    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from zonelytics.plans import ml

    rows = [(f"e{i}", "Z0", ("hvac_failure", "nutrient_drift")[i % 2], float(i % 2 * 3 + i % 5), float(i % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id string, zone_id string, anomaly_type string, x double, y double").coalesce(1)
    small, now, most, fit = {"numTrees": 5, "maxDepth": 3}, [0], [0], Pipeline.fit
    lock = threading.Lock()

    def watched(self, *args):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.3)
        try:
            return fit(self, *args)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(Pipeline, "fit", watched)
    got = ml.cross_validated_f1(df, 3, ["x", "y"], **small)
    assert most[0] > 1
    parts = ml.folds(ml.class_weights(df), ("event_id", "zone_id"), "anomaly_type", 3)
    parts = StringIndexer(inputCol="anomaly_type", outputCol="label", stringOrderType="alphabetAsc").fit(parts).transform(parts)
    forest = ml.RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", **{**ml.FOREST_PARAMS, **small})
    monkeypatch.setattr(Pipeline, "fit", fit)
    cv = CrossValidator(
        estimator=Pipeline(stages=[ml._assembler(["x", "y"]), forest]), estimatorParamMaps=ParamGridBuilder().build(), numFolds=3, foldCol="fold",
        evaluator=MulticlassClassificationEvaluator(metricName="f1"),
    )
    assert abs(got - cv.fit(parts).avgMetrics[0]) < 1e-12


def test_few_totals_meet_rows_without_a_shuffle_of_these(spark):
    from pyspark.sql import functions as F

    from zonelytics.operators.windows import share_of_total

    df = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("flag"), (F.col("id") % 5).cast("double").alias("v"))
    out = share_of_total(df, "v", ["flag"])
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    sums = {r["flag"]: r["s"] for r in out.groupBy("flag").agg(F.sum("share").alias("s")).collect()}
    assert set(sums) == {None, 1, 2} and all(abs(s - 1) < 1e-9 for s in sums.values())
