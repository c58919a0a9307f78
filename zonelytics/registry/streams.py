"""Registered streaming queries: the given event log replayed through Structured Streaming."""

from pyspark.sql import functions as F

from zonelytics.plans import alerting as al
from zonelytics.plans import views
from zonelytics.registry import cols, query
from zonelytics.registry.star import ROUTED, ROUTED_SQL, mixed_messages, routed_rows
from zonelytics.registry.events import LATEST, LATEST_EQ, _HOURLY_DIGITS, _HOURLY_SQL
from zonelytics.registry.ops import _ACKS, _COLD, _COLD_SHIPPED, _EQ, _NUTR, _TEMP, _resolved, cold_rule
from zonelytics.session import sized_state, work_dir
from zonelytics.sources import sinks
from zonelytics.sources.adapters import ADAPTERS, Tables
from zonelytics.streaming import ingest
from zonelytics.streaming import rules as sr
from zonelytics.streaming import views as sv

TIE = ("event_id",)


def live(t) -> Tables:
    """The adapters over the event log read as a stream."""
    ingest.use_rocksdb(t.spark)
    stream = ingest.read_files(t.spark, t.sf_dir, t.events.schema, glob="events.parquet")
    return Tables(t.spark, t.sf_dir, events=stream)


def replay(t, df, mode="append"):
    """Run a stream to the end of its input and return what it wrote."""
    base = work_dir(t.spark, "stream")
    with sized_state(t.spark):
        if mode == "append":
            ingest.write_files(df, f"{base}/out", f"{base}/ckpt").awaitTermination()
        else:
            ingest.write_batches(df, ingest.save_snapshot(f"{base}/out"), f"{base}/ckpt", mode).awaitTermination()
    if mode == "append":
        return t.spark.read.schema(df.schema).parquet(f"{base}/out")
    return ingest.newest_snapshot(t.spark, f"{base}/out")


# windows are emitted once the watermark (newest reading - 2 minutes) has passed their end
_CLOSED = "timestamp + INTERVAL {w} <= (SELECT date_trunc('milliseconds', max(timestamp)) - INTERVAL 2 MINUTE FROM {src})"


@query("str1_hourly_summary", f"SELECT * FROM ({_HOURLY_SQL}) WHERE {_CLOSED.format(w='1 HOUR', src='telemetry')}", _HOURLY_DIGITS)
def _(t):
    return replay(t, sv.hourly_summary(live(t).telemetry))


@query("str1_latest_reading", f"SELECT * FROM {LATEST}")
def _(t):
    return replay(t, sv.latest(live(t).telemetry, TIE), "complete")


@query("str1_equipment_latest", f"SELECT * FROM {LATEST_EQ}")
def _(t):
    return replay(t, sv.latest(live(t).equipment, TIE), "complete")


@query("str1_daily_alerts", f"""
  SELECT * FROM (SELECT greenhouse_id, severity, alert_type, time_bucket(INTERVAL 1 DAY, timestamp) AS timestamp, count(*) AS alert_count, avg(anomaly_score) AS avg_anomaly_score,
    count(*) FILTER (acknowledged) AS acknowledged_count FROM alerts GROUP BY ALL) WHERE {_CLOSED.format(w='1 DAY', src='alerts')}""", cols("avg_anomaly_score"))
def _(t):
    return replay(t, sv.daily_alerts(live(t).alerts))


@query("str2_enriched", """
  SELECT s.event_id, s.timestamp, s.zone_id, c.crop_name, c.target_temperature FROM telemetry s JOIN zone_config c ON c.zone_id = s.zone_id""")
def _(t):
    return replay(t, sv.enriched(live(t).telemetry, t.zone_config).select("event_id", "timestamp", "zone_id", "crop_name", "target_temperature"))


@query("str3_deduplicated", "SELECT event_id, timestamp, zone_id FROM telemetry")
def _(t):
    """The log arrives twice; one copy of every (timestamp, zone) is kept."""
    twice = live(t).telemetry.unionByName(live(t).telemetry)
    return replay(t, sv.deduplicated(twice, ["timestamp", "zone_id"]).select("event_id", "timestamp", "zone_id"))


@query("jn15_stream_stream_join", """
  SELECT e.event_id, e.timestamp, e.zone_id, e.heating_output, s.air_temperature FROM equipment e JOIN telemetry s
    ON s.zone_id = e.zone_id AND s.timestamp > e.timestamp - INTERVAL 30 SECOND AND s.timestamp < e.timestamp + INTERVAL 30 SECOND""")
def _(t):
    joined = sv.equipment_with_readings(live(t).equipment, live(t).telemetry)
    return replay(t, joined.select("event_id", "timestamp", "zone_id", "heating_output", "air_temperature"))


@query("src9_src10_stream_routing", """
  SELECT 'sensor_telemetry' AS kind, count(*) AS n FROM telemetry UNION ALL SELECT 'weather', count(*) FROM weather UNION ALL SELECT 'rejected', count(*) FROM events WHERE event_type = 'error'""")
def _(t):
    """Rows -> JSON messages -> text files -> stream -> typed tables."""
    base = work_dir(t.spark, "routing")
    junk = t.events.filter("event_type = 'error'").select(F.concat(F.lit("broken "), F.col("props")).alias("value"))
    mixed = sinks.to_messages(t.telemetry, "sensor_telemetry").unionByName(sinks.to_messages(t.weather, "weather")).unionByName(junk)
    mixed.write.text(f"{base}/messages")
    stream = t.spark.readStream.format("text").load(f"{base}/messages")
    ingest.write_batches(stream, ingest.route_to_tables(f"{base}/tables"), f"{base}/ckpt").awaitTermination()
    out = None
    for kind in ("sensor_telemetry", "weather", "rejected"):
        rows = ingest.routed_table(t.spark, f"{base}/tables", kind)
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("src9_stream_routed_rows", ROUTED_SQL, cols("a b c"))
def _(t):
    """Every kind with its rows, through text files, a stream and the routed tables."""
    base = work_dir(t.spark, "routing")
    mixed_messages(t, junk=True).write.text(f"{base}/messages")
    stream = t.spark.readStream.format("text").load(f"{base}/messages")
    ingest.write_batches(stream, ingest.route_to_tables(f"{base}/tables"), f"{base}/ckpt").awaitTermination()
    return routed_rows({kind: ingest.routed_table(t.spark, f"{base}/tables", kind) for kind in ROUTED})


# Rules: intervals that end after the final watermark stay open, so the twin reads the rest.
def _closed_rows(name: str, src: str) -> None:
    ADAPTERS[f"{name}_closed"] = f"""SELECT * FROM {name} WHERE time_bucket(INTERVAL 30 SECOND, timestamp) + INTERVAL 30 SECOND <= (SELECT max(timestamp) - INTERVAL 2 MINUTE FROM {src})"""


for _n, _s in (("o_temp_rows", "telemetry"), ("o_nutrient_rows", "telemetry"), ("o_equipment_rows", "equipment")):
    _closed_rows(_n, _s)


def _stream_rule(name, alerts_sql, rows, rule, source, tie=TIE, delay=ingest.DEFAULT_DELAY):
    sql = _resolved(alerts_sql, rows, 30).replace(rows, f"{rows}_closed")

    @query(name, sql)
    def _(t):
        log = replay(t, sr.rule_stream(source(t), rule, tie=tie, delay=delay))
        return sr.current_alerts(log, rule)


_stream_rule("rul1_stream_temperature", _TEMP, "o_temp_rows", al.TEMPERATURE, lambda t: sv.enriched(live(t).telemetry, t.zone_config))
_stream_rule("rul3_stream_nutrient", _NUTR, "o_nutrient_rows", al.NUTRIENT, lambda t: sv.enriched(live(t).telemetry, t.zone_config))

ADAPTERS["o_cold_rows_closed"] = """SELECT * FROM o_cold_rows WHERE time_bucket(INTERVAL 60 SECOND, timestamp) + INTERVAL 60 SECOND <= (SELECT max(timestamp) - INTERVAL 2 MINUTE FROM alerts)"""


@query("rul4_stream_cold_chain", f"SELECT zone_id, timestamp, CAST(NULL AS TIMESTAMP) AS resolved_at FROM {_COLD}".replace("o_cold_rows", "o_cold_rows_closed"))
def _(t):
    log = replay(t, sr.rule_stream(live(t).alerts, cold_rule(), tie=("alert_id",)))
    return sr.current_alerts(log, cold_rule())


ADAPTERS["o_cold_shipped_rows_closed"] = """SELECT * FROM o_cold_shipped_rows WHERE time_bucket(INTERVAL 60 SECOND, timestamp) + INTERVAL 60 SECOND <= (SELECT max(timestamp) - INTERVAL 2 MINUTE FROM alerts)"""


@query("rul4_stream_cold_chain_shipped", f"SELECT zone_id, timestamp, CAST(NULL AS TIMESTAMP) AS resolved_at FROM {_COLD_SHIPPED}".replace("o_cold_shipped_rows", "o_cold_shipped_rows_closed"))
def _(t):
    """With the shipped threshold."""
    return sr.current_alerts(replay(t, sr.rule_stream(live(t).alerts, al.COLD_CHAIN, tie=("alert_id",))), al.COLD_CHAIN)


# --- the equipment rule: left outer stream join, nearest reading, rule state; then limits and escalation -----------------

_stream_rule("rul2_stream_equipment", _EQ, "o_equipment_rows", al.EQUIPMENT_OFFLINE, lambda t: sv.equipment_for_rule(live(t).equipment, live(t).telemetry, t.zone_config), (*TIE, *sv.NEAREST), None)


@query("jn15_left_outer_late_equipment", """
  SELECT e.event_id, e.timestamp, e.zone_id, s.event_id AS reading_id, s.air_temperature FROM (SELECT event_id, zone_id, timestamp + INTERVAL 29 SECOND AS timestamp FROM equipment) e
  LEFT JOIN telemetry s ON s.zone_id = e.zone_id AND s.timestamp > e.timestamp - INTERVAL 30 SECOND AND s.timestamp < e.timestamp + INTERVAL 30 SECOND
  WHERE s.event_id IS NOT NULL OR e.timestamp + INTERVAL 30 SECOND <= (SELECT max(timestamp) - INTERVAL 2 MINUTE FROM telemetry)""")
def _(t):
    """Equipment 29 seconds late; rows without a reading come once the watermark has passed."""
    late = live(t).equipment.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 29 SECONDS"))
    return replay(t, sv.equipment_with_readings(late, live(t).telemetry, how="left").select("event_id", "timestamp", "zone_id", "reading_id", "air_temperature"))


@query("rul11_stream_throttle", """
  WITH a AS (SELECT alert_id, zone_id, timestamp, alert_type AS rule, date_trunc('hour', timestamp) AS h FROM alerts WHERE timestamp <= (SELECT max(timestamp) - INTERVAL 2 MINUTE FROM alerts)
    QUALIFY row_number() OVER (PARTITION BY zone_id, h ORDER BY timestamp, rule, alert_id) <= 1)
  SELECT alert_id, zone_id, timestamp FROM a QUALIFY row_number() OVER (PARTITION BY h ORDER BY timestamp, zone_id, rule, alert_id) <= 2""")
def _(t):
    alerts = live(t).alerts.select("alert_id", "zone_id", "timestamp", F.col("alert_type").alias("rule"))
    return replay(t, sr.throttle_stream(alerts, per_key=1, overall=2).select("alert_id", "zone_id", "timestamp"))


@query("rul12_stream_escalation", f"""
  SELECT alert_id, timestamp + INTERVAL 30 MINUTE AS escalated_at FROM alerts a WHERE severity = 'critical'
    AND timestamp + INTERVAL 30 MINUTE <= (SELECT least((SELECT max(timestamp) FROM alerts WHERE severity = 'critical'), (SELECT max(ack_time) FROM {_ACKS} k)) - INTERVAL 2 MINUTE)
    AND NOT EXISTS (SELECT 1 FROM {_ACKS} k WHERE k.zone_id = a.zone_id AND k.rule = a.alert_type AND k.ack_time BETWEEN a.timestamp AND a.timestamp + INTERVAL 30 MINUTE)""")
def _(t):
    rule = F.col("alert_type").alias("rule")
    alerts = live(t).alerts.select("alert_id", "zone_id", "timestamp", "severity", rule)
    acks = live(t).alerts.filter("acknowledged").select("zone_id", rule, (F.col("timestamp") + F.expr("INTERVAL 10 MINUTE")).alias("ack_time"))
    return replay(t, sr.escalate_stream(alerts, acks).select("alert_id", "escalated_at"))
