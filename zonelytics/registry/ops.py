"""Registered rule, graph and scenario queries."""

from pyspark.sql import functions as F

from zonelytics.functions.timebins import day_of_week_mon0
from zonelytics.operators import graph as gr
from zonelytics.operators import rules as ru
from zonelytics.operators import scenario as sc
from zonelytics.operators.joins import lookup
from zonelytics.plans import alerting as al
from zonelytics.registry import cols, query
from zonelytics.sources.adapters import ADAPTERS

TIE = ("event_id",)

# --- rules -------------------------------------------------------------------------------
# Twin: last row per interval, gaps and islands by run number, sequential cooldown by recursion.

ADAPTERS["o_temp_rows"] = """
  SELECT s.timestamp, s.zone_id, s.event_id, abs(air_temperature - target_temperature) > 3 AS cond, abs(air_temperature - target_temperature) <= 1.5e0 AS res
  FROM telemetry s JOIN zone_config c ON c.zone_id = s.zone_id"""
ADAPTERS["o_nutrient_rows"] = """
  SELECT s.timestamp, s.zone_id, s.event_id, abs(substrate_ph - target_ph) > 0.5e0 AND abs(substrate_ec - target_ec) > 0.3e0 AS cond,
    abs(substrate_ph - target_ph) <= 0.2e0 AND abs(substrate_ec - target_ec) <= 0.15e0 AS res
  FROM telemetry s JOIN zone_config c ON c.zone_id = s.zone_id"""
ADAPTERS["o_equipment_near"] = """
  SELECT e.*, s.air_temperature, s.substrate_moisture FROM equipment e LEFT JOIN telemetry s ON s.zone_id = e.zone_id AND s.timestamp > e.timestamp - INTERVAL 30 SECOND AND s.timestamp < e.timestamp + INTERVAL 30 SECOND
    QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(s.timestamp) - epoch_us(e.timestamp)), s.timestamp, CASE WHEN s.timestamp <= e.timestamp THEN -s.event_id ELSE s.event_id END) = 1"""
ADAPTERS["o_equipment_rows"] = """
  SELECT e.timestamp, e.zone_id, e.event_id, heating_output = 0 AND air_temperature < target_temperature - 2 AS heat, irrigation_pump AND irrigation_flow = 0 AS water,
    (heating_output > 0 OR air_temperature >= target_temperature - 1) AND (NOT irrigation_pump OR irrigation_flow > 0) AS res
  FROM o_equipment_near e LEFT JOIN zone_config c ON c.zone_id = e.zone_id"""
ADAPTERS["o_cold_rows"] = """
  SELECT timestamp, zone_id, alert_id AS event_id, anomaly_score > 0.3e0 AS cond, false AS res FROM alerts WHERE alert_type = 'cold-chain-break'"""


def _fires(rows: str, sustain: int, interval: int) -> str:
    return f"""(WITH last AS (SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY zone_id, time_bucket(INTERVAL {interval} SECOND, timestamp) ORDER BY timestamp DESC, event_id DESC) = 1),
      b AS (SELECT *, CASE WHEN lag(cond) OVER w AND timestamp - lag(timestamp) OVER w <= INTERVAL {2 * interval} SECOND THEN 0 ELSE 1 END AS brk FROM last WINDOW w AS (PARTITION BY zone_id ORDER BY timestamp, event_id)),
      r AS (SELECT *, sum(brk) OVER (PARTITION BY zone_id ORDER BY timestamp, event_id) AS run FROM b WHERE cond),
      s AS (SELECT *, min(timestamp) OVER (PARTITION BY zone_id, run) AS began FROM r)
      SELECT zone_id, min(timestamp) AS timestamp FROM s WHERE timestamp - began >= INTERVAL {sustain} SECOND GROUP BY zone_id, run)"""


def _cooled(fires: str, seconds: int) -> str:
    return f"""(WITH RECURSIVE f AS MATERIALIZED (SELECT DISTINCT zone_id, timestamp FROM {fires}),
      k AS (SELECT zone_id, min(timestamp) AS timestamp FROM f GROUP BY 1
        UNION ALL SELECT * FROM (SELECT k.zone_id, min(f.timestamp) AS timestamp FROM k JOIN f ON f.zone_id = k.zone_id AND f.timestamp >= k.timestamp + INTERVAL {seconds} SECOND GROUP BY k.zone_id, k.timestamp))
      SELECT * FROM k)"""


def _resolved(alerts: str, rows: str, interval: int) -> str:
    return f"""SELECT a.zone_id, a.timestamp, (SELECT min(r.timestamp) FROM
        (SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY zone_id, time_bucket(INTERVAL {interval} SECOND, timestamp) ORDER BY timestamp DESC, event_id DESC) = 1) r
        WHERE r.zone_id = a.zone_id AND r.res AND r.timestamp > a.timestamp) AS resolved_at FROM {alerts} a"""


_OUT = ["zone_id", "timestamp", "resolved_at"]
_TEMP = _cooled(_fires("o_temp_rows", 120, 30), 900)
_NUTR = _cooled(_fires("o_nutrient_rows", 180, 30), 1200)
_EQ = _cooled(f"(SELECT * FROM {_fires('(SELECT *, heat AS cond FROM o_equipment_rows)', 90, 30)} UNION SELECT * FROM {_fires('(SELECT *, water AS cond FROM o_equipment_rows)', 60, 30)})", 600)
ADAPTERS["o_cold_shipped_rows"] = """
  SELECT timestamp, zone_id, alert_id AS event_id, anomaly_score > 0.7e0 AS cond, false AS res FROM alerts WHERE alert_type = 'cold-chain-break'"""
_COLD_SHIPPED = _cooled(_fires("o_cold_shipped_rows", 0, 60), 300)
_COLD = _cooled(_fires("o_cold_rows", 0, 60), 300)


def temperature_source(t):
    return al.with_setpoints(t.telemetry, t.zone_config)


def cold_rule():
    """The shipped rule with a threshold that the test scores reach."""
    return ru.Rule.from_dict({**al.RULE_DATA[3], "condition": {**al.RULE_DATA[3]["condition"], "threshold": 0.3}})


@query("rul1_temperature_deviation", _resolved(_TEMP, "o_temp_rows", 30))
def _(t):
    return ru.fire(temperature_source(t), al.TEMPERATURE, tie=TIE).select(*_OUT)


@query("rul2_equipment_offline", _resolved(_EQ, "o_equipment_rows", 30))
def _(t):
    return ru.fire(al.equipment_with_readings(t.equipment, t.telemetry, t.zone_config), al.EQUIPMENT_OFFLINE, tie=TIE).select(*_OUT)


@query("rul3_nutrient_drift", _resolved(_NUTR, "o_nutrient_rows", 30))
def _(t):
    return ru.fire(temperature_source(t), al.NUTRIENT, tie=TIE).select(*_OUT)


@query("rul4_cold_chain", f"SELECT zone_id, timestamp, CAST(NULL AS TIMESTAMP) AS resolved_at FROM {_COLD}")
def _(t):
    return ru.fire(t.alerts, cold_rule(), tie=("alert_id",)).select(*_OUT)


@query("rul6_sustained_detection", f"SELECT * FROM {_fires('o_temp_rows', 120, 30)}")
def _(t):
    return ru.rule_events(temperature_source(t), al.TEMPERATURE, tie=TIE).filter("fired").select("zone_id", "timestamp")


@query("rul6_sustained_small_chunks", f"SELECT * FROM {_fires('o_temp_rows', 120, 30)}")
def _(t):
    """The same with ten-minute chunks: many runs cross a chunk border."""
    return ru.rule_events(temperature_source(t), al.TEMPERATURE, tie=TIE, chunk=600).filter("fired").select("zone_id", "timestamp")


@query("rul8_cooldown", f"SELECT * FROM {_cooled('(SELECT zone_id, timestamp FROM telemetry_sparse)', 7200)}")
def _(t):
    """Greedy two-hour spacing of all sparse readings."""
    return ru.spaced(t.telemetry_sparse, ["zone_id"], "timestamp", 7200).select("zone_id", "timestamp")


@query("rul8_cooldown_small_chunks", f"SELECT * FROM {_cooled('(SELECT zone_id, timestamp FROM telemetry_sparse)', 3600)}")
def _(t):
    return ru.spaced(t.telemetry_sparse, ["zone_id"], "timestamp", 3600, chunk=1800).select("zone_id", "timestamp")


@query("rul10_dedup_window", f"SELECT zone_id, timestamp FROM {_cooled('(SELECT zone_id, timestamp FROM alerts)', 300)}")
def _(t):
    return ru.spaced(t.alerts, ["zone_id"], "timestamp", al.DEDUP_SECONDS).select("zone_id", "timestamp")


@query("rul10_duplicate_instants", f"""
  SELECT k.zone_id, k.timestamp, min(t.event_id) AS event_id FROM {_cooled('(SELECT zone_id, timestamp FROM telemetry_sparse)', 7200)} k
  JOIN telemetry_sparse t ON t.zone_id = k.zone_id AND t.timestamp = k.timestamp GROUP BY ALL""")
def _(t):
    """Every row twice, the copy with a higher id: one row per kept instant stays, the first by id."""
    twice = t.telemetry_sparse.unionByName(t.telemetry_sparse.withColumn("event_id", F.col("event_id") + 1_000_000_000))
    return ru.spaced(twice, ["zone_id"], "timestamp", 7200, tie=TIE).select("zone_id", "timestamp", "event_id")


@query("rul2_equipment_across_bins", """
  SELECT e.event_id, e.timestamp, e.zone_id, s.air_temperature FROM (SELECT event_id, zone_id, timestamp + INTERVAL 29 SECOND AS timestamp FROM equipment) e
  LEFT JOIN telemetry s ON s.zone_id = e.zone_id AND s.timestamp > e.timestamp - INTERVAL 30 SECOND AND s.timestamp < e.timestamp + INTERVAL 30 SECOND
  QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(s.timestamp) - epoch_us(e.timestamp)), s.timestamp, CASE WHEN s.timestamp <= e.timestamp THEN -s.event_id ELSE s.event_id END) = 1""")
def _(t):
    """Equipment 29 seconds late: the nearest reading often lies in the next half minute; rows without one stay."""
    late = t.equipment.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 29 SECONDS"))
    return al.equipment_with_readings(late, t.telemetry, t.zone_config).select("event_id", "timestamp", "zone_id", "air_temperature")


@query("rul4_cold_chain_shipped", f"SELECT zone_id, timestamp, CAST(NULL AS TIMESTAMP) AS resolved_at FROM {_COLD_SHIPPED}")
def _(t):
    return ru.fire(t.alerts, al.COLD_CHAIN, tie=("alert_id",)).select(*_OUT)


@query("rul13_all_actions", """
  SELECT rule, CAST(n AS INT) AS action_no, CASE n WHEN 1 THEN 'TeamsNotification' WHEN 2 THEN 'Email' ELSE 'NotebookTrigger' END AS action_type, count(*) AS alerts
  FROM (SELECT CASE alert_id % 4 WHEN 0 THEN 'Temperature Deviation Alert' WHEN 1 THEN 'Equipment Offline While Needed' WHEN 2 THEN 'Nutrient Drift' ELSE 'Cold Chain Temperature Exceedance' END AS rule
    FROM (SELECT CAST(substr(alert_id, 2) AS BIGINT) AS alert_id FROM (SELECT concat('A', CAST(event_id AS VARCHAR)) AS alert_id FROM telemetry_sparse))), (VALUES (1), (2), (3)) v(n) GROUP BY ALL""")
def _(t):
    """All twelve actions of the shipped rules, over rows dealt to the rules by id."""
    names, made = list(al.RULES), None
    for n, rule in enumerate(al.RULES.values()):
        rows = ru.action_rows(t.telemetry_sparse.filter(F.col("event_id") % 4 == n).withColumn("branch", F.lit(rule.name)), rule)
        one = rows.groupBy("action_no", "action_type").agg(F.count(F.lit(1)).alias("alerts")).select(F.lit(names[n]).alias("rule"), "action_no", "action_type", "alerts")
        made = one if made is None else made.unionByName(one)
    return made


@query("rul11_throttle", """
  WITH a AS (SELECT alert_id, zone_id, timestamp, alert_type AS rule, date_trunc('hour', timestamp) AS h FROM alerts QUALIFY row_number() OVER (PARTITION BY zone_id, h ORDER BY timestamp, rule) <= 1)
  SELECT alert_id, zone_id, timestamp FROM a QUALIFY row_number() OVER (PARTITION BY h ORDER BY timestamp, zone_id, rule) <= 2""")
def _(t):
    return ru.throttle(t.alerts.withColumn("rule", F.col("alert_type")), per_key=1, overall=2).select("alert_id", "zone_id", "timestamp")


_ACKS = "(SELECT zone_id, alert_type AS rule, timestamp + INTERVAL 10 MINUTE AS ack_time FROM alerts WHERE acknowledged)"


@query("rul12_escalation", f"""
  SELECT alert_id, timestamp + INTERVAL 30 MINUTE AS escalated_at FROM alerts a WHERE severity = 'critical' AND timestamp + INTERVAL 30 MINUTE <= (SELECT max(timestamp) FROM alerts)
    AND NOT EXISTS (SELECT 1 FROM {_ACKS} k WHERE k.zone_id = a.zone_id AND k.rule = a.alert_type AND k.ack_time BETWEEN a.timestamp AND a.timestamp + INTERVAL 30 MINUTE)""")
def _(t):
    alerts = t.alerts.withColumn("rule", F.col("alert_type"))
    acks = alerts.filter("acknowledged").select("zone_id", "rule", (F.col("timestamp") + F.expr("INTERVAL 10 MINUTE")).alias("ack_time"))
    return ru.escalate(alerts, acks).select("alert_id", "escalated_at")


@query("rul13_action_rows", f"""
  SELECT zone_id, timestamp, CAST(n AS INT) AS action_no, CASE n WHEN 1 THEN 'TeamsNotification' WHEN 2 THEN 'Email' ELSE 'NotebookTrigger' END AS action_type,
    CASE n WHEN 1 THEN concat('Temperature alert: ', zone_id) WHEN 2 THEN concat('Temperature deviation in ', zone_id) ELSE '' END AS subject
  FROM {_TEMP}, (VALUES (1), (2), (3)) v(n)""")
def _(t):
    carry = ("greenhouse_id", "air_temperature", "target_temperature", "crop_name")
    alerts = ru.fire(temperature_source(t), al.TEMPERATURE, tie=TIE, carry=carry)
    return ru.action_rows(alerts, al.TEMPERATURE).select("zone_id", "timestamp", "action_no", "action_type", "subject")


@query("rul14_alert_table", f"SELECT timestamp, zone_id, 'critical' AS severity, 'hvac-failure' AS alert_type, 'Temperature Deviation Alert: Temperature Deviation Alert' AS message, false AS acknowledged FROM {_TEMP}")
def _(t):
    rows = ru.to_alert_table(ru.fire(temperature_source(t), al.TEMPERATURE, tie=TIE), al.TEMPERATURE, "hvac-failure")
    return rows.select("timestamp", "zone_id", "severity", "alert_type", "message", "acknowledged")


@query("rul_all_limited", f"""
  WITH a AS (SELECT 'Temperature Deviation Alert' AS rule, * FROM {_TEMP} UNION ALL SELECT 'Equipment Offline While Needed', * FROM {_EQ} UNION ALL SELECT 'Nutrient Drift', * FROM {_NUTR}
    UNION ALL SELECT 'Cold Chain Temperature Exceedance', * FROM {_COLD}),
  z AS (SELECT *, date_trunc('hour', timestamp) AS h FROM a QUALIFY row_number() OVER (PARTITION BY zone_id, date_trunc('hour', timestamp) ORDER BY timestamp, rule) <= 3)
  SELECT rule, zone_id, timestamp FROM z QUALIFY row_number() OVER (PARTITION BY h ORDER BY timestamp, zone_id, rule) <= 50""")
def _(t):
    src = temperature_source(t)
    cold = t.alerts.withColumn("event_id", F.col("alert_id"))
    sources = {al.TEMPERATURE.name: src, al.NUTRIENT.name: src, al.EQUIPMENT_OFFLINE.name: al.equipment_with_readings(t.equipment, t.telemetry, t.zone_config), al.COLD_CHAIN.name: cold}
    return al.run_rules(sources, [al.TEMPERATURE, al.EQUIPMENT_OFFLINE, al.NUTRIENT, cold_rule()], TIE).select("rule", "zone_id", "timestamp")


@query("fn_daily_ids", """
  SELECT event_id, concat('ALR-', strftime(timestamp, '%Y%m%d'), printf('-%04d', row_number() OVER (PARTITION BY CAST(timestamp AS DATE) ORDER BY timestamp, event_id))) AS id
  FROM (SELECT alert_id AS event_id, timestamp FROM alerts)""")
def _(t):
    return ru.daily_ids(t.alerts, "ALR", "timestamp", ["alert_id"]).select(F.col("alert_id").alias("event_id"), "id")


# --- graph ------------------------------------------------------------------------------------

@query("gr1_assembled_counts", "SELECT label, count(*) AS n FROM graph_nodes GROUP BY 1 UNION ALL SELECT label, count(*) FROM graph_edges GROUP BY 1")
def _(t):
    n = t.graph_nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(t.graph_edges.groupBy("label").agg(F.count(F.lit(1)).alias("n")))


@query("gr1_typed_union", """
  SELECT 'Supplier' AS label, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT 'Customer', c_name, NULL, c_mktsegment FROM customer""")
def _(t):
    parts = {
        "Supplier": t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "Customer": t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
    }
    return gr.assemble(parts, "node")


@query("gr2_dangling_ends", """
  SELECT DISTINCT node_id FROM (SELECT src AS node_id FROM graph_edges UNION SELECT dst FROM graph_edges) WHERE node_id NOT IN (SELECT node_id FROM graph_nodes WHERE label <> 'Supplier')""")
def _(t):
    return gr.dangling(t.graph_nodes.filter("label <> 'Supplier'"), t.graph_edges)


@query("gr3_one_hop", """
  SELECT a.name AS a_name, b.name AS b_name FROM graph_edges e JOIN graph_nodes a ON a.node_id = e.src JOIN graph_nodes b ON b.node_id = e.dst WHERE e.label = 'has_customer' AND a.node_id IN ('n:3', 'n:7')""")
def _(t):
    hit = gr.one_hop(t.graph_nodes, t.graph_edges, start=F.col("node_id").isin("n:3", "n:7"), edge=F.col("label") == "has_customer")
    return hit.select("a_name", "b_name")


@query("gr3_one_hop_by_end", """
  SELECT a.name AS a_name, b.name AS b_name, e.label AS e_label FROM graph_edges e JOIN graph_nodes a ON a.node_id = e.src JOIN graph_nodes b ON b.node_id = e.dst WHERE b.label = 'Nation'""")
def _(t):
    return gr.one_hop(t.graph_nodes, t.graph_edges, end=F.col("label") == "Nation").select("a_name", "b_name", "e_label")


@query("gr4_two_hop", """
  SELECT a.name AS region, b.name AS nation, c.label AS child_type, c.name AS child FROM graph_edges x JOIN graph_edges y ON y.src = x.dst
  JOIN graph_nodes a ON a.node_id = x.src JOIN graph_nodes b ON b.node_id = x.dst JOIN graph_nodes c ON c.node_id = y.dst WHERE a.node_id = 'r:1' AND x.label = 'contains'""")
def _(t):
    hit = gr.two_hop(t.graph_nodes, t.graph_edges, F.col("node_id") == "r:1", first=F.col("label") == "contains")
    return hit.select(F.col("a_name").alias("region"), F.col("b_name").alias("nation"), F.col("c_label").alias("child_type"), F.col("c_name").alias("child"))


@query("gr5_paths_1_2", """
  WITH e AS (SELECT src, dst, concat(src, '|', dst, '|', label) AS id FROM graph_edges),
  p AS (SELECT src AS source_id, dst AS target_id, 1 AS hops FROM e WHERE src = 'n:5'
    UNION ALL SELECT x.src, y.dst, 2 FROM e x JOIN e y ON y.src = x.dst AND y.id <> x.id WHERE x.src = 'n:5')
  SELECT p.*, s.name AS source_name, t.name AS target_name, t.label AS target_label FROM p JOIN graph_nodes s ON s.node_id = source_id JOIN graph_nodes t ON t.node_id = target_id""")
def _(t):
    return gr.paths(t.graph_nodes, t.graph_edges, F.col("node_id") == "n:5")


@query("gr5_paths_1_3_adjacent", """
  WITH RECURSIVE e AS (SELECT src, dst, concat(src, '|', dst, '|', label) AS id FROM graph_edges WHERE label = 'adjacent_to'),
  p AS (SELECT src AS source_id, dst AS target_id, 1 AS hops, [id] AS used FROM e
    UNION ALL SELECT source_id, e.dst, hops + 1, list_append(used, e.id) FROM p JOIN e ON e.src = p.target_id WHERE hops < 3 AND NOT list_contains(used, e.id))
  SELECT source_id, target_id, hops, count(*) AS paths FROM p GROUP BY ALL""")
def _(t):
    found = gr.paths(t.graph_nodes, t.graph_edges, F.col("label") == "Nation", 1, 3, F.col("label") == "adjacent_to")
    return found.groupBy("source_id", "target_id", "hops").agg(F.count(F.lit(1)).alias("paths"))


@query("gr8_dependency_closure", """
  WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM graph_edges WHERE label <> 'adjacent_to'),
  p AS (SELECT src AS source_id, dst AS node_id, 1 AS hops FROM e WHERE src = 'r:2' UNION SELECT source_id, e.dst, hops + 1 FROM p JOIN e ON e.src = p.node_id)
  SELECT source_id, node_id, min(hops) AS hops FROM p GROUP BY ALL""")
def _(t):
    start = t.graph_nodes.filter("node_id = 'r:2'").select("node_id")
    return gr.reachable(t.graph_edges.filter("label <> 'adjacent_to'"), start)


@query("gr8_dependents_reverse", """
  SELECT s.node_id AS source_id, CASE h WHEN 1 THEN concat('n:', s_nationkey) ELSE concat('r:', n_regionkey) END AS node_id, CAST(h AS INT) AS hops
  FROM (SELECT concat('s:', s_suppkey) AS node_id, s_nationkey FROM supplier) s JOIN nation ON n_nationkey = s_nationkey, (VALUES (1), (2)) v(h)""")
def _(t):
    start = t.graph_nodes.filter("label = 'Supplier'").select("node_id")
    return gr.reachable(t.graph_edges.filter("label <> 'adjacent_to'"), start, reverse=True)


@query("gr10_derived_edges", "SELECT concat('zone:', zone_id) AS src, concat('reading:', CAST(event_id AS VARCHAR)) AS dst, 'has_sensor' AS label FROM telemetry_sparse")
def _(t):
    parts = t.telemetry_sparse.select("zone_id", F.concat(F.lit("reading:"), F.col("event_id").cast("string")).alias("node_id"))
    return gr.derived_edges(parts, "zone_id", "has_sensor")


@query("gr11_adjacency", """
  SELECT a.node_id AS src, b.node_id AS dst, 'adjacent_to' AS label FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM (SELECT *, concat('s:', s_suppkey) AS node_id FROM supplier)) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM (SELECT *, concat('s:', s_suppkey) AS node_id FROM supplier)) b ON a.s_nationkey = b.s_nationkey AND abs(a.r - b.r) = 1""")
def _(t):
    items = t.supplier.select("s_nationkey", "s_suppkey", F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("node_id"))
    return gr.adjacency(items, "s_nationkey", "s_suppkey", chunk=F.floor(F.col("s_suppkey") / 25))


@query("gr12_runbook_totals", """
  SELECT alert_type AS anomaly_type, count(*) AS steps, count(*) FILTER (acknowledged) AS automated_steps, CAST(sum(CAST(anomaly_score * 500 AS INT)) AS BIGINT) AS total_minutes,
    CAST(sum(CASE WHEN acknowledged THEN 0 ELSE CAST(anomaly_score * 500 AS INT) END) AS BIGINT) AS manual_minutes
  FROM (SELECT alert_type, acknowledged, floor(anomaly_score * 500) / 500e0 + 1e-6 AS anomaly_score FROM alerts) GROUP BY 1""")
def _(t):
    actions = t.alerts.select(F.col("alert_type").alias("anomaly_type"), F.col("acknowledged").alias("automated"), F.floor(F.col("anomaly_score") * 500).alias("sla_minutes"))
    return gr.runbook_totals(actions)


# --- scenarios -----------------------------------------------------------------------------------

_CH = {"air_temperature": "double", "air_humidity": "double", "vpd": "double", "substrate_ph": "double", "substrate_ec": "double", "substrate_moisture": "double",
       "water_flow_rate": "double", "heating_output": "double", "irrigation_pump": "boolean"}

_OVERLAY = """
  WITH RECURSIVE i AS (SELECT anomaly_id, scenario, severity, start_time, end_time, unnest(string_split(zone_ids, ',')) AS zone_id,
      CASE scenario WHEN 'hvac-failure' THEN 0.15e0 WHEN 'nutrient-drift' THEN 0.3e0 WHEN 'irrigation-failure' THEN 0.1e0 ELSE 0.2e0 END AS o,
      CASE scenario WHEN 'hvac-failure' THEN 0.45e0 WHEN 'nutrient-drift' THEN 0.4e0 WHEN 'irrigation-failure' THEN 0.5e0 ELSE 0.6e0 END AS k FROM scenarios),
  h AS MATERIALIZED (SELECT s.event_id, i.scenario, i.severity AS sev, o, k, (epoch_us(s.timestamp) - epoch_us(start_time)) / CAST(epoch_us(end_time) - epoch_us(start_time) AS DOUBLE) AS p,
      row_number() OVER (PARTITION BY s.event_id ORDER BY start_time, anomaly_id) AS n
    FROM telemetry s JOIN i ON i.zone_id = s.zone_id AND s.timestamp >= i.start_time AND s.timestamp < i.end_time),
  g AS MATERIALIZED (SELECT *, CASE WHEN p < o THEN 1 WHEN p < o + k THEN 2 ELSE 3 END AS ph, CASE WHEN p < o THEN p / o WHEN p < o + k THEN (p - o) / k ELSE (p - (o + k)) / (1 - (o + k)) END AS q FROM h),
  f AS (SELECT event_id, CAST(0 AS BIGINT) AS n, air_temperature AS t, air_humidity AS rh, vpd, substrate_ph AS acid, substrate_ec AS ec, substrate_moisture AS m, water_flow_rate AS fl,
      CAST(NULL AS DOUBLE) AS heat, CAST(NULL AS BOOLEAN) AS pump FROM telemetry
    UNION ALL SELECT f.event_id, f.n + 1,
      CASE WHEN scenario <> 'hvac-failure' THEN t WHEN ph = 1 THEN t - 8 * sev * 0.5e0 * q WHEN ph = 2 THEN t - 8 * sev * (0.5e0 + 0.5e0 * q) ELSE t - 8 * sev * (1 - q) * 0.5e0 END,
      CASE WHEN scenario <> 'hvac-failure' THEN rh WHEN ph = 1 THEN rh + 5 * q * sev WHEN ph = 2 THEN least(98e0, rh + 15 * sev) ELSE rh + 5 * (1 - q) * sev END,
      CASE WHEN scenario = 'hvac-failure' AND ph = 2 THEN vpd * greatest(0.1e0, 1 - 0.7e0 * sev) ELSE vpd END,
      CASE WHEN scenario <> 'nutrient-drift' THEN acid WHEN ph = 1 THEN acid + 1.8e0 * sev * 0.3e0 * q WHEN ph = 2 THEN acid + 1.8e0 * sev * (0.3e0 + 0.7e0 * q) ELSE acid + 1.8e0 * sev * (1 - q) * 0.5e0 END,
      CASE WHEN scenario = 'nutrient-drift' THEN ec - 1.2e0 * sev * (CASE ph WHEN 1 THEN 0.2e0 * q WHEN 2 THEN 0.2e0 + 0.8e0 * q ELSE (1 - q) * 0.3e0 END)
           WHEN scenario = 'irrigation-failure' THEN ec + (CASE ph WHEN 1 THEN 0e0 WHEN 2 THEN sev * q ELSE 0.5e0 * (1 - q) * sev END) ELSE ec END,
      CASE WHEN scenario <> 'irrigation-failure' OR ph = 1 THEN m WHEN ph = 2 THEN greatest(15e0, m - 20 * sev * q) ELSE greatest(15e0, m - 10 * (1 - q) * sev) END,
      CASE WHEN scenario <> 'irrigation-failure' THEN fl WHEN ph = 1 THEN fl * (1 - q) WHEN ph = 2 THEN 0e0 ELSE q * 25 END,
      CASE WHEN scenario <> 'hvac-failure' THEN heat WHEN ph = 3 THEN q * 80 ELSE 0e0 END,
      CASE WHEN scenario <> 'irrigation-failure' THEN pump WHEN ph = 1 THEN q < 0.5e0 WHEN ph = 2 THEN false ELSE true END
    FROM f JOIN g ON g.event_id = f.event_id AND g.n = f.n + 1)
  SELECT event_id, t AS air_temperature, rh AS air_humidity, vpd, acid AS substrate_ph, ec AS substrate_ec, m AS substrate_moisture, fl AS water_flow_rate, heat AS heating_output, pump AS irrigation_pump,
    CAST(n AS INT) AS incidents FROM f QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC) = 1"""


def zone_incidents(t):
    return t.scenarios.withColumn("zone_id", F.explode(F.split("zone_ids", ","))).drop("zone_ids", "greenhouse_id")


@query("ra1_anomaly_overlay", _OVERLAY, cols("air_temperature air_humidity vpd substrate_ph substrate_ec substrate_moisture water_flow_rate heating_output"))
def _(t):
    return sc.overlay(t.telemetry, zone_incidents(t), _CH).select("event_id", *_CH, "incidents")


@query("ra1_cold_chain_overlay", """
  WITH i AS (SELECT event_id, greenhouse_id, start_time, end_time FROM anomaly_events WHERE anomaly_type = 'cold-chain-break'),
  h AS (SELECT a.alert_id, (epoch_us(a.timestamp) - epoch_us(start_time)) / CAST(epoch_us(end_time) - epoch_us(start_time) AS DOUBLE) AS p
    FROM alerts a JOIN i ON i.greenhouse_id = a.greenhouse_id AND a.timestamp >= start_time AND a.timestamp < end_time QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY start_time DESC, event_id DESC) = 1),
  v AS (SELECT alert_id, 2 + 6e0 * (CASE WHEN p < 0.2e0 THEN 0.3e0 * p / 0.2e0 WHEN p < 0.2e0 + 0.6e0 THEN 0.3e0 + 0.7e0 * (p - 0.2e0) / 0.6e0 ELSE 0.8e0 END) AS c FROM h)
  SELECT alert_id, c AS cold_chain_temp, c <= 5 AS cold_chain_compliant FROM v""", cols("cold_chain_temp"))
def _(t):
    incidents = t.anomaly_events.select("greenhouse_id", F.col("event_id").alias("anomaly_id"), F.col("anomaly_type").alias("scenario"), F.lit(0.5).alias("severity"), "start_time", "end_time")
    only = {"cold-chain-break": sc.PHASES["cold-chain-break"]}
    channels = {"cold_chain_temp": "double", "cold_chain_compliant": "boolean"}
    hit = sc.overlay(t.alerts, incidents, channels, key="greenhouse_id", phases=only).filter("incidents > 0")
    return hit.select("alert_id", "cold_chain_temp", "cold_chain_compliant")


_T0 = "(SELECT max(start_time) - INTERVAL 20 MINUTE FROM scenarios)"


def _noon(t):
    return t.scenarios.agg(F.max("start_time").alias("x")).scalar() - F.expr("INTERVAL 20 MINUTE")


@query("ra2_life_cycle", f"""
  SELECT anomaly_id, CASE WHEN end_time <= {_T0} THEN 'resolved' WHEN start_time <= {_T0} THEN 'active' ELSE 'pending' END AS status,
    CASE WHEN start_time <= {_T0} THEN epoch(least({_T0}, end_time)) - epoch(start_time) END AS elapsed_seconds, epoch(end_time) - epoch(start_time) AS duration_seconds FROM scenarios""")
def _(t):
    return sc.life_cycle(t.scenarios, _noon(t)).select("anomaly_id", "status", "elapsed_seconds", "duration_seconds")


@query("ra2_active_by_zone", f"""
  SELECT zone_id, count(*) AS active, string_agg(DISTINCT scenario, ',' ORDER BY scenario) AS scenarios FROM
    (SELECT scenario, unnest(string_split(zone_ids, ',')) AS zone_id FROM scenarios WHERE start_time <= {_T0} AND end_time > {_T0}) GROUP BY 1""")
def _(t):
    return sc.active_by_zone(t.scenarios, _noon(t))


@query("ra3_hourly_utilities", """
  WITH z AS (SELECT *, date_trunc('hour', timestamp) AS hr FROM equipment QUALIFY row_number() OVER (PARTITION BY zone_id, date_trunc('hour', timestamp) ORDER BY timestamp DESC, event_id DESC) = 1),
  s AS (SELECT greenhouse_id, hr, 2 + sum(CASE WHEN supplemental_light THEN 0.4e0 ELSE 0 END) + sum(0.2e0 * cooling_output / 100) + sum(CASE WHEN irrigation_pump OR recirc_pump THEN 0.1e0 ELSE 0 END) AS electricity_kwh,
      sum(0.5e0 * heating_output / 100) AS gas, sum(CASE WHEN irrigation_pump THEN 250e0 ELSE 12.5e0 END) AS water_liters,
      sum(CASE WHEN co2_injection_rate > 0 THEN 0.5e0 * least(1, co2_injection_rate / 2) ELSE 0 END) AS co2 FROM z GROUP BY 1, 2),
  w AS (SELECT greenhouse_id, date_trunc('hour', timestamp) AS hr, avg(outside_temperature) AS ot FROM weather GROUP BY 1, 2),
  g AS (SELECT s.*, gas * CASE WHEN ot < 0 THEN 1 + abs(ot) * 0.005e0 ELSE 1 END AS natural_gas_m3 FROM s LEFT JOIN w USING (greenhouse_id, hr))
  SELECT greenhouse_id, hr AS timestamp, electricity_kwh, natural_gas_m3, water_liters, water_liters * 0.8e0 AS water_recycled_liters, greatest(0, co2 - 1.8e0 * natural_gas_m3) AS co2_purchased_kg FROM g""",
       cols("electricity_kwh natural_gas_m3 water_liters water_recycled_liters co2_purchased_kg"))
def _(t):
    return sc.hourly_utilities(t.equipment, t.weather, TIE)


def grown(t):
    env = lookup(t.env_daily, t.zone_config, "zone_id")
    return sc.growing_factors(lookup(env, t.dim_crop.select("crop_id", "crop_category", "growth_cycle_days"), "crop_id"))


ADAPTERS["o_grown"] = """
  SELECT *, least(1.3e0, greatest(0.1e0, dli_factor * temp_factor * nutrient_factor)) AS growth_factor FROM (
    SELECT e.date, e.zone_id, crop_category, growth_cycle_days, size_sqft, least(1.2e0, total_dli / (CASE crop_category WHEN 'leafy_green' THEN 17 WHEN 'vine_crop' THEN 25 ELSE 20 END)) AS dli_factor,
      greatest(0.3e0, 1 - abs(avg_temp - target_temperature) * 0.08e0) AS temp_factor,
      greatest(0.5e0, 1 - abs(avg_ec - target_ec) * 0.15e0) * greatest(0.5e0, 1 - abs(avg_ph - target_ph) * 0.2e0) AS nutrient_factor
    FROM env_daily e JOIN zone_config c ON c.zone_id = e.zone_id JOIN dim_crop k ON k.crop_id = c.crop_id)"""


@query("ra4_growing_factors", """
  SELECT date, zone_id, dli_factor, temp_factor, nutrient_factor, growth_factor, CASE WHEN growth_factor >= 0.85e0 THEN 'A' WHEN growth_factor >= 0.65e0 THEN 'B' ELSE 'C' END AS grade FROM o_grown""",
       cols("dli_factor temp_factor nutrient_factor growth_factor"))
def _(t):
    return grown(t).select("date", "zone_id", "dli_factor", "temp_factor", "nutrient_factor", "growth_factor", "grade")


@query("ra5_cycle_yield", """
  WITH a AS (SELECT *, date_diff('day', min(date) OVER (PARTITION BY zone_id), date) AS age FROM o_grown),
  b AS (SELECT *, age // (growth_cycle_days + 1) AS cycle, CAST(age % (growth_cycle_days + 1) AS INT) AS days_since,
      floor(growth_cycle_days * CASE crop_category WHEN 'vine_crop' THEN 0.35e0 ELSE 0.4e0 END) AS mature FROM a),
  c AS (SELECT *, growth_factor * size_sqft * CASE crop_category WHEN 'leafy_green' THEN 0.015e0 WHEN 'vine_crop' THEN 0.008e0 ELSE 0.005e0 END *
      CASE WHEN crop_category = 'leafy_green' THEN 0.3e0 + 0.7e0 * pow(days_since / CAST(growth_cycle_days AS DOUBLE), 0.6e0)
           WHEN days_since >= mature THEN exp(-pow((days_since - mature) / (growth_cycle_days - mature) - 0.5e0, 2) / 0.08e0) ELSE 0 END AS daily_kg FROM b)
  SELECT date, zone_id, cycle, days_since, daily_kg, sum(daily_kg) OVER (PARTITION BY zone_id, cycle ORDER BY date) AS cycle_kg FROM c""", cols("daily_kg cycle_kg", 4))
def _(t):
    return sc.cycle_yield(grown(t)).select("date", "zone_id", "cycle", "days_since", "daily_kg", "cycle_kg")


@query("ra6_order_days", """
  SELECT delivery_frequency, ok AS eligible, count(*) AS orders FROM (SELECT delivery_frequency, CASE delivery_frequency WHEN 'daily' THEN true WHEN '3x_weekly' THEN isodow(o_orderdate) IN (1, 3, 5) ELSE isodow(o_orderdate) = 1 END AS ok
    FROM orders JOIN dim_customer ON customer_id = CAST(o_custkey AS VARCHAR)) GROUP BY ALL""")
def _(t):
    o = t.orders.withColumn("customer_id", F.col("o_custkey").cast("string"))
    flagged = lookup(o, t.dim_customer, "customer_id").withColumn("eligible", sc.orders_on("delivery_frequency", day_of_week_mon0("o_orderdate")))
    return flagged.groupBy("delivery_frequency", "eligible").agg(F.count(F.lit(1)).alias("orders"))


@query("ra7_allocation", """
  WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_suppkey % 16 < 8 THEN 'G0' ELSE 'G1' END AS greenhouse_id, CAST(l_partkey % 8 AS INT) AS crop, CAST(year(l_shipdate) AS INT) AS yr, l_quantity * 5 AS request_kg FROM lineitem),
  s AS (SELECT CASE WHEN l_suppkey % 16 < 8 THEN 'G0' ELSE 'G1' END AS greenhouse_id, CAST(l_suppkey % 8 AS INT) AS crop, CAST(year(l_shipdate) AS INT) AS yr, sum(l_quantity) * 2 AS stock_kg FROM lineitem GROUP BY ALL),
  q AS (SELECT r.*, coalesce(stock_kg, 0e0) AS stock, coalesce(sum(request_kg) OVER (PARTITION BY greenhouse_id, crop, yr ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS prior
    FROM r LEFT JOIN s USING (greenhouse_id, crop, yr))
  SELECT l_orderkey, l_linenumber, l_partkey, greenhouse_id, crop, yr, request_kg, greatest(0e0, least(request_kg, stock - prior)) AS allocated_kg FROM q""", cols("allocated_kg", 4))
def _(t):
    site = F.when(F.col("l_suppkey") % 16 < 8, "G0").otherwise("G1").alias("greenhouse_id")
    year = F.year("l_shipdate").cast("int").alias("yr")
    by = ["greenhouse_id", "crop", "yr"]
    requests = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", site, (F.col("l_partkey") % 8).cast("int").alias("crop"), year, (F.col("l_quantity") * 5).alias("request_kg"))
    stock = t.lineitem.groupBy(site, (F.col("l_suppkey") % 8).cast("int").alias("crop"), year).agg((F.sum("l_quantity") * 2).alias("stock_kg"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    out = sc.allocate(requests, stock, by, order, F.floor(F.col("l_orderkey") / 5000))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *by, "request_kg", "allocated_kg")


@query("ra8_shelf_life_and_cases", """
  SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, CAST(floor(5 + l_partkey % 10 - (l_quantity * 3) / 24e0) AS INT)) AS shelf_days,
    greatest(1, CAST(floor(l_quantity / (CASE WHEN l_partkey % 3 = 0 THEN 5e0 WHEN l_partkey % 3 = 1 THEN 10e0 ELSE 4e0 END)) AS INT)) AS cases FROM lineitem""")
def _(t):
    kind = F.when(F.col("l_partkey") % 3 == 0, "leafy_green").when(F.col("l_partkey") % 3 == 1, "vine_crop").otherwise("berry")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", sc.shelf_life_at_delivery(5 + F.col("l_partkey") % 10, F.col("l_quantity") * 3).alias("shelf_days"), sc.cases("l_quantity", kind).alias("cases"))


@query("ra9_schedule_statistics", """
  SELECT scenario, 'Winter' AS season, greenhouse_id, count(*) AS events, avg(severity) AS avg_severity, sum((epoch(end_time) - epoch(start_time)) / 60) AS minutes FROM scenarios GROUP BY ALL""", cols("avg_severity minutes"))
def _(t):
    return sc.schedule_statistics(t.scenarios)
