"""The four shipped alert rules and their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelytics.operators.joins import asof_join, lookup
from zonelytics.operators.rules import Rule, fire_all, throttle

# --- fixed values: rules as data -------------------------------------------------
RULE_DATA = [
    {
        "name": "Temperature Deviation Alert", "enabled": True, "object_id_column": "zone_id", "grouping_columns": ["greenhouse_id", "zone_id"],
        "measure": {"expression": "abs(air_temperature - target_temperature)", "alias": "temp_deviation_c"},
        "condition": {"type": "BECOMES", "operator": "GreaterThan", "threshold": 3.0, "sustained_duration_seconds": 120, "evaluation_interval_seconds": 30},
        "severity": "critical", "cooldown_minutes": 15,
        "auto_resolve": {"enabled": True, "condition": "abs(air_temperature - target_temperature) <= 1.5", "message": "{{zone_id}} is back within 1.5 degrees"},
        "actions": [
            {"type": "TeamsNotification", "channel": "alerts", "template": {"title": "Temperature alert: {{zone_id}}", "body": "{{zone_id}} in {{greenhouse_id}} is {{temp_deviation_c}} degrees off target"}},
            {"type": "Email", "recipients": ["operations"], "template": {"subject": "Temperature deviation in {{zone_id}}", "body": "measured {{air_temperature}}, target {{target_temperature}}, crop {{crop_name}}"}},
            {"type": "NotebookTrigger", "notebook_name": "anomaly-response-hvac", "parameters": {"zone_id": "{{zone_id}}", "greenhouse_id": "{{greenhouse_id}}", "anomaly_type": "temperature-deviation", "deviation_value": "{{temp_deviation_c}}"}},
        ],
    },
    {
        "name": "Equipment Offline While Needed", "enabled": True, "object_id_column": "zone_id", "grouping_columns": ["greenhouse_id", "zone_id"],
        "condition": {
            "type": "OR", "evaluation_interval_seconds": 30,
            "sub_conditions": [
                {"name": "Heating Offline While Cold", "expression": "heating_output == 0 AND air_temperature < target_temperature - 2", "sustained_duration_seconds": 90},
                {"name": "Irrigation Offline During Cycle", "expression": "irrigation_pump == true AND irrigation_flow == 0", "sustained_duration_seconds": 60},
            ],
        },
        "severity": "critical", "cooldown_minutes": 10,
        "auto_resolve": {
            "enabled": True,
            "condition": "(heating_output > 0 OR air_temperature >= target_temperature - 1) AND (irrigation_pump == false OR irrigation_flow > 0)",
            "message": "equipment in {{zone_id}} works again",
        },
        "actions": [
            {"type": "TeamsNotification", "channel": "alerts", "template": {"title": "Equipment alert: {{zone_id}}", "body": "{{zone_id}} in {{greenhouse_id}}: heating {{heating_output}}, flow {{irrigation_flow}}, air {{air_temperature}} of {{target_temperature}}"}},
            {"type": "Email", "recipients": ["operations", "maintenance"], "template": {"subject": "Equipment offline in {{zone_id}}", "body": "heating {{heating_output}}, flow {{irrigation_flow}}, moisture {{substrate_moisture}}"}},
            {"type": "NotebookTrigger", "notebook_name": "anomaly-response-equipment", "parameters": {"zone_id": "{{zone_id}}", "anomaly_type": "equipment-offline"}},
        ],
    },
    {
        "name": "Nutrient Drift", "enabled": True, "object_id_column": "zone_id", "grouping_columns": ["greenhouse_id", "zone_id"],
        "measures": [{"expression": "abs(substrate_ph - target_ph)", "alias": "ph_deviation"}, {"expression": "abs(substrate_ec - target_ec)", "alias": "ec_deviation"}],
        "condition": {
            "type": "AND", "sustained_duration_seconds": 180, "evaluation_interval_seconds": 30,
            "sub_conditions": [
                {"measure": "ph_deviation", "operator": "GreaterThan", "threshold": 0.5},
                {"measure": "ec_deviation", "operator": "GreaterThan", "threshold": 0.3},
            ],
        },
        "severity": "warning", "cooldown_minutes": 20,
        "auto_resolve": {"enabled": True, "condition": "abs(substrate_ph - target_ph) <= 0.2 AND abs(substrate_ec - target_ec) <= 0.15", "message": "nutrients in {{zone_id}} are on target"},
        "actions": [
            {"type": "TeamsNotification", "channel": "alerts", "template": {"title": "Nutrient alert: {{zone_id}}", "body": "{{zone_id}} in {{greenhouse_id}}: pH off by {{ph_deviation}}, EC off by {{ec_deviation}}"}},
            {"type": "Email", "recipients": ["growers", "nutrients"], "template": {"subject": "Nutrient drift in {{zone_id}}", "body": "pH {{substrate_ph}} of {{target_ph}}, EC {{substrate_ec}} of {{target_ec}}, crop {{crop_name}}"}},
            {"type": "NotebookTrigger", "notebook_name": "anomaly-response-nutrient", "parameters": {"zone_id": "{{zone_id}}", "anomaly_type": "nutrient-drift"}},
        ],
    },
    {
        "name": "Cold Chain Temperature Exceedance", "enabled": True, "source": {"filter": "alert_type == 'cold-chain-break'"}, "object_id_column": "zone_id", "grouping_columns": ["greenhouse_id"],
        "condition": {"type": "BECOMES", "operator": "GreaterThan", "measure_expression": "anomaly_score", "threshold": 0.7, "sustained_duration_seconds": 0, "evaluation_interval_seconds": 60},
        "severity": "critical", "cooldown_minutes": 5, "auto_resolve": {"enabled": False},
        "actions": [
            {"type": "TeamsNotification", "channel": "alerts", "template": {"title": "Cold chain alert: {{greenhouse_id}}", "body": "alert {{alert_id}}, {{severity}}, score {{anomaly_score}}: {{message}}"}},
            {"type": "Email", "recipients": ["quality", "operations", "logistics"], "template": {"subject": "Cold chain break in {{greenhouse_id}} at {{timestamp}}", "body": "alert {{alert_id}}, score {{anomaly_score}}"}},
            {"type": "NotebookTrigger", "notebook_name": "anomaly-response-coldchain", "parameters": {"greenhouse_id": "{{greenhouse_id}}", "alert_id": "{{alert_id}}", "anomaly_type": "cold-chain-break", "anomaly_score": "{{anomaly_score}}"}},
        ],
    },
]
LIMITS = {"per_key": 3, "overall": 50}
DEDUP_SECONDS = 300
ESCALATION_MINUTES = 30
# --- end of fixed values ----------------------------------------------------------

RULES = {r.name: r for r in map(Rule.from_dict, RULE_DATA)}
TEMPERATURE, EQUIPMENT_OFFLINE, NUTRIENT, COLD_CHAIN = RULES.values()


def with_setpoints(telemetry: DataFrame, config: DataFrame) -> DataFrame:
    return lookup(telemetry, config, "zone_id")


def equipment_with_readings(equipment: DataFrame, telemetry: DataFrame, config: DataFrame, seconds: int = 30) -> DataFrame:
    """Equipment rows with the nearest reading of their zone less than ``seconds`` away, and the set-points.

    Of two equally near readings the earlier is taken; a row without one stays,
    with NULL readings. Both as-of joins run per (zone, time chunk).
    """
    s = telemetry.select("zone_id", "timestamp", "event_id", "air_temperature", "substrate_moisture")
    before = asof_join(equipment, s, ["zone_id"], tie=("event_id",), prefix="_b_")
    both = asof_join(before, s, ["zone_id"], direction="forward", strict=True, tie=("event_id",), prefix="_a_")
    away = lambda side: F.abs(F.unix_micros(f"_{side}_timestamp") - F.unix_micros("timestamp"))
    near = lambda side: F.coalesce(away(side) < seconds * 1_000_000, F.lit(False))
    first = near("b") & ~F.coalesce(near("a") & (away("a") < away("b")), F.lit(False))
    found = {c: F.when(first, F.col(f"_b_{c}")).when(near("a"), F.col(f"_a_{c}")) for c in ("air_temperature", "substrate_moisture")}
    return lookup(both.select(*equipment.columns, *[v.alias(k) for k, v in found.items()]), config, "zone_id", "left")


def run_rules(sources: dict[str, DataFrame], rules: list[Rule], tie: tuple[str, ...] = ()) -> DataFrame:
    """Alerts of several rules, limited together. ``sources`` maps rule names to their input.

    Rules given the same frame, key and interval share one pass over it.
    """
    passes: dict[tuple, list[Rule]] = {}
    for rule in rules:
        if rule.enabled:
            passes.setdefault((id(sources[rule.name]), rule.key, rule.interval, rule.source_filter), []).append(rule)
    out = None
    for members in passes.values():
        for rule, alerts in zip(members, fire_all(sources[members[0].name], members, tie=tie, dedup=DEDUP_SECONDS)):
            one = alerts.select("rule", "severity", rule.key, "timestamp", "branch", "resolved_at")
            out = one if out is None else out.unionByName(one)
    return throttle(out, **LIMITS)
