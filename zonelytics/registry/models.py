"""Registered feature, split, model and evaluation queries."""

from pyspark.sql import functions as F

from zonelytics.operators.quantiles import exact_quantiles
from zonelytics.plans import ml
from zonelytics.plans import pipeline as pl
from zonelytics.registry import cols, query
from zonelytics.session import cut, work_dir
from zonelytics.sources.adapters import ADAPTERS

ADAPTERS["o_daily"] = """
  SELECT harvest_date, zone_id, greenhouse_id, crop_id, sum(harvest_weight_kg) AS harvest_weight_kg, max(days_to_harvest) AS days_to_harvest FROM harvest GROUP BY ALL"""
ADAPTERS["o_features"] = """
  SELECT h.*, avg_temp, avg_humidity, avg_co2, total_dli, avg_vpd, avg_ec, avg_ph, temp_excursion_hours, hours_in_optimal_range, CAST(month(harvest_date) AS INT) AS month, CAST(dayofyear(harvest_date) AS INT) AS day_of_year,
    abs(avg_temp - optimal_temp_c) AS temp_deviation, CAST(crop_category = 'leafy_green' AS INT) AS is_leafy_green, z.size_sqft, harvest_weight_kg / z.size_sqft AS yield_per_sqft,
    avg(avg_temp) OVER w AS avg_temp_7d_avg, avg(total_dli) OVER w AS total_dli_7d_avg, avg(avg_humidity) OVER w AS avg_humidity_7d_avg, avg(avg_vpd) OVER w AS avg_vpd_7d_avg
  FROM o_daily h JOIN env_daily e ON e.date = h.harvest_date AND e.zone_id = h.zone_id AND e.greenhouse_id = h.greenhouse_id LEFT JOIN dim_crop c ON c.crop_id = h.crop_id LEFT JOIN dim_zone z ON z.zone_id = h.zone_id
  WINDOW w AS (PARTITION BY h.zone_id ORDER BY harvest_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
_SHOWN = [*ml.YIELD_FEATURES, "yield_per_sqft", "harvest_weight_kg"]
_U = "(CAST(concat('0x', substr(md5({k}), 1, 8)) AS BIGINT) / 4294967296e0)"


def daily(t):
    return t.harvest.groupBy("harvest_date", "zone_id", "greenhouse_id", "crop_id").agg(F.sum("harvest_weight_kg").alias("harvest_weight_kg"), F.max("days_to_harvest").alias("days_to_harvest"))


def features(t):
    return ml.yield_features(daily(t), t.env_daily, t.dim_crop, t.dim_zone)


@query("ml1_yield_features", f"SELECT harvest_date, zone_id, {', '.join(_SHOWN)} FROM o_features",
       cols("avg_temp total_dli avg_vpd avg_ec avg_ph temp_excursion_hours hours_in_optimal_range temp_deviation yield_per_sqft avg_temp_7d_avg total_dli_7d_avg avg_humidity_7d_avg avg_vpd_7d_avg"))
def _(t):
    return features(t).select("harvest_date", "zone_id", *_SHOWN)


@query("ml4_hash_split", f"""
  SELECT harvest_date, zone_id, {_U.format(k="concat(zone_id, '|', CAST(harvest_date AS VARCHAR), '|', crop_id, '|42')")} < 0.8e0 AS is_train FROM o_daily""")
def _(t):
    train, test = ml.hash_split(daily(t), ["zone_id", "harvest_date", "crop_id"])
    return train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False))).select("harvest_date", "zone_id", "is_train")


_PRED = "(SELECT l_orderkey, l_quantity AS actual, l_quantity * (9e-1 + l_partkey % 21 / 1e2) AS predicted, CAST(l_suppkey % 8 < 4 AS INT) AS is_leafy_green FROM lineitem)"


def predictions(t):
    """A fixed stand-in for model output over all order lines."""
    return t.lineitem.select(
        F.col("l_quantity").alias("harvest_weight_kg"), (F.col("l_quantity") * (0.9 + F.col("l_partkey") % 21 / 100.0)).alias("predicted"), (F.col("l_suppkey") % 8 < 4).cast("int").alias("is_leafy_green"))


@query("ml3_regression_metrics", f"""
  SELECT sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, 1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual) AS r2, avg(abs((actual - predicted) / actual)) * 100 AS mape, count(*) AS n FROM {_PRED}""",
       cols("rmse r2 mape"))
def _(t):
    return ml.regression_metrics(predictions(t))


@query("ml5_residual_summary", f"""
  SELECT avg(actual - predicted) AS mean_residual, stddev_samp(actual - predicted) AS std_residual, median(abs((actual - predicted) / actual) * 100) AS median_abs_pct_error FROM {_PRED}""",
       cols("mean_residual std_residual median_abs_pct_error"))
def _(t):
    return ml.residual_summary(ml.residuals(predictions(t)))


@query("ml5_error_by_flag", f"SELECT is_leafy_green, avg(abs((actual - predicted) / actual) * 100) AS mape, count(*) AS n FROM {_PRED} GROUP BY 1", cols("mape"))
def _(t):
    return ml.error_by_flag(ml.residuals(predictions(t)))


@query("ag16_exact_quantiles", """
  SELECT zone_id, median(reading) AS q50, quantile_cont(reading, 0.9) AS q90 FROM telemetry_sparse GROUP BY 1""", cols("q50 q90"))
def _(t):
    rows = t.telemetry_sparse
    return exact_quantiles(rows, "reading", [0.5, 0.9], ["zone_id"], ["q50", "q90"])


@query("ag16_quantiles_null_group", """
  SELECT nullif(zone_id, 'Z3') AS zone, quantile_cont(reading, 0.25) AS q25, median(reading) AS q50 FROM telemetry_sparse GROUP BY 1""", cols("q25 q50"))
def _(t):
    rows = t.telemetry_sparse.withColumn("zone", F.nullif("zone_id", F.lit("Z3")))
    return exact_quantiles(rows, "reading", [0.25, 0.5], ["zone"], ["q25", "q50"])


ADAPTERS["o_anomaly"] = """
  SELECT s.anomaly_id AS event_id, s.zone_id, replace(scenario, '-', '_') AS anomaly_type, e.avg_temp, e.avg_ph, e.avg_ec, CAST(hour(start_time) AS INT) AS hour_of_day, CAST(isodow(start_time) - 1 AS INT) AS day_of_week,
    CAST(month(start_time) AS INT) AS month, CAST(hour(start_time) < 6 OR hour(start_time) >= 22 AS INT) AS is_night, CAST(isodow(start_time) >= 6 AS INT) AS is_weekend,
    (epoch(end_time) - epoch(start_time)) / 60e0 AS duration_minutes, abs(avg_ph - 6) AS ph_deviation, abs(avg_ec - 2) AS ec_deviation
  FROM (SELECT *, unnest(string_split(zone_ids, ',')) AS zone_id FROM scenarios) s
  JOIN (SELECT CAST(timestamp AS DATE) AS date, zone_id, greenhouse_id, avg(air_temperature) AS avg_temp, avg(substrate_ph) AS avg_ph, avg(substrate_ec) AS avg_ec FROM telemetry GROUP BY ALL) e
    ON e.date = CAST(s.start_time AS DATE) AND e.zone_id = s.zone_id AND e.greenhouse_id = s.greenhouse_id"""


def incident_features(t):
    events = t.scenarios.withColumnsRenamed({"anomaly_id": "event_id", "scenario": "anomaly_type"})
    env = pl.fact_zone_daily_environment(pl.clean_sensors(t.telemetry), t.zone_config)
    return ml.anomaly_features(events, env, t.dim_zone)


@query("ml7_anomaly_features", "SELECT * FROM o_anomaly", cols("avg_temp avg_ph avg_ec duration_minutes ph_deviation ec_deviation"))
def _(t):
    return incident_features(t).select("event_id", "zone_id", "anomaly_type", "avg_temp", "avg_ph", "avg_ec", "hour_of_day", "day_of_week", "month", "is_night", "is_weekend", "duration_minutes", "ph_deviation", "ec_deviation")


ADAPTERS["o_env_fact"] = """
  SELECT d.*, CASE WHEN abs(avg_temp - target_temperature) > 2 THEN abs(avg_temp - target_temperature) * 2 ELSE 0e0 END AS temp_excursion_hours,
    24 - CASE WHEN abs(avg_temp - target_temperature) > 2 THEN abs(avg_temp - target_temperature) * 2 ELSE 0e0 END AS hours_in_optimal_range
  FROM (SELECT CAST(timestamp AS DATE) AS date, zone_id, greenhouse_id, avg(air_temperature) AS avg_temp, avg(air_humidity) AS avg_humidity, avg(co2_level) AS avg_co2,
      sum(par_light) * 30 / 1e6 AS total_dli, avg(vpd) AS avg_vpd, avg(substrate_ec) AS avg_ec, avg(substrate_ph) AS avg_ph FROM telemetry GROUP BY ALL) d
    LEFT JOIN (SELECT zone_id, target_temperature FROM zone_config) c ON c.zone_id = d.zone_id"""
# what the given log does not carry has neutral defaults, as the reader of the features must see them
_DEFAULTS = {"affected_sensor_count": 0.0, "temp_deviation": 0.0, "moisture_drop": 0.0}


@query("ml7_all_inputs", f"""
  SELECT o.event_id, o.zone_id, o.anomaly_type, {', '.join(f'e.{c}' for c in ml.CLIMATE)}, o.hour_of_day, o.day_of_week, o.month, o.is_night, o.is_weekend, o.duration_minutes, o.ph_deviation, o.ec_deviation,
    {', '.join(f'CAST({v} AS DOUBLE) AS {c}' for c, v in _DEFAULTS.items())}, {', '.join(f'0 AS affected_{s}' for s in ml.SYSTEMS)}
  FROM o_anomaly o JOIN scenarios a ON a.anomaly_id = o.event_id JOIN o_env_fact e ON e.zone_id = o.zone_id AND e.date = CAST(a.start_time AS DATE) AND e.greenhouse_id = a.greenhouse_id""",
       cols(" ".join([*ml.CLIMATE, "duration_minutes", "ph_deviation", "ec_deviation", "temp_deviation"])))
def _(t):
    """All 25 inputs of the classifier."""
    return incident_features(t).select("event_id", "zone_id", "anomaly_type", *ml.ANOMALY_FEATURES)


@query("ml8_label_encoding", """
  SELECT event_id, actual, CASE actual WHEN 'cold_chain_break' THEN 0e0 WHEN 'hvac_failure' THEN 1e0 WHEN 'irrigation_failure' THEN 2e0 WHEN 'nutrient_drift' THEN 3e0 ELSE 4e0 END AS label_index FROM predictions""")
def _(t):
    return ml.labelled(t.predictions, "actual").select("event_id", "actual", "label_index")


@query("ml9_stratified_split", f"""
  WITH u AS (SELECT event_id, actual, {_U.format(k="concat(CAST(event_id AS VARCHAR), '|42')")} AS u FROM predictions), c AS (SELECT actual, quantile_cont(u, 0.8) AS cut FROM u GROUP BY 1)
  SELECT event_id, u.actual, u < cut AS is_train FROM u JOIN c ON c.actual = u.actual""")
def _(t):
    return ml.stratified(t.predictions, ["event_id"], "actual").select("event_id", "actual", "is_train")


@query("ml12_stratified_folds", f"""
  WITH u AS (SELECT event_id, actual, {_U.format(k="concat(CAST(event_id AS VARCHAR), '|42|fold')")} AS u FROM predictions), c AS (SELECT actual, quantile_cont(u, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM u GROUP BY 1)
  SELECT event_id, u.actual, CAST(len(list_filter(cuts, lambda x: x <= u)) AS INT) AS fold FROM u JOIN c ON c.actual = u.actual""")
def _(t):
    return ml.folds(t.predictions, ["event_id"], "actual").select("event_id", "actual", "fold")


@query("ml10_class_weights", """
  SELECT actual, (SELECT count(*) FROM predictions) / (5e0 * count(*)) AS weight FROM predictions GROUP BY 1""", cols("weight"))
def _(t):
    return ml.class_weights(t.predictions, "actual").groupBy("actual").agg(F.max("weight").alias("weight"))


_REPORT = """
  WITH s AS (SELECT actual AS class, count(*) AS support, count(*) FILTER (actual = predicted) AS hit FROM predictions GROUP BY 1), g AS (SELECT predicted AS class, count(*) AS guessed FROM predictions GROUP BY 1),
  r AS (SELECT class, hit / CAST(guessed AS DOUBLE) AS precision, hit / CAST(support AS DOUBLE) AS recall, support, hit FROM s JOIN g USING (class)),
  f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM r)"""


@query("ml11_classification_metrics", _REPORT + " SELECT sum(hit) / CAST(sum(support) AS DOUBLE) AS accuracy, sum(f1 * support) / sum(support) AS f1_weighted, avg(f1) AS f1_macro FROM f", cols("accuracy f1_weighted f1_macro"))
def _(t):
    return ml.classification_metrics(t.predictions)


@query("ml13_class_report", _REPORT + " SELECT class, precision, recall, f1, support, hit FROM f", cols("precision recall f1"))
def _(t):
    return ml.class_report(t.predictions)


@query("ml13_confusion_matrix", "SELECT actual, " + ", ".join(f"count(*) FILTER (predicted = '{c}') AS {c}" for c in sorted(ml.ANOMALY_CLASSES)) + " FROM predictions GROUP BY 1")
def _(t):
    return ml.confusion_matrix(t.predictions)


@query("ml14_misclassified_pairs", "SELECT actual, predicted, count(*) AS count FROM predictions WHERE actual <> predicted GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5")
def _(t):
    return ml.misclassified_pairs(t.predictions)


def upcoming(t):
    return ml.upcoming_features(daily(t), t.env_daily, t.dim_crop, t.dim_zone)


@query("ml15_upcoming_inputs", f"""
  WITH n AS (SELECT zone_id, max(date) AS newest FROM env_daily GROUP BY 1),
  w AS (SELECT e.zone_id, newest, {', '.join(f'avg({c}) AS {c}' for c in ml.CLIMATE)} FROM env_daily e JOIN n ON n.zone_id = e.zone_id WHERE e.date > newest - INTERVAL 7 DAY GROUP BY ALL),
  l AS (SELECT zone_id, crop_id, days_to_harvest FROM o_daily QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY harvest_date DESC, crop_id DESC, days_to_harvest DESC) = 1)
  SELECT w.zone_id, l.crop_id, CAST(newest + INTERVAL 1 DAY AS DATE) AS week_start, {', '.join(ml.CLIMATE)}, CAST(month(newest + INTERVAL 1 DAY) AS INT) AS month, CAST(dayofyear(newest + INTERVAL 1 DAY) AS INT) AS day_of_year,
    days_to_harvest, abs(avg_temp - optimal_temp_c) AS temp_deviation, CAST(coalesce(crop_category = 'leafy_green', false) AS INT) AS is_leafy_green, z.size_sqft, {', '.join(f'{c} AS {c}_7d_avg' for c in ml.ROLLED)}
  FROM w JOIN l ON l.zone_id = w.zone_id LEFT JOIN dim_crop c ON c.crop_id = l.crop_id LEFT JOIN dim_zone z ON z.zone_id = w.zone_id""",
       cols(" ".join([*ml.CLIMATE, "temp_deviation", *[f"{c}_7d_avg" for c in ml.ROLLED]])))
def _(t):
    return upcoming(t).select("zone_id", "crop_id", "week_start", *ml.YIELD_FEATURES)


# --- trained models: no SQL twin -------------------------------------------------------------
# All train with the library's full settings. The yield model is trained once per application and table folder, and kept as a saved model.

_YIELD: dict[tuple[str, str], str] = {}


def trained(t):
    # training reads its input many times: the features are written once
    train, test = ml.hash_split(cut(features(t), "features"), ["zone_id", "harvest_date", "crop_id"])
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _YIELD:
        path = work_dir(t.spark, "yield-model")
        ml.save_model(ml.train_yield(train), path)
        _YIELD[key] = path
    return ml.load_model(_YIELD[key]), test


@query("ml2_yield_model_metrics")
def _(t):
    model, test = trained(t)
    return ml.regression_metrics(model.transform(test))


@query("ml6_feature_importance")
def _(t):
    return ml.importance(t.spark, trained(t)[0], ml.YIELD_FEATURES)


@query("ml15_score_upcoming")
def _(t):
    return ml.score_upcoming(trained(t)[0], upcoming(t))


@query("ml10_forest_report")
def _(t):
    rows = cut(ml.class_weights(ml.stratified(cut(incident_features(t), "features"), ["event_id", "zone_id"], "anomaly_type")), "training")
    model = ml.train_classifier(rows.filter("is_train"))
    out = model.transform(rows.filter("NOT is_train")).withColumnRenamed("anomaly_type", "actual")
    return ml.class_report(out.select("actual", "predicted"))


@query("ml12_cross_validated_f1")
def _(t):
    f1 = ml.cross_validated_f1(cut(incident_features(t), "features"))
    return t.scenarios.agg(F.count(F.lit(1)).alias("incidents")).withColumn("f1_mean", F.lit(f1))


@query("ml16_saved_model_scores")
def _(t):
    model, test = trained(t)
    path = work_dir(t.spark, "model")
    ml.save_model(model, path, sorted(ml.ANOMALY_CLASSES))
    return ml.load_model(path).transform(test).select("zone_id", "harvest_date", "predicted")
