"""Feature pipelines, models and their evaluation, all on DataFrames."""

from __future__ import annotations

import json
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonelytics.functions import formulas as fm
from zonelytics.functions.timebins import day_of_week_mon0
from zonelytics.operators.joins import join_null_safe
from zonelytics.operators.quantiles import exact_quantile, exact_quantiles
from zonelytics.operators.windows import rolling_mean_days
from zonelytics.sources.readers import with_default

# --- fixed values: model inputs, classes and hyper-parameters ----------------------
CLIMATE = ["avg_temp", "avg_humidity", "avg_co2", "total_dli", "avg_vpd", "avg_ec", "avg_ph", "temp_excursion_hours", "hours_in_optimal_range"]
ROLLED = ["avg_temp", "total_dli", "avg_humidity", "avg_vpd"]
YIELD_FEATURES = [*CLIMATE, "month", "day_of_year", "days_to_harvest", "temp_deviation", "is_leafy_green", "size_sqft", *[f"{c}_7d_avg" for c in ROLLED]]
YIELD_TARGET = "harvest_weight_kg"
SYSTEMS = ["heating", "cooling", "irrigation", "nutrient", "cold_chain"]
ANOMALY_FEATURES = [
    *CLIMATE, "hour_of_day", "day_of_week", "month", "is_night", "is_weekend", "duration_minutes", "affected_sensor_count",
    "temp_deviation", "moisture_drop", "ph_deviation", "ec_deviation", *[f"affected_{s}" for s in SYSTEMS],
]
ANOMALY_CLASSES = ["hvac_failure", "nutrient_drift", "irrigation_failure", "cold_chain_break", "unknown"]
YIELD_PARAMS = {"maxIter": 300, "stepSize": 0.05, "maxDepth": 8, "subsamplingRate": 0.8, "minInstancesPerNode": 20, "seed": 42}
FOREST_PARAMS = {"numTrees": 200, "maxDepth": 12, "minInstancesPerNode": 3, "featureSubsetStrategy": "sqrt", "seed": 42}
# how trees are grown, not which: tasks remember the node of each row instead of being sent all trees with every level
GROWING = {"cacheNodeIds": True}


# --- features ------------------------------------------------------------------------

def yield_features(harvest: DataFrame, env: DataFrame, crops: DataFrame, zones: DataFrame) -> DataFrame:
    """Harvest rows with the climate of their day, crop and zone attributes and rolling means over the zone's last 7 harvest days."""
    day = env.withColumnRenamed("date", "harvest_date").select("harvest_date", "zone_id", "greenhouse_id", *CLIMATE)
    rows = harvest.join(day, ["harvest_date", "zone_id", "greenhouse_id"])
    rows = rows.join(crops.select("crop_id", "crop_category", "optimal_temp_c", "growth_cycle_days"), "crop_id", "left")
    rows = rows.join(zones.select("zone_id", "size_sqft"), "zone_id", "left")
    rows = rows.withColumns(
        {
            "month": F.month("harvest_date"), "day_of_year": F.dayofyear("harvest_date"),
            "temp_deviation": F.abs(F.col("avg_temp") - F.col("optimal_temp_c")),
            "is_leafy_green": F.coalesce((F.col("crop_category") == "leafy_green").cast("int"), F.lit(0)),
            "yield_per_sqft": fm.ratio(F.col("harvest_weight_kg"), F.col("size_sqft").cast("double")),
        }
    )
    return rolling_mean_days(rows, ROLLED, ["zone_id"], "harvest_date", 7)


def upcoming_features(harvest: DataFrame, env: DataFrame, crops: DataFrame, zones: DataFrame) -> DataFrame:
    """One row of model inputs per zone for the week after its newest climate day.

    Climate: means of the zone's last seven calendar days up to that day, whole days only (those without rows are left out); the crop
    is that of its newest harvest, with that harvest's growing time. A zone without a harvest has no crop and no row.
    """
    newest = env.groupBy("zone_id").agg(F.max("date").alias("newest"))
    week = env.join(newest, "zone_id").filter(F.col("date") > F.date_sub("newest", 7))
    climate = week.groupBy("zone_id", "newest").agg(*[F.avg(c).alias(c) for c in CLIMATE])
    last = harvest.groupBy("zone_id").agg(F.max(F.struct("harvest_date", "crop_id", "days_to_harvest")).alias("_last")).select("zone_id", "_last.crop_id", "_last.days_to_harvest")
    rows = climate.join(last, "zone_id").join(crops.select("crop_id", "crop_category", "optimal_temp_c"), "crop_id", "left")
    rows = rows.join(zones.select("zone_id", "size_sqft"), "zone_id", "left").withColumn("week_start", F.date_add("newest", 1))
    return rows.withColumns(
        {
            "month": F.month("week_start"), "day_of_year": F.dayofyear("week_start"), "temp_deviation": F.abs(F.col("avg_temp") - F.col("optimal_temp_c")),
            "is_leafy_green": F.coalesce((F.col("crop_category") == "leafy_green").cast("int"), F.lit(0)), **{f"{c}_7d_avg": F.col(c) for c in ROLLED},
        }
    ).drop("newest")


def anomaly_features(events: DataFrame, env: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per event and affected zone with that day's climate, time and signature columns.

    Zone lists are split, label spelling is normalised, and columns the event
    log does not carry get neutral defaults.
    """
    rows = events.withColumns(
        {
            "zone_id": F.explode(F.split("zone_ids", ",")), "event_date": F.to_date("start_time"),
            "anomaly_type": F.translate("anomaly_type", "-", "_"),
        }
    )
    day = env.withColumnRenamed("date", "event_date").select("event_date", "zone_id", "greenhouse_id", *CLIMATE)
    rows = rows.join(day, ["event_date", "zone_id", "greenhouse_id"], "left")
    rows = rows.join(zones.select("zone_id", "size_sqft", "primary_crop_id"), "zone_id", "left")
    if "duration_minutes" not in rows.columns and "end_time" in rows.columns:
        rows = rows.withColumn("duration_minutes", (F.unix_seconds("end_time") - F.unix_seconds("start_time")) / 60)
    for name, default in (("duration_minutes", 0.0), ("affected_sensor_count", 0.0), ("moisture_drop_pct", 0.0)):
        rows = with_default(rows, name, default)
    rows = with_default(rows, "setpoint_temp", F.col("avg_temp"))
    number = lambda c: F.col(c).cast("string").try_cast("double")
    hour, weekday = F.hour("start_time"), day_of_week_mon0("start_time")
    rows = rows.withColumns(
        {
            "hour_of_day": hour, "day_of_week": weekday, "month": F.month("start_time"), "is_night": fm.is_night(hour).cast("int"),
            "is_weekend": (weekday >= 5).cast("int"), "duration_minutes": number("duration_minutes"), "affected_sensor_count": number("affected_sensor_count"),
            "temp_deviation": F.abs(F.col("avg_temp") - F.col("setpoint_temp")), "moisture_drop": F.col("moisture_drop_pct"),
            "ph_deviation": F.abs(F.col("avg_ph") - 6.0), "ec_deviation": F.abs(F.col("avg_ec") - 2.0),
        }
    )
    for s in SYSTEMS:
        rows = with_default(rows, f"affected_{s}", 0).withColumn(f"affected_{s}", F.col(f"affected_{s}").cast("int"))
    return rows.filter(F.col("anomaly_type").isin(*ANOMALY_CLASSES)).dropna(subset=ANOMALY_FEATURES)


def labelled(df: DataFrame, label: str = "anomaly_type", name: str = "label_index") -> DataFrame:
    """Class numbers in alphabetical order."""
    out = F.lit(None).cast("double")
    for i, c in enumerate(sorted(ANOMALY_CLASSES)):
        out = F.when(F.col(label) == c, F.lit(float(i))).otherwise(out)
    return df.withColumn(name, out)


def class_weights(df: DataFrame, label: str = "anomaly_type") -> DataFrame:
    """Balanced weights n / (classes * class size)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    totals = sizes.agg(F.sum("_size").alias("n"), F.count(F.lit(1)).alias("k"))
    weight = totals.select("n").scalar() / (totals.select("k").scalar() * F.col("_size"))
    return join_null_safe(df, sizes.select(label, weight.alias("weight")), [label])


# --- splits --------------------------------------------------------------------------

def hash_split(df: DataFrame, keys: Sequence[str], train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train/test by a hash of the row key: the same rows whatever the partitioning."""
    u = fm.unit_hash(*keys, F.lit(seed))
    return df.filter(u < train), df.filter(u >= train)


def stratified(df: DataFrame, keys: Sequence[str], label: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``is_train``: per class, the share ``train`` of rows with the smallest key hashes.

    The cut is a quantile of the class's hashes, found without ranking a whole
    class in one task.
    """
    rows = df.withColumn("_u", fm.unit_hash(*keys, F.lit(seed)))
    cut = exact_quantile(rows, "_u", train, [label], "_cut")
    return join_null_safe(rows, cut, [label]).withColumn("is_train", F.col("_u") < F.col("_cut")).drop("_u", "_cut")


def folds(df: DataFrame, keys: Sequence[str], label: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Stratified fold numbers: every class is cut into ``k`` equal parts at quantiles of its rows' key hashes."""
    rows = df.withColumn("_u", fm.unit_hash(*keys, F.lit(seed), F.lit("fold")))
    names = [f"_cut{i}" for i in range(1, k)]
    cuts = exact_quantiles(rows, "_u", [i / k for i in range(1, k)], [label], names)
    passed = sum((F.col(c) <= F.col("_u")).cast("int") for c in names)
    return join_null_safe(rows, cuts, [label]).withColumn(name, passed).drop("_u", *names)


# --- models --------------------------------------------------------------------------

def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")


def train_yield(train: DataFrame, features: Sequence[str] = YIELD_FEATURES, **params) -> PipelineModel:
    gbt = GBTRegressor(featuresCol="features", labelCol=YIELD_TARGET, predictionCol="predicted", **{**YIELD_PARAMS, **params})
    return Pipeline(stages=[_assembler(features), gbt]).fit(train)


def train_classifier(train: DataFrame, features: Sequence[str] = ANOMALY_FEATURES, **params) -> PipelineModel:
    """Weighted random forest; ``train`` carries anomaly_type and weight (see ``class_weights``)."""
    indexer = StringIndexer(inputCol="anomaly_type", outputCol="label", stringOrderType="alphabetAsc").fit(train)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", predictionCol="predicted_index", **{**FOREST_PARAMS, **GROWING, **params})
    names = IndexToString(inputCol="predicted_index", outputCol="predicted", labels=indexer.labels)
    return Pipeline(stages=[indexer, _assembler(features), forest, names]).fit(train)


def cross_validated_f1(df: DataFrame, k: int = 5, features: Sequence[str] = ANOMALY_FEATURES, keys: Sequence[str] = ("event_id", "zone_id"), parallelism: int = 3, **params) -> float:
    """Mean weighted F1 over k stratified folds, ``parallelism`` of which are trained at a time.

    A forest on few rows is a chain of short jobs that leave most cores idle, and the folds do not depend on each other.
    """
    rows = folds(class_weights(df), keys, "anomaly_type", k)
    indexed = StringIndexer(inputCol="anomaly_type", outputCol="label", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", **{**FOREST_PARAMS, **GROWING, **params})
    pipeline, evaluator = Pipeline(stages=[_assembler(features), forest]), MulticlassClassificationEvaluator(metricName="f1")

    def f1(fold: int) -> float:
        train, test = indexed.filter(F.col("fold") != fold).cache(), indexed.filter(F.col("fold") == fold).cache()
        for part, name in ((train, "training"), (test, "validation")):
            if part.isEmpty():
                raise ValueError(f"The {name} data at fold {fold} is empty.")
        try:
            return evaluator.evaluate(pipeline.fit(train).transform(test))
        finally:
            train.unpersist()
            test.unpersist()

    with ThreadPool(min(parallelism, k)) as pool:
        return sum(pool.map(inheritable_thread_target(df.sparkSession)(f1), range(k), chunksize=1)) / k


def importance(spark: SparkSession, model: PipelineModel, features: Sequence[str], n: int = 10) -> DataFrame:
    """The n most important features of the pipeline's tree model (a list as long as the feature names)."""
    trees = next(s for s in model.stages if hasattr(s, "featureImportances"))
    pairs = list(zip(features, [float(x) for x in trees.featureImportances.toArray()]))
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(n)


def score_upcoming(model: PipelineModel, upcoming: DataFrame) -> DataFrame:
    """Predicted yield of a day of the coming week per zone; see ``upcoming_features``."""
    return model.transform(upcoming).select("zone_id", "crop_id", "week_start", "predicted")


def save_model(model: PipelineModel, path: str, labels: Sequence[str] | None = None) -> None:
    model.write().overwrite().save(f"{path}/model")
    if labels:
        spark = SparkSession.getActiveSession()
        body = json.dumps({str(i): x for i, x in enumerate(labels)})
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/labels")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def load_labels(spark: SparkSession, path: str) -> dict[int, str]:
    return {int(k): v for k, v in json.loads(spark.read.text(f"{path}/labels").first()[0]).items()}


# --- evaluation tables ------------------------------------------------------------------

def regression_metrics(df: DataFrame, actual: str = YIELD_TARGET, predicted: str = "predicted") -> DataFrame:
    y, p = F.col(actual), F.col(predicted)
    sums = df.agg(
        F.avg(F.pow(y - p, 2)).alias("_mse"), F.var_pop(y).alias("_var"), (F.avg(F.abs(F.try_divide(y - p, y))) * 100).alias("mape"), F.count(F.lit(1)).alias("n")
    )
    return sums.select(F.sqrt("_mse").alias("rmse"), (1 - F.try_divide(F.col("_mse"), F.col("_var"))).alias("r2"), "mape", "n")


def residuals(df: DataFrame, actual: str = YIELD_TARGET, predicted: str = "predicted") -> DataFrame:
    res = F.col(actual) - F.col(predicted)
    return df.withColumns({"residual": res, "abs_pct_error": F.abs(F.try_divide(res, F.col(actual))) * 100})


def residual_summary(df: DataFrame) -> DataFrame:
    """Mean and deviation of the residual and the median percentage error."""
    head = df.agg(F.avg("residual").alias("mean_residual"), F.stddev_samp("residual").alias("std_residual"))
    return head.withColumn("median_abs_pct_error", exact_quantile(df, "abs_pct_error", 0.5, name="m").scalar())


def error_by_flag(df: DataFrame, flag: str = "is_leafy_green") -> DataFrame:
    return df.groupBy(flag).agg(F.avg("abs_pct_error").alias("mape"), F.count(F.lit(1)).alias("n"))


def confusion_counts(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes: Sequence[str] = tuple(sorted(ANOMALY_CLASSES))) -> DataFrame:
    """Actual classes as rows, predicted ones as columns."""
    return df.groupBy("actual").pivot("predicted", list(classes)).agg(F.count(F.lit(1))).na.fill(0)


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, from one pass over the pairs."""
    n = confusion_counts(df)
    sides = n.select(
        F.explode(F.array(
            F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hit")),
        )).alias("s")
    ).select("s.*")
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "hit")])
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    per = per.withColumns({"precision": part("hit", "guessed"), "recall": part("hit", "support")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return per.withColumn("f1", f1).select("class", "precision", "recall", "f1", "support", "hit")


def classification_metrics(df: DataFrame) -> DataFrame:
    r = class_report(df)
    total = F.sum("support").cast("double")
    return r.agg(
        (F.sum("hit") / total).alias("accuracy"), (F.sum(F.col("f1") * F.col("support")) / total).alias("f1_weighted"), F.avg("f1").alias("f1_macro"))


def misclassified_pairs(df: DataFrame, n: int = 5) -> DataFrame:
    wrong = df.filter(~(F.col("actual") == F.col("predicted")))
    return wrong.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "actual", "predicted").limit(n)
