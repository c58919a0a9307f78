"""Report queries: saved calls of the measure evaluator plus a little shaping.

``as_of`` is a date column or literal; by default the newest harvest date, as
a scalar sub-query. Grouped results are small (dimension grain), so the
windows and pivots below run over aggregates, never over fact rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonelytics.functions import formulas as fm
from zonelytics.operators.joins import lookup
from zonelytics.operators.latest import latest_per_key
from zonelytics.operators.windows import moving_average_days
from zonelytics.plans.measures import ANOMALY, ENV, HARVEST, SHIP, Model, evaluate, with_single_row

Filters = dict[str, Callable[[Column], Column]]
KPIS = ["total_harvest_kg", "grade_a_pct", "energy_cost_per_kg", "on_time_delivery_pct", "anomaly_count", "prevented_loss_usd"]


def today(model: Model, as_of=None) -> Column:
    if as_of is None:
        return model.facts[HARVEST].agg(F.max("harvest_date").alias("d")).scalar()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def last_days(model: Model, days: int, as_of=None) -> Filters:
    """Date slicer: the last ``days`` days up to and including ``as_of``."""
    end = today(model, as_of)
    return {"dim_date.date": lambda c: (c > F.date_sub(end, days)) & (c <= end)}


def slicers(model: Model, days: int | None = 30, greenhouse: str | None = None, crops: Sequence[str] = (), zones: Sequence[str] = (), as_of=None) -> Filters:
    """The report's slicer bar as evaluator filters."""
    out: Filters = last_days(model, days, as_of) if days else {}
    if greenhouse:
        out["dim_greenhouse.greenhouse_id"] = lambda c: c == greenhouse
    if crops:
        out["dim_crop.crop_name"] = lambda c: c.isin(*crops)
    if zones:
        out["dim_zone.zone_id"] = lambda c: c.isin(*zones)
    return out


# --- fixed values: preset filters by bookmark, days of history ------------------
BOOKMARKS = {"morning overview": 7, "site focus": 30, "yield comparison": 90, "sustainability report": 91, "anomaly demo": 1}


def bookmark(model: Model, name: str, greenhouse: str | None = None, as_of=None) -> Filters:
    return slicers(model, BOOKMARKS[name], greenhouse, as_of=as_of)


def kpi_cards(model: Model, filters: Filters | None = None) -> DataFrame:
    """One row per KPI: value, value a year earlier, change in percent, colour."""
    both = evaluate(model, KPIS, filters=filters, before=True)
    pairs = F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("value"), F.col(f"{k}_before").cast("double").alias("before")) for k in KPIS])
    rows = both.select(F.explode(pairs).alias("_k")).select("_k.*")
    rows = rows.withColumn("yoy_pct", fm.ratio(F.col("value") - F.col("before"), F.col("before"), 100.0))
    up, kpi, v = F.col("yoy_pct"), F.col("kpi"), F.col("value")
    direction = lambda good: F.when(good, "green").when(~good & (up != 0), "red")
    colour = (
        F.when(kpi == "total_harvest_kg", direction(up > 0)).when(kpi == "grade_a_pct", fm.kpi_colour(v, 85, 75))
        .when(kpi == "energy_cost_per_kg", direction(up < 0)).when(kpi == "on_time_delivery_pct", fm.kpi_colour(v, 95, 90))
        .when(kpi == "anomaly_count", fm.kpi_colour(v, 3, 6, False)).otherwise("green")
    )
    return rows.withColumn("colour", colour)


def sparklines(model: Model, days: int = 90, as_of=None, kpis: Sequence[str] = ("total_harvest_kg", "grade_a_pct", "energy_cost_per_kg", "on_time_delivery_pct")) -> DataFrame:
    return evaluate(model, list(kpis), ["dim_date.date"], last_days(model, days, as_of)).orderBy("date")


def yield_by_site_and_crop(model: Model, filters: Filters | None = None) -> DataFrame:
    return evaluate(model, ["total_harvest_kg"], ["dim_greenhouse.name", "dim_crop.crop_name"], filters).orderBy(F.col("total_harvest_kg").desc(), "name", "crop_name")


def monthly_yield_overlay(model: Model, years: Sequence[int], filters: Filters | None = None) -> DataFrame:
    """Months as rows, one column per year."""
    monthly = evaluate(model, ["total_harvest_kg"], ["dim_date.month_num", "dim_date.month_name", "dim_date.year"], filters)
    wide = monthly.groupBy("month_num", "month_name").pivot("year", list(years)).agg(F.sum("total_harvest_kg"))
    return wide.withColumnsRenamed({str(y): f"y{y}" for y in years}).orderBy("month_num")


def zone_scorecard(model: Model, filters: Filters | None = None) -> DataFrame:
    measures = ["avg_zone_temperature_c", "optimal_hours_pct", "avg_dli", "grade_a_pct"]
    return evaluate(model, measures, ["dim_zone.greenhouse_id", "dim_zone.zone_id", "dim_zone.zone_name"], filters).orderBy("greenhouse_id", "zone_id")


def resource_split(model: Model, filters: Filters | None = None) -> DataFrame:
    """Each site's share of energy cost and of shipped cases (a site attribute of the facts themselves)."""
    split = evaluate(model, ["energy_cost_usd", "cases_shipped"], ["greenhouse_id"], filters)
    total = Window.partitionBy(F.lit(1))  # one row per site
    return split.withColumns({f"{m}_share": fm.ratio(F.col(m).cast("double"), F.sum(m).over(total).cast("double")) for m in ("energy_cost_usd", "cases_shipped")})


def zone_production(model: Model, filters: Filters | None = None) -> DataFrame:
    """Site -> zone matrix with subtotals and the grand total."""
    measures = ["total_harvest_kg", "yield_per_sqft_kg", "grade_a_pct", "waste_pct", "avg_cycle_length_days", "revenue_usd"]
    return evaluate(model, measures, ["dim_zone.greenhouse_id", "dim_zone.zone_id"], filters, rollup=True)


def light_vs_yield(model: Model, filters: Filters | None = None) -> DataFrame:
    """Zone-months with light and yield, and the fitted line through all of them."""
    points = evaluate(model, ["avg_dli", "total_harvest_kg"], ["dim_zone.zone_id", "dim_zone.size_sqft", "dim_date.year", "dim_date.month_num"], filters)
    y, x = F.col("total_harvest_kg"), F.col("avg_dli")
    line = points.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("correlation"))
    return with_single_row(points, line).withColumn("fitted_kg", F.col("intercept") + F.col("slope") * x)


def month_variance(model: Model, as_of=None) -> DataFrame:
    """This month against the last one by crop, with a total row."""
    end = today(model, as_of)
    this, last = F.trunc(end, "month"), F.add_months(F.trunc(end, "month"), -1)
    month = lambda start: {"dim_date.date": lambda c: (c >= start) & (c < F.add_months(start, 1))}
    now = evaluate(model, ["total_harvest_kg"], ["dim_crop.crop_name"], month(this)).withColumnRenamed("total_harvest_kg", "this_month_kg")
    old = evaluate(model, ["total_harvest_kg"], ["dim_crop.crop_name"], month(last)).withColumnRenamed("total_harvest_kg", "last_month_kg")
    both = now.unionByName(old, allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("this_month_kg", "last_month_kg")]
    crops = both.groupBy("crop_name").agg(*sums)
    total = both.agg(*sums).select(F.lit("Total").alias("crop_name"), "this_month_kg", "last_month_kg")
    return crops.unionByName(total).withColumn("variance_kg", F.col("this_month_kg") - F.col("last_month_kg"))


def monthly_change_by_crop(model: Model) -> DataFrame:
    """Every month of every crop with the change to the month before it."""
    monthly = evaluate(model, ["total_harvest_kg"], ["dim_crop.crop_name", "dim_date.year", "dim_date.month_num"])
    w = Window.partitionBy("crop_name").orderBy("year", "month_num")  # one row per month
    before = F.lag("total_harvest_kg").over(w)
    return monthly.withColumns({"last_month_kg": before, "change_kg": F.col("total_harvest_kg") - before})


def daily_yield(model: Model, days: int = 90, as_of=None) -> DataFrame:
    daily = evaluate(model, ["total_harvest_kg"], ["dim_greenhouse.name", "dim_date.date"], last_days(model, days, as_of))
    return moving_average_days(daily, "total_harvest_kg", ["name"], "date", 7, "avg_7d_kg").orderBy("date", "name")


def grade_distribution(model: Model) -> DataFrame:
    """Grade A, grade B and waste of each crop as shares of their sum."""
    kg = lambda c: F.sum(F.col("harvest_weight_kg") * F.col(c) / 100)
    h = model.facts[HARVEST].groupBy("crop_id").agg(kg("grade_a_pct").alias("_a"), kg("grade_b_pct").alias("_b"), F.sum("waste_kg").alias("_w"))
    named = h.join(model.dims["dim_crop"].select("crop_id", "crop_name"), "crop_id", "left")
    total = F.col("_a") + F.col("_b") + F.col("_w")
    share = lambda c, n: fm.ratio(F.col(c), total, 100.0).alias(n)
    return named.select("crop_name", share("_a", "grade_a_share"), share("_b", "grade_b_share"), share("_w", "waste_share"))


def sustainability(model: Model, by: Sequence[str] = (), filters: Filters | None = None) -> DataFrame:
    """Four gauges with their colours."""
    measures = ["water_recycling_rate_pct", "yoy_energy_efficiency_pct", "waste_pct", "carbon_intensity"]
    out = evaluate(model, measures, by, filters)
    return out.withColumns(
        {
            "water_colour": fm.kpi_colour("water_recycling_rate_pct", 85, 75), "energy_colour": fm.kpi_colour("yoy_energy_efficiency_pct", 5, 0),
            "waste_colour": fm.kpi_colour("waste_pct", 5, 8, False), "carbon_colour": fm.kpi_colour("carbon_intensity", 0.3, 0.5, False),
        }
    )


def anomaly_timeline(model: Model) -> DataFrame:
    month = F.date_trunc("month", "start_time").cast("date").alias("month")
    return model.facts[ANOMALY].groupBy(month, "anomaly_type").agg(F.count(F.lit(1)).alias("anomaly_count"), F.avg("response_time_minutes").alias("avg_response_time_min"))


def energy_vs_yield(model: Model) -> DataFrame:
    rows = evaluate(model, ["energy_cost_usd", "total_harvest_kg"], ["dim_date.year", "dim_date.month_num"])
    label = F.date_format(F.make_date("year", "month_num", F.lit(1)), "MMM yyyy")
    return rows.withColumn("month_label", label).orderBy("year", "month_num")


def roi_cards(model: Model, as_of=None) -> DataFrame:
    out = evaluate(model, ["prevented_loss_usd", "avg_response_time_min", "days_since_last_anomaly"], as_of=as_of)
    days = F.col("days_since_last_anomaly")
    return out.withColumns(
        {"response_on_target": F.col("avg_response_time_min") < 15, "days_colour": F.when(days > 14, "green").when(days > 7, "yellow").otherwise("red")}
    )


def customer_scorecard(model: Model, filters: Filters | None = None) -> DataFrame:
    measures = ["shipment_count", "on_time_delivery_pct", "cold_chain_compliance_pct", "fill_rate_pct", "avg_shelf_life_days"]
    out = evaluate(model, measures, ["dim_customer.name"], filters).withColumns(
        {
            "on_time_colour": fm.kpi_colour("on_time_delivery_pct", 95, 90), "cold_chain_colour": fm.kpi_colour("cold_chain_compliance_pct", 98, 95),
            "compliance_risk": fm.compliance_risk("cold_chain_compliance_pct"), "service_concern": fm.service_concern("on_time_delivery_pct"),
        }
    )
    return out.orderBy(F.col("on_time_delivery_pct").asc_nulls_last(), "name")


def delivery_text(scorecard: DataFrame) -> DataFrame:
    """Performance as text: percentage, then the count behind it."""
    n = F.round(F.col("shipment_count") * F.col("on_time_delivery_pct") / 100, 0).cast("bigint")
    text = F.format_string("%.0f%% on-time — %d of %d", F.round("on_time_delivery_pct", 0), n, F.col("shipment_count"))
    return scorecard.withColumn("delivery_text", text)


def zone_detail(model: Model, zone: str) -> DataFrame:
    """Day-by-day history of one zone: climate and the harvest log."""
    env = model.facts[ENV].filter(F.col("zone_id") == zone)
    log = model.facts[HARVEST].filter(F.col("zone_id") == zone).groupBy(F.col("harvest_date").alias("date")).agg(
        F.count(F.lit(1)).alias("harvests"), F.sum("harvest_weight_kg").alias("harvest_kg"), F.sum("waste_kg").alias("waste_kg"))
    return env.select("date", "zone_id", "avg_temp", "total_dli", "avg_vpd", "temp_excursion_hours").join(log, "date", "full_outer")


def customer_detail(model: Model, customer: str) -> DataFrame:
    ship = model.facts[SHIP].filter(F.col("customer_id") == customer)
    names = model.dims["dim_product"].select("product_id", "product_name")
    return ship.join(names, "product_id", "left").select(
        "ship_date", "order_id", "product_name", "quantity_cases", "quantity_ordered", "delivery_status", "cold_chain_compliant", "shelf_life_remaining_days")


def zone_tooltip(status: DataFrame, alerts: DataFrame, tie: tuple[str, ...] = ("alert_id",)) -> DataFrame:
    """Current against target temperature, health score and the newest alert of each zone."""
    newest = latest_per_key(alerts, ["zone_id"], tie=tie).select("zone_id", F.col("timestamp").alias("last_alert_at"), F.col("alert_type").alias("last_alert"))
    return status.join(newest, "zone_id", "left").select(
        "zone_id", "zone_name", "crop_name", "air_temperature", "target_temperature", "health_score", fm.needs_attention("health_score").alias("needs_attention"),
        "last_alert_at", "last_alert")


def shipment_tooltip(shipments: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    rows = shipments.join(products.select(F.col("product_id").alias("product_sku"), "product_name"), "product_sku", "left")
    rows = rows.join(customers.select("customer_id", F.col("name").alias("customer")), "customer_id", "left")
    status = F.when(fm.cold_chain_ok("cold_chain_temp"), "OK").otherwise("WARM")
    return rows.select("order_id", "product_sku", "customer", "product_name", "ship_date", status.alias("temp_status"))


def quality_and_excursions(model: Model, zone: str) -> DataFrame:
    """Grade A share per day next to the day's temperature excursion."""
    grade = evaluate(model, ["grade_a_pct", "waste_pct"], ["dim_date.date"], {"dim_zone.zone_id": lambda c: c == zone})
    env = model.facts[ENV].filter(F.col("zone_id") == zone).select("date", "temp_excursion_hours", "avg_temp")
    return grade.join(env, "date").withColumn("quality_concern", fm.quality_concern("grade_a_pct", "waste_pct"))


def top_zones(model: Model, n: int = 3, filters: Filters | None = None) -> DataFrame:
    return evaluate(model, ["yield_per_sqft_kg"], ["dim_zone.zone_id"], filters).orderBy(F.col("yield_per_sqft_kg").desc(), "zone_id").limit(n)


def at_risk_shipments(shipments: DataFrame, crops: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Undelivered shipments that are too warm, late or short of shelf life, with the reason."""
    rows = lookup(shipments, crops.select("crop_id", "crop_name", "shelf_life_days"), "crop_id", "left")
    warm = ~fm.cold_chain_ok("cold_chain_temp")
    if ranges is not None:  # transport range per crop instead of one limit for all
        rows = lookup(rows, ranges, "crop_id", "left")
        warm = ~F.coalesce(fm.transport_fit("cold_chain_temp", "min_temp_c", "max_temp_c"), fm.cold_chain_ok("cold_chain_temp"))
    late = F.col("delivery_status") == "delayed"
    short = fm.low_shelf_life("shelf_life_remaining_days", "shelf_life_days", "crop_name")
    reason = F.concat_ws(",", F.when(warm, "temperature"), F.when(late, "late"), F.when(short, "shelf_life"))
    return rows.filter(F.col("delivery_status").isin("in_transit", "delayed")).withColumn("risk", reason).filter("risk <> ''")


def breach_impact(alerts: DataFrame, shipments: DataFrame, products: DataFrame) -> DataFrame:
    """Cold-chain alerts with what their site shipped that day, by product type.

    Shipments are summed per site, day and product type before they meet the
    alerts, so one alert never fans out to single order lines.
    """
    per_day = (
        shipments.join(products.select(F.col("product_id").alias("product_sku"), "package_type"), "product_sku", "left")
        .groupBy("greenhouse_id", F.to_date("ship_date").alias("day"), "package_type")
        .agg(F.count(F.lit(1)).alias("shipments"), F.sum("quantity_cases").alias("cases"), F.count_if(~F.col("cold_chain_compliant")).alias("warm_shipments"))
    )
    hits = alerts.filter("alert_type = 'cold-chain-break'").withColumn("day", F.to_date("timestamp"))
    return hits.select("alert_id", "greenhouse_id", "severity", "day").join(per_day, ["greenhouse_id", "day"])


def late_by_route(shipments: DataFrame, customers: DataFrame) -> DataFrame:
    """Share of delayed shipments per site and customer region."""
    rows = lookup(shipments, customers.select("customer_id", "region"), "customer_id", "left")
    out = rows.groupBy("greenhouse_id", "region").agg(
        F.count(F.lit(1)).alias("shipments"), F.count_if(F.col("delivery_status") == "delayed").alias("late"))
    return out.withColumn("late_pct", fm.ratio(F.col("late").cast("double"), F.col("shipments").cast("double"), 100.0))


def exceptions_by_cause(shipments: DataFrame) -> DataFrame:
    cause = (
        F.when(~F.col("cold_chain_compliant"), "cold chain").when(F.col("delivery_status") == "delayed", "late")
        .when(F.col("quantity_cases") < F.col("quantity_ordered"), "short quantity")
    )
    return shipments.withColumn("cause", cause).filter("cause IS NOT NULL").groupBy("cause").agg(F.count(F.lit(1)).alias("exceptions")).orderBy(
        F.col("exceptions").desc(), "cause")


def quarterly_fill_rate(model: Model) -> DataFrame:
    rows = evaluate(model, ["fill_rate_pct"], ["dim_date.year", "dim_date.quarter"])
    before = F.lag("fill_rate_pct").over(Window.partitionBy(F.lit(1)).orderBy("year", "quarter"))  # one row per quarter
    return rows.withColumns({"previous_pct": before, "change_pct": F.col("fill_rate_pct") - before})


def energy_week_vs_last_year(model: Model, as_of=None) -> DataFrame:
    """Seven days up to ``as_of`` against the same dates a year earlier, per site."""
    week = last_days(model, 7, as_of)
    return evaluate(model, ["energy_cost_usd", "electricity_kwh"], ["dim_greenhouse.name"], week, before=True)


def highest_vpd(latest: DataFrame, n: int = 5) -> DataFrame:
    return latest.select("zone_id", "vpd", "timestamp").orderBy(F.col("vpd").desc(), "zone_id").limit(n)
