"""Registered report queries."""

from pyspark.sql import functions as F

from zonelytics.functions import formulas as fm
from zonelytics.operators.quantiles import exact_quantile
from zonelytics.operators.windows import change, rolling_mean, share_of_total
from zonelytics.plans import detect, views
from zonelytics.plans import measures as me
from zonelytics.plans import reports as rp
from zonelytics.registry import cols, query
from zonelytics.registry.events import LATEST, TIE
from zonelytics.registry.star import model
from zonelytics.sources.adapters import ADAPTERS

D = "(SELECT max(harvest_date) FROM harvest)"
SPAN = "BETWEEN (SELECT lo FROM o_span) AND (SELECT hi FROM o_span)"
ADAPTERS["o_prior_harvest"] = "SELECT * REPLACE (CAST(harvest_date + INTERVAL 12 MONTH AS DATE) AS harvest_date) FROM harvest"
ADAPTERS["o_prior_energy"] = "SELECT * REPLACE (CAST(date + INTERVAL 12 MONTH AS DATE) AS date) FROM o_energy"
ADAPTERS["o_prior_shipments"] = "SELECT * REPLACE (CAST(ship_date + INTERVAL 12 MONTH AS DATE) AS ship_date) FROM o_shipments"
CROP = "concat('Crop ', substr(crop_id, 5))"


def _kpi(h, e, s, where="{c} > " + D + " - 30 AND {c} <= " + D):
    w = lambda c: where.format(c=c)
    return f"""(SELECT (SELECT sum(harvest_weight_kg) FROM {h} WHERE {w('harvest_date')}) AS kg, (SELECT sum(harvest_weight_kg * grade_a_pct) / sum(harvest_weight_kg) FROM {h} WHERE {w('harvest_date')}) AS ga,
      (SELECT sum(energy_cost_usd) FROM {e} WHERE {w('date')}) AS cost, (SELECT count(*) FILTER (on_time_flag) / CAST(count(*) AS DOUBLE) * 100 FROM {s} WHERE {w('ship_date')}) AS ot,
      (SELECT CAST(count(*) AS DOUBLE) FROM anomaly_events) AS n, (SELECT sum(prevented_loss_usd) FROM anomaly_events) AS pl)"""


_NOW, _OLD = _kpi("harvest", "o_energy", "o_shipments"), _kpi("o_prior_harvest", "o_prior_energy", "o_prior_shipments")


@query("rp1_kpi_cards", f"""
  WITH v AS (SELECT unnest(['total_harvest_kg', 'grade_a_pct', 'energy_cost_per_kg', 'on_time_delivery_pct', 'anomaly_count', 'prevented_loss_usd']) AS kpi,
      unnest([a.kg, a.ga, a.cost / a.kg, a.ot, a.n, a.pl]) AS value, unnest([b.kg, b.ga, b.cost / b.kg, b.ot, b.n, b.pl]) AS before FROM {_NOW} a, {_OLD} b),
  y AS (SELECT *, (value - before) / before * 100 AS yoy_pct FROM v)
  SELECT *, CASE kpi WHEN 'total_harvest_kg' THEN CASE WHEN yoy_pct > 0 THEN 'green' WHEN yoy_pct < 0 THEN 'red' END WHEN 'grade_a_pct' THEN CASE WHEN value >= 85 THEN 'green' WHEN value >= 75 THEN 'yellow' ELSE 'red' END
    WHEN 'energy_cost_per_kg' THEN CASE WHEN yoy_pct < 0 THEN 'green' WHEN yoy_pct > 0 THEN 'red' END WHEN 'on_time_delivery_pct' THEN CASE WHEN value >= 95 THEN 'green' WHEN value >= 90 THEN 'yellow' ELSE 'red' END
    WHEN 'anomaly_count' THEN CASE WHEN value <= 3 THEN 'green' WHEN value <= 6 THEN 'yellow' ELSE 'red' END ELSE 'green' END AS colour FROM y""", cols("value before yoy_pct", 4))
def _(t):
    m = model(t)
    return rp.kpi_cards(m, rp.last_days(m, 30))


@query("rp2_sparklines", f"""
  WITH h AS (SELECT harvest_date AS date, sum(harvest_weight_kg) AS kg, sum(harvest_weight_kg * grade_a_pct) / sum(harvest_weight_kg) AS ga FROM harvest GROUP BY 1), e AS (SELECT date, sum(energy_cost_usd) AS cost FROM o_energy GROUP BY 1),
  s AS (SELECT ship_date AS date, count(*) FILTER (on_time_flag) / CAST(count(*) AS DOUBLE) * 100 AS ot FROM o_shipments GROUP BY 1)
  SELECT date, kg AS total_harvest_kg, ga AS grade_a_pct, cost / kg AS energy_cost_per_kg, ot AS on_time_delivery_pct FROM h FULL JOIN e USING (date) FULL JOIN s USING (date) WHERE date > {D} - 90 AND date <= {D}""",
       cols("total_harvest_kg grade_a_pct energy_cost_per_kg on_time_delivery_pct"))
def _(t):
    return rp.sparklines(model(t))


@query("rp3_yield_by_site_crop", f"SELECT concat('Site ', greenhouse_id) AS name, {CROP} AS crop_name, sum(harvest_weight_kg) AS total_harvest_kg FROM harvest GROUP BY 1, 2", cols("total_harvest_kg", 4))
def _(t):
    return rp.yield_by_site_and_crop(model(t))


@query("rp4_monthly_overlay", """
  SELECT CAST(month(harvest_date) AS INT) AS month_num, monthname(harvest_date) AS month_name, sum(harvest_weight_kg) FILTER (year(harvest_date) = 1999) AS y1999, sum(harvest_weight_kg) FILTER (year(harvest_date) = 2000) AS y2000
  FROM harvest GROUP BY 1, 2""", cols("y1999 y2000", 4))
def _(t):
    return rp.monthly_yield_overlay(model(t), [1999, 2000])


@query("rp5_zone_scorecard", """
  SELECT z.greenhouse_id, z.zone_id, z.zone_name, t AS avg_zone_temperature_c, o AS optimal_hours_pct, d AS avg_dli, g AS grade_a_pct FROM dim_zone z
  JOIN (SELECT zone_id, avg(avg_temp) AS t, sum(hours_in_optimal_range) / (count(*) * 24) * 100 AS o, avg(total_dli) AS d FROM env_daily GROUP BY 1) e ON e.zone_id = z.zone_id
  JOIN (SELECT zone_id, sum(harvest_weight_kg * grade_a_pct) / sum(harvest_weight_kg) AS g FROM harvest GROUP BY 1) h ON h.zone_id = z.zone_id""", cols("avg_zone_temperature_c optimal_hours_pct avg_dli grade_a_pct"))
def _(t):
    return rp.zone_scorecard(model(t))


@query("rp6_resource_split", """
  SELECT greenhouse_id, energy_cost_usd, cases_shipped, energy_cost_usd / sum(energy_cost_usd) OVER () AS energy_cost_usd_share, cases_shipped / CAST(sum(cases_shipped) OVER () AS DOUBLE) AS cases_shipped_share
  FROM (SELECT greenhouse_id, sum(energy_cost_usd) AS energy_cost_usd FROM o_energy GROUP BY 1) JOIN (SELECT greenhouse_id, CAST(sum(quantity_cases) AS BIGINT) AS cases_shipped FROM o_shipments GROUP BY 1) USING (greenhouse_id)""",
       {**cols("energy_cost_usd", 3), **cols("energy_cost_usd_share cases_shipped_share")})
def _(t):
    return rp.resource_split(model(t))


@query("rp7_zone_production", """
  SELECT z.greenhouse_id, h.zone_id, CAST(grouping(z.greenhouse_id) + grouping(h.zone_id) AS INT) AS grouping_level, sum(harvest_weight_kg) AS total_harvest_kg,
    sum(harvest_weight_kg) / (CASE WHEN grouping(h.zone_id) = 0 THEN any_value(z.size_sqft) ELSE (SELECT sum(size_sqft) FROM dim_zone) END / 10.764e0) AS yield_per_sqft_kg,
    sum(harvest_weight_kg * grade_a_pct) / sum(harvest_weight_kg) AS grade_a_pct, sum(waste_kg) / (sum(harvest_weight_kg) + sum(waste_kg)) * 100 AS waste_pct, avg(days_to_harvest) AS avg_cycle_length_days, sum(revenue_estimate_usd) AS revenue_usd
  FROM harvest h JOIN dim_zone z ON z.zone_id = h.zone_id GROUP BY ROLLUP (z.greenhouse_id, h.zone_id)""",
       {**cols("total_harvest_kg yield_per_sqft_kg grade_a_pct waste_pct avg_cycle_length_days", 5), "revenue_usd": 2})
def _(t):
    return rp.zone_production(model(t))


_POINTS = """(SELECT h.*, e.avg_dli FROM (SELECT zone_id, CAST(year(harvest_date) AS INT) AS year, CAST(month(harvest_date) AS INT) AS month_num, sum(harvest_weight_kg) AS total_harvest_kg FROM harvest GROUP BY ALL) h
  JOIN (SELECT zone_id, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month_num, avg(total_dli) AS avg_dli FROM env_daily GROUP BY ALL) e USING (zone_id, year, month_num))"""


@query("rp8_light_vs_yield", f"""
  WITH p AS MATERIALIZED (SELECT * FROM {_POINTS}), l AS (SELECT regr_slope(total_harvest_kg, avg_dli) AS slope, regr_intercept(total_harvest_kg, avg_dli) AS intercept, corr(avg_dli, total_harvest_kg) AS correlation FROM p)
  SELECT p.zone_id, z.size_sqft, year, month_num, avg_dli, total_harvest_kg, slope, intercept, correlation, intercept + slope * avg_dli AS fitted_kg FROM p JOIN dim_zone z ON z.zone_id = p.zone_id, l""",
       cols("avg_dli total_harvest_kg slope intercept correlation fitted_kg"))
def _(t):
    return rp.light_vs_yield(model(t))


@query("rp9_month_variance", f"""
  WITH v AS (SELECT {CROP} AS crop_name, coalesce(sum(harvest_weight_kg) FILTER (harvest_date >= date_trunc('month', {D})), 0e0) AS this_month_kg, coalesce(sum(harvest_weight_kg) FILTER (harvest_date < date_trunc('month', {D})), 0e0) AS last_month_kg
    FROM harvest WHERE harvest_date >= date_trunc('month', {D}) - INTERVAL 1 MONTH GROUP BY 1)
  SELECT *, this_month_kg - last_month_kg AS variance_kg FROM (SELECT * FROM v UNION ALL SELECT 'Total', sum(this_month_kg), sum(last_month_kg) FROM v)""", cols("this_month_kg last_month_kg variance_kg", 4))
def _(t):
    return rp.month_variance(model(t))


@query("rp10_daily_yield", f"""
  WITH d AS (SELECT concat('Site ', greenhouse_id) AS name, harvest_date AS date, sum(harvest_weight_kg) AS total_harvest_kg FROM harvest WHERE harvest_date > {D} - 90 GROUP BY 1, 2)
  SELECT *, avg(total_harvest_kg) OVER (PARTITION BY name ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS avg_7d_kg FROM d""", cols("total_harvest_kg avg_7d_kg", 5))
def _(t):
    return rp.daily_yield(model(t))


@query("rp11_grade_distribution", f"""
  SELECT crop_name, a / (a + b + w) * 100 AS grade_a_share, b / (a + b + w) * 100 AS grade_b_share, w / (a + b + w) * 100 AS waste_share FROM
    (SELECT {CROP} AS crop_name, sum(harvest_weight_kg * grade_a_pct / 100) AS a, sum(harvest_weight_kg * grade_b_pct / 100) AS b, sum(waste_kg) AS w FROM harvest GROUP BY 1)""", cols("grade_a_share grade_b_share waste_share"))
def _(t):
    return rp.grade_distribution(model(t))


@query("rp12_sustainability", f"""
  WITH h AS (SELECT CAST(year(harvest_date) AS INT) AS year, sum(harvest_weight_kg) AS kg, sum(waste_kg) AS w FROM harvest GROUP BY 1), p AS (SELECT CAST(year(harvest_date) AS INT) AS year, sum(harvest_weight_kg) AS kg FROM o_prior_harvest WHERE harvest_date {SPAN} GROUP BY 1),
  e AS (SELECT CASE WHEN date {SPAN} THEN CAST(year(date) AS INT) END AS year, sum(energy_cost_usd) AS cost, sum(water_recycled_liters) / sum(water_liters) * 100 AS wr, sum(electricity_kwh) * 0.42e0 + sum(natural_gas_m3) * 1.93e0 AS co2 FROM o_energy GROUP BY 1),
  pe AS (SELECT CAST(year(date) AS INT) AS year, sum(energy_cost_usd) AS cost FROM o_prior_energy WHERE date {SPAN} GROUP BY 1), y AS (SELECT year FROM h UNION SELECT year FROM e),
  v AS (SELECT y.year, e.wr AS water_recycling_rate_pct, (pe.cost / p.kg - coalesce(e.cost / h.kg, 0)) / (pe.cost / p.kg) * 100 AS yoy_energy_efficiency_pct, w / (h.kg + w) * 100 AS waste_pct, co2 / h.kg AS carbon_intensity
    FROM y LEFT JOIN h ON h.year = y.year LEFT JOIN p ON p.year = y.year LEFT JOIN e ON e.year IS NOT DISTINCT FROM y.year LEFT JOIN pe ON pe.year = y.year)
  SELECT *, CASE WHEN water_recycling_rate_pct >= 85 THEN 'green' WHEN water_recycling_rate_pct >= 75 THEN 'yellow' WHEN water_recycling_rate_pct IS NOT NULL THEN 'red' END AS water_colour,
    CASE WHEN yoy_energy_efficiency_pct >= 5 THEN 'green' WHEN yoy_energy_efficiency_pct >= 0 THEN 'yellow' WHEN yoy_energy_efficiency_pct IS NOT NULL THEN 'red' END AS energy_colour,
    CASE WHEN waste_pct <= 5 THEN 'green' WHEN waste_pct <= 8 THEN 'yellow' WHEN waste_pct IS NOT NULL THEN 'red' END AS waste_colour,
    CASE WHEN carbon_intensity <= 0.3e0 THEN 'green' WHEN carbon_intensity <= 0.5e0 THEN 'yellow' WHEN carbon_intensity IS NOT NULL THEN 'red' END AS carbon_colour FROM v""",
       cols("water_recycling_rate_pct yoy_energy_efficiency_pct waste_pct carbon_intensity"))
def _(t):
    return rp.sustainability(model(t), ["dim_date.year"])


@query("rp13_anomaly_timeline", """
  SELECT CAST(date_trunc('month', start_time) AS DATE) AS month, anomaly_type, count(*) AS anomaly_count, avg(response_time_minutes) AS avg_response_time_min FROM anomaly_events GROUP BY ALL""", cols("avg_response_time_min"))
def _(t):
    return rp.anomaly_timeline(model(t))


@query("rp14_energy_vs_yield", f"""
  WITH h AS (SELECT CAST(year(harvest_date) AS INT) AS year, CAST(month(harvest_date) AS INT) AS month_num, sum(harvest_weight_kg) AS kg FROM harvest GROUP BY 1, 2),
  e AS (SELECT CASE WHEN date {SPAN} THEN CAST(year(date) AS INT) END AS year, CASE WHEN date {SPAN} THEN CAST(month(date) AS INT) END AS month_num, sum(energy_cost_usd) AS cost FROM o_energy GROUP BY 1, 2),
  k AS (SELECT year, month_num FROM h UNION SELECT year, month_num FROM e)
  SELECT k.year, k.month_num, cost AS energy_cost_usd, kg AS total_harvest_kg, strftime(make_date(k.year, k.month_num, 1), '%b %Y') AS month_label FROM k
  LEFT JOIN h ON h.year = k.year AND h.month_num = k.month_num LEFT JOIN e ON e.year IS NOT DISTINCT FROM k.year AND e.month_num IS NOT DISTINCT FROM k.month_num""", cols("energy_cost_usd total_harvest_kg", 3))
def _(t):
    return rp.energy_vs_yield(model(t))


@query("rp15_roi_cards", """
  SELECT p AS prevented_loss_usd, r AS avg_response_time_min, d AS days_since_last_anomaly, r < 15 AS response_on_target, CASE WHEN d > 14 THEN 'green' WHEN d > 7 THEN 'yellow' ELSE 'red' END AS days_colour
  FROM (SELECT sum(prevented_loss_usd) AS p, avg(response_time_minutes) AS r, CAST(date_diff('day', CAST(max(start_time) AS DATE), DATE '2024-02-10') AS INT) AS d FROM anomaly_events)""", cols("prevented_loss_usd avg_response_time_min", 3))
def _(t):
    return rp.roi_cards(model(t), "2024-02-10")


_SCORE = """SELECT c.name, count(*) AS shipment_count, count(*) FILTER (on_time_flag) / CAST(count(*) AS DOUBLE) * 100 AS on_time_delivery_pct, count(*) FILTER (cold_chain_compliant) / CAST(count(*) AS DOUBLE) * 100 AS cold_chain_compliance_pct,
    sum(quantity_cases) / CAST(sum(quantity_ordered) AS DOUBLE) * 100 AS fill_rate_pct, avg(shelf_life_remaining_days) AS avg_shelf_life_days FROM o_shipments s JOIN dim_customer c ON c.customer_id = s.customer_id {where} GROUP BY 1"""
_SCORE_FULL = """SELECT *, CASE WHEN on_time_delivery_pct >= 95 THEN 'green' WHEN on_time_delivery_pct >= 90 THEN 'yellow' ELSE 'red' END AS on_time_colour,
    CASE WHEN cold_chain_compliance_pct >= 98 THEN 'green' WHEN cold_chain_compliance_pct >= 95 THEN 'yellow' ELSE 'red' END AS cold_chain_colour, cold_chain_compliance_pct < 98 AS compliance_risk, on_time_delivery_pct < 95 AS service_concern FROM ({s})"""


@query("rp16_customer_scorecard", _SCORE_FULL.format(s=_SCORE.format(where="")), cols("on_time_delivery_pct cold_chain_compliance_pct fill_rate_pct avg_shelf_life_days"))
def _(t):
    return rp.customer_scorecard(model(t))


@query("wn11_rolling_30_day_scorecard", _SCORE_FULL.format(s=_SCORE.format(where=f"WHERE ship_date > {D} - 30 AND ship_date <= {D}")), cols("on_time_delivery_pct cold_chain_compliance_pct fill_rate_pct avg_shelf_life_days"))
def _(t):
    m = model(t)
    return rp.customer_scorecard(m, rp.last_days(m, 30))


@query("rp16_delivery_text", f"""
  SELECT name, concat(CAST(CAST(floor(on_time_delivery_pct + 0.5e0) AS INT) AS VARCHAR), '% on-time — ', CAST(CAST(round(shipment_count * on_time_delivery_pct / 100) AS BIGINT) AS VARCHAR), ' of ', CAST(shipment_count AS VARCHAR)) AS delivery_text
  FROM ({_SCORE.format(where="")})""")
def _(t):
    return rp.delivery_text(rp.customer_scorecard(model(t))).select("name", "delivery_text")


@query("rp17_zone_detail", """
  SELECT coalesce(e.date, h.date) AS date, e.zone_id, avg_temp, total_dli, avg_vpd, temp_excursion_hours, harvests, harvest_kg, waste_kg FROM (SELECT * FROM env_daily WHERE zone_id = 'Z05') e
  FULL JOIN (SELECT harvest_date AS date, count(*) AS harvests, sum(harvest_weight_kg) AS harvest_kg, sum(waste_kg) AS waste_kg FROM harvest WHERE zone_id = 'Z05' GROUP BY 1) h ON h.date = e.date""",
       cols("avg_temp total_dli avg_vpd temp_excursion_hours harvest_kg waste_kg"))
def _(t):
    return rp.zone_detail(model(t), "Z05")


@query("rp17_customer_detail", """
  SELECT ship_date, order_id, product_name, quantity_cases, quantity_ordered, delivery_status, cold_chain_compliant, shelf_life_remaining_days FROM o_shipments s LEFT JOIN dim_product p ON p.product_id = s.product_id WHERE customer_id = '42'""")
def _(t):
    return rp.customer_detail(model(t), "42")


@query("rp18_zone_tooltip", f"""
  SELECT z.*, a.timestamp AS last_alert_at, a.alert_type AS last_alert, health_score < 70 AS needs_attention FROM (
    SELECT l.zone_id, zone_name, crop_name, air_temperature, target_temperature, greatest(0e0, 1e2 - abs(air_temperature - target_temperature) * 5 - abs(air_humidity - target_humidity) - abs(co2_level - target_co2) * 0.02e0
      - abs(substrate_ph - target_ph) * 20 - abs(substrate_ec - target_ec) * 10) AS health_score FROM {LATEST} l JOIN zone_config c ON c.zone_id = l.zone_id) z
  LEFT JOIN (SELECT * FROM alerts QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY timestamp DESC, alert_id DESC) = 1) a ON a.zone_id = z.zone_id""", cols("health_score"))
def _(t):
    status = detect.zone_status_dashboard(views.zone_latest_reading(t.telemetry, TIE), t.zone_config)
    return rp.zone_tooltip(status, t.alerts)


@query("rp18_shipment_tooltip", """
  SELECT order_id, product_sku, c.name AS customer, product_name, ship_date, CASE WHEN cold_chain_temp <= 5 THEN 'OK' ELSE 'WARM' END AS temp_status FROM shipments s
  LEFT JOIN dim_product p ON p.product_id = s.product_sku LEFT JOIN dim_customer c ON c.customer_id = s.customer_id""")
def _(t):
    return rp.shipment_tooltip(t.shipments, t.dim_product, t.dim_customer)


@query("rp19_bookmark_site_focus", f"""
  SELECT harvest_date AS date, sum(harvest_weight_kg) AS total_harvest_kg FROM harvest WHERE greenhouse_id = 'G1' AND harvest_date > {D} - 30 GROUP BY 1""", cols("total_harvest_kg", 4))
def _(t):
    m = model(t)
    return me.evaluate(m, ["total_harvest_kg"], ["dim_date.date"], rp.bookmark(m, "site focus", "G1"))


@query("rp19_bookmarks", " UNION ALL ".join(
    f"SELECT '{name}' AS bookmark, sum(harvest_weight_kg) AS total_harvest_kg, count(DISTINCT harvest_date) AS days FROM harvest WHERE greenhouse_id = 'G1' AND harvest_date > {D} - {days}"
    for name, days in rp.BOOKMARKS.items()), cols("total_harvest_kg", 4))
def _(t):
    """All presets of one site."""
    m, out = model(t), None
    for name in rp.BOOKMARKS:
        days = me.evaluate(m, ["total_harvest_kg"], ["dim_date.date"], rp.bookmark(m, name, "G1"))
        one = days.agg(F.sum("total_harvest_kg").alias("total_harvest_kg"), F.count("date").alias("days")).select(F.lit(name).alias("bookmark"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("flt10_slicers", f"""
  SELECT zone_id, sum(harvest_weight_kg) AS total_harvest_kg FROM harvest WHERE {CROP} IN ('Crop 1', 'Crop 3') AND zone_id IN ('Z01', 'Z03', 'Z09') AND harvest_date > {D} - 365 GROUP BY 1""", cols("total_harvest_kg", 4))
def _(t):
    m = model(t)
    return me.evaluate(m, ["total_harvest_kg"], ["dim_zone.zone_id"], rp.slicers(m, 365, crops=["Crop 1", "Crop 3"], zones=["Z01", "Z03", "Z09"]))


@query("rp20_monthly_change_by_crop", f"""
  SELECT *, lag(total_harvest_kg) OVER w AS last_month_kg, total_harvest_kg - lag(total_harvest_kg) OVER w AS change_kg FROM
    (SELECT {CROP} AS crop_name, CAST(year(harvest_date) AS INT) AS year, CAST(month(harvest_date) AS INT) AS month_num, sum(harvest_weight_kg) AS total_harvest_kg FROM harvest GROUP BY ALL) WINDOW w AS (PARTITION BY crop_name ORDER BY year, month_num)""",
       cols("total_harvest_kg last_month_kg change_kg", 4))
def _(t):
    return rp.monthly_change_by_crop(model(t))


@query("rp21_quality_and_excursions", """
  SELECT date, grade_a_pct, waste_pct, temp_excursion_hours, avg_temp, grade_a_pct < 75 OR waste_pct > 8 AS quality_concern FROM
    (SELECT harvest_date AS date, sum(harvest_weight_kg * grade_a_pct / 1e2) / sum(harvest_weight_kg) * 100 AS grade_a_pct, sum(waste_kg) / (sum(harvest_weight_kg) + sum(waste_kg)) * 100 AS waste_pct FROM harvest WHERE zone_id = 'Z03' GROUP BY 1)
  JOIN (SELECT date, temp_excursion_hours, avg_temp FROM env_daily WHERE zone_id = 'Z03') USING (date)""", cols("grade_a_pct waste_pct temp_excursion_hours avg_temp"))
def _(t):
    return rp.quality_and_excursions(model(t), "Z03")


@query("rp22_top_zones", """
  SELECT zone_id, sum(harvest_weight_kg) / (any_value(size_sqft) / 10.764e0) AS yield_per_sqft_kg FROM harvest JOIN (SELECT zone_id, size_sqft FROM dim_zone) USING (zone_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""", cols("yield_per_sqft_kg"))
def _(t):
    return rp.top_zones(model(t))


@query("rp23_at_risk_shipments", """
  SELECT order_id, product_sku, crop_name, risk FROM (SELECT *, concat_ws(',', CASE WHEN cold_chain_temp > 5 THEN 'temperature' END, CASE WHEN delivery_status = 'delayed' THEN 'late' END,
      CASE WHEN shelf_life_remaining_days < shelf_life_days * 0.5e0 THEN 'shelf_life' END) AS risk
    FROM (SELECT s.*, crop_name, shelf_life_days FROM shipments s LEFT JOIN dim_crop c ON c.crop_id = s.crop_id) WHERE delivery_status IN ('in_transit', 'delayed')) WHERE risk <> ''""")
def _(t):
    return rp.at_risk_shipments(t.shipments, t.dim_crop).select("order_id", "product_sku", "crop_name", "risk")


@query("rp23_at_risk_by_transport_range", """
  SELECT order_id, product_sku, range_name, risk FROM (SELECT *, concat_ws(',', CASE WHEN NOT cold_chain_temp BETWEEN lo AND hi THEN 'temperature' END, CASE WHEN delivery_status = 'delayed' THEN 'late' END,
      CASE WHEN shelf_life_remaining_days < shelf_life_days * 0.5e0 THEN 'shelf_life' END) AS risk
    FROM (SELECT s.*, shelf_life_days FROM shipments s LEFT JOIN dim_crop c ON c.crop_id = s.crop_id) JOIN (VALUES """
       + ", ".join(f"({i}, '{name}', {lo}e0, {hi}e0)" for i, (name, (lo, hi)) in enumerate(fm.TRANSPORT_RANGES.items()))
       + """) r(n, range_name, lo, hi) ON n = CAST(substr(crop_id, 5) AS BIGINT) % """ + str(len(fm.TRANSPORT_RANGES)) + """ WHERE delivery_status IN ('in_transit', 'delayed')) WHERE risk <> ''""")
def _(t):
    """The shipped transport ranges, dealt to the crops of the test data by number."""
    number = {name: i for i, name in enumerate(fm.TRANSPORT_RANGES)}
    ranges = t.spark.createDataFrame([(number[k], k, lo, hi) for k, (lo, hi) in fm.TRANSPORT_RANGES.items()], "n int, range_name string, min_temp_c double, max_temp_c double")
    dealt = t.dim_crop.select("crop_id", (F.substring("crop_id", 5, 9).cast("bigint") % len(number)).alias("n")).join(ranges, "n").drop("n")
    return rp.at_risk_shipments(t.shipments, t.dim_crop, dealt).select("order_id", "product_sku", "range_name", "risk")


@query("rp24_breach_impact", """
  WITH a AS (SELECT alert_id, greenhouse_id, severity, CAST(timestamp - INTERVAL 312 MONTH AS DATE) AS day FROM alerts WHERE alert_type = 'cold-chain-break'),
  s AS (SELECT greenhouse_id, CAST(ship_date AS DATE) AS day, package_type, count(*) AS shipments, CAST(sum(quantity_cases) AS BIGINT) AS cases, count(*) FILTER (NOT cold_chain_compliant) AS warm_shipments
    FROM (SELECT s.*, p.package_type FROM shipments s LEFT JOIN dim_product p ON p.product_id = s.product_sku) GROUP BY ALL)
  SELECT alert_id, a.greenhouse_id, severity, a.day, package_type, shipments, cases, warm_shipments FROM a JOIN s ON s.greenhouse_id = a.greenhouse_id AND s.day = a.day""")
def _(t):
    # the alert log is moved onto the dates of the shipments
    moved = t.alerts.withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 312 MONTH"))
    return rp.breach_impact(moved, t.shipments, t.dim_product)


@query("rp25_late_by_route", """
  SELECT greenhouse_id, region, count(*) AS shipments, count(*) FILTER (delivery_status = 'delayed') AS late, count(*) FILTER (delivery_status = 'delayed') / CAST(count(*) AS DOUBLE) * 100 AS late_pct
  FROM (SELECT s.*, c.region FROM shipments s LEFT JOIN dim_customer c ON c.customer_id = s.customer_id) GROUP BY 1, 2""", cols("late_pct"))
def _(t):
    return rp.late_by_route(t.shipments, t.dim_customer)


@query("rp25_exceptions_by_cause", """
  SELECT cause, count(*) AS exceptions FROM (SELECT CASE WHEN NOT cold_chain_compliant THEN 'cold chain' WHEN delivery_status = 'delayed' THEN 'late' WHEN quantity_cases < quantity_ordered THEN 'short quantity' END AS cause FROM shipments)
  WHERE cause IS NOT NULL GROUP BY 1""")
def _(t):
    return rp.exceptions_by_cause(t.shipments)


@query("rp26_quarterly_fill_rate", """
  SELECT *, lag(fill_rate_pct) OVER (ORDER BY year, quarter) AS previous_pct, fill_rate_pct - lag(fill_rate_pct) OVER (ORDER BY year, quarter) AS change_pct FROM
    (SELECT CAST(year(ship_date) AS INT) AS year, concat('Q', quarter(ship_date)) AS quarter, sum(quantity_cases) / CAST(sum(quantity_ordered) AS DOUBLE) * 100 AS fill_rate_pct FROM o_shipments GROUP BY 1, 2)""",
       cols("fill_rate_pct previous_pct change_pct"))
def _(t):
    return rp.quarterly_fill_rate(model(t))


@query("rp27_energy_week", f"""
  SELECT concat('Site ', n.greenhouse_id) AS name, n.c AS energy_cost_usd, n.k AS electricity_kwh, p.c AS energy_cost_usd_before, p.k AS electricity_kwh_before FROM
    (SELECT greenhouse_id, sum(energy_cost_usd) AS c, sum(electricity_kwh) AS k FROM o_energy WHERE date > DATE '2000-06-15' - 7 AND date <= DATE '2000-06-15' GROUP BY 1) n
  LEFT JOIN (SELECT greenhouse_id, sum(energy_cost_usd) AS c, sum(electricity_kwh) AS k FROM o_prior_energy WHERE date > DATE '2000-06-15' - 7 AND date <= DATE '2000-06-15' GROUP BY 1) p ON p.greenhouse_id = n.greenhouse_id""",
       cols("energy_cost_usd electricity_kwh energy_cost_usd_before electricity_kwh_before", 4))
def _(t):
    return rp.energy_week_vs_last_year(model(t), "2000-06-15")


@query("rp28_highest_vpd", f"SELECT zone_id, vpd, timestamp FROM {LATEST} ORDER BY vpd DESC, zone_id LIMIT 5")
def _(t):
    return rp.highest_vpd(views.zone_latest_reading(t.telemetry, TIE))


@query("wn1_rolling_mean", """
  SELECT date, zone_id, avg(avg_temp) OVER w AS avg_temp_7d_avg, avg(total_dli) OVER w AS total_dli_7d_avg FROM env_daily WINDOW w AS (PARTITION BY zone_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", cols("avg_temp_7d_avg total_dli_7d_avg"))
def _(t):
    return rolling_mean(t.env_daily, ["avg_temp", "total_dli"], ["zone_id"], "date").select("date", "zone_id", "avg_temp_7d_avg", "total_dli_7d_avg")


@query("wn6_change", """
  SELECT date, zone_id, avg_temp, lag(avg_temp) OVER w AS previous_avg_temp, avg_temp - lag(avg_temp) OVER w AS change FROM env_daily WINDOW w AS (PARTITION BY zone_id ORDER BY date)""", cols("change previous_avg_temp avg_temp"))
def _(t):
    return change(t.env_daily, "avg_temp", ["zone_id"], "date").select("date", "zone_id", "avg_temp", "previous_avg_temp", "change")


@query("wn7_share_null_group", """
  SELECT l_orderkey, l_linenumber, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY nullif(l_returnflag, 'R')) AS share FROM lineitem""", cols("share", 9))
def _(t):
    """Rows whose group is NULL are a group."""
    rows = t.lineitem.withColumn("flag", F.nullif("l_returnflag", F.lit("R")))
    return share_of_total(rows, "l_extendedprice", ["flag"]).select("l_orderkey", "l_linenumber", "share")


@query("wn7_share_of_total", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_returnflag) AS share FROM lineitem""", cols("share", 12))
def _(t):
    return share_of_total(t.lineitem, "l_extendedprice", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey", "share")


@query("ag16_summary_statistics", """
  SELECT zone_id, avg(reading) AS mean, stddev_samp(reading) AS std, median(reading) AS median FROM telemetry_sparse GROUP BY 1""", cols("mean std median"))
def _(t):
    rows = t.telemetry_sparse
    moments = rows.groupBy("zone_id").agg(F.avg("reading").alias("mean"), F.stddev_samp("reading").alias("std"))
    return moments.join(exact_quantile(rows, "reading", 0.5, ["zone_id"], "median"), "zone_id")


@query("ag13_distinct_count", "SELECT greenhouse_id, count(DISTINCT zone_id) AS zones, count(DISTINCT channel) AS channels FROM telemetry_sparse GROUP BY 1")
def _(t):
    return t.telemetry_sparse.groupBy("greenhouse_id").agg(F.countDistinct("zone_id").alias("zones"), F.countDistinct("channel").alias("channels"))


@query("ag14_value_counts", "SELECT anomaly_type, count(*) AS count FROM anomaly_events GROUP BY 1")
def _(t):
    return t.anomaly_events.groupBy("anomaly_type").count().orderBy(F.col("count").desc(), "anomaly_type")
