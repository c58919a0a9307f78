"""Domain formulas as pure ``Column`` functions (no UDFs, so all stay in generated code)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: physical ranges of a plausible reading -------------------
VALID_RANGES = {
    "air_temperature": (-10.0, 50.0),
    "air_humidity": (0.0, 100.0),
    "co2_level": (100.0, 5000.0),
    "substrate_ph": (3.0, 9.0),
}
# --- fixed values: measuring ranges of the sensors --------------------------
SENSOR_RANGES = {
    "air_temperature": (5.0, 40.0),
    "air_humidity": (20.0, 100.0),
    "co2_level": (300.0, 2500.0),
    "par_light": (0.0, 1200.0),
    "substrate_temperature": (10.0, 30.0),
    "substrate_moisture": (20.0, 95.0),
    "substrate_ec": (0.5, 5.0),
    "substrate_ph": (4.0, 8.5),
    "water_flow_rate": (0.0, 60.0),
    "vpd": (0.0, 3.0),
}
# --- fixed values: tariffs and emission factors -----------------------------
ELECTRICITY_USD_PER_KWH = 0.12
GAS_USD_PER_M3 = 0.45
CO2E_PER_KWH = 0.42
CO2E_PER_M3 = 1.93
SQFT_PER_M2 = 10.764
# --- fixed values: reading channel, set-point column, prefix ----------------
CHANNELS = [
    ("air_temperature", "target_temperature", "temp"),
    ("air_humidity", "target_humidity", "humidity"),
    ("co2_level", "target_co2", "co2"),
    ("substrate_ph", "target_ph", "ph"),
    ("substrate_ec", "target_ec", "ec"),
]
# --- fixed values: points lost per unit of deviation ------------------------
PENALTY_TOTAL = {"temp": 5.0, "humidity": 1.0, "co2": 0.02, "ph": 20.0, "ec": 10.0}
PENALTY_CHANNEL = {"temp": 20.0, "humidity": 5.0, "co2": 0.2, "ph": 100.0, "ec": 50.0}
# --- fixed values: transport temperature range in degrees C by crop name ----
TRANSPORT_RANGES = {
    "Baby Spinach": (1.0, 4.0),
    "Romaine Lettuce": (1.0, 4.0),
    "Arugula": (1.0, 4.0),
    "Basil": (10.0, 15.0),
    "Cocktail Tomato": (10.0, 13.0),
    "Bell Pepper": (7.0, 10.0),
    "Mini Cucumber": (10.0, 12.0),
    "Strawberry": (0.0, 4.0),
}
COLD_CHAIN_MAX_C = 5.0


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid_reading() -> Column:
    """All checked channels inside their physical range; NULL fails."""
    checks = [F.col(c).between(lo, hi) for c, (lo, hi) in VALID_RANGES.items()]
    out = checks[0]
    for check in checks[1:]:
        out = out & check
    return out


def clamp(x: str | Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def clamp_sensors(columns: Sequence[str]) -> dict[str, Column]:
    return {c: clamp(c, *SENSOR_RANGES[c]) for c in columns if c in SENSOR_RANGES}


def vpd_kpa(temp: str | Column, humidity: str | Column) -> Column:
    t, rh = _c(temp), _c(humidity)
    saturation = F.lit(0.6108) * F.exp(F.lit(17.27) * t / (t + F.lit(237.3)))
    return saturation * (F.lit(1.0) - rh / F.lit(100.0))


def heat_index(temp: str | Column, humidity: str | Column) -> Column:
    t, h = _c(temp), _c(humidity)
    hot = F.lit(1.611) * t + F.lit(2.339) * h - F.lit(0.146) * t * h - F.lit(8.785)
    return F.when(t > 27, hot).otherwise(t)


def wind_chill(temp: str | Column, wind: str | Column) -> Column:
    t = _c(temp)
    v = F.pow(_c(wind), F.lit(0.16))
    cold = F.lit(13.12) + F.lit(0.6215) * t - F.lit(11.37) * v + F.lit(0.3965) * t * v
    return F.when(t < 10, cold).otherwise(t)


def recycling_pct(used: str | Column, recycled: str | Column) -> Column:
    return F.when(_c(used) > 0, _c(recycled) / _c(used) * 100).otherwise(F.lit(0.0))


def deviations(signed: bool = True) -> dict[str, Column]:
    """Distance of each controlled channel from its set-point."""
    out = {}
    for value, target, prefix in CHANNELS:
        d = F.col(value) - F.col(target)
        out[f"{prefix}_deviation"] = d if signed else F.abs(d)
    return out


def health_from_deviations() -> Column:
    """0-100 score: one common budget reduced by every absolute deviation."""
    score = F.lit(100.0)
    for prefix, points in PENALTY_TOTAL.items():
        score = score - F.abs(F.col(f"{prefix}_deviation")) * F.lit(points)
    return F.greatest(F.lit(0.0), score)


def channel_score(value: str | Column, target: str | Column, prefix: str) -> Column:
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.abs(_c(value) - _c(target)) * F.lit(PENALTY_CHANNEL[prefix]))


def health_status(score: str | Column) -> Column:
    return F.when(_c(score) >= 85, "Healthy").when(_c(score) >= 60, "Warning").otherwise("Critical")


def excursion_hours(avg_temp: str | Column, target: str | Column) -> Column:
    off = F.abs(_c(avg_temp) - _c(target))
    return F.when(off > 2.0, off * 2.0).otherwise(F.lit(0.0))


def dli(par: str | Column, interval_seconds: int = 30) -> Column:
    """Aggregate: daily light integral of instantaneous PAR."""
    return F.sum(par) * F.lit(interval_seconds) / F.lit(1e6)


def energy_cost(kwh: str | Column, gas: str | Column) -> Column:
    return _c(kwh) * F.lit(ELECTRICITY_USD_PER_KWH) + _c(gas) * F.lit(GAS_USD_PER_M3)


def cost_per_kg(cost: str | Column, kg: str | Column) -> Column:
    return F.when(_c(kg) > 0, _c(cost) / _c(kg)).otherwise(F.lit(0.0))


def carbon(kwh: str | Column, gas: str | Column) -> Column:
    return _c(kwh) * F.lit(CO2E_PER_KWH) + _c(gas) * F.lit(CO2E_PER_M3)


def on_time(status: str | Column) -> Column:
    return _c(status) == F.lit("delivered")


def climate_grade(avg_temp: str | Column) -> Column:
    off = F.abs(_c(avg_temp) - F.lit(21.0))
    return F.when(off < 2, "A").when(off < 4, "B").otherwise("C")


def unit_hash(*keys: str | Column) -> Column:
    """Repeatable stand-in for a random number in [0, 1): the first 32 bits of an MD5."""
    text = F.concat_ws("|", *[_c(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def vpd_status(vpd: str | Column, low: str, ok: str, high: str, lo: float = 0.8, hi: float = 1.2) -> Column:
    return F.when(_c(vpd) < lo, low).when(_c(vpd) > hi, high).otherwise(ok)


def temperature_band(deviation: str | Column, labels: Sequence[str] = ("On Target", "Warning", "Critical")) -> Column:
    off = F.abs(_c(deviation))
    return F.when(off <= 1, labels[0]).when(off <= 3, labels[1]).otherwise(labels[2])


def co2_band(value: str | Column, target: str | Column) -> Column:
    v, t = _c(value), _c(target)
    return F.when(F.abs(v - t) <= 50, "On Target").when(v < t, "Below Target").otherwise("Above Target")


def irrigation_status(pump: str | Column, flow: str | Column, labels: Sequence[str] = ("Flowing", "Pump ON / No Flow", "Off")) -> Column:
    return (
        F.when(_c(pump) & (_c(flow) > 0), labels[0])
        .when(_c(pump) & (_c(flow) == 0), labels[1])
        .otherwise(labels[2])
    )


def kpi_colour(value: str | Column, good: float, fair: float, higher_is_better: bool = True) -> Column:
    v = _c(value)
    if higher_is_better:
        return F.when(v.isNull(), None).when(v >= good, "green").when(v >= fair, "yellow").otherwise("red")
    return F.when(v.isNull(), None).when(v <= good, "green").when(v <= fair, "yellow").otherwise("red")


def is_night(hour: str | Column) -> Column:
    return (_c(hour) < 6) | (_c(hour) >= 22)


def quality_concern(grade_a_pct: str | Column, waste_pct: str | Column) -> Column:
    return (_c(grade_a_pct) < 75) | (_c(waste_pct) > 8)


def compliance_risk(cold_chain_pct: str | Column) -> Column:
    return _c(cold_chain_pct) < 98


def service_concern(on_time_pct: str | Column) -> Column:
    return _c(on_time_pct) < 95


def needs_attention(health_score: str | Column) -> Column:
    return _c(health_score) < 70


def low_shelf_life(remaining: str | Column, shelf_life: str | Column, crop: str | Column) -> Column:
    short = _c(remaining) < _c(shelf_life) * F.lit(0.5)
    return short | ((_c(crop) == "Strawberry") & (_c(remaining) <= 2))


def transport_fit(temp: str | Column, lo: str | Column, hi: str | Column) -> Column:
    return _c(temp).between(_c(lo), _c(hi))


def cold_chain_ok(temp: str | Column) -> Column:
    return _c(temp) <= COLD_CHAIN_MAX_C


def fill_template(template: str, columns: Sequence[str]) -> Column:
    """Replace every ``{{name}}`` mark by that column's text (empty when NULL)."""
    import re

    parts: list[Column] = []
    for piece in re.split(r"(\{\{\w+\}\})", template):
        name = piece[2:-2] if piece.startswith("{{") else None
        if name in columns:
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """Division that yields NULL on a zero or missing denominator."""
    out = F.try_divide(numerator, denominator)
    return out * F.lit(scale) if scale != 1.0 else out
