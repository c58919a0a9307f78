"""Semantic layer: relationships, 30 measures and one evaluator.

A query is a list of measures plus grouping attributes (``dim.column``, or a
bare column for an attribute the facts carry themselves) and filters. Each fact
is aggregated on its own at the requested grain and the small results are then
brought together, so facts are never joined row to row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelytics.functions import formulas as fm
from zonelytics.functions.timebins import AsOf

# --- fixed values: many-to-one links, fact column -> dimension key ----------------
RELATIONSHIPS: dict[str, dict[str, tuple[str, str]]] = {
    "fact_daily_harvest": {
        "dim_date": ("harvest_date", "date_key"), "dim_zone": ("zone_id", "zone_id"),
        "dim_greenhouse": ("greenhouse_id", "greenhouse_id"), "dim_crop": ("crop_id", "crop_id"),
    },
    "fact_zone_daily_environment": {"dim_date": ("date", "date_key"), "dim_zone": ("zone_id", "zone_id")},
    "fact_daily_energy": {"dim_date": ("date", "date_key"), "dim_greenhouse": ("greenhouse_id", "greenhouse_id")},
    "fact_shipments": {
        "dim_date": ("ship_date", "date_key"), "dim_customer": ("customer_id", "customer_id"), "dim_product": ("product_id", "product_id"),
    },
    "fact_weekly_crop_health": {"dim_date": ("week_start", "date_key"), "dim_zone": ("zone_id", "zone_id")},
    "fact_anomaly_events": {"dim_greenhouse": ("greenhouse_id", "greenhouse_id")},
}
HIERARCHIES = {
    "date": ["dim_date.year", "dim_date.quarter", "dim_date.month_name", "dim_date.date"],
    "geography": ["dim_greenhouse.country", "dim_greenhouse.location_state", "dim_greenhouse.location_city"],
}
SORT_BY = {"month_name": "month_num", "day_name": "day_of_week"}

# --- fixed values: default aggregate per column, where it is not the sum ------------
_AVERAGED = (
    "grade_a_pct grade_b_pct grade_c_pct waste_pct days_to_harvest avg_temp avg_humidity avg_co2 total_dli avg_vpd avg_ec avg_ph "
    "hours_in_optimal_range energy_per_kg_produce shelf_life_remaining_days avg_plant_height_cm avg_leaf_count response_time_minutes "
    "growth_cycle_days optimal_temp_c optimal_humidity_pct market_price_per_kg_usd shelf_life_days package_weight_kg"
).split()
DEFAULT_AGGREGATE: dict[str, str] = {**dict.fromkeys(_AVERAGED, "avg"), "min_temp": "min", "max_temp": "max"}

HARVEST, ENV, ENERGY, SHIP, ANOMALY = (
    "fact_daily_harvest", "fact_zone_daily_environment", "fact_daily_energy", "fact_shipments", "fact_anomaly_events",
)


def with_single_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Adds the columns of a one-row frame through a single scalar sub-query."""
    whole = one.select(F.struct(*one.columns).alias("_one")).scalar()
    return df.withColumn("_one", whole).withColumns({c: F.col("_one")[c] for c in one.columns}).drop("_one")


@dataclass(frozen=True)
class Base:
    """One aggregate over one fact; ``prior`` reads the fact one year earlier (1: where the calendar has the later date, 2: in any case).

    Every kind splits into a partial and a final step, so that a fact can be
    reduced to its foreign keys before it meets a dimension.
    """

    name: str
    fact: str
    kind: str  # sum, avg, count, count_if or max
    expr: Callable[[], Column] = lambda: F.lit(1)
    prior: int = 0

    def partial(self) -> list[Column]:
        e = self.expr()
        if self.kind == "avg":
            return [F.sum(e).alias(f"{self.name}#s"), F.count(e).alias(f"{self.name}#n")]
        made = {"sum": F.sum, "count": F.count, "count_if": F.count_if, "max": F.max}[self.kind](e)
        return [made.alias(f"{self.name}#s")]

    def final(self, shifted: bool = False) -> Column:
        """``shifted``: rows of both years are there, marked by ``_shift``; a count without any row of its own year is NULL."""
        part = F.col(f"`{self.name}#s`")
        if self.kind in ("count", "count_if") and shifted:
            return F.sum(part).cast("bigint").alias(self.name)
        if self.kind == "avg":
            return F.try_divide(F.sum(part).cast("double"), F.sum(F.col(f"`{self.name}#n`"))).alias(self.name)
        if self.kind in ("count", "count_if"):
            return F.coalesce(F.sum(part), F.lit(0)).cast("bigint").alias(self.name)
        return (F.max(part) if self.kind == "max" else F.sum(part)).alias(self.name)


@dataclass(frozen=True)
class Measure:
    key: str
    title: str
    bases: tuple[Base, ...]
    combine: Callable[[], Column]
    fmt: str = "#,##0.0"


def _sum(fact: str, column: str, prior: int = 0) -> Base:
    return Base(f"_{'p' if prior else 's'}_{column}", fact, "sum", lambda: F.col(column).cast("double"), prior)


def _count(fact: str) -> Base:
    return Base(f"_n_{fact}", fact, "count")


def _count_if(fact: str, column: str) -> Base:
    return Base(f"_k_{column}", fact, "count_if", lambda: F.coalesce(F.col(column), F.lit(False)))


def _avg(fact: str, column: str) -> Base:
    return Base(f"_a_{column}", fact, "avg", lambda: F.col(column))


def _plain(key: str, title: str, base: Base, fmt: str = "#,##0.0", cast: str | None = None) -> Measure:
    return Measure(key, title, (base,), lambda: F.col(base.name).cast(cast) if cast else F.col(base.name), fmt)


def _ratio(key: str, title: str, top: Base, bottom: Base, scale: float = 100.0, fmt: str = '#,##0.0"%"') -> Measure:
    return Measure(key, title, (top, bottom), lambda: fm.ratio(F.col(top.name), F.col(bottom.name), scale), fmt)


_KG, _COST = _sum(HARVEST, "harvest_weight_kg"), _sum(ENERGY, "energy_cost_usd")
_KG_P, _COST_P = _sum(HARVEST, "harvest_weight_kg", 1), _sum(ENERGY, "energy_cost_usd", 1)
_KWH, _GAS = _sum(ENERGY, "electricity_kwh"), _sum(ENERGY, "natural_gas_m3")
_WATER, _RECYCLED, _WASTE = _sum(ENERGY, "water_liters"), _sum(ENERGY, "water_recycled_liters"), _sum(HARVEST, "waste_kg")
_CASES, _ORDERED, _SHIPMENTS = _sum(SHIP, "quantity_cases"), _sum(SHIP, "quantity_ordered"), _count(SHIP)
_GRADE_A = Base("_grade_a_kg", HARVEST, "sum", lambda: F.col("harvest_weight_kg") * F.col("grade_a_pct") / 100)
_SQFT = Base("_sqft", "dim_zone", "sum", lambda: F.col("size_sqft").cast("double"))
_LAST = Base("_last_anomaly", ANOMALY, "max", lambda: F.col("start_time"))
_HOURS, _ENV_ROWS = _sum(ENV, "hours_in_optimal_range"), _count(ENV)


def _c(b: Base) -> Column:
    return F.col(b.name)


def _growth(now: Column, before: Column) -> Column:
    """Nothing this year counts as 0, so a group of the year before only has lost all."""
    return fm.ratio(F.coalesce(now, F.lit(0.0)) - before, before, 100.0)


_CPK, _CPK_P = lambda: fm.ratio(_c(_COST), _c(_KG)), lambda: fm.ratio(_c(_COST_P), _c(_KG_P))
USD, INT = r"\$#,##0.00", "#,##0"

MEASURES: dict[str, Measure] = {
    m.key: m
    for m in [
        _plain("total_harvest_kg", "Total Harvest (kg)", _KG),
        Measure("yield_per_sqft_kg", "Yield per SqFt (kg)", (_KG, _SQFT), lambda: fm.ratio(_c(_KG), _c(_SQFT) / fm.SQFT_PER_M2), "#,##0.00"),
        _ratio("grade_a_pct", "Grade A %", _GRADE_A, _KG),
        Measure("yoy_yield_growth_pct", "YoY Yield Growth %", (_KG, _KG_P), lambda: _growth(_c(_KG), _c(_KG_P)), '#,##0.0"%"'),
        _plain("revenue_usd", "Revenue (USD)", _sum(HARVEST, "revenue_estimate_usd"), USD),
        Measure("waste_pct", "Waste %", (_WASTE, _KG), lambda: fm.ratio(_c(_WASTE), _c(_KG) + _c(_WASTE), 100.0), '#,##0.0"%"'),
        _plain("total_units_harvested", "Total Units Harvested", _sum(HARVEST, "harvest_units"), INT, "bigint"),
        _plain("avg_cycle_length_days", "Avg Cycle Length (days)", _avg(HARVEST, "days_to_harvest")),
        _plain("energy_cost_usd", "Energy Cost (USD)", _COST, USD),
        Measure("energy_cost_per_kg", "Energy Cost per Kg", (_COST, _KG), lambda: _CPK(), USD),
        Measure("yoy_energy_efficiency_pct", "YoY Energy Efficiency %", (_COST, _KG, _COST_P, _KG_P),
                lambda: fm.ratio(_CPK_P() - F.coalesce(_CPK(), F.lit(0.0)), _CPK_P(), 100.0), '#,##0.0"%"'),
        _ratio("water_recycling_rate_pct", "Water Recycling Rate %", _RECYCLED, _WATER),
        Measure("carbon_footprint_kg", "Carbon Footprint (kg CO2e)", (_KWH, _GAS), lambda: fm.carbon(_c(_KWH), _c(_GAS))),
        _plain("gas_usage_m3", "Gas Usage (m³)", _GAS),
        _plain("electricity_kwh", "Electricity (kWh)", _KWH),
        _plain("water_usage_l", "Water Usage (L)", _WATER),
        _ratio("on_time_delivery_pct", "On-Time Delivery %", _count_if(SHIP, "on_time_flag"), _SHIPMENTS),
        _ratio("cold_chain_compliance_pct", "Cold Chain Compliance %", _count_if(SHIP, "cold_chain_compliant"), _SHIPMENTS),
        _plain("avg_shelf_life_days", "Avg Shelf Life (days)", _avg(SHIP, "shelf_life_remaining_days")),
        _plain("cases_shipped", "Cases Shipped", _CASES, INT, "bigint"),
        _plain("shipment_count", "Shipment Count", _SHIPMENTS, INT),
        _ratio("fill_rate_pct", "Fill Rate %", _CASES, _ORDERED),
        _plain("prevented_loss_usd", "Prevented Loss (USD)", _sum(ANOMALY, "prevented_loss_usd"), USD),
        _plain("avg_response_time_min", "Avg Response Time (min)", _avg(ANOMALY, "response_time_minutes")),
        _plain("anomaly_count", "Anomaly Count", _count(ANOMALY), INT),
        Measure("days_since_last_anomaly", "Days Since Last Anomaly", (_LAST,), lambda: F.datediff(F.col("_as_of"), _c(_LAST)), INT),
        _plain("avg_zone_temperature_c", "Avg Zone Temperature (°C)", _avg(ENV, "avg_temp")),
        Measure("optimal_hours_pct", "Optimal Hours %", (_HOURS, _ENV_ROWS), lambda: fm.ratio(_c(_HOURS), _c(_ENV_ROWS) * 24, 100.0), '#,##0.0"%"'),
        _plain("avg_dli", "Avg DLI (mol/m²/day)", _avg(ENV, "total_dli")),
        _plain("temp_excursion_hours", "Temp Excursion Hours", _sum(ENV, "temp_excursion_hours")),
        # used by reports; both parts are measures of their own
        Measure("carbon_intensity", "Carbon Intensity (kg CO2e/kg)", (_KWH, _GAS, _KG),
                lambda: fm.ratio(fm.carbon(_c(_KWH), _c(_GAS)), _c(_KG)), "0.00"),
    ]
}


class Frames(dict):
    """Tables by name; a callable value is planned when its table is first used."""

    def __getitem__(self, name: str) -> DataFrame:
        value = super().__getitem__(name)
        if not isinstance(value, DataFrame):
            value = value()
            self[name] = value
        return value


@dataclass
class Model:
    facts: dict[str, DataFrame]
    dims: dict[str, DataFrame]
    relationships: dict[str, dict[str, tuple[str, str]]] = field(default_factory=lambda: RELATIONSHIPS)

    def __post_init__(self) -> None:
        self.facts, self.dims = Frames(self.facts), Frames(self.dims)

    def table(self, name: str) -> DataFrame:
        return self.facts[name] if name in self.facts else self.dims[name]


def _attribute(model: Model, fact: str, attr: str) -> tuple[str, str] | None:
    """(dimension or "", column) of an attribute as seen from a fact; None when not related."""
    if "." not in attr:
        return ("", attr) if attr in model.table(fact).columns else None
    dim, column = attr.split(".")
    if fact == dim:
        return ("", column)
    return (dim, column) if dim in model.relationships.get(fact, {}) else None


def out_name(attr: str) -> str:
    return attr.split(".")[-1]


def _starred(model: Model, fact: str, attrs: Sequence[str], members: Sequence[Base]) -> tuple[DataFrame, bool]:
    """Partial aggregates of a fact with the wanted attributes as ``@name`` columns, from one scan; and whether years are marked.

    The fact is first reduced to one row per combination of the foreign keys in
    use. A hot customer or product therefore reaches the dimension join as a
    few rows, whether that join is broadcast or sorted. Orphan keys keep NULL
    attributes. Where measures of the year before take part, each reduced row then stands for its own
    date and, a year later, for those measures: ``_shift`` is 0, 1 or 2 as ``Base.prior``, and the partials
    of the others are NULL in it.
    """
    df = model.table(fact)
    links = model.relationships.get(fact, {})
    wanted: dict[str, set[str]] = {}
    keys: dict[str, Column] = {}
    for attr in attrs:
        found = _attribute(model, fact, attr)
        if found and found[0]:
            wanted.setdefault(found[0], set()).add(found[1])
            keys[f"_fk_{found[0]}"] = F.col(links[found[0]][0])
        elif found:
            keys[f"@{out_name(attr)}"] = F.col(found[1])
    kinds = sorted({b.prior for b in members})
    shifted = "dim_date" in links and kinds != [0]
    if shifted:
        keys["_fk_dim_date"] = F.col(links["dim_date"][0])
        wanted.setdefault("dim_date", set())
    partials = [p for b in members for p in b.partial()]
    df = df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*partials)
    if shifted:
        df = df.withColumn("_shift", F.explode(F.array(*map(F.lit, kinds))))
        own = {c: F.when(F.col("_shift") == b.prior, F.col(f"`{c}`")) for b in members for c in (f"{b.name}#s", f"{b.name}#n") if c in df.columns}
        later = F.when(F.col("_shift") > 0, F.add_months("_fk_dim_date", 12)).otherwise(F.col("_fk_dim_date"))
        df = df.withColumns({**own, "_fk_dim_date": later})
    for dim, columns in wanted.items():
        side = model.dims[dim].select(F.col(links[dim][1]).alias(f"_fk_{dim}"), *[F.col(c).alias(f"@{c}") for c in sorted(columns)])
        if shifted and dim == "dim_date":  # a shifted row counts only where the calendar has the later date
            df = df.join(side.withColumn("_known", F.lit(True)), f"_fk_{dim}", "left").filter("_shift <> 1 or _known").drop("_known")
        else:
            df = df.join(side, f"_fk_{dim}", "left")
    return df, shifted


def evaluate(
    model: Model,
    measures: Sequence[str],
    by: Sequence[str] = (),
    filters: dict[str, Callable[[Column], Column]] | None = None,
    rollup: bool = False,
    as_of: AsOf = None,
    before: bool = False,
) -> DataFrame:
    """Measures by attributes. A fact ignores keys and filters it has no relationship to.

    Every fact is read once, for all measures and both years. ``before`` adds each measure's
    value a year earlier as ``<measure>_before``: dated facts moved one year on, others as they are.

    ``filters`` maps an attribute to a predicate over its column. With
    ``rollup`` every prefix of ``by`` is also aggregated; ``grouping_level``
    tells how many trailing keys are rolled up.
    """
    filters = filters or {}
    keys = [out_name(a) for a in by]
    picked = [MEASURES[m] for m in measures]
    bases = {b.name: b for m in picked for b in m.bases}
    earlier = {n: replace(b, name=f"{n}~", prior=2) for n, b in bases.items() if before}
    if before and any(b.prior for b in bases.values()):
        raise ValueError("a measure of the year before has no year before")
    groups: dict[str, list[Base]] = {}
    for b in (*bases.values(), *earlier.values()):
        groups.setdefault(b.fact, []).append(b)

    parts: list[tuple[list[str], DataFrame]] = []
    for fact, members in groups.items():
        by_fact, only = list(by), dict(filters)
        if fact == "dim_zone":  # floor area follows the zone id alone, whatever else is selected
            by_fact = [a for a in by if a == "dim_zone.zone_id"]
            only = {a: p for a, p in filters.items() if a == "dim_zone.zone_id"}
        related = [a for a in by_fact if _attribute(model, fact, a)]
        only = {a: p for a, p in only.items() if _attribute(model, fact, a)}
        df, shifted = _starred(model, fact, [*related, *only], members)
        for attr, predicate in only.items():
            df = df.filter(predicate(F.col(f"@{out_name(attr)}")))
        own = [out_name(a) for a in related]
        cols = [F.col(f"@{k}").alias(k) for k in own]
        aggs = [b.final(shifted and bool(cols)) for b in members]
        now = F.max((F.col("_shift") == 0).cast("int")) if shifted and (own or rollup) else F.max(F.lit(0 if all(b.prior for b in members) or fact == "dim_zone" else 1))
        aggs.append(now.alias("_current"))
        if rollup and own == keys:
            level = sum((F.grouping(F.col(f"@{k}")).cast("int") for k in own), F.lit(0))
            part = df.rollup(*[F.col(f"@{k}") for k in own]).agg(*aggs, level.alias("grouping_level"))
            part = part.withColumnsRenamed({f"@{k}": k for k in own})
            own = [*own, "grouping_level"]
        elif cols:
            part = df.groupBy(*cols).agg(*aggs)
        else:
            part = df.agg(*aggs)
        if not cols:
            part = part.withColumn("_current", F.lit(0 if all(b.prior for b in members) or fact == "dim_zone" else 1))
        parts.append((own, part))

    full = [*keys, "grouping_level"] if rollup else keys
    complete = [p for own, p in parts if own == full]
    if not complete:
        raise ValueError("no measure relates to all grouping attributes")
    merged = complete[0]
    if len(complete) > 1:
        for p in complete[1:]:
            merged = merged.unionByName(p, allowMissingColumns=True)
        names = [c for c in merged.columns if c not in full]
        merged = merged.groupBy(*full).agg(*[F.max(c).alias(c) for c in names]) if full else merged.agg(*[F.max(c).alias(c) for c in names])
    for own, part in parts:
        if own == full:
            continue
        part = part.drop("_current")
        if own:
            same = [merged[k].eqNullSafe(part[k]) for k in own]
            merged = merged.join(part, same, "left").drop(*[part[k] for k in own])
            if rollup and _SQFT.name in part.columns:  # a subtotal has no zone filter: the whole area counts
                area = model.dims["dim_zone"].agg(F.sum("size_sqft").cast("double").alias("a")).scalar()
                merged = merged.withColumn(_SQFT.name, F.coalesce(_SQFT.name, area))
        else:  # one row: a scalar sub-query per column instead of a cross join
            merged = with_single_row(merged, part)
    if any(m.key == "days_since_last_anomaly" for m in picked):
        newest = model.facts[ANOMALY].agg(F.max("start_time").alias("t")).scalar()
        merged = merged.withColumn("_as_of", newest if as_of is None else (as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")))
    out = merged.select("*", *[m.combine().alias(m.key) for m in picked])
    if before:  # the same formulas over the values of the year before
        out = out.withColumns({n: F.col(f"`{b.name}`") for n, b in earlier.items()}).withColumns({f"{m.key}_before": m.combine() for m in picked})
    out = out.select(*full, "_current", *[m.key for m in picked], *[f"{m.key}_before" for m in picked if before])
    # a group that only the year before has stays if one of the measures has a value there
    values = [f"{m.key}_before" for m in picked] if before else [m.key for m in picked if any(b.prior for b in m.bases)]
    some = F.coalesce(*[F.when(F.col(v).isNotNull(), True) for v in values], F.lit(False))
    return out.filter((F.col("_current") == 1) | some).drop("_current")


def auto(model: Model, fact: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Columns summarised by their declared default aggregate (sum unless stated otherwise)."""
    aggs = [getattr(F, DEFAULT_AGGREGATE.get(c, "sum"))(c).alias(c) for c in columns]
    if not by:
        return model.table(fact).agg(*aggs)
    kinds = {c: DEFAULT_AGGREGATE.get(c, "sum") for c in columns}
    least = [c for c in columns if kinds[c] == "min"]  # as the largest of the negatives
    members = [Base(c, fact, "max" if c in least else kinds[c], lambda c=c: -F.col(c) if c in least else F.col(c)) for c in columns]
    keys = [F.col(f"@{out_name(a)}").alias(out_name(a)) for a in by]
    out = _starred(model, fact, by, members)[0].groupBy(*keys).agg(*[b.final() for b in members])
    return out.withColumns({c: -F.col(c) for c in least})


def formatted(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Display text of measures by their format strings."""
    out = df
    for key in measures:
        fmt = MEASURES[key].fmt
        places = len(fmt.split(".")[1].rstrip('"%')) if "." in fmt else 0
        text = F.format_number(F.col(key).cast("double"), places)
        if fmt.startswith("\\$"):
            text = F.concat(F.lit("$"), text)
        if fmt.endswith('"%"'):
            text = F.concat(text, F.lit("%"))
        out = out.withColumn(f"{key}_text", text)
    return out


def hierarchy(model: Model, measures: Sequence[str], name: str, filters=None) -> DataFrame:
    """Rollup along a declared hierarchy."""
    return evaluate(model, measures, HIERARCHIES[name], filters, rollup=True)
