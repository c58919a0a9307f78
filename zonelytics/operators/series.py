"""Regular time series in long form: gap filling, decomposition, FIR filters.

Raw readings are aggregated to bins first (partial aggregation before the
exchange), so a series holds at most span / step rows whatever the reading
rate. Windows by key below run over those bins, never over raw readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonelytics.functions.timebins import binned, seconds, span_col
from zonelytics.operators.joins import join_null_safe
from zonelytics.operators.quantiles import exact_quantiles
from zonelytics.operators.windows import running_total
from zonelytics.session import cut


def make_series(
    df: DataFrame,
    step,
    value: Column,
    name: str,
    by: Sequence[str],
    ts: str = "timestamp",
    fill: float | str | None = 0.0,
) -> DataFrame:
    """Every bin between a key's first and last one; empty bins hold ``fill`` (a number, None or ``"ffill"``)."""
    bins = binned(df, list(by), step, value.alias(name), ts=ts)
    gap = span_col(step)
    nxt = F.lead(ts).over(Window.partitionBy(*by).orderBy(ts))
    spans = bins.withColumn("_until", F.coalesce(nxt - gap, F.col(ts)))
    slots = spans.withColumn("_slot", F.explode(F.sequence(F.col(ts), F.col("_until"), gap)))
    if fill == "ffill":
        filled = F.col(name)
    else:
        filled = F.when(F.col("_slot") == F.col(ts), F.col(name)).otherwise(F.lit(fill).cast("double"))
    return slots.select(*by, F.col("_slot").alias(ts), filled.alias(name))


def decompose_anomalies(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    threshold: float = 1.5,
    period: int | None = None,
    method: str = "sigma",
    ts: str = "timestamp",
    prefix: str = "",
    step=None,
) -> DataFrame:
    """Adds ``anomaly`` (-1, 0, 1), ``score`` and ``baseline`` to a binned series.

    baseline = least-squares line over the bin index + mean of the detrended
    value per phase (``period`` bins); score = residual / its population
    standard deviation, 0 for a flat residual or fewer than 3 bins.
    ``method="tukey"`` measures the distance beyond the quartiles in units of
    the interquartile range instead.

    A series is never gathered: line, phase means and spread are aggregates with
    partial steps (the line from mergeable moments), joined back by key. The bin index is
    (time - first time) / ``step`` for a regular series; without ``step`` the rows are
    numbered, day by day with the counts of the days before. NULL keys are a series. The bins
    are written once, since these steps read them again.
    """
    by = list(by)
    rows = df if by else df.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    if step is None:
        day = F.floor(F.unix_seconds(ts) / 86400)
        rows = running_total(cut(rows.withColumn("_one", F.lit(1.0)), "series"), "_one", keys, [ts], day, "_x").drop("_one")
    else:
        rows = rows.withColumn("_x", F.round(F.unix_micros(ts) / (seconds(step) * 1_000_000)))
    rows = cut(rows, "series")
    y, x = F.col(value), F.col("_x")
    line = rows.groupBy(*keys).agg(
        F.count(value).alias("_n"), F.min("_x").alias("_x0"), F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("_slope"),
        F.avg(value).alias("_y"), F.regr_avgx(y, x).alias("_mid"),
    )
    rows = join_null_safe(rows, line, keys).withColumn("_i", x - F.col("_x0"))
    trend = F.col("_y") + F.col("_slope") * (x - F.col("_mid"))
    if period:
        rows = rows.withColumn("_phase", (F.col("_i") % period).cast("int"))
        season = rows.groupBy(*keys, "_phase").agg(F.avg(y - trend).alias("_season"))
        rows = join_null_safe(rows, season, [*keys, "_phase"]).drop("_phase")
    else:
        rows = rows.withColumn("_season", F.lit(0.0))
    rows = rows.withColumn(f"{prefix}baseline", trend + F.col("_season"))
    rows = rows.withColumn("_res", y - F.col(f"{prefix}baseline"))
    if method == "tukey":
        spread = exact_quantiles(rows, "_res", [0.25, 0.75], keys, ["_q1", "_q3"])
        iqr = F.col("_q3") - F.col("_q1")
        raw = F.when(F.col("_res") > F.col("_q3"), (F.col("_res") - F.col("_q3")) / iqr).when(
            F.col("_res") < F.col("_q1"), (F.col("_res") - F.col("_q1")) / iqr
        ).otherwise(0.0)
        score = F.when((F.col("_n") < 3) | (iqr <= 1e-9), F.lit(0.0)).otherwise(raw)
    else:
        spread = rows.groupBy(*keys).agg(F.stddev_pop("_res").alias("_sd"))
        score = F.when((F.col("_n") < 3) | (F.col("_sd") <= 1e-9), F.lit(0.0)).otherwise(F.col("_res") / F.col("_sd"))
    rows = join_null_safe(rows, spread, keys, "left").withColumn(f"{prefix}score", score)
    flag = F.when(F.abs(F.col(f"{prefix}score")) > threshold, F.signum(f"{prefix}score").cast("int")).otherwise(F.lit(0))
    return rows.withColumn(f"{prefix}anomaly", flag).select(*df.columns, *[f"{prefix}{c}" for c in ("baseline", "score", "anomaly")])


def fir(
    df: DataFrame,
    value: str,
    coefficients: Sequence[float],
    by: Sequence[str],
    ts: str = "timestamp",
    normalize: bool = False,
    name: str = "filtered",
) -> DataFrame:
    """y[i] = sum of c[k] * s[i-k]; samples before the series start count as 0."""
    w = Window.partitionBy(*by).orderBy(ts)
    total = sum(coefficients) if normalize else 1.0
    terms = [F.lit(float(c) / total) * F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) for k, c in enumerate(coefficients)]
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return df.withColumn(name, out)


def slope(df: DataFrame, value: str, by: Sequence[str], ts: str = "timestamp", name: str = "slope") -> DataFrame:
    """Centred two-step slope per bin; NULL until two earlier bins exist."""
    w = Window.partitionBy(*by).orderBy(ts)
    return df.withColumn(name, (F.col(value) - F.lag(value, 2).over(w)) / 2.0)


def mv_expand(df: DataFrame, columns: dict[str, str], index: str | None = None) -> DataFrame:
    """Explode parallel arrays together, casting each item to the given type."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    rest = [c for c in df.columns if c not in columns]
    out = df.select(*rest, F.posexplode(zipped).alias("_pos", "_item"))
    items = [F.col("_item")[c].cast(t).alias(c) for c, t in columns.items()]
    return out.select(*rest, *([F.col("_pos").alias(index)] if index else []), *items)


def to_arrays(df: DataFrame, values: Sequence[str], by: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Binned series as one row of parallel arrays in time order (an edge format only)."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(ts), *[F.col(v) for v in values])))
    out = df.groupBy(*by).agg(packed.alias("_s")) if by else df.agg(packed.alias("_s"))
    return out.select(*by, *[F.col("_s").getField(c).alias(c) for c in (ts, *values)])
