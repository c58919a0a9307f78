"""Time windows, relative-time filters and calendar expressions."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AsOf = datetime | str | Column | None


def seconds(span: timedelta | int | float) -> int:
    return int(span.total_seconds()) if isinstance(span, timedelta) else int(span)


def span_col(span: timedelta | int) -> Column:
    """A day-time interval literal."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds(span)))


def _by_day(df: DataFrame, ts: str) -> bool:
    return ts == "timestamp" and dict(df.dtypes).get("date") == "date"


def as_of_col(df: DataFrame, as_of: AsOf = None, ts: str = "timestamp") -> Column:
    """The query time. Defaults to the newest row, as a scalar sub-query (never collected).

    Of a table partitioned by ``date`` only the newest day is read for it.
    """
    if as_of is None:
        if _by_day(df, ts):
            df = df.filter(F.col("date") == df.agg(F.max("date").alias("day")).scalar())
        return df.agg(F.max(ts).alias("as_of")).scalar()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp")


def recent(df: DataFrame, lookback: timedelta | int, as_of: AsOf = None, ts: str = "timestamp") -> DataFrame:
    """Rows younger than ``lookback``; the lower bound is exclusive.

    A ``date`` column, by which the lake tables are partitioned, is filtered as
    well, so that old partitions are not read.
    """
    since = as_of_col(df, as_of, ts) - span_col(lookback)
    rows = df.filter(F.col(ts) > since)
    return rows.filter(F.col("date") >= F.to_date(since)) if _by_day(df, ts) else rows


def bin_start(step: timedelta | int, ts: str | Column = "timestamp") -> Column:
    """Epoch-aligned bin start, usable as a grouping key or a projection."""
    return F.window(ts, f"{seconds(step)} seconds")["start"]


def binned(df: DataFrame, keys: list[str], step: timedelta | int, *aggs: Column, ts: str = "timestamp") -> DataFrame:
    """Aggregate per key and time bin. Works on batch and (watermarked) streaming input alike."""
    return (
        df.groupBy(*keys, F.window(ts, f"{seconds(step)} seconds").alias("_bin"))
        .agg(*aggs)
        .withColumn(ts, F.col("_bin.start"))
        .drop("_bin")
    )


def day_of_week_sun0(ts: str) -> Column:
    return (F.dayofweek(ts) - 1).cast("int")


def day_of_week_mon0(ts: str) -> Column:
    return F.weekday(ts).cast("int")


def minutes_between(earlier: str | Column, later: Column) -> Column:
    """Whole minute boundaries crossed between two instants."""
    minute = lambda c: F.floor(F.unix_seconds(c) / 60)
    return minute(later) - minute(F.col(earlier) if isinstance(earlier, str) else earlier)


def season(month: Column) -> Column:
    return (
        F.when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .when(month.isin(9, 10, 11), "Fall")
        .otherwise("Winter")
    )


def calendar_columns(day: str = "date") -> dict[str, Column]:
    d = F.col(day)
    iso_day = F.weekday(d) + 1
    return {
        "date_key": d,
        "date": d,
        "day_name": F.date_format(d, "EEEE"),
        "day_of_week": iso_day.cast("int"),
        "week_num": F.weekofyear(d).cast("int"),
        "month_name": F.date_format(d, "MMMM"),
        "month_num": F.month(d).cast("int"),
        "quarter": F.concat(F.lit("Q"), F.quarter(d).cast("string")),
        "year": F.year(d).cast("int"),
        "fiscal_year": F.year(d).cast("int"),
        "is_weekend": iso_day >= 6,
        "season": season(F.month(d)),
        "day_of_year": F.dayofyear(d).cast("int"),
    }


def dim_date(spark: SparkSession, start: date | str, end: date | str) -> DataFrame:
    """One row per day, both ends included, with 13 calendar columns."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))).alias("date")
    )
    return days.select(*[c.alias(n) for n, c in calendar_columns().items()])


def dim_date_spanning(df: DataFrame, day: str) -> DataFrame:
    """The calendar covering all dates of a fact table."""
    bounds = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).filter("lo IS NOT NULL")
    days = bounds.select(F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("date"))
    return days.select(*[c.alias(n) for n, c in calendar_columns().items()])
