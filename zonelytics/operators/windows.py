"""Window calculations over facts of day or coarser grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonelytics.operators.joins import join_null_safe
from zonelytics.session import cut


def rolling_mean(df: DataFrame, columns: Sequence[str], by: Sequence[str], order: str, rows: int = 7, suffix: str | None = None) -> DataFrame:
    """Mean of the last ``rows`` rows per key, starting with the first row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0)
    tail = suffix or f"_{rows}d_avg"
    return df.withColumns({f"{c}{tail}": F.avg(c).over(w) for c in columns})


def rolling_mean_days(df: DataFrame, columns: Sequence[str], by: Sequence[str], day: str, days: int = 7, suffix: str | None = None, chunk: int = 512) -> DataFrame:
    """Mean of ``columns`` over the last ``days`` days a key has rows on, this one included; one value a day, however many rows it has.

    Rows of a day carry the same values (their mean counts otherwise), so ties cannot change a result. A key's days
    are numbered chunk by chunk, and each chunk of numbers also gets the last ``days - 1`` of the one before, so no
    key is ever one window. NULL keys are a key; rows without a day keep NULL means.
    """
    tail = suffix or f"_{days}d_avg"
    each = df.filter(F.col(day).isNotNull()).groupBy(*by, day).agg(*[F.avg(c).alias(c) for c in columns])
    each = running_total(each.withColumn("_one", F.lit(1.0)), "_one", by, [day], F.floor(F.unix_date(F.to_date(day)) / chunk), "_n").drop("_one")
    home = F.floor(F.col("_n") / chunk)
    near = F.when(F.col("_n") % chunk > chunk - days, F.array(home, home + 1)).otherwise(F.array(home))
    spread = each.withColumns({"_home": home, "_chunk": F.explode(near)})
    w = Window.partitionBy(*by, "_chunk").orderBy("_n").rowsBetween(1 - days, 0)
    means = spread.withColumns({f"{c}{tail}": F.avg(c).over(w) for c in columns}).filter("_chunk = _home").select(*by, day, *[f"{c}{tail}" for c in columns])
    return join_null_safe(df, means, [*by, day], "left")


def moving_average_days(df: DataFrame, value: str, by: Sequence[str], day: str, days: int = 7, name: str = "moving_avg") -> DataFrame:
    """Mean over the last ``days`` calendar days, missing days left out."""
    w = Window.partitionBy(*by).orderBy(F.unix_date(day)).rangeBetween(1 - days, 0)
    return df.withColumn(name, F.avg(value).over(w))


def change(df: DataFrame, value: str, by: Sequence[str], order: str, name: str = "change") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({f"previous_{value}": F.lag(value).over(w), name: F.col(value) - F.lag(value).over(w)})


def share_of_total(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Value as a fraction of its group total.

    The total comes from an aggregate joined back, not from a window, so a
    group (or the whole frame) is never gathered in one task. The totals are
    written first: their size is then known when the join is planned, and few
    totals meet the rows where these lie, without a shuffle by group.
    """
    if by:
        totals = cut(df.groupBy(*by).agg(F.sum(value).alias("_total")), "totals")
        out = join_null_safe(df, totals, by)
        return out.withColumn(name, F.try_divide(F.col(value), F.col("_total"))).drop("_total")
    return df.withColumn(name, F.try_divide(F.col(value), df.agg(F.sum(value).alias("t")).scalar()))


def running_total(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], chunk: Column, name: str) -> DataFrame:
    """Sum of the earlier rows of a group, exact for groups of any size.

    ``chunk`` is a number that grows with ``order`` (say a range of order ids).
    Sums inside a chunk and the totals of the chunks before it are added, so a
    hot group is spread over its chunks.
    """
    rows = df.withColumn("_chunk", chunk)
    totals = rows.groupBy(*by, "_chunk").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0.0)))
    out = join_null_safe(out, offsets, [*by, "_chunk"])
    return out.withColumn(name, F.col("_offset") + F.col("_local")).drop("_chunk", "_local", "_offset")
