"""Newest row per key, ordered lists and deterministic de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", tie: Sequence[str] = ()) -> DataFrame:
    """The whole newest row of every key.

    ``row_number() = 1`` is planned with a group limit below the exchange, so
    each task ships at most one row per key, however hot the key is.
    """
    order = [F.col(ts).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in tie]]
    return (
        df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter("_rn = 1")
        .drop("_rn")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key by an explicit order: duplicate removal with a repeatable survivor."""
    return (
        df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter("_rn = 1")
        .drop("_rn")
    )


def latest_incremental(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", tie: Sequence[str] = ()) -> DataFrame:
    """The same result as a plain aggregate, which streaming (complete or update mode) accepts."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in (ts, *tie)])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def ordered_list(value: str, ts: str = "timestamp") -> Column:
    """Aggregate: values in time order. For pre-binned series only (one entry per bin)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))))
    return F.transform(pairs, lambda p: p["v"])
