"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonelytics.operators.joins import join_null_safe


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles per group (one column each) without holding a group in one task.

    Values are counted, the counts are summed in order-preserving buckets, and
    only the buckets holding the wanted ranks are looked at value by value; all
    quantiles share these passes. NULL keys are a group. The built-in exact
    percentile keeps all distinct values of a group in one aggregation buffer instead.
    """
    names = list(names) or [f"q{i}" for i in range(len(qs))]
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    bucket = F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * 65536)
    counted = (
        rows.select(*keys, F.col(value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", bucket)
    )
    hist = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_hc"))
    order = Window.partitionBy(*keys).orderBy("_b")
    whole = Window.partitionBy(*keys)
    hist = hist.withColumns(
        {"_before": F.sum("_hc").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_hc"), "_n": F.sum("_hc").over(whole)}
    )
    each = hist.withColumn("_x", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])))
    at = (F.col("_n") - 1) * F.col("_x.q")
    inside = lambda r: (F.col(r) >= F.col("_before")) & (F.col(r) < F.col("_before") + F.col("_hc"))
    wanted = each.withColumns({"_i": F.col("_x.i"), "_lo": F.floor(at), "_hi": F.ceil(at), "_w": at - F.floor(at)}).filter(inside("_lo") | inside("_hi"))
    ranks = F.collect_list(F.struct("_i", "_lo", "_hi", "_w"))  # at most one per quantile
    buckets = wanted.groupBy(*keys, "_b", "_before").agg(ranks.alias("_ranks"))
    near = join_null_safe(counted, buckets, [*keys, "_b"])
    upto = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_end", F.col("_before") + F.sum("_c").over(upto)).withColumn("_r", F.explode("_ranks"))
    holds = lambda r: (F.col(f"_r.{r}") < F.col("_end")) & (F.col(f"_r.{r}") >= F.col("_end") - F.col("_c"))

    def quantile(i: int):
        mine = F.col("_r._i") == i
        low, high = (F.max(F.when(mine & holds(r), F.col("_v"))) for r in ("_lo", "_hi"))
        return low + (high - low) * F.max(F.when(mine, F.col("_r._w")))

    out = near.groupBy(*keys).agg(*[quantile(i).alias(n) for i, n in enumerate(names)])
    return out if by else out.drop("_all")


def exact_quantile(df: DataFrame, value: str, q: float, by: Sequence[str] = (), name: str = "quantile") -> DataFrame:
    return exact_quantiles(df, value, [q], by, [name])
