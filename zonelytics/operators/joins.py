"""Join shapes Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonelytics.functions.timebins import seconds
from zonelytics.session import cut


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Equi-join that keeps the left copy of every other column both sides carry."""
    on = [on] if isinstance(on, str) else list(on)
    clash = [c for c in right.columns if c in left.columns and c not in on]
    return left.join(right.drop(*clash), on, how)


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the left copy of the keys is kept."""
    l, r = left.alias("_l"), right.withColumnsRenamed({k: f"_right_{k}" for k in on}).alias("_r")
    same = [F.col(f"_l.`{k}`").eqNullSafe(F.col(f"_r.`_right_{k}`")) for k in on]
    return l.join(r, same, how).drop(*[f"_right_{k}" for k in on])


def lookup_keys(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "left") -> DataFrame:
    """Equi-join on differently named keys; the right keys and clashing columns are dropped."""
    renamed = right
    for l, r in pairs.items():
        if l != r:
            if l in renamed.columns:
                renamed = renamed.drop(l)
            renamed = renamed.withColumnRenamed(r, l)
    return lookup(left, renamed, list(pairs), how)


#: levels of dyadic slots; slot numbers of a second's width fit in far fewer
_LEVELS = 48


def dyadic_cover(intervals: DataFrame, start: str = "start_time", end: str = "end_time", bucket: int = 900) -> DataFrame:
    """Each half-open interval as the fewest slots of width ``bucket`` times a power of two: rows with ``_level`` and ``_slot``.

    At every level at most a slot at either end is left over by the wider ones, so an interval of n
    buckets has no more than 2 log2(n) rows. Empty intervals have none.
    """
    size = seconds(bucket)
    first = F.floor(F.unix_seconds(start) / size)
    after = F.floor(F.unix_seconds(F.col(end) - F.expr("INTERVAL 1 MICROSECOND")) / size) + 1
    odd = lambda x: x.bitwiseAND(F.lit(1).cast("bigint"))
    shifted = lambda x, k: F.call_function("shiftright", x, k)

    def ends(k: Column) -> Column:
        low, high = -shifted(-F.col("_first"), k), shifted(F.col("_after"), k)
        one = F.when((low < high) & (odd(low) == 1), F.struct(k.alias("level"), low.alias("slot")))
        two = F.when((low + odd(low) < high) & (odd(high) == 1), F.struct(k.alias("level"), (high - 1).alias("slot")))
        return F.array(one, two)

    rows = intervals.filter(F.col(end) > F.col(start)).withColumns({"_first": first, "_after": after})
    slots = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), ends)))
    return rows.withColumn("_cover", F.explode(slots)).withColumns({"_level": F.col("_cover.level"), "_slot": F.col("_cover.slot")}).drop("_cover", "_first", "_after")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    ts: str = "timestamp",
    start: str = "start_time",
    end: str = "end_time",
    bucket: int = 900,
    how: str = "inner",
) -> DataFrame:
    """Points inside half-open intervals ``[start, end)`` of the same key; ``how``: inner or left.

    An interval is covered by dyadic slots, few whatever its length, and a point stands in one slot of
    every level that some interval uses, so the join is an equi-join on (key, level, slot): a hot
    key is split by time, no cross join arises, and every pair is met once.
    """
    size = seconds(bucket)
    cover = dyadic_cover(intervals, start, end, bucket)
    used = cover.agg(F.array_sort(F.collect_set("_level")).alias("levels")).scalar()  # at most _LEVELS + 1 numbers
    clash = [c for c in cover.columns if c in points.columns and c not in by]
    if how == "left":
        points = cut(points.withColumn("_id", F.monotonically_increasing_id()), "points")
    slot = F.floor(F.unix_seconds(ts) / size)
    spread = points.withColumn("_level", F.explode(used)).withColumn("_slot", F.call_function("shiftright", slot, F.col("_level")))
    p, s = spread.alias("p"), cover.drop(*clash).alias("s")
    on = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in (*by, "_level", "_slot")]
    on += [F.col(f"p.{ts}") >= F.col(f"s.{start}"), F.col(f"p.{ts}") < F.col(f"s.{end}")]
    keep = [c for c in s.columns if c not in (*by, "_level", "_slot")]
    met = p.join(s, on).select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"s.{c}") for c in keep])
    return points.join(met.select("_id", *keep), "_id", "left").drop("_id") if how == "left" else met


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    ts: str = "timestamp",
    direction: str = "backward",
    strict: bool = False,
    chunk: int = 21600,
    tie: Sequence[str] = (),
    prefix: str = "",
) -> DataFrame:
    """Each left row with the closest right row at or before it (or after it).

    The sort-based union runs per (key, time chunk), never per key, so one hot
    key spreads over many tasks. The row needed from outside a chunk travels
    in a summary of one row per (key, chunk). ``strict`` excludes equal times.
    """
    back = direction == "backward"
    payload = [c for c in right.columns if c not in by]
    slot = F.floor(F.unix_seconds(F.col(ts)) / seconds(chunk))
    # at equal times a matching right row must come first, an excluded one last
    rank = 1 if strict else 0
    lcols = [F.col(c) for c in left.columns]
    l = left.select(*by, F.col(ts).alias("_t"), F.lit(1 - rank).alias("_side"), F.struct(*lcols).alias("_l")).withColumn("_r", F.lit(None))
    r = right.select(*by, F.col(ts).alias("_t"), F.lit(rank).alias("_side"), F.lit(None).alias("_l"), F.struct(*payload).alias("_r"))
    both = l.unionByName(r).withColumn("_slot", F.floor(F.unix_seconds("_t") / seconds(chunk)))
    order_col = F.struct("_t", *[F.col(f"_r.{t}") for t in tie]) if tie else F.col("_t")
    pick = F.max_by if back else F.min_by
    known = both.groupBy(*by, "_slot").agg(pick(F.col("_r"), F.when(F.col("_r").isNotNull(), order_col)).alias("_edge"))
    slots = Window.partitionBy(*by).orderBy(F.col("_slot").asc() if back else F.col("_slot").desc())
    carry = known.select(
        *by,
        "_slot",
        F.last("_edge", ignorenulls=True).over(slots.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
    )
    sort = [F.col("_t"), F.col("_side"), *[F.col(f"_r.{t}") for t in tie]] if back else [
        F.col("_t").desc(), F.col("_side"), *[F.col(f"_r.{t}").desc() for t in tie]]
    w = Window.partitionBy(*by, "_slot").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_in", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_l").isNotNull())
    # AQE may turn this into a broadcast of the summary; otherwise it is co-keyed
    joined = filled.join(carry, [*by, "_slot"], "left")
    match = F.coalesce("_in", "_carry")
    return joined.select(
        *[F.col(f"_l.{c}").alias(c) for c in left.columns],
        *[match[c].alias(f"{prefix}{c}" if prefix or c not in left.columns else f"right_{c}") for c in payload],
    )
