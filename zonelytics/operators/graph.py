"""Bounded pattern matching over node and edge DataFrames.

Nodes are (node_id, label, name, ...), edges (src, dst, label, ...). Start
filters apply to the first hop, so work follows the reached frontier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonelytics.operators.joins import join_null_safe
from zonelytics.session import work_dir


def assemble(parts: dict[str, DataFrame], kind: str) -> DataFrame:
    """Union of typed tables to one node or edge frame; columns a type lacks are NULL."""
    out = None
    for label, df in parts.items():
        one = df.withColumn("label", F.lit(label)) if kind == "node" else df
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends without a node (an empty result means the graph is well formed)."""
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()
    return ends.join(nodes.select("node_id"), "node_id", "left_anti")


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def one_hop(nodes: DataFrame, edges: DataFrame, start: Column | None = None, end: Column | None = None, edge: Column | None = None) -> DataFrame:
    """Every (a)-[e]->(b); columns carry the prefixes ``a_``, ``e_``, ``b_``. Filters use plain node or edge columns."""
    a = _prefixed(nodes.filter(start) if start is not None else nodes, "a")
    b = _prefixed(nodes.filter(end) if end is not None else nodes, "b")
    e = _prefixed(edges.filter(edge) if edge is not None else edges, "e")
    return e.join(a, F.col("e_src") == F.col("a_node_id")).join(b, F.col("e_dst") == F.col("b_node_id"))


def two_hop(nodes: DataFrame, edges: DataFrame, start: Column | None = None, first: Column | None = None, second: Column | None = None) -> DataFrame:
    """Every (a)-[e1]->(b)-[e2]->(c) with prefixes ``a_``, ``b_``, ``c_``."""
    ids = nodes.filter(start).select("node_id") if start is not None else None
    e1 = edges.filter(first) if first is not None else edges
    e2 = edges.filter(second) if second is not None else edges
    if ids is not None:
        e1 = e1.join(ids, e1.src == ids.node_id, "left_semi")
    chain = e1.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), F.col("label").alias("e1_label")).join(
        e2.select(F.col("src").alias("_b"), F.col("dst").alias("_c"), F.col("label").alias("e2_label")), "_b"
    )
    for mark, prefix in (("_a", "a"), ("_b", "b"), ("_c", "c")):
        side = _prefixed(nodes, prefix)
        chain = chain.join(side, F.col(mark) == F.col(f"{prefix}_node_id")).drop(mark)
    return chain


def paths(nodes: DataFrame, edges: DataFrame, start: Column, min_hops: int = 1, max_hops: int = 2, edge: Column | None = None) -> DataFrame:
    """One row per path of ``min_hops``..``max_hops`` edges; an edge occurs at most once in a path."""
    e = edges.filter(edge) if edge is not None else edges
    e = e.select("src", "dst", F.concat_ws("\u0001", "src", "dst", "label").alias("_id"))
    at = nodes.filter(start).select(F.col("node_id").alias("source_id"), F.col("node_id").alias("_at"), F.array().cast("array<string>").alias("_used"))
    found = None
    for hop in range(1, max_hops + 1):
        step = at.join(e, at["_at"] == e["src"]).filter(~F.array_contains("_used", F.col("_id")))
        at = step.select("source_id", F.col("dst").alias("_at"), F.concat("_used", F.array("_id")).alias("_used"))
        if hop >= min_hops:
            here = at.select("source_id", F.col("_at").alias("target_id"), F.lit(hop).alias("hops"), F.array_join("_used", " ").alias("_path"))
            found = here if found is None else found.unionByName(here)
    source = nodes.select(F.col("node_id").alias("source_id"), F.col("name").alias("source_name"))
    target = nodes.select(F.col("node_id").alias("target_id"), F.col("name").alias("target_name"), F.col("label").alias("target_label"))
    return found.join(source, "source_id").join(target, "target_id").drop("_path")


def reachable(edges: DataFrame, start: DataFrame, reverse: bool = False, max_hops: int | None = None) -> DataFrame:
    """Shortest hop count from each start node to every node it reaches (``start`` has one column ``node_id``).

    Breadth-first by joins on the new frontier only. Every hop is written to a
    folder of its own and what has been seen is read back from all of them, so
    the plan stays as small however long the chains are. It ends when a hop finds
    nothing new, or after ``max_hops`` where a bound is asked for.
    """
    spark = edges.sparkSession
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).alias("_at"), F.col(b).alias("_next")).distinct()
    base = work_dir(spark, "reach")
    frontier = start.select(F.col("node_id").alias("source_id"), F.col("node_id").alias("node_id")).distinct()
    kinds, hop = frontier.schema, 0
    while True:
        path = f"{base}/hops={hop}"
        frontier.write.parquet(path)
        frontier = spark.read.schema(kinds).parquet(path)
        seen = spark.read.schema(T.StructType([*kinds.fields, T.StructField("hops", T.IntegerType())])).parquet(base)
        if frontier.isEmpty() or hop == max_hops:
            return seen.filter("hops > 0")
        hop += 1
        frontier = (
            frontier.join(step, F.col("node_id") == F.col("_at"))
            .select("source_id", F.col("_next").alias("node_id"))
            .distinct()
            .join(seen.select("source_id", "node_id"), ["source_id", "node_id"], "left_anti")
        )


def derived_edges(parts: DataFrame, owner: str, label: str) -> DataFrame:
    """Edges from an owner column of the parts themselves (``owner`` names a prefix-free zone id column)."""
    return parts.select(F.concat(F.lit("zone:"), F.col(owner)).alias("src"), F.col("node_id").alias("dst"), F.lit(label).alias("label"))


def adjacency(items: DataFrame, site: str, order: str, chunk: Column, node_id: str = "node_id", label: str = "adjacent_to") -> DataFrame:
    """Neighbours in order within a site, in both directions; items without a site are neighbours, too.

    ``chunk``, a number growing with ``order``, splits a large site: the last
    item of a chunk is linked to the first one of the next.
    """
    rows = items.withColumn("_chunk", chunk)
    heads = rows.groupBy(site, "_chunk").agg(F.min_by(node_id, order).alias("_head"))
    carry = heads.select(site, "_chunk", F.lead("_head").over(Window.partitionBy(site).orderBy("_chunk")).alias("_carry"))
    inside = Window.partitionBy(site, "_chunk").orderBy(order)
    linked = rows.withColumn("_next", F.lead(node_id).over(inside))
    linked = join_null_safe(linked, carry, [site, "_chunk"])
    pairs = linked.select(F.col(node_id).alias("a"), F.coalesce("_next", "_carry").alias("b")).filter("b IS NOT NULL")
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.inline(both)).withColumn("label", F.lit(label))


def runbook_totals(actions: DataFrame) -> DataFrame:
    return actions.groupBy("anomaly_type").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if("automated").alias("automated_steps"),
        F.sum("sla_minutes").alias("total_minutes"), F.sum(F.when(~F.col("automated"), F.col("sla_minutes")).otherwise(0)).alias("manual_minutes"),
    )
