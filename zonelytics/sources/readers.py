"""Batch sources: raw parquet datasets, JSON messages, incident history."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonelytics import schemas

# --- fixed values: raw dataset folders ----------------------------------------
RAW_DATASETS = ("iot_telemetry", "weather", "equipment", "daily_harvest", "energy", "shipments")


def read_raw(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """One raw dataset; ``greenhouse_id`` and ``date`` come from the folder names (they win over file columns)."""
    path = f"{root.rstrip('/')}/{dataset}"
    return spark.read.option("basePath", path).parquet(path)


def with_lineage(df: DataFrame) -> DataFrame:
    return df.withColumns({"_ingested_at": F.current_timestamp(), "_source_file": F.col("_metadata.file_path")})


def ingest(spark: SparkSession, root: str, database: str | None = None, datasets: Iterable[str] = RAW_DATASETS, prefix: str = "raw_"):
    """Load every readable dataset into a table; returns (row counts, skipped datasets with the reason)."""
    from zonelytics.sources.sinks import overwrite_table, table_rows

    counts: dict[str, int] = {}
    skipped: dict[str, str] = {}
    for name in datasets:
        try:
            df = read_raw(spark, root, name)
        except AnalysisException as e:
            skipped[name] = e.getCondition() or str(e)
            continue
        table = f"{database}.{prefix}{name}" if database else f"{prefix}{name}"
        overwrite_table(with_lineage(df), table)
        counts[table] = table_rows(spark, table)
    return counts, skipped


def json_mapping(schema: T.StructType) -> dict[str, tuple[str, str]]:
    """Column -> (JSON path, type) map of a table; one level, path = column name."""
    return {f.name: (f"$.{f.name}", f.dataType.simpleString()) for f in schema.fields}


#: stands behind the value while it is parsed; what follows an object would push it out of its place
_END = "~end of message~"


def parsed_json(df: DataFrame, value: str = "value", name: str = "_json") -> DataFrame:
    """Adds the value's VARIANT, parsed once per row; NULL for all but a single JSON object, white space around it allowed.

    Text behind the object, a second object and repeated fields make it malformed.
    """
    text = F.col(value)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    alone = (F.try_variant_get("_w", "$[1]", "string") == _END) & text.rlike(r"^\s*\{")
    # behind a generator, so that Spark does not parse again in the filters and columns that follow
    once = df.select("*", F.inline(F.array(F.struct(wrapped.alias("_w")))))
    return once.withColumn(name, F.when(alone, F.try_variant_get("_w", "$[0]", "variant"))).drop("_w")


def _typed(variant: str, path: str, kind: str):
    """A field by path, leniently: what cannot be read as ``kind`` is NULL."""
    raw = F.try_variant_get(variant, path, "string")
    return F.try_to_timestamp(raw) if kind == "timestamp" else raw.try_cast(kind)


def from_json_mapping(df: DataFrame, mapping: dict[str, tuple[str, str]], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Typed columns by path map, and the rejects: text that is no JSON object.

    The text is parsed once per row; a field of the wrong type
    becomes NULL, as the source's lenient mapping does.
    """
    parsed = parsed_json(df, value)
    rows = parsed.filter(F.col("_json").isNotNull()).select(*[_typed("_json", path, kind).alias(name) for name, (path, kind) in mapping.items()])
    return rows, parsed.filter(F.col("_json").isNull()).drop("_json")


def typed_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """Mixed JSON messages with one struct column per event type, filled for messages of that type, from one parse.

    ``kind`` is the event type, or ``rejected`` for text that is no JSON object or of another type; ``value`` is kept for those only.
    """
    parsed = parsed_json(df, value)
    sent = F.try_variant_get("_json", "$.event_type", "string")
    kind = F.when(sent.isin(*schemas.EVENT_TYPES), sent).otherwise(F.lit("rejected"))
    rows = parsed.withColumn("kind", F.coalesce(kind, F.lit("rejected")))
    made = [
        F.when(F.col("kind") == name, F.struct(*[_typed("_json", path, t).alias(c) for c, (path, t) in json_mapping(schema).items()])).alias(name)
        for name, schema in schemas.EVENT_TYPES.items()
    ]
    return rows.select("kind", F.when(F.col("kind") == "rejected", F.col(value)).alias("value"), *made)


def of_kind(messages: DataFrame, kind: str) -> DataFrame:
    """The table of one kind out of ``typed_messages``; partition and column pruning reach a stored form."""
    return messages.filter(F.col("kind") == kind).select("value" if kind == "rejected" else f"{kind}.*")


def route_messages(df: DataFrame, value: str = "value") -> dict[str, DataFrame]:
    """Split a mixed JSON stream by ``event_type`` into typed tables, plus ``rejected``. See ``typed_messages`` for all at once."""
    messages = typed_messages(df, value)
    return {kind: of_kind(messages, kind) for kind in (*schemas.EVENT_TYPES, "rejected")}


def read_history(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Incident history kept as JSON lines, which split, or as one JSON ``array`` per file, which is one task each."""
    return spark.read.schema(schemas.ANOMALY_HISTORY).option("multiLine", array).json(path)


def with_default(df: DataFrame, column: str, default) -> DataFrame:
    """Adds a column that is absent; an existing one is left as it is."""
    return df if column in df.columns else df.withColumn(column, default if hasattr(default, "alias") else F.lit(default))
