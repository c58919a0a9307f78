"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelytics.llm import decontaminate, packing, partenum, pseudonyms, toxicity
from zonelytics.llm.common import discard, row_key, table, without, written
from zonelytics.llm.queries import KEY, tokenizer_path


def lean(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows: executors and their Python workers hold a tenth of Spark's default at once. No result depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 by their nearest labelled examples; all labels of ``sf_dir`` teach."""
    lean(spark)
    labels = table(spark, sf_dir, "labels")
    learned = toxicity.labelled(docs, labels, F.lit(True))
    model = toxicity.fit(learned)
    discard(learned)
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle sets of similarity 0.8 or more."""
    lean(spark)
    return partenum.one_of_each(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no item of ``benchmark``; rows that share a doc_id but not the text are told apart."""
    lean(spark)
    keyed = docs.select(row_key().alias("doc_id"), "text")
    found = decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct()
    return without(docs, written(found, "contaminated"))


def hide_personal_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; ``n_chars`` follows the new text. Other columns, whatever their names, stay."""
    lean(spark)
    whole = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    new = pseudonyms.pseudonymise(whole, KEY)
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        old, kind = columns["n_chars"], docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("text") == "", old).otherwise(F.coalesce(F.length("text").cast(kind), old))
    return new.select(*(columns[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 2048, one row per piece of a document."""
    lean(spark)
    return packing.pack(docs, tokenizer_path(), remembered=80_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", hide_personal_values),
    ("packing", pack),
]

#: votes, signatures, seeds and tokens are beyond SQL; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
