"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelytics.llm import alignment, decontaminate, langmix, licenses, lineblocks, maxent, negatives, packing, partenum, pseudonyms, spans, spotsigs, toxicity
from zonelytics.llm.common import crc_mod, table


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(table(spark, sf_dir, "documents"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    found = langmix.identify(docs, langmix.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op4_nearest_example_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "neighbours", "similarities", "terms")


def op5_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.drop_repeats(table(spark, sf_dir, "documents"))


def op6_hashed_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False))
    scored = maxent.score(docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: stands for a secret that a deployment takes from its own key store
KEY = "pseudonym key"


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op8_line_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineblocks.main_text(table(spark, sf_dir, "pages"))


def op9_partenum_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_groups(table(spark, sf_dir, "documents"), n=3, percent=90)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_angular_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(e.select(F.col("vec_id").alias("id"), label.alias("label"), (F.col("vec_id") % 50 == 0).alias("anchor"), F.col("embedding").alias("vector")))


def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return licenses.scan(table(spark, sf_dir, "documents")).withColumns(joined).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permitted", F.size("found").alias("n_found")
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_spaced_seed_decontamination, op2_spotsigs_fingerprints, op3_language_mixture, op4_nearest_example_toxicity, op5_sentence_span_dedup,
        op6_hashed_maxent_scores, op7_feistel_pseudonyms, op8_line_block_extraction, op9_partenum_jaccard_join, op10_best_fit_packing,
        op11_angular_hard_negatives, op12_licence_scan, op13_tokenizer_alignment,
    )
}
#: SQL for those that SQL expresses
SQL: dict[str, str] = {
    "op11_angular_hard_negatives": """
  WITH rows AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (
    SELECT a.id AS anchor_id, r.id, r.label = a.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
    FROM rows a JOIN rows r ON a.id <> r.id WHERE a.id % 50 = 0),
  positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
  SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id,
    p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
  QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 3""",
}
