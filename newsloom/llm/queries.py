"""The numbered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import conversations, embeddings, fingerprints, licenses, line_dedup, lm, mixing, ngram_join, packing, secrets, token_counts, toxicity, vector_codes
from newsloom.llm.common import table, tokenizer


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def fingerprint_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of operator 2: documents that signature bands join, with the least doc_id of each component."""
    return fingerprints.near_duplicates(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.kneser_ney_scores(table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_repairs(table(spark, sf_dir, "conversations"))


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_document_fingerprints,
        op3_lm_scoring,
        op4_license_scans,
        op5_embedding_near_dedup,
        op6_token_counts,
        op7_ngram_jaccard_join,
        op8_best_fit_packing,
        op9_toxicity,
        op10_mixing,
        op11_vector_codes,
        op12_conversation_repair,
        op13_secret_scans,
        fingerprint_bands,
    )
} | {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {"op1_line_dedup": line_dedup.LINE_DIGEST_SQL, "op11_vector_codes": vector_codes.CODES_SQL, "op12_conversation_repair": conversations.REPAIRS_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
