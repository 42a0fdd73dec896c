"""Queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, golay_simhash, lang_id, licenses, lm_score, merkle, quality_bayes, repetition, secrets


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file: in the folder that TOKENIZER_DIR names, else where public_tokenizers has it. Looked up
    when a query needs it, so that the others work without that package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op2_word_first_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_table(spark, sf_dir, "documents"))


def op3_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(_table(spark, sf_dir, "documents"))


def op4_hierarchical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.by_source(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"]).select(*quality_bayes.OUTPUT)


def op5_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = merkle.warc_records(_table(spark, sf_dir, "pages"))
    return merkle.audit(records, merkle.damaged(records))


def op6_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "shared", "item_shingles", "containment")


def op8_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op9_bpe_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), vocabulary())


def op10_fuzzy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_context_tree_weighting,
        op2_word_first_backoff,
        op3_repetition_coverage,
        op4_hierarchical_bayes,
        op5_merkle_fixity,
        op6_golay_simhash,
        op7_minhash_containment,
        op8_credential_linking,
        op9_bpe_merge_rounds,
        op10_fuzzy_notices,
    )
}

ORACLES = {
    "op3_repetition_coverage": repetition.oracle(),
    "op5_merkle_fixity": merkle.oracle(),
    "op7_minhash_containment": decontam.oracle(),
    "op8_credential_linking": secrets.oracle(),
}
