"""The registered queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import chunked_bpe, exact_dedup, filter_audit, importance, license_scan, packing, quality_rules, simhash, spelling_variants, suffix_dedup, token_files, toxicity, weak_pii
from siltstone.llm.common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir)).drop("blocks")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)))
    base = rows["fail_bits"].bitwiseAND(quality_rules.mask_of("v1")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy costs, alone: from the ledger of all documents."""
    return quality_rules.ablations(quality_rules.ledger(documents(spark, sf_dir)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.encode_decode(documents(spark, sf_dir), digests=True)


def op11_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_pii.digests(weak_pii.personal_data(documents(spark, sf_dir)))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), _labels(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_license_scan, op3_quality_rules, op4_toxicity, op5_packing, op6_importance, op7_token_files, op8_suffix_dedup, op9_simhash, op10_chunked_bpe, op11_weak_pii, op12_spelling_variants, op13_filter_audit, quality_ablations)}
ORACLE_SQL = {"op1_exact_dedup": exact_dedup.ORACLE_SQL, "op2_license_scan": license_scan.oracle_sql(), "op13_filter_audit": filter_audit.ORACLE_SQL}
