"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; a runner writes each result as Parquet
and hands the reread table on. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import exact_dedup, importance, packing, shingle_dedup, suffix_dedup
from siltstone.llm.common import documents, staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the importance sample go."""
    return importance.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that pairs of five-word shingle sets with a Jaccard similarity of 0.8 or more link:
    fingerprints give the first candidates, the sets the rest, so no pair is lost."""
    return shingle_dedup.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of long strings that a smaller document holds go from the texts."""
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact_duplicates), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages), ("packing", packed)]

#: Gumbel sampling from a fitted model, bit votes of hashes and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
