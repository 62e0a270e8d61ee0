"""The queries of the ten operators over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, exact_dedup, histogram, packing, pii, quality, repeats, simhash, vptree, warc
from corvane.llm.common import read


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(read(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(read(spark, sf_dir, "documents"))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_conversations(read(spark, sf_dir, "conversations"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(read(spark, sf_dir, "documents"))


def op7_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.token_histogram(read(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    return vptree.nearest_neighbours(read(spark, sf_dir, "embeddings"), every=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_warc_derivatives, op2_exact_dedup, op3_quality_classifier, op4_repeated_passages, op5_vector_packing,
            op6_pii_pseudonyms, op7_token_histogram, op8_bpe_round_trip, op9_simhash_near_dedup, op10_vantage_point_neighbours,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.DUPLICATES_SQL}
