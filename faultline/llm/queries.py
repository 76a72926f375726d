"""The queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import langid, lm_scoring, packing, substring_dedup, suffix_dedup, token_counts
from .exact_dedup import OP6_SQL, exact_groups
from .minhash_dedup import near_groups
from .mixing import mix
from .quality_rules import OP3_SQL, quality
from .text_sql import documents


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), width=3, percent=85)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, sf_dir)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(documents(spark, sf_dir)))


ALL = (
    op1_minhash_dedup,
    op2_packing,
    op3_quality_rules,
    op4_suffix_dedup,
    op5_mixing,
    op6_exact_dedup,
    op7_lm_scoring,
    op8_token_counts,
    op9_language_id,
    op10_substring_dedup,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op6_exact_dedup": OP6_SQL}
