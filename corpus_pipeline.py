"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing and packing, each over all that the one before kept.

Each stage is written as Parquet in the shared folder of the session and read again by the
next. All but the last return the columns of documents. Nulls, empty and long texts, ties,
repeated rows and empty tables are handled as the operators' own docstrings say: language
ID rejects texts without a language (null, empty, no letter); exact dedup keeps one row of
each text; near-dedup keeps the smallest doc_id of each group; mixing repeats rows that it
takes more than once; packing gives a row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import exact_dedup, langid, minhash_dedup, mixing, packing
from faultline.llm.scratch import Scratch
from faultline.llm.text_sql import documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a language stay."""
    return langid.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: the smallest doc_id."""
    return minhash_dedup.deduplicate(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Language ID, MinHash and tokenisation are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(name, stage(spark, docs, sf_dir))
    return scratch.put(STAGES[-1][0], STAGES[-1][1](spark, docs, sf_dir))
