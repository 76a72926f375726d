"""Shared column expressions of the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII space characters that separate words.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words, without keeping them: runs of non-spaces."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A hash spread evenly over [0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


#: Stands for a null doc_id inside the operators: such rows are one document that comes first in every order.
NO_ID = -(1 << 63)


def masked(docs: DataFrame) -> DataFrame:
    """docs with doc_id as a long that is never null."""
    return docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))


def unmasked(rows: DataFrame, *ids: str) -> DataFrame:
    """rows with null again where an id column stands for none."""
    return rows.select(*(F.nullif(F.col(c), F.lit(NO_ID)).alias(c) if c in (ids or ("doc_id",)) else F.col(f"`{c}`") for c in rows.columns))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't use."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def text_hash(*more: Column) -> Column:
    """Tells rows that repeat a doc_id apart: a hash of the text (null and empty differ) and of more."""
    return F.xxhash64(F.col("text"), F.col("text").isNull(), *more)


def only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text_hash are among rows (doc_id masked, h); one of those that repeat both, unless ``many`` is true there."""
    key, own, many, turn = (free_name(docs, n) for n in ("_kept_id", "_kept_h", "_kept_many", "_kept_turn"))
    wanted = rows.groupBy(F.col("doc_id").alias(key), F.col("h").alias(own)).agg(F.max("many").alias(many))
    held = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(own, text_hash())
    held = held.join(wanted, [key, own]).withColumn(turn, F.row_number().over(Window.partitionBy(key, own).orderBy(key)))
    return held.filter(F.col(many) | (F.col(turn) == 1)).select([f"`{c}`" for c in docs.columns])
