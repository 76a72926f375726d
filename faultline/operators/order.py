"""Ranks and cuts over all rows without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def below(rows: DataFrame, value: str) -> DataFrame:
    """_v, _below, _n, _total: each distinct value with how many rows are smaller, how many have it, and how many there are.

    Values are counted first and dealt out by ranges; only one sum per range meets in one place.
    """
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    dealt = cut(counts.repartitionByRange("_v").withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range; ranges are as many as shuffle partitions.
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(parts), "_part")
    return out.select("_v", (F.col("_base") + F.col("_in")).alias("_below"), "_n", "_total")


def with_share_below(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows with the share of rows that have a smaller value: ties share, the least gets 0."""
    b = below(rows, value)
    return rows.join(b, rows[value].eqNullSafe(b["_v"]), "left").withColumn(out, F.col("_below") / F.col("_total")).drop("_v", "_below", "_n", "_total")


def with_place(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows with their place from 0 by falling value: ties share the first of their places."""
    b = below(rows, value)
    return rows.join(b, rows[value].eqNullSafe(b["_v"]), "left").withColumn(out, F.col("_total") - F.col("_below") - F.col("_n")).drop("_v", "_below", "_n", "_total")


def first_rows(rows: DataFrame, order: list[Column | str], k: int | None, rank: str = "rank") -> DataFrame:
    """The first k rows in an order, with their rank from 1: each task keeps k, so no task orders all (k None: all rows are the answer)."""
    top = rows if k is None else rows.orderBy(*order).limit(k)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
