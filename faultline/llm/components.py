"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))
    return tuple(edges.agg(F.count("*"), F.coalesce(mark, F.lit(0))).first())


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hangs the neighbours of each node onto its least neighbour: the larger ones (both_ways) or the smaller ones."""
    if both_ways:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = around.join(least, "u")
    if both_ways:
        out = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, comp (least node of its component) for every node of links (a, b)."""
    edges = scratch.put(f"{name}-0", links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    was, turn = _state(edges), 0
    while was[0]:
        turn += 1
        edges = scratch.put(f"{name}-{turn}", _star(_star(edges, True), False))
        scratch.drop(f"{name}-{turn - 1}")
        now = _state(edges)
        if now == was:
            break
        was = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
